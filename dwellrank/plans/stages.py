"""The work from raw data to reports, one function per stage.

Every stage reads and writes relations in a shared folder, so a lost executor
costs the running stage's tasks only and each stage can be run again alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from dwellrank import config, schemas
from dwellrank.functions import conditions as names
from dwellrank.functions.models import PASSAGE_TOKENS, QUERY_TOKENS, query_encoding, standin_log_probs
from dwellrank.functions.scores import FULL_CONTEXT
from dwellrank.functions.text import word_count
from dwellrank.operators import align as A, answer as N, coverage as C, embed as E, evaluate as V, gaze_table as G
from dwellrank.operators import retrieve as R, rewards as W
from dwellrank.operators.ordering import position_in_group
from dwellrank.sources import artifacts as IN, gaze as GS, questions as Q, writers as OUT
from dwellrank.sources.gaze import _exists
from dwellrank.sources.nested import write_aligned


def inspect_inputs(spark: SparkSession, gaze_path: str, qa_path: str, out: str) -> dict:
    """Schema reports of the two raw inputs."""
    gaze, qa = GS.read_interest_areas(spark, gaze_path), Q.read_local_questions(spark, qa_path)
    ia = GS.inspect_interest_areas(gaze).first().asDict()
    questions = Q.inspect_questions(qa, "source_position").first().asDict(recursive=True)
    OUT.write_summary(spark, f"{out}/schema/ia_columns", {"path": gaze_path, **ia})
    OUT.write_report_csv(GS.sample_interest_areas(gaze), f"{out}/schema/ia_sample")
    OUT.write_summary(spark, f"{out}/schema/qa_columns", {"path": qa_path, **questions})
    return {"ia_columns": ia["column_count"], "ia_rows": ia["row_count"], "qa_examples": questions["example_count"]}


def align_inputs(
    spark: SparkSession, gaze_path: str, out: str, qa_path: str | None = None, dataset: str | None = None,
    split: str | None = None, connector: Callable | None = None, max_examples: int | None = None,
    max_readers: int | None = None, shuffle_choices: bool = True, choice_seed: int = 13,
    include_practice: bool = False, exclude_repeated: bool = False, nested: bool = True,
) -> dict:
    """Questions matched with reading records."""
    if dataset is not None:
        questions = Q.read_questions(spark, dataset, split, shuffle_choices, choice_seed, connector)
    else:
        questions = Q.read_local_questions(spark, qa_path, shuffle_choices, choice_seed)
    if "example_ordinal" not in questions.columns:
        questions = Q.with_ordinals(questions)
    questions = OUT.write_parquet(A.limit_examples(questions, max_examples), f"{out}/data/questions")
    raw = GS.read_interest_areas(spark, gaze_path, list(G.SCAN_COLUMNS))
    kept = G.drop_repeated(G.drop_practice(raw, include_practice), exclude_repeated)
    gaze = G.normalize_gaze(kept, "src_ordinal")
    aligned = OUT.write_parquet(A.trim_readers(A.align(questions, gaze), max_readers), f"{out}/data/aligned")
    # the report looks at the matched, trimmed records, as the coverage numbers of the original do
    report = A.alignment_report(questions, aligned, aligned).first().asDict()
    OUT.write_jsonl(A.unmatched_questions(questions, aligned), f"{out}/data/unmatched_questions")
    if nested:
        write_aligned(questions, aligned, f"{out}/data/aligned_examples")
    OUT.write_summary(spark, f"{out}/data/alignment_report", {
        **report, "ia_path": gaze_path, "qa_path": dataset or qa_path, "max_examples": max_examples,
        "max_readers_per_example": max_readers, "shuffle_choices": shuffle_choices, "choice_seed": choice_seed,
        "include_practice": include_practice, "exclude_repeated": exclude_repeated,
    })
    return report


def embed_texts(
    spark: SparkSession, out: str, conditions: tuple[str, ...] = names.DEFAULT_EMBEDDED, dim: int = 128,
    strategy: str = "sentence", max_words: int = 80, stride: int = 0, seed: int = 13, max_examples: int | None = None,
    shuffle: str = "generator", only_matched: bool = True, encoder: Callable | None = None, predictor: Callable | None = None,
    max_tokens: tuple[int, int] = (PASSAGE_TOKENS, QUERY_TOKENS),
) -> dict:
    """Chunk and question vectors (E2); with conditions=("text",), only_matched=False the text-only run.

    ``encoder`` and ``predictor`` are loaders of a passage/query encoder (M1, M2)
    and of a reading-time model (M9); without them hashes and word lengths stand in.
    """
    questions = IN.load_examples(spark.read.parquet(f"{out}/data/questions"))
    aligned = spark.read.parquet(f"{out}/data/aligned") if set(conditions) & set(E.READER_CONDITIONS) or only_matched else None
    if only_matched:
        questions = questions.join(aligned.select("example_id"), "example_id", "left_semi")
        questions = _renumber(questions)
    questions = A.limit_examples(questions, max_examples)
    encoded = OUT.write_parquet(
        E.encode_texts(questions, strategy, max_words, stride, encoder, max_tokens[0]), f"{out}/embeddings/encoded")
    rows = E.embed(
        encoded, aligned, conditions, dim, seed, shuffle,
        cut=lambda df: OUT.write_parquet(df, f"{out}/embeddings/reader_weights"), predictor=predictor,
    )
    OUT.write_embeddings(rows, f"{out}/embeddings/chunks")
    asked = None if encoder is None else lambda q: query_encoding(encoder, q, max_tokens[1])
    OUT.write_parquet(E.query_vectors(encoded, dim, asked), f"{out}/embeddings/queries")
    counts = {
        r["condition"]: r["records"]
        for r in V.results_per_condition(spark.read.parquet(f"{out}/embeddings/chunks")).collect()
    }
    summary = {
        "encoder_backend": "hash" if encoder is None else "model", "conditions": list(conditions), "aligned_examples": encoded.count(),
        **{f"{c}_embeddings": counts.get(c, 0) for c in names.BASE_CONDITIONS},
        "query_embeddings": spark.read.parquet(f"{out}/embeddings/queries").count(),
    }
    OUT.write_summary(spark, f"{out}/embeddings/summary", summary)
    return summary


def _renumber(questions: DataFrame) -> DataFrame:
    """0-based order of the kept questions."""
    old = questions.withColumnRenamed("example_ordinal", "_old")
    return position_in_group(old, [], F.shiftright("_old", 12), ["_old"], "example_ordinal").drop("_old")


def retrieve_evidence(
    spark: SparkSession, out: str, conditions: list[str] | None = None, top_k: int = 3, alphas: tuple[float, ...] = (),
    candidates: tuple[int, ...] = (),
) -> dict:
    """Ranked evidence (E4); by default every condition that was embedded."""
    path = f"{out}/embeddings/chunks"
    if conditions is None:
        present = {r[0] for r in spark.read.parquet(path).select("condition").distinct().collect()}
        conditions = [c for c in names.BASE_CONDITIONS if c in present]
    wanted = names.requested(conditions, alphas, candidates, top_k)
    queries = IN.read_queries(spark, f"{out}/embeddings/queries")
    scored = R.score_chunks(IN.read_embeddings(spark, path, wanted), queries)
    composite = any(names.is_composite(c) for c in wanted)
    if composite:  # several rankings use the scores
        scored = OUT.write_parquet(scored, f"{out}/retrieval/scored")
    if any(names.is_hybrid(c) or names.is_rerank(c) for c in wanted):
        R.check_views(scored.where(F.col("condition") == "text"), scored.where(F.col("condition") == "actual_gaze"))
    evidence = OUT.write_parquet(R.retrieve(scored, wanted, top_k), f"{out}/retrieval/evidence")
    results = R.nest_results(evidence)
    OUT.write_jsonl(R.result_lines(results), f"{out}/retrieval/results")
    counts = {r["condition"]: r["records"] for r in V.results_per_condition(results).collect()}
    summary = {
        "top_k": top_k, "conditions": wanted, "hybrid_alphas": list(alphas), "rerank_candidate_top_n": list(candidates),
        "query_examples": queries.count(), "retrieval_records": sum(counts.values()), "records_by_condition": counts,
    }
    OUT.write_summary(spark, f"{out}/retrieval/summary", summary)
    return summary


def answer_questions(
    spark: SparkSession, out: str, conditions: list[str] | None = None, mode: str = "generate", include_bare: bool = False,
    resume: bool = True, overwrite: bool = False, shuffle_choices: bool = True, choice_seed: int = 13,
    max_records: int | None = None, **models,
) -> dict:
    """Predictions for retrieval results, continuing where an earlier run stopped."""
    path = f"{out}/predictions/predictions"
    retrievals = IN.read_retrievals(spark, f"{out}/retrieval/results", conditions)
    if max_records is not None:
        retrievals = retrievals.orderBy("condition", "example_id", "reader_id").limit(max_records)
    if not include_bare and not retrievals.take(1):
        raise ValueError("no retrieval results found")
    questions = IN.questions_by_id(spark.read.parquet(f"{out}/data/questions"))
    wanted = N.requests(retrievals, questions, include_bare)
    keep = resume and not overwrite and _exists(spark, path)
    done = IN.read_predictions(spark, path) if keep else None
    if done is not None:
        N.check_resume(done, shuffle_choices, choice_seed)
    total = wanted.count()
    todo = N.pending(wanted, done)
    seen = Observation("answers")
    OUT.write_jsonl(
        N.answer(todo, mode, **models).observe(seen, F.count("*").alias("rows")), path, "append" if keep else "overwrite"
    )
    written = seen.get["rows"]
    summary = {
        "scoring_mode": mode, "shuffle_choices": shuffle_choices, "choice_seed": choice_seed if shuffle_choices else None,
        "requested_records": total, "skipped_existing": total - written, "newly_written": written,
        "prediction_records": total, "complete": True,
    }
    OUT.write_summary(spark, f"{out}/predictions/summary", summary)
    return summary


def evaluate_answers(spark: SparkSession, out: str, baseline: str | None = None) -> dict:
    """Accuracy, paired differences and retrieval overlap."""
    path, results_path = f"{out}/predictions/predictions", f"{out}/retrieval/evidence"
    count = 0
    if _exists(spark, path):
        predictions = IN.read_predictions(spark, path)
        count = predictions.count()
    if count:
        base = baseline or V.default_baseline(predictions)
        order = [F.col("condition"), F.col("reader_id").asc_nulls_first()]
        OUT.write_report_csv(V.accuracy_by_group(predictions), f"{out}/results/by_condition", order)
        OUT.write_report_csv(V.paired_deltas(predictions, base), f"{out}/results/paired_deltas", [F.col("treatment")])
    else:
        OUT.write_report_csv(OUT.empty_report(spark, schemas.BY_CONDITION_COLUMNS), f"{out}/results/by_condition")
        OUT.write_report_csv(OUT.empty_report(spark, schemas.PAIRED_COLUMNS), f"{out}/results/paired_deltas")
    overlap, counts = [], {}
    if _exists(spark, results_path):
        results = V.chunk_sets(spark.read.parquet(results_path))
        rows = V.retrieval_overlap(results)
        OUT.write_table_csv(rows, f"{out}/results/retrieval_overlap")
        overlap = [r.asDict() for r in V.overlap_by_condition(rows).orderBy("condition").collect()]
        counts = {r["condition"]: r["records"] for r in V.results_per_condition(results).orderBy("condition").collect()}
    summary = {
        "prediction_records": count, "retrieval_records": sum(counts.values()),
        "retrieval_records_by_condition": counts, "overlap_by_condition": overlap,
    }
    OUT.write_summary(spark, f"{out}/results/summary", summary)
    return summary


def cover_spans(spark: SparkSession, out: str, qa_path: str, conditions: list[str], cutoffs: list[int]) -> list[dict]:
    """Coverage of gold spans by the retrieved chunks."""
    names.requested(conditions, top_k=1)
    gold = C.gold_spans(Q.gold_span_rows(Q.read_articles(spark, qa_path)))
    evidence = spark.read.parquet(f"{out}/retrieval/evidence").where(F.col("condition").isin(conditions))
    if not evidence.take(1):
        raise ValueError("no matching retrieval results found")
    records = IN.read_embedding_records(spark, f"{out}/embeddings/chunks", conditions)
    detail = OUT.write_parquet(C.span_coverage(C.resolve_intervals(evidence, records), gold, cutoffs), f"{out}/results/coverage")
    OUT.write_table_csv(detail, f"{out}/results/coverage_detail", sort_columns=True)
    summary = C.coverage_summary(detail)
    OUT.write_report_csv(summary, f"{out}/results/coverage_summary", [F.col("condition"), F.col("top_k")], sort_columns=True)
    return [r.asDict() for r in summary.orderBy("condition", "top_k").collect()]


def score_rewards(
    spark: SparkSession, rows: DataFrame, out: str, conditions: tuple[str, ...] = (FULL_CONTEXT,), budgets: tuple[int, ...] = (512,),
    subsets: list[str] | None = None, max_examples: int | None = None, normalization: str = "mean", max_length: int = 8192,
    resume: bool = True, overwrite: bool = False, store_text: bool = False, scorer: Callable | None = None, **compression,
) -> dict:
    """Reward pairs under full and compressed contexts.

    ``skipped_existing`` counts everything that was not newly written.
    """
    pairs = W.condition_budget_pairs(list(conditions), list(budgets))
    path = f"{out}/predictions/pairs"
    selected = W.select_rows(rows, subsets, max_examples)
    if not selected.take(1):
        raise ValueError("no rows match the requested filters")
    contexts = W.build_contexts(selected, pairs, **compression)
    longest = F.greatest(word_count(F.col("chosen")), word_count(F.col("reject")))
    score = scorer or (lambda p, c: standin_log_probs(p, c, max_length, longest))
    requested = selected.count() * len(pairs)
    keep = resume and not overwrite and _exists(spark, path)
    if keep:
        ident = W.prediction_id(W.row_id(F.col("id"), F.col("row_index")), F.col("condition"), F.col("context_budget_tokens"))
        done = spark.read.parquet(path).select(F.col("id").alias("_key"))
        contexts = contexts.withColumn("_key", ident).join(done, "_key", "left_anti").drop("_key")
    seen = Observation("pairs")
    scored = W.score_pairs(contexts, score, normalization, store_text).observe(seen, F.count("*").alias("rows"))
    scored.write.mode("append" if keep else "overwrite").parquet(path)
    table = OUT.write_parquet(W.summarize(spark.read.parquet(path)), f"{out}/results/summary_rows")
    written = seen.get["rows"]
    by_subset, by_condition = (table.where(F.col("scope") == s).drop("scope") for s in ("subset", "condition"))
    OUT.write_report_csv(by_subset, f"{out}/results/by_subset", W.report_order(), sort_columns=True)
    OUT.write_report_csv(by_condition.drop("subset"), f"{out}/results/by_condition", sort_columns=True)
    overall = table.where(F.col("scope") == "overall").first().asDict()
    summary = {
        "prediction_records": overall["count"], **{k: overall[k] for k in ("accuracy", "tie_rate", "mean_score_delta", "median_score_delta")},
        "conditions": list(conditions), "context_budgets": list(budgets), "score_normalization": normalization,
        "requested_records": requested, "skipped_existing": requested - written, "newly_written": written,
    }
    OUT.write_summary(spark, f"{out}/results/summary", summary)
    return summary


def run_all(
    spark: SparkSession, gaze_path: str, qa_path: str, out: str, max_examples: int | None = None, max_readers: int | None = None,
    top_k: int = 3, dim: int = 128, conditions: tuple[str, ...] = names.DEFAULT_EMBEDDED, alphas: tuple[float, ...] = (),
    candidates: tuple[int, ...] = (), mode: str = "loglik", include_bare: bool = True, coverage: bool = False,
    skip: tuple[str, ...] = (),
) -> dict:
    """All stages in one session (E10, E11); ``skip`` names stages to leave out."""
    report = {}
    if "inspect" not in skip:
        report["inspect"] = inspect_inputs(spark, gaze_path, qa_path, out)
    if "align" not in skip:
        report["align"] = align_inputs(spark, gaze_path, out, qa_path, max_examples=max_examples, max_readers=max_readers)
    if "embed" not in skip:
        report["embed"] = embed_texts(spark, out, conditions, dim)
    if "retrieve" not in skip:
        report["retrieve"] = retrieve_evidence(spark, out, None, top_k, alphas, candidates)
    if "answer" not in skip:
        report["answer"] = answer_questions(spark, out, mode=mode, include_bare=include_bare)
    if "evaluate" not in skip:
        report["evaluate"] = evaluate_answers(spark, out)
    if coverage:
        report["coverage"] = cover_spans(spark, out, qa_path, ["text", "actual_gaze"], [1, top_k])
    return report


def run_configured(spark: SparkSession, path: str, **more) -> dict:
    """All stages with the settings of a YAML file (S20); ``more`` overrides or adds arguments."""
    return run_all(spark, **(config.run_arguments(config.read_settings(path)) | more))
