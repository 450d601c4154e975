import math

import pytest
from pyspark.sql import functions as F

from dwellrank.operators import coverage as C, evaluate as E, rewards as W

PREDICTIONS = "example_id string, reader_id string, condition string, predicted_index int, gold_index int, src_ordinal bigint"


def predictions(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], PREDICTIONS)


def test_accuracy(spark):
    p = predictions(spark, [("a", None, "text", 0, 0), ("b", None, "text", 1, 0), ("c", None, "text", None, 0)])
    assert E.accuracy(p).first()[0] == 0.5
    assert math.isnan(E.accuracy(p.where("predicted_index is null")).first()[0])


def test_paired(spark):
    p = predictions(spark, [("a", None, "t", 0, 0), ("b", None, "t", 0, 0), ("a", None, "text", 1, 0), ("b", None, "text", 0, 0)])
    row = E.compare_conditions(p, "text", "t").first()
    assert (row["n"], row["mean_delta"]) == (2, 0.5) and row["standard_error"] == pytest.approx(0.5)
    assert row["ci95_high"] == pytest.approx(0.5 + 1.96 * 0.5)


def test_paired_reader_fallback(spark):
    p = predictions(spark, [("a", "r1", "t", 0, 0), ("a", "r2", "t", 1, 0), ("a", None, "text", 1, 0), ("z", "r", "t", 0, 0)])
    row = E.compare_conditions(p, "text", "t").first()
    assert (row["n"], row["mean_delta"]) == (2, 0.5)
    exact = predictions(spark, [("a", "r1", "t", 0, 0), ("a", "r1", "text", 0, 0), ("a", None, "text", 1, 0)])
    row = E.compare_conditions(exact, "text", "t").first()
    assert (row["n"], row["mean_delta"], row["standard_error"]) == (1, 0.0, 0.0)


def test_paired_without_pairs_and_last_wins(spark):
    p = predictions(spark, [("a", "r1", "t", 0, 0)])
    row = E.compare_conditions(p, "text", "t").first()
    assert row["n"] == 0 and math.isnan(row["mean_delta"]) and math.isnan(row["ci95_low"])
    assert E.paired_deltas(p, "text").first()["n"] == 0
    again = predictions(spark, [("a", None, "t", 1, 0), ("a", None, "t", 0, 0), ("a", None, "text", 1, 0)])
    assert E.compare_conditions(again, "text", "t").first()["mean_delta"] == 1


def test_grouped(spark):
    p = predictions(spark, [("a", None, "text", 0, 0), ("b", None, "text", None, 0), ("a", "r1", "actual_gaze", 0, 0), ("c", None, "text", 1, None)])
    rows = {(r["condition"], r["reader_id"]): r for r in E.accuracy_by_group(p).collect()}
    text = rows[("text", None)]
    assert (text["accuracy"], text["count"], text["scored_count"], text["missing_parse_rate"]) == (1.0, 2, 1, 0.5)
    assert rows[("actual_gaze", "r1")]["accuracy"] == 1
    assert E.default_baseline(p) == "text" and E.default_baseline(p.where("condition <> 'text'")) == "bare_model"
    assert E.accuracy_by_group(p.limit(0)).collect() == []


def test_gain(spark):
    p = predictions(spark, [("a", None, "text", 0, 1), ("a", "r1", "actual_gaze", 1, 1), ("b", "r1", "actual_gaze", 1, 1), ("b", "r1", "text", 1, 1),
                            ("c", "r1", "actual_gaze", None, 1), ("c", None, "text", 1, 1), ("a", "r1", "other", 1, 1)])
    results = spark.createDataFrame([("text", "a", None, ["c1"]), ("actual_gaze", "a", "r1", ["c2"])], "condition string, example_id string, reader_id string, chunks array<string>")
    stats = spark.createDataFrame([("a", "r1", 0.8)], "example_id string, reader_id string, concentration double")
    rows = {r["example_id"]: r for r in E.gain_rows(p, results, stats).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"]["delta_vs_text"], rows["a"]["retrieval_jaccard_vs_text"], rows["a"]["concentration"]) == (1, 0.0, 0.8)
    assert (rows["b"]["delta_vs_text"], rows["b"]["retrieval_jaccard_vs_text"], rows["b"]["concentration"]) == (0, None, None)


def test_gain_fallback_is_reversed(spark):
    p = predictions(spark, [("a", None, "text", 0, 1), ("a", "r1", "text", 1, 1), ("a", "r1", "mean_gaze", 1, 1)])
    none = spark.createDataFrame([], "condition string, example_id string, reader_id string, chunks array<string>")
    assert E.gain_rows(p, none).first()["delta_vs_text"] == 1
    assert E.paired_rows(p, "text").first()["delta"] == 0


def test_gain_statistics_replace_columns(spark):
    p = predictions(spark, [("a", None, "text", 0, 1), ("a", "r1", "mean_gaze", 1, 1)])
    none = spark.createDataFrame([], "condition string, example_id string, reader_id string, chunks array<string>")
    stats = spark.createDataFrame([("a", "r1", 9)], "example_id string, reader_id string, delta_vs_text int")
    assert E.gain_rows(p, none, stats).first()["delta_vs_text"] == 9


def test_overlap_without_text(spark):
    results = spark.createDataFrame([("text", "a", None, ["c1", "c2"], "c1"), ("x", "a", "r", ["c2", "c3"], "c2"), ("x", "b", "r", ["c2"], "c2")],
                                    "condition string, example_id string, reader_id string, chunks array<string>, top_chunk string")
    rows = {r["example_id"]: r["jaccard_vs_text"] for r in E.retrieval_overlap(results).collect()}
    assert rows == {"a": pytest.approx(1 / 3), "b": None}
    summary = E.overlap_by_condition(E.retrieval_overlap(results)).first()
    assert (summary["count"], summary["mean"]) == (1, pytest.approx(1 / 3))


def test_coverage_flags(one):
    spans = lambda *p: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in p])
    flags = lambda i, s: {k: one(v) for k, v in C.coverage_flags(i, s).items()}
    assert flags(spans((0, 10)), spans((2, 5), (8, 12))) == {"any_overlap": 1, "any_full": 1, "all_full": 0}
    assert flags(spans((0, 10)), spans((10, 12))) == {"any_overlap": 0, "any_full": 0, "all_full": 0}
    empty = F.array().cast("array<struct<start:int,end:int>>")
    assert flags(spans((0, 10)), empty) == {"any_overlap": 0, "any_full": 0, "all_full": 1}


def test_missing_interval_and_spans(spark):
    evidence = spark.createDataFrame([("e", "r", "hybrid_gaze_alpha_0p5", 1, "c1", None, None)], "example_id string, reader_id string, condition string, rank int, chunk_id string, char_start int, char_end int")
    records = spark.createDataFrame([("text", "e", None, "c1", 3, 9)], "condition string, example_id string, reader_id string, chunk_id string, char_start int, char_end int")
    found = C.resolve_intervals(evidence, records)
    assert found.first()["interval"].asDict() == {"start": 3, "end": 9}
    with pytest.raises(Exception, match="no chunk record"):
        C.resolve_intervals(evidence.withColumn("condition", F.lit("mean_gaze")), records).collect()
    gold = spark.createDataFrame([], "example_id string, level string, a_spans array<struct<start:int,end:int>>, d_spans array<struct<start:int,end:int>>")
    with pytest.raises(Exception, match="no gold spans"):
        C.span_coverage(found, gold, [1]).collect()


REWARDS = "subset string, correct boolean, tie boolean, score_delta double"


def test_reward_summary(spark):
    rows = spark.createDataFrame([("a", True, False, 1.0), ("a", False, False, -1.0), ("b", True, True, 0.0)], REWARDS)
    found = {(r["scope"], r["subset"]): r for r in W.summarize(rows).collect()}
    overall = found[("overall", None)]
    assert overall["count"] == 3 and overall["accuracy"] == pytest.approx(2 / 3) and overall["median_score_delta"] == 0
    assert found[("subset", "a")]["accuracy"] == 0.5 and found[("subset", "b")]["accuracy"] == 1
    assert found[("subset", "a")]["mean_compression_ratio"] == 1 and found[("condition", None)]["mean_compressed_context_tokens"] == 0


def test_exact_median(spark):
    import random
    import statistics

    rng = random.Random(1)
    rows = [("a", rng.choice([rng.gauss(0, 1), 0.5, -0.25])) for _ in range(20001)] + [("b", float(i)) for i in range(10)] + [(None, 7.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r["k"]: r["median"] for r in W.exact_median(df, ["k"], "v").collect()}
    assert got == {k: statistics.median(v for g, v in rows if g == k) for k in ("a", "b", None)}


def greedy(spark, chunks, scores, budget):
    items = [(i * 10, i * 10 + 5, t) for i, t in enumerate(chunks)]
    df = spark.createDataFrame([(items, scores, [len(t.split()) for t in chunks])], "c array<struct<start:int,end:int,text:string>>, s array<double>, k array<int>")
    return [x["text"] for x in df.select(W.greedy_select(F.col("c"), F.col("s"), F.col("k"), F.lit(budget)).alias("r")).first()["r"]]


def test_budget(spark):
    texts = ["Alpha first.", "Beta second.", "Gamma third."]
    assert greedy(spark, texts, [0.1, 0.9, 0.8], 4) == ["Beta second.", "Gamma third."]
    assert greedy(spark, ["one two three four", "b"], [0.9, 0.1], 2) == ["one two three four"]
    assert greedy(spark, ["a b", "c d e", "f"], [0.9, 0.8, 0.1], 3) == ["a b", "f"]
    assert greedy(spark, ["a", "b"], [0.5, 0.5], 1) == ["a"]


def test_contexts(spark):
    rows = spark.createDataFrame([("", 0, " Alpha first. Beta second. Gamma third. ", "beta", "yes", "no", "s", None, "m")],
                                 "id string, row_index bigint, prompt string, question string, chosen string, reject string, subset string, chosen_model string, reject_model string")
    pairs = W.condition_budget_pairs(list(W.SUPPORTED), [4])
    assert pairs[0] == ("full_context", None) and len(pairs) == 4
    out = {r["condition"]: r for r in W.build_contexts(rows, pairs).collect()}
    full = out["full_context"]
    assert full["compressed_context"] == "Alpha first. Beta second. Gamma third." and full["selected_chunks"] == [] and full["compression_ratio"] == 1
    for name in W.SUPPORTED[1:]:
        r = out[name]
        assert r["original_context_tokens"] == 6 and r["compressed_context_tokens"] <= 4 and r["selected_chunk_count"] == 2
        assert r["compressed_context"] == "\n\n".join(c["text"] for c in r["selected_chunks"])
        assert [c["index"] for c in r["selected_chunks"]] == sorted(c["index"] for c in r["selected_chunks"])
    scored = W.score_pairs(W.build_contexts(rows, pairs), lambda p, c: F.when(c == "yes", F.array(F.lit(-1.0))).otherwise(F.array(F.lit(-2.0), F.lit(-4.0))))
    row = scored.where("condition = 'full_context'").first()
    assert (row["id"], row["chosen_score"], row["reject_score"], row["correct"], row["tie"]) == ("0::full_context::budget=full", -1.0, -3.0, True, False)
    with pytest.raises(ValueError):
        W.condition_budget_pairs(["x"], [1])
    with pytest.raises(ValueError):
        W.condition_budget_pairs(["full_context"], [0])
    with pytest.raises(Exception, match="empty context"):
        W.build_contexts(rows.withColumn("prompt", F.lit(" ")), [("query_only_compression", 4)]).collect()
    assert W.needs_query_encoder(["query_only_compression"]) and not W.needs_trt_predictor(["query_only_compression"])
    assert not W.needs_query_encoder(["predicted_et_only_compression", "full_context"])


def test_report_order(spark):
    df = spark.createDataFrame([("c", 1024, "a"), ("c", 512, "a"), ("c", None, "a")], "condition string, context_budget_tokens int, subset string")
    assert [r[1] for r in df.orderBy(*W.report_order()).collect()] == [1024, 512, None]


def test_gain_with_repeated_results(spark):
    p = predictions(spark, [("a", None, "text", 0, 1), ("a", "r1", "actual_gaze", 1, 1)])
    rows = [("text", "a", None, ["c9"], 1), ("text", "a", None, ["c1"], 2), ("actual_gaze", "a", "r1", ["c1"], 3), ("actual_gaze", "a", "r1", ["c1", "c2"], 4)]
    results = spark.createDataFrame(rows, "condition string, example_id string, reader_id string, chunks array<string>, src_ordinal bigint")
    stats = spark.createDataFrame([("a", "r1", 0.8, 1), ("a", "r1", 0.9, 2)], "example_id string, reader_id string, concentration double, src_ordinal bigint")
    got = E.gain_rows(p, results, stats.drop("src_ordinal")).collect()
    assert len(got) == 1 and (got[0]["retrieval_jaccard_vs_text"], got[0]["concentration"]) == (0.5, 0.9)


def test_repeated_chunk_records(spark):
    evidence = spark.createDataFrame([("text", "a", None, "k", 1, None, None)], "condition string, example_id string, reader_id string, chunk_id string, rank int, char_start int, char_end int")
    records = spark.createDataFrame([("text", "a", None, "k", 0, 4, 1), ("text", "a", None, "k", 5, 9, 2)], "condition string, example_id string, reader_id string, chunk_id string, char_start int, char_end int, src_ordinal bigint")
    got = C.resolve_intervals(evidence, records).collect()
    assert len(got) == 1 and tuple(got[0]["interval"]) == (5, 9)


def test_interval_preference(spark):
    """Own offsets, own condition, actual_gaze, text, in this order; the last of equal record keys; alike rows stay as many as they are."""
    rows = [("q", "r1", "hybrid_gaze_alpha_0p5", 1, "a", 1, 2), ("q", "r1", "hybrid_gaze_alpha_0p5", 2, "a", None, None), ("q", "r1", "hybrid_gaze_alpha_0p5", 2, "a", None, None),
            ("q", "r1", "hybrid_gaze_alpha_0p5", 3, "b", None, None), ("q", "r2", "hybrid_gaze_alpha_0p5", 4, "b", None, None), ("q", "r1", "actual_gaze", 5, "b", None, None), ("q", None, "text", 6, "c", None, None)]
    evidence = spark.createDataFrame(rows, "example_id string, reader_id string, condition string, rank int, chunk_id string, char_start int, char_end int")
    shape = "condition string, example_id string, reader_id string, chunk_id string, char_start int, char_end int, src_ordinal int"
    records = spark.createDataFrame([("hybrid_gaze_alpha_0p5", "q", "r1", "a", 10, 11, 0), ("actual_gaze", "q", "r1", "a", 20, 21, 0), ("text", "q", None, "a", 30, 31, 0),
                                     ("actual_gaze", "q", "r1", "b", 40, 41, 5), ("actual_gaze", "q", "r1", "b", 42, 43, 9), ("text", "q", None, "b", 50, 51, 0), ("text", "q", None, "c", 60, 61, 0)], shape)
    found = C.resolve_intervals(evidence, records)
    assert sorted((r["rank"], r["interval"]["start"]) for r in found.collect()) == [(1, 1), (2, 10), (2, 10), (3, 42), (4, 50), (5, 42), (6, 60)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    lost = evidence.withColumn("chunk_id", F.lit("z"))
    with pytest.raises(Exception, match="no chunk record for z"):
        C.resolve_intervals(lost, records).collect()
    assert {r["interval"] for r in C.resolve_intervals(lost.where("char_start is null"), records, strict=False).collect()} == {None}
