import csv
import glob
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellrank import config, schemas
from dwellrank.functions import conditions as N
from dwellrank.operators import answer as W, coverage as C
from dwellrank.plans import stages as S
from dwellrank.sources import artifacts as IN, gaze as GS, npz, questions as Q, writers as OUT
from dwellrank.streaming import incremental as R

TEXTS = {"Adv": "Alpha beta gamma. Delta epsilon zeta.", "Ele": "Alpha beta. Gamma delta."}
HEADER = ["participant_id", "article_batch", "article_id", "article_title", "paragraph_id", "difficulty_level", "onestopqa_question_id", "IA_ID", "IA_LABEL",
          "IA_DWELL_TIME", "IA_FIXATION_COUNT", "IA_SKIP", "practice_trial", "repeated_reading_trial", "paragraph", "question", "question_preview", "trial_index",
          "TRIAL_INDEX", "selected_answer", "is_correct"]


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")
    level = lambda t: {"context": t, "a_spans": [[0, 1], [2, 2]], "d_spans": [[], [0, 0, 2, 2]]}
    paragraph = {"paragraph_id": 1, **{k: level(t) for k, t in TEXTS.items()}, "Int": {"context": ""},
                 "qas": [{"q_ind": i, "question": f"Question {i}?", "answers": ["w", "x", "y", "z"]} for i in range(2)]}
    articles = [{"article_id": "1_2", "title": "Title", "paragraphs": [paragraph]}]
    (root / "qa.json").write_text(json.dumps({"data": articles}))
    (root / "list.json").write_text(json.dumps(articles, indent=1))
    (root / "bad.json").write_text('{"other": 1}')
    rows = []
    for reader in ("r2", "r1", "r3"):
        for name, text in TEXTS.items():
            for q in range(2):
                for i, word in enumerate(text.split()):
                    rows.append([reader, "1", "2", "Title", "1", name, q, i + 1, word, 100 + 10 * i, 1, i % 2, "False", "False", text, f"Question {q}?", "", 1, 1, "A", "1"])
    rows.append(["r9", "1", "2", "Title", "1", "Adv", 0, 1, "Alpha", "bad", "", "", "True", "False", TEXTS["Adv"], "Question 0?", "", 1, 1, "A", "1"])
    rows.append(["r9", "8", "8", "Other", "1", "Adv", 0, 1, "Alpha", 5, "", "", "False", "False", "unknown", "none", "", 1, 1, "A", "1"])
    with open(root / "ia.csv", "w", newline="") as handle:
        csv.writer(handle).writerows([HEADER, *rows])
    with zipfile.ZipFile(root / "ia.csv.zip", "w") as archive:
        archive.write(root / "ia.csv", "ia.csv")
    return root


@pytest.fixture(scope="module")
def finished(spark, inputs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("artifacts"))
    report = S.run_all(spark, f"{inputs}/ia.csv.zip", f"{inputs}/qa.json", out, max_readers=2, dim=32, top_k=1,
                       conditions=N.BASE_CONDITIONS, alphas=(0.75,), candidates=(2,), coverage=True)
    return out, report


def rows_of(path):
    lines = [line for f in sorted(glob.glob(f"{path}/part-*")) for line in open(f, encoding="utf8") if line.strip()]
    return [json.loads(line) for line in lines]


def test_counts(finished):
    _, report = finished
    assert report["inspect"] == {"ia_columns": 21, "ia_rows": 62, "qa_examples": 4}
    assert report["align"]["aligned_examples"] == 4 and report["align"]["readers_max"] == 2 and report["align"]["method_exact_id"] == 4
    embed = report["embed"]
    assert [embed[f"{c}_embeddings"] for c in N.BASE_CONDITIONS] == [8, 16, 8, 16, 16, 8] and embed["query_embeddings"] == 4
    by_condition = report["retrieve"]["records_by_condition"]
    assert by_condition["text"] == 4 and by_condition["actual_gaze"] == by_condition["hybrid_gaze_alpha_0p75"] == by_condition["text_top2_gaze_rerank"] == 8
    assert report["answer"]["newly_written"] == sum(by_condition.values()) + 4
    assert report["evaluate"]["prediction_records"] == report["answer"]["newly_written"]
    assert {(r["condition"], r["top_k"]) for r in report["coverage"]} == {("text", 1), ("actual_gaze", 1)}


def test_written_forms(spark, finished):
    out, _ = finished
    first = rows_of(f"{out}/data/aligned_examples")[0]
    assert set(first) == {"qa", "reader_gaze"} and list(first["reader_gaze"]) == ["r1", "r2"]
    assert [w["word_index"] for w in first["reader_gaze"]["r1"]] == list(range(1, len(first["reader_gaze"]["r1"]) + 1))
    result = rows_of(f"{out}/retrieval/results")[0]
    assert isinstance(result["ranked_chunks"][0][0], str) and isinstance(result["ranked_chunks"][0][1], float)
    prediction = rows_of(f"{out}/predictions/predictions")[0]
    assert prediction["metadata"]["choice_shuffle"]["seed"] == 13 and prediction["prompt"].endswith("Answer:")
    report = next(csv.DictReader(open(glob.glob(f"{out}/results/paired_deltas/part-*.csv")[0])))
    assert report["baseline"] == "text" and "ci95_low" in report
    assert json.loads("".join(open(glob.glob(f"{out}/data/alignment_report/part-*")[0])))["choice_seed"] == 13
    qa, words = IN.read_aligned(spark, f"{out}/data/aligned_examples")
    assert qa.count() == 4 and words.where("reader_id = 'r1' and example_id like '%Adv:0'").count() == 6
    back = IN.evidence_of(IN.read_retrievals(spark, f"{out}/retrieval/results", ["text"])).collect()
    assert len(back) == 4 and all(r["score"] is not None and r["char_end"] > 0 for r in back)


def test_resume(spark, finished):
    out, report = finished
    again = S.answer_questions(spark, out, mode="loglik", include_bare=True)
    assert again["newly_written"] == 0 and again["skipped_existing"] == report["answer"]["newly_written"]
    with pytest.raises(ValueError, match="different choice shuffle"):
        S.answer_questions(spark, out, mode="loglik", choice_seed=7)
    keys = IN.read_predictions(spark, f"{out}/predictions/predictions").groupBy(*W.KEYS).count()
    assert keys.where("count > 1").count() == 0


def test_available_conditions_only(spark, finished):
    out, _ = finished
    assert S.retrieve_evidence(spark, out, ["text"], 3)["conditions"] == ["text"]
    with pytest.raises(ValueError):
        S.retrieve_evidence(spark, out, ["nothing"])


def test_empty_evaluation(spark, tmp_path):
    S.evaluate_answers(spark, str(tmp_path))
    header = open(glob.glob(f"{tmp_path}/results/by_condition/part-*.csv")[0]).read().strip()
    assert header == ",".join(schemas.BY_CONDITION_COLUMNS)


def test_gold_spans(spark, inputs):
    gold = {r["example_id"]: r for r in C.gold_spans(Q.gold_span_rows(Q.read_articles(spark, f"{inputs}/qa.json"))).where("level = 'Adv'").collect()}
    spans = lambda r, k: [(s["start"], s["end"]) for s in r[k]]
    assert spans(gold["local:1_2:1:Adv:0"], "a_spans") == [(0, 10)] and spans(gold["local:1_2:1:Adv:0"], "d_spans") == []
    assert spans(gold["local:1_2:1:Adv:1"], "d_spans") == [(0, 5), (11, 17)]


def test_question_files(spark, inputs, monkeypatch, tmp_path):
    a, b = (Q.with_ordinals(Q.read_local_questions(spark, f"{inputs}/{n}")).orderBy("example_ordinal").collect() for n in ("qa.json", "list.json"))
    assert [r["example_id"] for r in a] == [r["example_id"] for r in b] == [f"local:1_2:1:{lv}:{q}" for lv in ("Adv", "Ele") for q in (0, 1)]
    assert a[0]["paragraph_id"] == "batch=1|article=2|paragraph=1|level=Adv|question=0" and a[0]["metadata"]["article_title"] == "Title"
    with pytest.raises(Exception, match="top-level data list"):
        Q.read_articles(spark, f"{inputs}/bad.json").collect()
    with pytest.raises(FileNotFoundError):
        Q.read_articles(spark, f"{inputs}/none.json")
    monkeypatch.chdir(tmp_path)
    with pytest.raises(RuntimeError, match="no local fallback"):
        Q.read_questions(spark, "unknown/dataset")
    monkeypatch.setenv(Q.FALLBACK_VARIABLE, f"{inputs}/qa.json")
    assert Q.read_questions(spark, "unknown/dataset").count() == 4
    flat = spark.createDataFrame([(0, "c", "q", "a|b", "B")], "example_ordinal bigint, context string, question string, choices string, answer string")
    row = Q.read_questions(spark, "named", connector=lambda name, split: flat).first()
    assert (row["example_id"], row["choices"], row["answer_index"]) == ("0", ["a", "b"], 1)


def test_missing_answers(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"article_id": "1", "title": "t", "paragraphs": [{"paragraph_id": 1, "Adv": {"context": "c"}, "qas": [{"q_ind": 0, "question": "q", "answers": []}]}]}]))
    with pytest.raises(Exception, match="no answers"):
        Q.read_local_questions(spark, str(tmp_path / "q.json")).collect()


def test_interest_areas(spark, inputs):
    plain, zipped = (GS.read_interest_areas(spark, f"{inputs}/{n}", ["participant_id", "IA_LABEL"]) for n in ("ia.csv", "ia.csv.zip"))
    values = lambda d: [(r["participant_id"], r["IA_LABEL"]) for r in d.orderBy("src_ordinal").collect()]
    assert values(plain) == values(zipped) and plain.columns == ["participant_id", "IA_LABEL", "src_ordinal"]
    assert GS.sample_interest_areas(GS.read_interest_areas(spark, f"{inputs}/ia.csv")).count() == 25
    with pytest.raises(FileNotFoundError):
        GS.read_interest_areas(spark, f"{inputs}/none.csv")


def test_pruned_csv_scan(spark, inputs):
    plan = GS.read_interest_areas(spark, f"{inputs}/ia.csv", ["IA_LABEL"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<IA_LABEL:string>" in plan


def test_npz(spark, tmp_path):
    rows = [(f"e::text::none::c{i}", "e", None, "text", f"c{i}", "p", "t", 0, 1, [0, 1], [float(i), 1.0]) for i in range(5)]
    df = spark.createDataFrame(rows, schemas.EMBEDDING_DDL).repartition(2)
    files = npz.write_npz(df, str(tmp_path / "out"), "embedding_id", "vec", "ids", "embeddings").collect()
    assert sum(r["rows"] for r in files) == 5
    back = npz.read_embedding_npz(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    np.savez(tmp_path / "bad.npz", ids=np.array(["a"]), embeddings=np.zeros((2, 2)), records_json=np.array("[{}]"))
    with pytest.raises(Exception, match="inconsistent lengths"):
        npz.read_embedding_npz(spark, str(tmp_path / "bad.npz")).collect()
    np.savez(tmp_path / "q.npz", example_ids=np.array(["e"]), queries=np.ones((1, 2)), records_json=np.array('[{"example_id": "e", "choices": ["a"], "answer_index": 1}]'))
    q = npz.read_query_npz(spark, str(tmp_path / "q.npz")).first()
    assert q["qvec"] == [1.0, 1.0] and q["choices"] == ["a"] and q["answer_index"] == 1


def test_jsonable_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), [1.0, float("nan")], (float("inf"), "x"), {"k": float("nan")})], "a double, b array<double>, c struct<d:double,e:string>, m map<string,double>")
    row = OUT.jsonable(df).first()
    assert row["a"] is None and row["b"] == [1.0, None] and row["c"]["d"] == float("inf") and row["m"] == {"k": None}
    OUT.write_table_csv(spark.createDataFrame([(1, 2)], "z int, a int"), str(tmp_path / "t"), sort_columns=True)
    assert open(glob.glob(f"{tmp_path}/t/part-*.csv")[0]).readline().strip() == "a,z"
    with pytest.raises(ValueError):
        OUT.write_embeddings(spark.createDataFrame([], schemas.EMBEDDING_DDL), str(tmp_path / "none"))
    (tmp_path / "x.jsonl").write_text('{"example_id": "a"}\n\n{"example_id": "b", "prompt": null}\n')
    rows = IN.read_predictions(spark, str(tmp_path / "x.jsonl")).orderBy("example_id").collect()
    assert [(r["example_id"], r["prompt"], r["raw_output"]) for r in rows] == [("a", "", ""), ("b", "", "")]


def test_rewards_stage(spark, tmp_path):
    rows = spark.createDataFrame([(f"id{i}", i, "Alpha one. Beta two. Gamma three.", "beta", "yes it is", "no", "s" if i % 2 else "t", "m", None) for i in range(4)],
                                 "id string, row_index bigint, prompt string, question string, chosen string, reject string, subset string, chosen_model string, reject_model string")
    run = lambda **k: S.score_rewards(spark, rows, str(tmp_path), ("full_context", "query_only_compression"), (2,), **k)
    first = run(max_examples=2)
    assert (first["requested_records"], first["newly_written"], first["prediction_records"]) == (4, 4, 4)
    second = run()
    assert (second["newly_written"], second["skipped_existing"], second["prediction_records"]) == (4, 4, 8)
    third = run(overwrite=True, subsets=["s"])
    assert (third["newly_written"], third["prediction_records"]) == (4, 4)
    with pytest.raises(ValueError):
        run(subsets=["none"])


def test_incremental(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    part = lambda a, b: spark.range(a, b).selectExpr("id", "id % 2 as g").coalesce(1).write.mode("append").parquet(str(source))
    part(0, 10)
    part(5, 12)
    run = lambda name, **k: R.run_incremental(
        R.incremental_scan(spark, str(source), "id bigint, g bigint", 1), out, str(tmp_path / name), ["id"], lambda d: d.where("g = 0"), **k)
    report = R.progress(run("c1"))
    assert report["done"] and report["input_rows"] == 17
    ids = lambda: sorted(r["id"] for r in spark.read.parquet(out).collect())
    assert ids() == [0, 2, 4, 6, 8, 10]
    part(12, 15)
    run("c1")
    run("c2")
    assert ids() == [0, 2, 4, 6, 8, 10, 12, 14]
    run("c3", overwrite=True)
    assert ids() == [0, 2, 4, 6, 8, 10, 12, 14]


def test_missing_question(spark):
    results = spark.createDataFrame([("x",)], "example_id string")
    known = spark.createDataFrame([("y", "q")], "example_id string, question string")
    with pytest.raises(Exception, match="no question for example"):
        W.join_questions(results, known).collect()
    assert W.join_questions(results, known, strict=False).count() == 0


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("seed: 7\nretrieval: {top_k: 9}\npaths: {artifacts_dir: out}\n")
    found = config.read_settings(tmp_path / "c.yaml")
    assert (found["seed"], found["retrieval.top_k"], found["paths.artifacts_dir"], found["chunking.max_words"]) == (7, 9, "out", 80)
    with pytest.raises(ValueError):
        config.settings({"data": {"unknown": 1}})
    arguments = config.run_arguments(found)
    assert (arguments["top_k"], arguments["out"], arguments["max_examples"]) == (9, "out", None)


def test_run_with_settings(tmp_path, monkeypatch):
    from dwellrank.plans import stages

    (tmp_path / "c.yaml").write_text("retrieval: {top_k: 4}\n")
    monkeypatch.setattr(stages, "run_all", lambda spark, **given: given)
    given = stages.run_configured(None, tmp_path / "c.yaml", out="elsewhere", dim=16)
    assert (given["top_k"], given["out"], given["dim"]) == (4, "elsewhere", 16)


def test_repeated_keys_keep_the_last(spark):
    questions = spark.createDataFrame(
        [("a", "first", ["x"], 0, None, 1), ("a", "last", ["y"], 1, None, 2), ("b", "only", ["z"], 0, None, 0)],
        "example_id string, question string, choices array<string>, answer_index int, s string, example_ordinal int",
    ).selectExpr("*", "named_struct('choice_shuffle', cast(null as struct<enabled:boolean,seed:bigint,order:array<int>,original_answer_index:int,original_choices:array<string>>)) as metadata")
    assert sorted((r["example_id"], r["question"]) for r in IN.questions_by_id(questions).collect()) == [("a", "last"), ("b", "only")]


def test_first_questions(spark):
    qa = spark.createDataFrame([("a", 0), ("b", 1)], "example_id string, example_ordinal bigint")
    assert [r["example_id"] for r in IN.load_examples(qa, 1).collect()] == ["a"]
    with pytest.raises(ValueError):
        IN.load_examples(qa, 0)
    with pytest.raises(ValueError, match="no questions"):
        IN.load_examples(qa.where(F.lit(False)))
