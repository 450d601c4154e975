import pytest
from pyspark.sql import functions as F

from dwellrank.operators import align as A, choices as C, gaze_table as G
from dwellrank.schemas import QA_DDL, SchemaInferenceError

GAZE = ("reader_id string, paragraph_id string, word_index int, word string, trt double, fixation_count double, skip double, src_ordinal bigint, "
        "metadata__paragraph string, metadata__question string, metadata__article_title string, metadata__difficulty_level string")


def questions(spark, rows):
    """(id, paragraph id, text, question, title, level, raw)"""
    data = [(i, p, t, q, ["a", "b"], 0, (None, None, None, title, None, level, None, raw, None)) for i, p, t, q, title, level, raw in rows]
    return spark.createDataFrame(data, QA_DDL)


def gaze(spark, rows):
    """(reader, paragraph id, word index, word, text, question, title, level)"""
    data = [(r, p, w, x, 10.0, None, None, i, t, q, ti, le) for i, (r, p, w, x, t, q, ti, le) in enumerate(rows)]
    return spark.createDataFrame(data, GAZE)


TEXT = "Alpha beta. Gamma delta."


def test_basic(spark):
    qa = questions(spark, [("q1", "p1", TEXT, "Q?", None, None, None), ("q2", "missing", "x", "Q?", None, None, None)])
    g = gaze(spark, [("r1", "p1", 2, "beta.", None, None, None, None), ("r1", "p1", 1, "Alpha", None, None, None, None), ("r2", "p1", 1, "Alpha", None, None, None, None)])
    a = A.align(qa, g)
    report = A.alignment_report(qa, g, a).first()
    assert (report["aligned_examples"], report["unmatched_qa_examples"], report["matched_readers"], report["method_exact_id"]) == (1, 1, 2, 1)
    assert (report["readers_min"], report["readers_max"], report["records_mean"], report["qa_matched_fraction"]) == (2, 2, 3.0, 0.5)
    assert [r[0] for r in A.unmatched_questions(qa, a).collect()] == ["q2"]
    nested = A.nest_aligned(qa, a).withColumn("readers", F.map_keys("reader_gaze")).first()
    assert nested["readers"] == ["r1", "r2"] and [w["word_index"] for w in nested["reader_gaze"]["r1"]] == [1, 2]
    assert {r["reader_id"] for r in A.trim_readers(a, 1).collect()} == {"r1"}
    with pytest.raises(ValueError):
        A.trim_readers(a, 0)


@pytest.mark.parametrize("tier,row", [
    (1, ("r", "p1", 1, "w", "other", "other", None, None)),
    (2, ("r", "g", 1, "w", " alpha  BETA. gamma delta.", "q? ", None, None)),
    (3, ("r", "g", 1, "w", "other", "Q?", "bottle story ", "Adv")),
    (4, ("r", "g", 1, "w", TEXT, "another", None, None)),
    (None, ("r", "g", 1, "w", "other", "Q?", "Bottle Story", "Ele")),
    (None, ("r", "g", 1, "w", "", None, None, None)),
])
def test_each_tier(spark, tier, row):
    qa = questions(spark, [("q1", "p1", TEXT, "Q?", "ignored", "ignored", '{"title": "Bottle Story", "level": 0}')])
    got = A.align(qa, gaze(spark, [row])).collect()
    assert [r["match_tier"] for r in got] == ([] if tier is None else [tier])
    kept = A.filter_matching(gaze(spark, [row]), qa).count()
    assert kept == (1 if tier else 0)


def test_first_tier_takes_the_whole_group(spark):
    qa = questions(spark, [("q1", "p1", TEXT, "Q?", None, None, None), ("q2", "p9", TEXT, "Q?", None, None, None)])
    g = gaze(spark, [("r1", "p1", 1, "a", TEXT, "Q?", None, None), ("r2", "p2", 1, "b", TEXT, "Q?", None, None), ("r3", "p3", 1, "c", TEXT, "X", None, None)])
    got = {(r["example_id"], r["reader_id"], r["match_tier"]) for r in A.align(qa, g).collect()}
    assert got == {("q1", "r1", 1), ("q2", "r1", 2), ("q2", "r2", 2)}


def test_metadata_level_without_raw(spark):
    qa = questions(spark, [("q1", "p1", TEXT, "Q?", "T", "1", None)])
    assert A.align(qa, gaze(spark, [("r", "g", 1, "w", None, "Q?", "t", "Int")])).first()["match_tier"] == 3


def raw_areas(spark, rows, drop=()):
    columns = ["participant_id", "article_batch", "article_id", "paragraph_id", "difficulty_level", "onestopqa_question_id", "IA_ID", "IA_LABEL", "IA_DWELL_TIME"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    return df.drop(*drop)


def test_canonical_gaze(spark):
    df = raw_areas(spark, [("r", "1", "2", "3", "Adv", None, "7", None, "bad"), ("r", "1", "2", "3", "Adv", "0", "8", "w", "12.5")])
    rows = G.normalize_gaze(df).orderBy("word_index").collect()
    assert rows[0]["paragraph_id"] == "batch=1|article=2|paragraph=3|level=Adv|question=nan"
    assert (rows[0]["word"], rows[0]["trt"], rows[0]["fixation_count"], rows[0]["skip"]) == ("nan", 0.0, None, None)
    assert rows[1]["trt"] == 12.5 and rows[1]["metadata__difficulty_level"] == "Adv"
    with pytest.raises(SchemaInferenceError):
        G.normalize_gaze(df.drop("IA_ID"))
    with pytest.raises(Exception, match="CAST"):
        G.normalize_gaze(raw_areas(spark, [("r", "1", "2", "3", "A", "0", "x", "w", "1")])).collect()


def test_trial_filters(spark):
    df = spark.createDataFrame([(1, "True", False), (2, "False", True), (3, None, False), (4, "False", None)], "n int, practice_trial string, repeated_reading_trial boolean")
    assert sorted(r["n"] for r in G.drop_practice(df).collect()) == [2, 4]
    assert G.drop_practice(df, True).count() == 4 and [r["n"] for r in G.drop_repeated(df, True).orderBy("n").collect()] == [1, 3]


def test_article_ids(one):
    key = lambda a: one(G.paragraph_id_of_article(F.lit(a), F.lit("3"), F.lit("Adv"), F.lit("0")))
    assert key("1_2_x") == "batch=1|article=2_x|paragraph=3|level=Adv|question=0"
    assert key("12") == "batch=|article=12|paragraph=3|level=Adv|question=0"


def test_inferred_columns():
    found = C.infer_qa_columns(["id", "Context", "question", "choices", "label"])
    assert found == {"paragraph": "Context", "question": "question", "choices": "choices", "answer": "label", "example_id": "id"}
    found = C.infer_qa_columns(["my_passage", "the_question", "answer_1", "answer_2", "para_id"])
    assert found["choices"] == "answer_1|answer_2" and found["answer"] == "" and found["paragraph"] == "my_passage" and found["paragraph_id"] == "para_id"
    for bad in (["context", "passage", "question", "choices"], ["context", "choices"], ["context", "question", "answer_1"], ["a_context", "b_context", "question", "choices"]):
        with pytest.raises(SchemaInferenceError):
            C.infer_qa_columns(bad)


@pytest.mark.parametrize("value,expected", [('["a", "b"]', ["a", "b"]), (" a | b || c ", ["a", "b", "c"]), ("[broken | x", ["[broken", "x"]), ('["a", 1]', ["a", "1"])])
def test_choices(spark, value, expected):
    df = spark.createDataFrame([(value,)], "c string")
    assert df.select(C.coerce_choices(F.col("c"), df.schema["c"].dataType)).first()[0] == expected


@pytest.mark.parametrize("kind,value,expected", [("string", "3", 3), ("string", " c ", 2), ("string", "", None), ("string", "AB", None), ("string", "-1", None),
                                                  ("boolean", True, 1), ("double", 2.9, 2), ("bigint", 4, 4), ("string", None, None)])
def test_answers(spark, kind, value, expected):
    df = spark.createDataFrame([(value,)], f"a {kind}")
    assert df.select(C.coerce_answer(F.col("a"), df.schema["a"].dataType)).first()[0] == expected


def test_choice_shuffle(spark):
    import hashlib
    import random

    qa = questions(spark, [(f"q{i}", "p", "t", "q", None, None, None) for i in range(40)])
    qa = qa.withColumn("choices", F.array(*[F.lit(c) for c in ("correct", "wrong-a", "wrong-b", "wrong-c")]))
    rows = C.shuffle_choices(qa, 13).collect()
    assert rows == C.shuffle_choices(qa.repartition(3), 13).orderBy("example_id").collect() or len(rows) == 40
    for r in rows:
        order = list(range(4))
        random.Random(int.from_bytes(hashlib.sha256(f"13:{r['example_id']}".encode()).digest()[:8], "big")).shuffle(order)
        note = r["metadata"]["choice_shuffle"]
        assert note["order"] == order and r["choices"][r["answer_index"]] == "correct" and note["original_answer_index"] == 0
    assert len({r["answer_index"] for r in rows}) > 1
    single = qa.withColumn("choices", F.array(F.lit("x")))
    assert C.shuffle_choices(single, 13).first()["metadata"]["choice_shuffle"] is None
    with pytest.raises(Exception, match="out of range"):
        C.shuffle_choices(qa.withColumn("answer_index", F.lit(9)), 13).collect()
    assert C.shuffle_choices(qa.withColumn("answer_index", F.lit(None).cast("int")), 13).first()["answer_index"] is None
    assert C.shuffle_choices(qa, 13, enabled=False) is qa
