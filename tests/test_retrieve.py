import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellrank.functions import conditions as N
from dwellrank.operators import retrieve as R

CHUNKS = "example_id string, reader_id string, condition string, chunk_id string, vec array<double>, text string, char_start int, char_end int"


def view(spark, rows):
    data = [("e", reader, condition, chunk, [float(x) for x in vec], f"text {chunk}", 0, 5) for reader, condition, chunk, vec in rows]
    df = spark.createDataFrame(data, CHUNKS)
    return df.withColumn("embedding_id", R.embedding_id(*[F.col(c) for c in ("example_id", "condition", "reader_id", "chunk_id")]))


def queries(spark, vec=(1.0, 0.0)):
    return spark.createDataFrame([("e", [float(x) for x in vec])], "example_id string, qvec array<double>")


def ids(df):
    return [(r["chunk_id"], r["score"]) for r in df.orderBy("rank").collect()]


def test_cosine_order(spark):
    v = view(spark, [(None, "text", "c1", [1, 0]), (None, "text", "c2", [0.5, 0.5]), (None, "text", "c3", [-1, 0])])
    got = ids(R.retrieve_base(R.score_chunks(v, queries(spark)), 3))
    assert [c for c, _ in got] == ["c1", "c2", "c3"] and got[0][1] == 1 and got[2][1] == -1


def test_ties_and_nan(spark):
    v = view(spark, [(None, "text", c, x) for c, x in (("a:chunk=2", [1, 0]), ("a:chunk=10", [2, 0]), ("n", [float("nan"), 0]), ("z", [0, 0]), ("m", [-1, 0]))])
    got = ids(R.retrieve_base(R.score_chunks(v, queries(spark)), 9))
    assert [c for c, _ in got] == ["a:chunk=10", "a:chunk=2", "z", "m", "n"]


def test_missing_query_is_an_error(spark):
    v = view(spark, [(None, "text", "c1", [1, 0])])
    with pytest.raises(Exception, match="no query vector"):
        R.score_chunks(v, queries(spark).where("example_id = 'x'")).collect()


@pytest.mark.parametrize("alpha,best", [(0.75, "c1"), (0.25, "c2")])
def test_hybrid(spark, alpha, best):
    v = view(spark, [(None, "text", "c1", [1, 0]), (None, "text", "c2", [0, 1]), ("r1", "actual_gaze", "c1", [0, 1]), ("r1", "actual_gaze", "c2", [1, 0])])
    name = N.hybrid_name(alpha)
    rows = R.retrieve(R.score_chunks(v, queries(spark)), [name], 1).collect()
    assert [(r["chunk_id"], r["reader_id"], r["condition"], r["alpha"]) for r in rows] == [(best, "r1", name, alpha)]
    assert rows[0]["score"] == pytest.approx(0.75)


def test_rerank(spark):
    v = view(spark, [(None, "text", "c1", [1, 0]), (None, "text", "c2", [0.8, 0.6]), (None, "text", "c3", [0, 1]),
                     ("r", "actual_gaze", "c1", [0, 1]), ("r", "actual_gaze", "c2", [1, 0]), ("r", "actual_gaze", "c3", [1, 0])])
    rows = R.retrieve(R.score_chunks(v, queries(spark)), ["text_top2_gaze_rerank"], 1).collect()
    assert [(r["chunk_id"], r["score"], r["text_candidate_rank"], r["candidate_top_n"]) for r in rows] == [("c2", 1.0, 2, 2)]


def test_pool_and_nesting(spark):
    v = view(spark, [("r1", "actual_gaze", "c1", [0, 1]), ("r2", "actual_gaze", "c2", [1, 0]), ("r2", "actual_gaze", "c1", [0.6, 0.8])])
    evidence = R.retrieve(R.score_chunks(v, queries(spark)), [N.POOL_MAXSIM], 3)
    rows = evidence.orderBy("rank").collect()
    assert [(r["chunk_id"], r["selected_reader_id"], r["reader_id"]) for r in rows] == [("c2", "r2", None), ("c1", "r2", None), ("c1", "r1", None)]
    nested = R.nest_results(evidence).first()
    assert nested["metadata"]["selected_reader_id"] == "r2" and nested["ranked_chunks"][0]["chunk_id"] == "c2"
    line = R.result_lines(R.nest_results(evidence)).select(F.to_json("ranked_chunks").alias("j")).first()["j"]
    assert line.startswith('[["c2",1')


def test_last_view_wins_and_shared_chunks(spark):
    v = view(spark, [(None, "text", "c1", [1, 0]), ("r", "actual_gaze", "c1", [0, 1]), ("r", "actual_gaze", "c9", [1, 0])]).withColumn("o", F.monotonically_increasing_id())
    later = view(spark, [("r", "actual_gaze", "c1", [1, 0])]).withColumn("o", F.lit(1 << 60))
    s = R.score_chunks(v.unionByName(later), queries(spark))
    text, gaze = s.where("condition = 'text'"), s.where("condition = 'actual_gaze'")
    rows = R.pair_views(text, gaze, "o").collect()
    assert [(r["chunk_id"], r["gaze_score"]) for r in rows] == [("c1", 1.0)]
    R.check_views(text, gaze)
    with pytest.raises(ValueError, match="no shared chunks"):
        R.check_views(text.where("chunk_id = 'x'"), gaze)


def test_listed_chunks(spark):
    chunks = spark.createDataFrame([("c2",), ("c1",)], "chunk_id string")
    e = view(spark, [("r", "x", "c1", [1, 0]), ("r", "x", "c2", [1, 0]), ("r", "x", "c3", [1, 0])])
    rows = R.retrieve_text_only(chunks, e.drop("reader_id", "condition"), queries(spark), 5).orderBy("rank").collect()
    assert [(r["chunk_id"], r["reader_id"], r["condition"]) for r in rows] == [("c1", None, "text"), ("c2", None, "text")]
    rows = R.retrieve_gaze_view(chunks, e.drop("condition"), queries(spark), 1, "mean_gaze").collect()
    assert [(r["chunk_id"], r["reader_id"], r["condition"]) for r in rows] == [("c1", "r", "mean_gaze")]
    with pytest.raises(ValueError):
        R.retrieve_gaze_view(chunks, e, queries(spark), 1, "text")
    with pytest.raises(Exception, match="missing embedding"):
        R.subset_embeddings(spark.createDataFrame([("cX",)], "chunk_id string"), e.drop("reader_id", "condition").withColumn("vec", F.col("vec").cast("array<float>"))).collect()


def test_condition_names():
    assert N.hybrid_name(0.75) == "hybrid_gaze_alpha_0p75" and N.hybrid_alpha("hybrid_gaze_alpha_0p75") == 0.75
    assert N.rerank_name(10) == "text_top10_gaze_rerank" and N.rerank_candidates("text_top10_gaze_rerank") == 10
    assert N.requested(["text", "text"], [0.5], [5]) == ["text", "hybrid_gaze_alpha_0p5", "text_top5_gaze_rerank"]
    assert N.stored_conditions(["mean_gaze", N.POOL_MAXSIM]) == ["actual_gaze", "mean_gaze"]
    for bad in (dict(conditions=["nope"]), dict(conditions=[], alphas=[1.5]), dict(conditions=[], candidates=[2], top_k=3), dict(conditions=["text"], top_k=0)):
        with pytest.raises(ValueError):
            N.requested(**bad)


def test_plan_keeps_k_per_partition(spark):
    v = view(spark, [(None, "text", "c1", [1, 0])])
    plan = R.retrieve_base(R.score_chunks(v, queries(spark)), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "NestedLoop" not in plan and "Python" not in plan


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(f"r{i % 3}", "actual_gaze", f"c{i:03d}", rng.normal(size=8).tolist()) for i in range(90)]
    q = rng.normal(size=8)
    got = R.retrieve_base(R.score_chunks(view(spark, rows), queries(spark, q)), 5).collect()
    for reader in ("r0", "r1", "r2"):
        mine = [(c, np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)) for r, _, c, v in rows if r == reader]
        best = [c for c, _ in sorted(mine, key=lambda x: (-x[1], x[0]))[:5]]
        assert [r["chunk_id"] for r in sorted((g for g in got if g["reader_id"] == reader), key=lambda g: g["rank"])] == best
