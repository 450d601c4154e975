"""Runs with a manifest."""

import pytest
from pyspark.sql import functions as F

from dwellrank.streaming import incremental as I

ROWS = "k bigint, v string, run string, batch bigint"


def keys(spark, out):
    return sorted((r["k"], r["v"]) for r in I.committed_rows(spark, out, ROWS).collect())


def batch(spark, rows, file):
    return spark.createDataFrame(rows, "k bigint, v string").withColumn("_file", F.lit(file))


def test_a_batch_counts_once(spark, tmp_path):
    """A repeated batch, a file in a later batch of another run, and rows without a line in the manifest."""
    out, same = str(tmp_path / "out"), lambda df: df
    first = batch(spark, [(1, "a"), (1, "again"), (2, "b")], "f1")
    I.write_batch(first, 0, out, "one", ["k"], same, {})
    I.write_batch(batch(spark, [(9, "other rows under the same number")], "f9"), 0, out, "one", ["k"], same, {})
    both = first.union(batch(spark, [(3, "c")], "f2"))
    I.write_batch(both, 0, out, "two", ["k"], same, {})
    spark.createDataFrame([(99, "lost")], "k bigint, v string").write.parquet(f"{out}/rows/run=three/batch=0")
    got = keys(spark, out)
    assert [k for k, _ in got] == [1, 2, 3] and got[0][1] in ("a", "again")
    lines = {(r["run"], r["batch"]): (r["files"], r["input_rows"], r["rows"]) for r in I.manifest(spark, out).collect()}
    assert lines == {("one", 0): (["f1"], 3, 2), ("two", 0): (["f2"], 1, 1)}
    I.write_batch(batch(spark, [(4, "d")], "f3"), 0, out, "three", ["k"], same, {})  # the lost batch is run again
    assert [k for k, _ in keys(spark, out)] == [1, 2, 3, 4]


def test_settings_are_kept(spark, tmp_path):
    out = str(tmp_path / "out")
    I.check_settings(spark, out, {"seed": 1})
    I.write_batch(batch(spark, [(1, "a")], "f1"), 0, out, "one", ["k"], lambda df: df, {"seed": 1, "on": True})
    I.check_settings(spark, out, {"on": True, "seed": 1})
    with pytest.raises(ValueError, match="other settings"):
        I.check_settings(spark, out, {"seed": 2, "on": True})


def test_new_files_only(spark, tmp_path):
    """A second start reads the file that came since, with its checkpoint or without; the progress tells each start's rows."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).selectExpr("id as k", "'v' as v").coalesce(1).write.parquet(source)
    run = lambda name: I.run_with_manifest(I.incremental_scan(spark, source, "k bigint, v string", 1), out, str(tmp_path / name), ["k"], {"x": 1})
    run("one")
    spark.range(10, 14).selectExpr("id as k", "'w' as v").coalesce(1).write.mode("append").parquet(source)
    run("one")
    assert [k for k, _ in keys(spark, out)] == list(range(14))
    seen = run("two")
    assert [k for k, _ in keys(spark, out)] == list(range(14))
    assert I.manifest(spark, out).agg(F.sum("input_rows")).first()[0] == 14
    assert seen.where("duration_ms < 0 or input_rows is null").count() == 0 and seen.count() >= 2
