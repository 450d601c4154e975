"""Registered queries that run incrementally and end when the input is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellrank.operators import evaluate as E
from dwellrank.plans import workload as D
from dwellrank.plans.evaluation import PREDICTIONS
from dwellrank.plans.registry import query
from dwellrank.session import shared_dir
from dwellrank.streaming.incremental import committed_rows, incremental_scan, manifest, run_incremental, run_with_manifest


@query("R1_incremental_scan", "select event_type, count(*)::bigint as n, round(sum(value), 4) as trt from events where value >= 5 group by 1")
def incremental_events(spark, sf):
    """New files are scanned once, filtered and appended; the report reads the appended rows."""
    source = D.table(spark, sf, "events")
    root = shared_dir(spark, "events")
    stream = incremental_scan(spark, f"{sf}/events*.parquet", source.schema)
    run_incremental(stream, f"{root}/rows", f"{root}/checkpoint", ["event_id"], lambda df: df.where(F.col("value") >= 5))
    rows = spark.read.parquet(f"{root}/rows")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("trt"))


@query("R3_resumed_run", "with" + PREDICTIONS + """z as (select 1)
select condition, count(*)::bigint as count, count(predicted_index)::bigint as scored_count from p where gold_index is not null group by 1""")
def resumed_run(spark, sf):
    """The same input run twice into one output: the second run finds every key written."""
    source = D.table(spark, sf, "orders")
    root = shared_dir(spark, "orders")
    for attempt in ("first", "second"):
        stream = incremental_scan(spark, f"{sf}/orders*.parquet", source.schema)
        run_incremental(stream, f"{root}/rows", f"{root}/checkpoint-{attempt}", ["o_orderkey"])
    rows = spark.read.parquet(f"{root}/rows")
    p = D.predictions_of(rows)
    a = E.accuracy_by_group(p)
    return a.groupBy("condition").agg(F.sum("count").alias("count"), F.sum("scored_count").alias("scored_count"))


EVENT_ROWS = "event_id bigint, user_id bigint, event_type string, value double, run string, batch bigint"
LONG_VIEWS = {"least_value": 5}


def _long_views(df):
    return df.where(F.col("value") >= LONG_VIEWS["least_value"]).select("event_id", F.col("user_id").cast("bigint").alias("user_id"), "event_type", "value")


def _run(spark, sf, root, attempt, settings=LONG_VIEWS):
    source = D.table(spark, sf, "events")
    stream = incremental_scan(spark, f"{sf}/events*.parquet", source.schema)
    return run_with_manifest(stream, root, f"{root}/checkpoint-{attempt}", ["event_id"], settings, _long_views)


@query("R2_replayed_files", "select event_id, user_id::bigint as user_id, event_type, round(value, 4) as value from events where value >= 5")
def replayed_files(spark, sf):
    """Two runs over the same files, each with its own checkpoint: the manifest keeps every row from being written twice."""
    root = shared_dir(spark, "manifest")
    for attempt in ("first", "second"):
        _run(spark, sf, root, attempt)
    return committed_rows(spark, root, EVENT_ROWS).select("event_id", "user_id", "event_type", F.round("value", 4).alias("value"))


@query("R4_other_settings", "select 'made with other settings' as refusal, count(*)::bigint as rows from events where value >= 5")
def other_settings(spark, sf):
    """A run with other settings is refused and changes nothing."""
    root = shared_dir(spark, "settings")
    _run(spark, sf, root, "first")
    try:
        _run(spark, sf, root, "second", {"least_value": 6})
        refusal = "none"
    except ValueError as e:
        refusal = "made with other settings" if "made with other settings" in str(e) else str(e)
    return committed_rows(spark, root, EVENT_ROWS).agg(F.lit(refusal).alias("refusal"), F.count("*").alias("rows"))


@query("R6_progress", "select count(*)::bigint as input_rows, (count(*) filter (value >= 5))::bigint as written_rows from events")
def run_progress(spark, sf):
    """Rows that the batches of a run have read, from the progress relation, and written, from the manifest."""
    root = shared_dir(spark, "progress")
    seen = _run(spark, sf, root, "first").agg(F.sum("input_rows").alias("input_rows"))
    return seen.join(manifest(spark, root).agg(F.sum("rows").alias("written_rows")))
