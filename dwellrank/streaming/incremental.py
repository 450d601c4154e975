"""Incremental runs on Structured Streaming: scan new files, skip done work, append."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from dwellrank.sources.gaze import _exists

MANIFEST = "run string, batch bigint, files array<string>, settings string, input_rows bigint, rows bigint"
PROGRESS = "run string, batch bigint, input_rows bigint, duration_ms bigint"


def incremental_scan(spark: SparkSession, path: str, schema, files_per_batch: int = 64, fmt: str = "parquet", **options) -> DataFrame:
    """A folder as a stream of its files."""
    return spark.readStream.format(fmt).schema(schema).options(**options).option("maxFilesPerTrigger", files_per_batch).load(path)


def without_written(batch: DataFrame, spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Rows whose key the output does not hold yet."""
    if not _exists(spark, out):
        return batch
    done = spark.read.parquet(out).select(*[F.col(k).alias(f"_{k}") for k in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = same if on is None else on & same
    return batch.join(done, on, "left_anti")


def run_incremental(
    stream: DataFrame, out: str, checkpoint: str, keys: list[str], transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    overwrite: bool = False,
):
    """Processes what is new and stops.

    A batch that is run again after a failure is dropped by its keys, so every
    key is written once. ``overwrite`` empties the output at the first batch and
    needs a new checkpoint folder. Gives the finished query with its progress.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        result = transform(batch)
        if overwrite and number == 0:
            result.dropDuplicates(keys).write.mode("overwrite").parquet(out)
            return
        without_written(result.dropDuplicates(keys), spark, out, keys).write.mode("append").parquet(out)

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def progress(query) -> dict:
    """Rows read and batches run so far."""
    reports = query.recentProgress
    return {"batches": len(reports), "input_rows": sum(r["numInputRows"] for r in reports), "done": not query.isActive}


# --- runs with a manifest --------------------------------------------------------------------


def fingerprint(settings: dict) -> str:
    """What the settings of a run are, in short."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """One row for each batch whose rows count: run, number, input files, settings, rows read and written."""
    path = f"{out}/manifest"
    return spark.read.schema(MANIFEST).json(f"{path}/*/*") if _exists(spark, f"{path}/*/*") else spark.createDataFrame([], MANIFEST)


def committed_rows(spark: SparkSession, out: str, schema) -> DataFrame:
    """The rows of all batches in the manifest; what a lost batch may have left is not among them."""
    rows = spark.read.schema(schema).option("basePath", f"{out}/rows").option("recursiveFileLookup", False).parquet(f"{out}/rows")
    return rows.join(manifest(spark, out).select("run", "batch"), ["run", "batch"], "left_semi").drop("run", "batch")


def check_settings(spark: SparkSession, out: str, settings: dict) -> None:
    """Refuses to add to an output that was made with other settings."""
    other = manifest(spark, out).where(F.col("settings") != fingerprint(settings)).select("run", "batch").take(1)
    if other:
        raise ValueError(f"the output holds batches that were made with other settings: {other[0].asDict()}")


def write_batch(batch: DataFrame, number: int, out: str, run: str, keys: list[str], transform: Callable[[DataFrame], DataFrame], settings: dict) -> None:
    """Writes one batch and then its line of the manifest (R2).

    The batch has its own folder, which a repetition overwrites, and counts
    from its line on. A batch that has a line is not run again; rows of files
    that an earlier batch of any run has read are left out. ``_file`` names the
    file of each row. Nothing that was written before is read but the manifest.
    """
    spark = batch.sparkSession
    done = manifest(spark, out)
    if done.where((F.col("run") == run) & (F.col("batch") == number)).take(1):
        return
    files = [r[0] for r in batch.select("_file").distinct().collect()]  # as many as one trigger takes
    seen = {r[0] for r in done.select(F.explode("files").alias("f")).where(F.col("f").isin(files)).collect()}
    todo = batch.where(~F.col("_file").isin(sorted(seen))) if seen else batch
    folder, seen_rows = f"run={run}/batch={number}", Observation()
    todo = todo.drop("_file").observe(seen_rows, F.count("*").alias("n"))
    transform(todo).dropDuplicates(keys).write.mode("overwrite").parquet(f"{out}/rows/{folder}")
    rows = spark.read.parquet(f"{out}/rows/{folder}").count()
    line = spark.createDataFrame([(run, number, sorted(set(files) - seen), fingerprint(settings), seen_rows.get["n"], rows)], MANIFEST)
    line.coalesce(1).write.mode("overwrite").json(f"{out}/manifest/{folder}")


class _Reports(StreamingQueryListener):
    """Keeps what the query says of its batches."""

    def __init__(self):
        self.batches: dict[str, dict[int, int]] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.batches.setdefault(str(p.id), {})[p.batchId] = p.batchDuration

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def run_with_manifest(
    stream: DataFrame, out: str, checkpoint: str, keys: list[str], settings: dict, transform: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Processes the files that no batch in the manifest has read, and stops (R2, R4, R6). Gives the progress relation of the output.

    Keys are unique within a batch; a key in files of different batches is
    written by each. With the same settings a run may go on after a failure,
    with its checkpoint or without it.
    """
    spark = stream.sparkSession
    check_settings(spark, out, settings)
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    reports = _Reports()
    spark.streams.addListener(reports)
    try:
        query = (
            stream.select("*", F.col("_metadata.file_path").alias("_file")).writeStream
            .foreachBatch(lambda batch, number: write_batch(batch, number, out, run, keys, transform, settings))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        took = {r["batchId"]: r["batchDuration"] for r in query.recentProgress} | reports.batches.get(str(query.id), {})
    finally:
        spark.streams.removeListener(reports)
    if took:  # Spark's own count of rows has those twice that a batch reads twice
        times = spark.createDataFrame([(run, *x) for x in sorted(took.items())], "run string, batch bigint, duration_ms bigint")
        lines = times.join(manifest(spark, out), ["run", "batch"]).select("run", "batch", "input_rows", "duration_ms")
        lines.coalesce(1).write.mode("overwrite").json(f"{out}/progress/run={run}")
    return progress_of(spark, out)


def progress_of(spark: SparkSession, out: str) -> DataFrame:
    """run, batch, input_rows, duration_ms of the last start of every run."""
    return spark.read.schema(PROGRESS).json(f"{out}/progress/*") if _exists(spark, f"{out}/progress/*") else spark.createDataFrame([], PROGRESS)
