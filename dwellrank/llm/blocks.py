"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of fixed size. The distinct blocks are sorted and their places are their integer
names; then adjacent pairs of names are sorted and named in turn, until one integer is left for each text. Names are
given by comparing contents, so two texts have one name only if they are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellrank.llm.common import BLANK, flat, relieved, steps, written

BLOCK_BYTES = 4096


def _normalised(texts: pa.Array):
    """Each text's bytes without white space, with the code points of the original."""
    data, offsets = flat(texts)
    for a, b in steps(offsets):
        part = data[offsets[a] : offsets[b]]
        keep = ~BLANK[part]
        left = part[keep].tobytes()
        ends = np.r_[0, np.cumsum(keep)][offsets[a : b + 1] - offsets[a]].tolist()
        points = np.r_[0, np.cumsum((part & 0xC0) != 0x80)][offsets[a : b + 1] - offsets[a]]
        for k, n in enumerate(np.diff(points).tolist()):
            yield left[ends[k] : ends[k + 1]], n


def _digests(batches, size):
    for batch in batches:
        shas, points, lists = [], [], []
        for text, n in _normalised(batch.column(1)):
            shas.append(hashlib.sha256(text).hexdigest())
            points.append(n)
            lists.append([hashlib.sha256(text[i : i + size]).digest()[:16] for i in range(0, len(text), size)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(points, pa.int64()), pa.array(shas, pa.string()), pa.array(lists, pa.list_(pa.binary()))],
            ["doc_id", "points", "text_sha256", "blocks"],
        )


def _blocks(batches, size):
    for batch in batches:
        found = set()
        for text, _ in _normalised(batch.column(0)):
            found.update(text[i : i + size] for i in range(0, len(text), size))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], ["block"])


def _numbered(sorted_rows: DataFrame) -> DataFrame:
    """The place of each distinct row: its partition's number and its place there, which never coincide."""
    return sorted_rows.withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row: doc_id, points (code points of the original), text_sha256, n_blocks and name: equal texts, and only they, share (n_blocks, name).

    Texts are compared without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty. Empty texts have no block and the name -1.
    Names are given to distinct texts, each with a key of its own, and go back to the rows by the text's digest: an id may be null or on several rows.
    The blocks' bytes are sent once, each distinct one of a batch once; beyond that only digests, which lead a text to the
    names of its blocks, and integers move. Two different blocks, or texts, with one digest would be found (they have two names) and end the job.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(
        source.mapInArrow(lambda it: relieved(_digests(it, block_bytes)), "doc_id long, points long, text_sha256 string, blocks array<binary>"),
        "block-lists",
    )
    texts = written(rows.select("text_sha256", "blocks").distinct().withColumn("key", F.monotonically_increasing_id()), "block-texts")
    distinct = source.select("text").mapInArrow(lambda it: relieved(_blocks(it, block_bytes)), "block binary").distinct()
    names = written(_numbered(distinct.sortWithinPartitions("block")).select(_digest(F.col("block")).alias("digest"), "name"), "block-names")
    names = names.groupBy("digest").agg(F.when(F.count("*") == 1, F.min("name")).otherwise(F.raise_error(F.lit("two blocks share a digest"))).alias("name"))
    parts = texts.select("key", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("place", "digest"))
    parts = parts.join(names.hint("rebalance"), "digest").select("key", "place", "name", "n_blocks")
    finished = None
    level, most = 0, texts.agg(F.max(F.size("blocks"))).first()[0] or 0
    left = parts = written(parts, "block-parts")
    while True:
        done = left.where(F.col("n_blocks") <= 2**level).select("key", "name")
        finished = done if finished is None else finished.unionByName(done)
        level += 1
        if most <= 2 ** (level - 1):
            break
        left = left.where(F.col("n_blocks") > 2 ** (level - 1))
        pairs = left.groupBy("key", "n_blocks", F.expr("place div 2").alias("place")).agg(
            F.min(F.struct(F.col("place").alias("at"), "name"))["name"].alias("first"),
            F.when(F.count("*") == 2, F.max(F.struct(F.col("place").alias("at"), "name"))["name"]).otherwise(-1).alias("second"),
        )
        pairs = written(pairs, "block-pairs")
        named = written(_numbered(pairs.select("first", "second").distinct().sortWithinPartitions("first", "second")), "pair-names")
        left = pairs.join(named, ["first", "second"]).select("key", "place", "name", "n_blocks")
    whole = texts.select("key", "text_sha256").join(finished, "key", "left").withColumn("name", F.coalesce("name", F.lit(-1).cast("long")))
    whole = whole.groupBy("text_sha256").agg(F.when(F.count("*") == 1, F.min("name")).otherwise(F.raise_error(F.lit("two texts share a digest"))).alias("name"))
    return rows.select("doc_id", "points", "text_sha256", F.size("blocks").alias("n_blocks")).join(whole.hint("rebalance"), "text_sha256")


def _digest(block):
    return F.unhex(F.substring(F.sha2(block, 256), 1, 32))


def _best(named: DataFrame) -> DataFrame:
    """For each group of equal texts the row that stays: most code points, then the smallest id, null last."""
    best = F.max(F.struct("points", (-F.col("doc_id")).alias("back")))
    return named.groupBy("n_blocks", "name").agg(best.alias("best"), F.count("*").alias("group_size"), F.min("text_sha256").alias("text_sha256"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original, then the smallest doc_id (null last), stays. ``kept`` says whether the row's id is
    that one's; it is null if either is null. Null texts are empty and equal to texts of white space only. An empty table gives an empty
    result; further columns of ``docs`` are not read.
    A group of any size is one aggregate with partial sums; its result is joined back, where large groups can be split.
    """
    named = written(identities(docs, id_col, text_col, block_bytes), "identities")
    groups = _best(named).select("n_blocks", "name", F.col("best.back").alias("back"), "group_size")
    return named.join(groups.hint("rebalance"), ["n_blocks", "name"]).select(
        "doc_id", (-F.col("back")).alias("keep_id"), "group_size", (F.col("doc_id") == -F.col("back")).alias("kept"), "text_sha256"
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of equal texts, whether its id is null, on several rows, or neither.

    Groups are decided on narrow rows; whole rows are sent once, to meet what stays by id, digest and code points. Rows that are alike in all of these
    differ in white space at most; one of them stays. An empty table gives an empty result; further columns of ``docs`` stay as they are.
    """
    named = written(identities(docs, id_col, text_col), "identities")
    stays = written(_stays(named), "stays")
    keys = ["__key", "__null", "__sha", "__points"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns(
        {
            "__key": F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")), "__null": F.col(id_col).isNull(),
            "__sha": F.sha2(F.regexp_replace(text, "[\\x20\\x09-\\x0D]", ""), 256), "__points": F.char_length(text).cast("long"),
        }
    )
    single = rows.join(stays.where("n = 1").select(keys), keys, "left_semi")
    alike = rows.join(stays.where("n > 1").select(keys), keys, "left_semi").dropDuplicates(keys)
    return single.unionByName(alike).select(docs.columns)


def _stays(named: DataFrame) -> DataFrame:
    """For each group the key of the row that stays, and how many rows have that key."""
    per_key = named.groupBy("n_blocks", "name", "points", F.coalesce("doc_id", F.lit(0).cast("long")).alias("__key"), F.col("doc_id").isNull().alias("__null")).agg(
        F.count("*").alias("n"), F.min("text_sha256").alias("__sha")
    )
    best = F.max(F.struct("points", (~F.col("__null")).alias("known"), (-F.col("__key")).alias("back"), "n", "__sha"))
    best = per_key.groupBy("n_blocks", "name").agg(best.alias("b"))
    return best.select((-F.col("b.back")).alias("__key"), (~F.col("b.known")).alias("__null"), F.col("b.__sha").alias("__sha"), F.col("b.points").alias("__points"), F.col("b.n").alias("n"))
