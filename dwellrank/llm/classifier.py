"""Quality classifier: Naive Bayes support vectors.

The n-gram indicators of a text are scaled by the log ratio of their class counts, and a linear hinge-loss model over
the scaled indicators is fitted by dual coordinate descent. The counts come from every labelled row; the linear model is
fitted on a bounded sample of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellrank.llm.common import BLANK, LOWER, flat, mixed, relieved, steps, word_hashes, word_spans, written

#: Hashed indicators; with the bias, the length of the model's weights.
SLOTS = 1 << 18
#: Most labelled rows that the linear model is fitted on (three quarters) and calibrated on (the rest).
SAMPLE_ROWS = 8192

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 upper case, 2 lower case or a byte of a longer character, 3 digit, 4 sentence mark
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3
_CLASS[[33, 44, 46, 58, 59, 63]] = 4


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Small numbers for what words look like: kinds of characters, the last character's kind, and whether the word before is the same."""
    kinds = _CLASS[data]
    code = np.zeros(len(starts), np.uint64)
    for k in range(5):
        total = np.r_[0, np.cumsum(kinds == k)]
        n = total[ends] - total[starts]
        code = code * np.uint64(3) + np.minimum(n, 2).astype(np.uint64)
    code = code * np.uint64(5) + kinds[ends - 1].astype(np.uint64)
    code = code * np.uint64(5) + kinds[starts].astype(np.uint64)
    same = np.zeros(len(starts), np.uint64)
    same[1:] = h[1:] == h[:-1]
    return code * np.uint64(2) + same


def indicators(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The distinct slots of each text: words, pairs of words, and one to three neighbouring word shapes. By portions of texts, with the first one's place."""
    data, offsets = flat(texts)
    for a, b in steps(offsets):
        out = []
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, bounds = word_spans(part, off)
        h = word_hashes(part, starts, ends)
        s = mixed(_shapes(part, starts, ends, h) + np.uint64(1) << np.uint64(8)) if len(h) else h
        after = lambda x, k: np.r_[x[k:], np.zeros(min(k, len(x)), np.uint64)]
        s2, s3 = mixed(s * np.uint64(3) + after(s, 1)), mixed(mixed(s * np.uint64(5) + after(s, 1)) + after(s, 2))
        grams = [(h, 0), (mixed(h * np.uint64(7) + after(h, 1)), 1), (s, 0), (s2, 1), (s3, 2)]
        grams = [((g >> np.uint64(46)).astype(np.int32), k) for g, k in grams]
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            slots = np.sort(np.concatenate([g[x : max(x, y - k)] for g, k in grams]))
            out.append(slots[np.r_[True, slots[1:] != slots[:-1]]] if len(slots) else slots)
        yield a, out


def _gathered(batches, threshold):
    """Counts of texts by slot and class, once for each batch, and the sampled rows themselves."""
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        draws = batch.column(2).to_numpy(zero_copy_only=False)
        both = np.zeros((2, SLOTS), np.int64)
        ok = draws < threshold
        for a, rows in indicators(batch.column(0)):
            own = labels[a : a + len(rows)]
            for want in (0, 1):
                found = [r for r, l in zip(rows, own) if l == want]
                if found:
                    both[want] += np.bincount(np.concatenate(found), minlength=SLOTS)
            drawn = np.flatnonzero(ok[a : a + len(rows)])
            if len(drawn):
                yield _record([None] * len(drawn), [rows[k].astype(np.int32).tobytes() for k in drawn], own[drawn].tolist(), draws[a + drawn].tolist())
        used = np.flatnonzero(both[0] + both[1])
        for part in np.unique(used >> 14).tolist():
            u = used[used >> 14 == part]
            packed = np.stack([u, both[0][u], both[1][u]]).astype(np.int32).tobytes()
            yield _record([part], [packed], [None], [None])


def _record(part, packed, label, draw):
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(packed, pa.binary()), pa.array(label, pa.int32()), pa.array(draw, pa.int64())], ["part", "packed", "label", "draw"]
    )


def _summed(batches):
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            slot, zero, one = np.frombuffer(packed, np.int32).reshape(3, -1)
            sums = totals.setdefault(part, np.zeros((2, 1 << 14), np.int64))
            sums[0, slot & 0x3FFF] += zero
            sums[1, slot & 0x3FFF] += one
    for part, sums in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["part", "sums"])


def hinge_by_dual_descent(rows: list[np.ndarray], scale: np.ndarray, labels: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) that minimise half their square plus ``cost`` times the hinge losses, by dual coordinate descent.

    A row's values are ``scale`` at its slots, at unit length; the bias sees 1. One dual variable is changed at a time, kept
    within 0 and ``cost``, and the weights follow at once.
    """
    values = [_unit(scale[r]) for r in rows]
    sign = np.where(labels == 1, 1.0, -1.0)
    diagonal = np.array([v @ v + 1.0 for v in values])
    weights, dual = np.zeros(len(scale) + 1), np.zeros(len(rows))
    draw = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in draw.permutation(len(rows)):
            gradient = sign[i] * (values[i] @ weights[rows[i]] + weights[-1]) - 1.0
            after = min(max(dual[i] - gradient / diagonal[i], 0.0), cost)
            if after != dual[i]:
                step = (after - dual[i]) * sign[i]
                weights[rows[i]] += step * values[i]
                weights[-1] += step
                most = max(most, abs(after - dual[i]))
                dual[i] = after
        if most < 1e-3:
            break
    return weights


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.sqrt(v @ v)
    return v / length if length else v


def _calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins, by Newton steps on slightly softened targets."""
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    theta = np.array([2.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (theta - [2.0, 0.0]))
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


class Model:
    """Weights over slots (already times the ratios), bias, ratios, and the curve that turns a margin into a score."""

    def __init__(self, ratios, weights, slope, offset):
        self.ratios, self.weights, self.slope, self.offset = ratios, weights, slope, offset

    def scores(self, texts: pa.Array) -> np.ndarray:
        margins = np.full(len(texts), self.weights[-1])
        for a, rows in indicators(texts):
            margins[a : a + len(rows)] += [_unit(self.ratios[r]) @ self.weights[r] for r in rows]
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the labelled rows (``labels``: id and a label of 0 or 1; other and null labels are left out).

    Without rows of both classes every text has the share of label 1 as its score (0.5 without any row).
    """
    labels = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
    count = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    total = sum(count.values())
    if len(count) < 2:
        share = min(max(count.get(1, 0) / total if total else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(SLOTS), np.zeros(SLOTS + 1), 0.0, float(np.log(share / (1 - share))))
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text"))
    rows = texts.join(labels.hint("merge"), F.col("__doc") == F.col("__id"))  # one plan at every size
    rows = rows.select("text", "label", F.xxhash64("__id").alias("draw"))
    # a row is drawn by its id's hash, so that about sample_rows are
    threshold = int(-(2**63) + min(1.0, sample_rows / total) * (2**64 - 1)) if total > sample_rows else 2**63 - 1
    found = written(rows.mapInArrow(lambda it: relieved(_gathered(it, threshold)), "part int, packed binary, label int, draw long"), "classifier")
    sums = found.where("part is not null").select("part", "packed").repartition("part").mapInArrow(_summed, "part int, sums binary")
    counts = np.zeros((2, SLOTS), np.int64)
    for r in sums.collect():  # SLOTS / 16384 rows of 256 KB
        counts[:, r["part"] << 14 : (r["part"] + 1) << 14] = np.frombuffer(r["sums"], np.int64).reshape(2, -1)
    share = (counts + 1.0) / (counts + 1.0).sum(1, keepdims=True)
    ratios = np.log(share[1] / share[0])
    ratios[counts.sum(0) == 0] = 0.0
    sample = found.where("part is null").orderBy("draw").limit(2 * sample_rows).collect()
    features = [np.frombuffer(r["packed"], np.int32) for r in sample]
    y = np.array([r["label"] for r in sample])
    cut = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[~cut])) < 2:
        cut[:] = False
    weights = hinge_by_dual_descent([f for f, c in zip(features, cut) if not c], ratios, y[~cut])
    held = cut if cut.any() else ~cut
    margins = np.array([_unit(ratios[f]) @ weights[f] for f, c in zip(features, held) if c]) + weights[-1]
    return Model(ratios, weights, *_calibrated(margins, y[held]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if the score is at least 0.5) of every whole text; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast((model.ratios, model.weights, model.slope, model.offset))  # four megabytes, whatever the data

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            s = own.scores(batch.column(1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def accepting(spark, model: Model, text_column: int):
    """A function for ``mapInArrow`` that lets through the rows whose text has a score of at least 0.5, all columns as they are."""
    shared = spark.sparkContext.broadcast((model.ratios, model.weights, model.slope, model.offset))

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            if batch.num_rows:
                keep = pa.array(own.scores(batch.column(text_column)) >= 0.5)
                for a in range(0, batch.num_rows, 512):  # a copy of a few rows at a time
                    yield batch.slice(a, 512).filter(keep.slice(a, 512))

    return lambda batches: relieved(run(batches))
