import math
import random

import pytest

from dwellrank.operators.ordering import position_in_group, top_share_sum
from pyspark.sql import functions as F


def test_positions(spark):
    rows = [(k, i) for k in ("a", "b") for i in range(0, 500, 3)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    got = {(r["k"], r["v"]): r["p"] for r in position_in_group(df, ["k"], F.shiftright("v", 4), ["v"], "p").collect()}
    assert got == {(k, i): i // 3 for k, i in rows}
    everywhere = position_in_group(df.where("k = 'a'"), [], F.shiftright("v", 4), ["v"], "p").collect()
    assert {r["v"]: r["p"] for r in everywhere} == {i: i // 3 for _, i in rows}


@pytest.mark.parametrize("share", [0.01, 0.2, 1 / 3, 1.0])
def test_top_share(spark, share):
    rng = random.Random(2)
    rows = [("big", rng.choice([rng.random(), 0.5])) for _ in range(20000)] + [("s", v) for v in (0.1, 0.2, 0.7)] + [("one", 4.0), ("bad", float("nan")), ("bad", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: r["concentration"] for r in top_share_sum(df, ["k"], "v", share).collect()}
    for name in ("big", "s", "one", "bad"):
        values = sorted((0.0 if math.isnan(v) else v for k, v in rows if k == name), reverse=True)
        assert got[name] == pytest.approx(sum(values[:max(1, math.ceil(len(values) * share))]))
    with pytest.raises(ValueError):
        top_share_sum(df, ["k"], "v", 1.5)
