"""Percentiles by distributed selection against sorted lists, on any path and any distribution."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import selection

SHARES = {"least": 0.0, "q": 0.25, "m": 0.5, "p90": 0.9, "most": 1.0}


def groups():
    r = random.Random(2)
    out = {
        "even": [float(i) for i in range(1_000)],
        "hot": [5.0] * 900 + [r.random() for _ in range(100)],
        "two": [1.0] * 400 + [2.0] * 400,
        "wide": [10.0 ** r.uniform(-300, 300) * r.choice((-1, 1)) for _ in range(700)],
        "tiny": [5e-324 * i for i in range(300)],
        "ends": [-math.inf] * 5 + [float(i) for i in range(300)] + [math.inf] * 5,
        "huge": [1.7e308 * (i - 150) / 150 for i in range(300)],
        "one": [7.0],
        "pair": [1.0, 2.0],
        None: [r.gauss(0, 1) for _ in range(500)],
    }
    return out


@pytest.mark.parametrize(("most", "buckets"), [(100_000, 1_024), (60, 32), (25, 4)])
def test_percentiles(spark, most, buckets):
    data = groups()
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    keep = df if buckets > 4 else df.where("g in ('hot', 'two', 'pair', 'one')")
    got = {r["g"]: r for r in selection.percentiles(keep, ["g"], "x", SHARES, most, buckets).collect()}
    assert set(got) == (set(data) if buckets > 4 else {"hot", "two", "pair", "one"})
    for g, r in got.items():
        xs = sorted(data[g])
        for name, s in SHARES.items():
            at = s * (len(xs) - 1)
            a, b = xs[math.floor(at)], xs[math.ceil(at)]
            want = a if a == b else a + (b - a) * (at - math.floor(at))
            assert r[name] == want or np.isclose(r[name], want, rtol=1e-12), (g, name)


def test_without_keys_and_without_rows(spark):
    df = spark.range(1, 1_002).select((F.col("id") * 0.5).alias("x"))
    assert [tuple(r) for r in selection.percentiles(df, [], "x", {"m": 0.5}, 100, 16).collect()] == [(250.5,)]
    assert selection.percentiles(df.where("x < 0"), [], "x", {"m": 0.5}).count() == 0
    assert selection.percentiles(df.withColumn("k", F.lit(1)), ["k"], F.col("x") * 2, {"a": 0.1, "b": 0.1}).columns == ["k", "a", "b"]
