"""Exact percentiles of groups by distributed selection: counts per bucket first, then ranks inside the buckets that hold one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.core import col
from trackloom.sources.shared import written

#: Rows of a range that are ranked by their values, buckets that a larger range is cut into, and ranges that are broadcast.
MOST, BUCKETS, SENT = 100_000, 1_024, 20_000
MAX = 1.7976931348623157e308


def _position(share: float) -> Column:
    return F.lit(float(share)) * (F.col("n") - 1)


def _ranks(shares: dict[str, float]) -> Column:
    return F.array_distinct(F.array(*[f(_position(s)).cast("long") for s in shares.values() for f in (F.floor, F.ceil)]))


def _narrowed(rows: DataFrame, wide: DataFrame, buckets: int) -> DataFrame:
    """Ranges cut to the bucket that holds their rank: bounds become the least and largest value inside, so each round ends."""
    ranges = wide.select("k", "lo", "hi").distinct()
    # there are no more large ranges than rows / MOST
    ranges = F.broadcast(ranges) if ranges.count() <= SENT else ranges
    inside = rows.join(ranges, "k").where(F.col("v").between(F.col("lo"), F.col("hi")))
    finite = lambda x: F.greatest(F.lit(-MAX), F.least(F.lit(MAX), x))
    log = lambda x: F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1_100))
    lo, hi, v = finite(F.col("lo")), finite(F.col("hi")), finite(F.col("v"))
    # a range of few magnitudes is cut evenly, one of many by magnitude; either never falls as v grows
    even = (F.signum(lo) == F.signum(hi)) & (F.greatest(F.abs(lo), F.abs(hi)) / 1_000 <= F.least(F.abs(lo), F.abs(hi)))
    part = F.floor(F.when(even, (v - lo) / (hi - lo)).otherwise((log(v) - log(lo)) / (log(hi) - log(lo))) * buckets)
    # bounds have buckets of their own, so every round takes something off
    part = F.when(F.col("v") == F.col("lo"), -1).when(F.col("v") == F.col("hi"), buckets + 1).otherwise(F.least(F.lit(buckets), F.greatest(F.lit(0), part)))
    cells = inside.groupBy("k", "lo", "hi", part.cast("int").alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
    up_to = Window.partitionBy("k", "lo", "hi").orderBy("part")
    cells = cells.withColumn("below", F.sum("c").over(up_to) - F.col("c"))
    found = wide.join(cells, ["k", "lo", "hi"]).where((F.col("before") + F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("below") + F.col("c")))
    return found.select("k", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("before") + F.col("below")).alias("before"), F.col("c").alias("inside"))


def _picked(values: DataFrame, by: list[str], ranks: DataFrame) -> DataFrame:
    """(k, rank, v): the value of each rank, from counts per value of `by`, each of which has MOST rows at most."""
    up_to = Window.partitionBy(*by).orderBy("v")
    values = values.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c")).withColumn("end", F.sum("c").over(up_to))
    found = ranks.join(values, by).where((F.col("rank") - F.col("before") >= F.col("end") - F.col("c")) & (F.col("rank") - F.col("before") < F.col("end")))
    return found.select("k", "rank", "v")


def percentiles(df: DataFrame, keys: list[str], value: str | Column, shares: dict[str, float], most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """Per key the exact percentiles of value, by name: linear between the two ranks next to share * (n - 1).

    No task sorts or holds more than `most` rows of a group. A group of up to `most` rows is ranked by counts per value. Of a
    larger one the buckets between its bounds are counted, and only the bucket that holds a rank goes on, until it is small or
    has one value; a round narrows a range `buckets` times or more. Null and NaN take no part; a key without other values has
    no row; null keys are a key.
    """
    rows = df.select(F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_")).alias("k"), col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = groups.select("k", F.explode(_ranks(shares)).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"))
    large = (F.col("inside") > most) & (F.col("lo") < F.col("hi"))
    wide = written(state.where(large), "wide-ranges")
    if wide.isEmpty():
        found = _picked(rows, ["k"], state)
    else:
        hot = F.broadcast(wide.select("k").distinct()) if wide.count() <= SENT * 2 * len(shares) else wide.select("k").distinct()
        found = _picked(rows.join(hot, "k", "left_anti"), ["k"], state.join(hot, "k", "left_anti"))
        while not wide.isEmpty():
            state = written(_narrowed(rows, wide, buckets), "ranges")
            one = state.where("lo = hi").select("k", "rank", F.col("lo").alias("v"))
            few = state.where((F.col("lo") < F.col("hi")) & (F.col("inside") <= most))
            ranges = few.select("k", "lo", "hi").distinct()
            ranges = F.broadcast(ranges) if ranges.count() <= SENT else ranges
            near = rows.join(ranges, "k").where(F.col("v").between(F.col("lo"), F.col("hi")))
            found = found.unionByName(one).unionByName(_picked(near, ["k", "lo", "hi"], few))
            wide = state.where(large)
    at = found.join(groups.select("k", "n"), "k")
    pick = lambda f, s: F.max(F.when(F.col("rank") == f(_position(s)).cast("long"), F.col("v")))
    out = at.groupBy("k", "n").agg(*[p for i, s in enumerate(shares.values()) for p in (pick(F.floor, s).alias(f"a{i}"), pick(F.ceil, s).alias(f"b{i}"))])

    def between(i: int, s: float) -> Column:
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        # equal ranks need no arithmetic, which infinities would spoil
        return F.when(a == b, a).otherwise(a + (b - a) * (_position(s) - F.floor(_position(s))))

    return out.select(*[F.col("k")[k].alias(k) for k in keys], *[between(i, s).alias(name) for i, (name, s) in enumerate(shares.items())])
