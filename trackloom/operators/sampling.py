"""Deterministic samples: evenly spaced, best per key or bucket, stratified, spread out; and labeler assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def evenly_spaced(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """At most k rows per key at positions round(i * (n - 1) / (k - 1)), half to even, deduplicated; k = 1 takes the middle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.select("*", (F.row_number().over(w) - 1).alias("_at"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_size"))
    if k == 1:
        return rows.where(F.col("_at") == F.floor(F.col("_size") / 2)).drop("_at", "_size")
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_size") - 1) / (k - 1)).cast("long"))
    return rows.where((F.col("_size") <= k) | F.array_contains(spots, F.col("_at").cast("long"))).drop("_at", "_size")


def spread(df: DataFrame, entity: str, bucket: Column, order: list[Column], k: int) -> DataFrame:
    """The best row per bucket, of which an entity keeps its earliest bucket only, thinned evenly to k rows over the buckets.

    An entity that was best in two buckets leaves the later one without a row, as no second best is asked.
    """
    best = top_per_key(df.withColumn("_bucket", bucket), ["_bucket"], order)
    once = top_per_key(best, [entity], [F.col("_bucket")]).withColumn("_all", F.lit(0))
    return evenly_spaced(once, ["_all"], [F.col("_bucket")], k).drop("_bucket", "_all")


def newest_complete(spans: DataFrame, day: str, lo: str, hi: str, least: int, within: int) -> DataFrame:
    """(day, covered, nth) of the days whose spans add up to `least` or more, newest first, nth from 1.

    Only the last `within` days up to the newest one with any span are asked; that one is often still coming in.
    """
    covered = spans.groupBy(day).agg(F.sum(F.col(hi) - F.col(lo)).alias("covered"))
    newest = spans.agg(F.max(day).alias("_newest"))
    rows = covered.crossJoin(F.broadcast(newest)).where((F.datediff("_newest", F.col(day)) < within) & (F.col("covered") >= least))
    # `within` rows at most
    return rows.select(day, "covered", F.row_number().over(Window.orderBy(F.col(day).desc())).alias("nth"))


def stratified(df: DataFrame, entity: str, strata: list[tuple[str, Column]], bucket: Column, order: list[Column], n: int) -> DataFrame:
    """For each stratum in turn: best row per bucket among entities not used before, then n of those evenly over the buckets."""
    out, pool = None, df.withColumn("_bucket", bucket)
    for name, predicate in strata:
        best = top_per_key(pool.where(predicate), ["_bucket"], order)
        some = evenly_spaced(best.withColumn("stratum", F.lit(name)), ["stratum"], [F.col("_bucket")], n)
        pool = pool.join(some.select(entity).distinct(), entity, "left_anti")
        out = some if out is None else out.unionByName(some)
    return out.drop("_bucket")


def assign(df: DataFrame, ordinal: str, total: int, labelers: list[str], overlap: float) -> DataFrame:
    """(row, labeler): round(total * overlap) evenly spaced rows go to all labelers, the others round robin. ordinal is 0-based."""
    if not labelers or not 0 <= overlap <= 1:
        raise ValueError("labelers and an overlap in [0, 1] are needed")
    m = min(total, round(total * overlap))
    n = F.lit(max(total, 1))
    # k rows before position p are shared, k = ceil(p * m / n); p itself is when k * n / m falls on it
    before = F.floor((F.col(ordinal) * m + n - 1) / n)
    shared = (before < m) & (before * n < (F.col(ordinal) + 1) * m)
    names = F.array(*map(F.lit, labelers))
    turn = F.pmod(F.col(ordinal) - before, F.lit(len(labelers))).cast("int")
    rows = df.withColumn("_shared", shared)
    return rows.withColumn("labeler", F.explode(F.when(F.col("_shared"), names).otherwise(F.array(F.element_at(names, turn + 1))))).drop("_shared")


def farthest_points(df: DataFrame, key: str, item: str, x: str, y: str, k: int, centre: tuple[float, float]) -> DataFrame:
    """k items per key that lie far apart: first the one farthest from the centre, then always the one farthest from its
    nearest chosen item; the smaller item wins a tie. (key, item, rank).

    A round is an aggregation with partial sums per task; what grows in a row is the list of the k chosen items only.
    """

    def d2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)

    rows = df.select(F.col(key).alias("_k"), F.struct(F.col(item).alias("i"), F.col(x).alias("x"), F.col(y).alias("y")).alias("p"))
    far = lambda d: F.max_by("p", F.struct(d.alias("d"), (-F.col("p.i")).alias("i")))
    chosen = rows.groupBy("_k").agg(F.array(far(d2(F.col("p.x"), F.col("p.y"), F.lit(centre[0]), F.lit(centre[1])))).alias("c"))
    for _ in range(k - 1):
        held = chosen.select(F.col("_k").alias("_h"), "c")
        near = F.array_min(F.transform("c", lambda c: d2(F.col("p.x"), F.col("p.y"), c["x"], c["y"])))
        best = rows.join(held, F.col("_k").eqNullSafe(F.col("_h"))).groupBy("_k").agg(F.any_value("c").alias("c"), F.max(near).alias("d"), far(near).alias("b"))
        # no distance left: all items of the key lie on chosen ones
        chosen = best.select("_k", F.when(F.col("d") > 0, F.array_append("c", F.col("b"))).otherwise(F.col("c")).alias("c"))
    return chosen.select(F.col("_k").alias(key), F.posexplode("c").alias("rank", "p")).select(key, F.col("p.i").alias(item), (F.col("rank") + 1).alias("rank"))


def top_above(df: DataFrame, value: Column, least: float, order: list, n: int) -> DataFrame:
    """The first n rows by order among those of at least a value."""
    return df.where(value >= least).orderBy(*order).limit(n)
