"""Column helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def micros(t: str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP or TIMESTAMP_NTZ column, whatever the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({t} as timestamp_ntz))")


def nan_last(x: str | Column) -> Column:
    """Sort key that puts NaN and null behind every number, descending."""
    return F.coalesce(F.nanvl(col(x), F.lit(float("-inf"))), F.lit(float("-inf"))).desc()


def truthy(*values: str | Column) -> Column:
    """The first value that is neither null nor zero, else zero."""
    return F.coalesce(*[F.nullif(col(v), F.lit(0)) for v in values], F.lit(0))


def half_buckets(total: Column, k: int, start: float = 0.0, end: float = 1.0) -> Column:
    """The middles of k equal parts of the positions from start * total to end * total, rounded half to even."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(total * start + (i + 0.5) * (total * (end - start)) / k).cast("long"))


def median_low(values: str | Column) -> Column:
    """Lower median of an array."""
    return F.get(F.array_sort(col(values)), F.floor((F.size(col(values)) - 1) / 2).cast("int"))


def median_high(values: str | Column) -> Column:
    """Upper median of an array."""
    return F.get(F.array_sort(col(values)), F.floor(F.size(col(values)) / 2).cast("int"))


def ordinals(df: DataFrame, bucket: str | Column, order: list, out: str = "ordinal") -> DataFrame:
    """1..N in the order of (bucket, *order) without one global window: counts per bucket first, then ranks inside one.

    bucket must not decrease along order; order must be total for a deterministic result.
    """
    rows = df.withColumn("_bucket", col(bucket))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    rows = rows.join(counts, F.col("_bucket").eqNullSafe(F.col("_b")))
    return rows.withColumn(out, (F.col("_before") + F.col("_rank")).cast("long")).drop("_bucket", "_b", "_before", "_rank", "_n")
