"""Upsampling, buckets, thinning and row-to-row operators."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsample(df: DataFrame, key: str, step: str, values: list[str], most: int, carry: list[str] = ()) -> DataFrame:
    """Fill gaps of more than one and less than `most` steps by linear interpolation between a row and the next.

    step is an integer column, unique per key. A value is null inside a gap unless both of its ends are not null; carried
    columns come from the earlier row. filled tells new rows.
    """
    w = Window.partitionBy(key).orderBy(step)
    rows = df.select(key, step, *values, *carry, (F.lead(step).over(w) - F.col(step)).alias("_gap"), *[F.lead(v).over(w).alias(f"_next_{v}") for v in values])
    inside = (F.col("_gap") > 1) & (F.col("_gap") < most)
    rows = rows.withColumn("_k", F.explode(F.when(inside, F.sequence(F.lit(0).cast("long"), F.col("_gap") - 1)).otherwise(F.array(F.lit(0).cast("long")))))
    lerp = [F.when(F.col("_k") == 0, F.col(v)).otherwise(F.col(v) + F.col("_k") / F.col("_gap") * (F.col(f"_next_{v}") - F.col(v))).alias(v) for v in values]
    return rows.select(key, (F.col(step) + F.col("_k")).alias(step), *lerp, *carry, (F.col("_k") > 0).alias("filled"))


def thin(df: DataFrame, key: str, t: str, step: float, payload: list[str]) -> DataFrame:
    """Greedy thinning of each key's rows in order of t: a row stays if it is the first, the last, or `step` after the last kept one.

    A key's sorted rows stream through one task, which holds the time of the last kept row and the row it saw last.
    """
    rows = df.select(key, t, *payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, due, held = object(), None, None
        for batch in chain(batches, [None]):
            # places of the batch that stay; the last row seen may be of the batch before
            stay, last = [], None
            for i, (k, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if batch else ()):
                new = k != now
                if new and last is not None:
                    stay.append(last)
                elif new and held is not None:
                    yield held
                if new or at >= due:
                    stay.append(i)
                    now, due, held, last = k, at + step, None, None
                else:
                    held, last = None, i
            if batch is None and held is not None:
                yield held
            if stay:
                yield batch.take(pa.array(stay, pa.int64()))
            if last is not None:
                held = batch.slice(last, 1)

    return rows.where(F.col(t).isNotNull()).repartition(key).sortWithinPartitions(key, t, *payload).mapInArrow(run, rows.schema)


def guarded_delta(df: DataFrame, key: str, order: list[str], value: str, ok: str, out: str = "delta") -> DataFrame:
    """value minus that of the row before, where both reads are good; a failed read breaks the chain for the next row too."""
    w = Window.partitionBy(key).orderBy(*order)
    good = F.when(F.col(ok), F.col(value))
    return df.withColumn(out, good - F.lag(good).over(w))


def previous(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Columns of the row before, as prev_<name>."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns])


def n_grams(df: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """How often each run of n values occurs along the order."""
    w = Window.partitionBy(key).orderBy(*order)
    parts = [F.lead(value, i).over(w).alias(f"_{i}") for i in range(n)]
    runs = df.select(*parts).where(F.col(f"_{n - 1}").isNotNull())
    return runs.groupBy(F.concat_ws(">", *[F.col(f"_{i}").cast("string") for i in range(n)]).alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def rollover(df: DataFrame, key: str, order: list[str], second: str, half: int = 43_200, out: str = "day_offset") -> DataFrame:
    """Running count of midnights: the second of the day falls by more than half a day."""
    w = Window.partitionBy(key).orderBy(*order)
    fell = F.when(F.col(second) + half < F.lag(second).over(w), 1).otherwise(0)
    return df.withColumn("_fell", fell).withColumn(out, F.sum("_fell").over(w).cast("long")).drop("_fell")
