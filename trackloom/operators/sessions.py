"""Smoothing, gap-split sessions and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.core import median_low, micros


def rolling_median_low(df: DataFrame, key: str, order: list[str], value: str, window: int, out: str = "smoothed") -> DataFrame:
    """Centred rolling lower median over `window` rows (odd), clipped at the ends; the identity for window <= 1."""
    if window <= 1:
        return df.withColumn(out, F.col(value))
    half = window // 2
    frame = Window.partitionBy(key).orderBy(*order).rowsBetween(-half, half)
    return df.withColumn(out, median_low(F.collect_list(value).over(frame)))


def split_on_gap(df: DataFrame, key: str, t: str, order: list[str], max_gap_s: float, out: str = "session") -> DataFrame:
    """Number sessions per key: a new one starts where the time since the row before is more than max_gap_s."""
    w = Window.partitionBy(key).orderBy(*order)
    gap = micros(t) - F.lag(micros(t)).over(w)
    return df.withColumn("_new", F.when(gap.isNull() | (gap > int(max_gap_s * 1e6)), 1).otherwise(0)).withColumn(out, F.sum("_new").over(w)).drop("_new")


def first_best(payload: str | Column, score: str, *tie: str) -> Column:
    """payload of the row with the largest score, the first by tie among equals."""
    return F.min_by(payload, F.struct(-F.col(score), *tie))


def episodes(df: DataFrame, key: str, t: str, tie: str, score: str, name: str, window: int, threshold: float, max_gap_s: float) -> DataFrame:
    """Smooth all rows, keep those at or over the threshold, split on gaps and summarise each session.

    The peak is the first row with the largest raw score; the name is that of the first kept row.
    """
    rows = rolling_median_low(df, key, [t, tie], score, window).where(F.col("smoothed") >= threshold)
    rows = split_on_gap(rows, key, t, [t, tie], max_gap_s)
    return rows.groupBy(key, "session").agg(
        F.min_by(name, F.struct(t, tie)).alias("first_name"),
        F.min(t).alias("onset"),
        F.max(t).alias("end"),
        F.max(score).alias("peak_score"),
        first_best(tie, score, t, tie).alias("peak_id"),
        F.count(F.lit(1)).alias("frame_count"),
    )


def crossings(df: DataFrame, key: str, t: str, tie: str, x: str, y: str, max_gap_s: float, least_s: float, least_span: float) -> DataFrame:
    """Gap-split runs that last least_s and whose points span least_span of the image: the diagonal of their extent."""
    rows = split_on_gap(df, key, t, [t, tie], max_gap_s)
    span = F.hypot(F.max(x) - F.min(x), F.max(y) - F.min(y))
    out = rows.groupBy(key, "session").agg(F.min(t).alias("onset"), F.max(t).alias("end"), F.count(F.lit(1)).alias("n"), span.alias("span"))
    return out.where((micros("end") - micros("onset") >= int(least_s * 1e6)) & (F.col("span") >= least_span))


def passes(df: DataFrame, key: str, t: str, tie: str, max_gap_s: float, least_s: float = 0.0, least_rows: int = 1) -> DataFrame:
    """Gap-split groups without a threshold, with their extent; short ones are left out."""
    rows = split_on_gap(df, key, t, [t, tie], max_gap_s)
    out = rows.groupBy(key, "session").agg(F.min(t).alias("onset"), F.max(t).alias("end"), F.count(F.lit(1)).alias("n"), F.min("value").alias("closest"), F.max("value").alias("farthest"))
    return out.where((micros("end") - micros("onset") >= int(least_s * 1e6)) & (F.col("n") >= least_rows))
