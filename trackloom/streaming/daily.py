"""What a daily run has to do: days not yet published whose input is there, large enough and at rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_actions(inputs: DataFrame, published: DataFrame, today: Column, lookback: int, now_s: Column, least_bytes: int, stable_s: int, force: bool = False) -> DataFrame:
    """(date, action) of today and the days before it, lookback in all.

    inputs has (date, bytes, modified_s), published (date). action is the first that holds of published (not with force),
    missing, small, unstable (modified less than stable_s ago), else due. Days that failed before come up again while they
    lie in the lookback.
    """
    spark = inputs.sparkSession
    days = spark.range(lookback).select(F.date_sub(today, F.col("id").cast("int")).alias("date"))
    done = published.select("date").distinct().withColumn("_done", F.lit(not force))
    files = inputs.groupBy("date").agg(F.max(F.struct("modified_s", "bytes")).alias("f"))
    rows = days.join(files, "date", "left").join(done, "date", "left")
    action = F.when(F.col("_done"), "published").when(F.col("f").isNull(), "missing").when(F.col("f.bytes") < least_bytes, "small")
    return rows.select("date", action.when(now_s - F.col("f.modified_s") < stable_s, "unstable").otherwise("due").alias("action"))
