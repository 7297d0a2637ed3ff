"""Gap sessions over a stream, and an incremental run over what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(stream: DataFrame, key: str, t: str, score: str, tie: str, threshold: float, gap_s: int, late: str = "1 hour") -> DataFrame:
    """Sessions of rows over the threshold: closed when the watermark is a gap past the last row; later rows are dropped.

    session_window merges rows that are exactly a gap apart, as the batch form does; its own end is not used.
    """
    kind = dict(stream.dtypes)[t]  # a watermark needs TIMESTAMP
    kept = stream.where(F.col(score) >= threshold).withColumn(t, F.col(t).cast("timestamp")).withWatermark(t, late)
    best = F.min_by(tie, F.struct(-F.col(score), t, tie))
    out = kept.groupBy(key, F.session_window(t, f"{gap_s} seconds")).agg(F.min(t).cast(kind).alias("onset"), F.max(t).cast(kind).alias("end"), F.max(score).alias("peak_score"), best.alias("peak_id"), F.count(F.lit(1)).alias("frame_count"))
    return out.drop("session_window")


def run_available(df: DataFrame, path: str, checkpoint: str):
    """Write all that is new since the last run as Parquet; what was done stays done."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
