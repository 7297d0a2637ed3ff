"""Small inputs that steer a job: settings by section, array files, and the table of episodes."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ModuleNotFoundError:  # JSON is read without it
    yaml = None

#: Columns of the table of episodes and labels; an episode has a row per labeler, and one row while nobody has labelled it.
EPISODE = (
    "row_id bigint, episode_id bigint, callsign string, transponder_id string, onset timestamp, end_time timestamp, frame_count bigint, peak_score double, "
    "peak_line_x1 double, peak_line_y1 double, peak_line_x2 double, peak_line_y2 double, peak_contrail_length_m double, "
    "label string, persistence_rating int, persistence string, measurement_km double, labeler_id string, label_timestamp timestamp, label_notes string, date string"
)


def read_settings(spark: SparkSession, path: str, known: dict[str, dict]) -> dict[str, dict]:
    """Sections with their defaults, overridden by the known fields of a YAML or JSON file; what is not known is passed over."""
    text = spark.read.text(path, wholetext=True).first()[0]
    raw = (yaml.safe_load(text) if yaml else json.loads(text)) or {}
    return {s: fields | {k: v for k, v in (raw.get(s) or {}).items() if k in fields} for s, fields in known.items()}


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, shape, values) of every numeric array in NPZ files; pickled objects are refused."""

    def parts(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    yield pd.DataFrame([(p, n, list(z[n].shape), z[n].astype(float).ravel()) for n in z.files], columns=["path", "name", "shape", "values"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parts, "path string, name string, shape array<long>, values array<double>")


def write_arrays(spark: SparkSession, path: str, **arrays) -> None:
    """A few small arrays as one NPZ file on any file system that Spark reaches."""
    import numpy as np

    data = io.BytesIO()
    np.savez(data, **arrays)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data.getvalue()))
    finally:
        out.close()


def create_episodes(spark: SparkSession, table: str, schema: str = EPISODE, by: str = "date") -> None:
    """The table, if it isn't there; columns that an older table lacks are added."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet PARTITIONED BY ({by})")
    have = set(spark.table(table).columns)
    want = spark.createDataFrame([], schema).schema
    new = [f"`{f.name}` {f.dataType.simpleString()}" for f in want if f.name not in have]
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(new)})")


def insert_episodes(fresh: DataFrame, table: str, order: list[str], bucket: str = "date") -> None:
    """Append rows with ids that go on from the largest one, in order inside a bucket; missing columns are null.

    One run at a time, as with any table without transactions.
    """
    from trackloom.functions.core import ordinals

    spark = fresh.sparkSession
    target = spark.table(table).schema
    last = spark.table(table).agg(F.coalesce(F.max("episode_id"), F.lit(0))).first()[0]
    rows = ordinals(fresh, bucket, order, "_nth").withColumn("episode_id", F.col("_nth") + last)
    if "row_id" in target.names:
        rows = rows.withColumn("row_id", F.col("_nth") + spark.table(table).agg(F.coalesce(F.max("row_id"), F.lit(0))).first()[0])
    cols = [(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target]
    rows.select(*cols).write.insertInto(table)
