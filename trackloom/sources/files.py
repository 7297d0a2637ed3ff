"""Sources and sinks: JSON lines, nested documents, label exports, partition rewrites, reports."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.sources.shared import written

DETECTION = "wall_time_utc timestamp, callsign string, transponder_id string, score double, pixel_line array<double>, method string, num_long_lines int, aligned_lines int, contrail_length_px double, contrail_length_grown_px double, contrail_length_m double"
TRAJECTORY = "callsign string, transponder_id string, aircraft_type string, orig string, dest string, points array<struct<time:timestamp,lat:double,lon:double,alt_ft:double,alt_gnss_ft:double>>"


def read_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines by an explicit schema; tolerant leaves out malformed rows instead of failing on them."""
    if not tolerant:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = spark.read.text(path).where(F.trim("value") != "")
    rows = rows.select(F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """Columns in the given order with a header, also when there are no rows."""
    df.select(*columns).write.mode(mode).option("header", True).csv(path)


def write_manifests(df: DataFrame, path: str, owner: str, order: list[str]) -> None:
    """One JSON document per owner with its rows in order, in a folder of its own."""
    rest = [c for c in df.columns if c != owner]
    docs = df.groupBy(owner).agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*order, *[c for c in rest if c not in order]))).alias("episodes"))).alias("value"))
    docs.write.mode("overwrite").partitionBy(owner).text(path)


def replace_open_rows(spark: SparkSession, path: str, fresh: DataFrame, day: str, labeler: str = "labeler_id", date: str = "date") -> None:
    """Rewrite one day's partition: labelled rows stay, open ones give way to fresh. The old partition is read whole first.

    With neither labelled rows nor fresh ones the day's partition is removed.
    """
    old = spark.read.parquet(path).where((F.col(date) == day) & F.col(labeler).isNotNull())
    new = old.unionByName(fresh.withColumn(date, F.lit(day).cast(old.schema[date].dataType)), allowMissingColumns=True)
    rows = written(new, "open-rows")
    if rows.isEmpty():
        # a dynamic overwrite without rows replaces nothing
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{date}={day}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    else:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def index_page(dates: DataFrame, title: str, most: int = 5_000) -> str:
    """Published dates (date, episodes, detected, labelers) as an HTML list, newest first; more than `most` are refused."""
    rows = dates.orderBy(F.col("date").desc()).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} dates; give a later start")
    item = lambda r: f'  <li><a href="{escape(r["date"])}/">{escape(r["date"])}</a> {r["episodes"]} episodes, {r["detected"]} detected' + (f", labelled by {escape(r['labelers'])}" if r["labelers"] else "") + "</li>"
    return "\n".join([f"<!doctype html><title>{escape(title)}</title>", f"<h1>{escape(title)}</h1>", "<ul>", *map(item, rows), "</ul>", ""])


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A small result as a Markdown table; a result with more rows than `most` is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; aggregate first")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"
