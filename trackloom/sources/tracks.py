"""Track sources: a source is a function of (since, until, box, least_ft) that returns points, one row each."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.geo import haversine_km
from trackloom.sources.files import TRAJECTORY

Source = Callable[..., DataFrame]
FLIGHT = ["callsign", "transponder_id", "aircraft_type", "orig", "dest"]


def _utc(t: dt.datetime) -> dt.datetime:
    return t.replace(tzinfo=dt.UTC) if t.tzinfo is None else t.astimezone(dt.UTC)


def utc_day(t: str | Column) -> Column:
    """The day in UTC of a TIMESTAMP, whatever the session time zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(t) / F.lit(86_400_000_000)).cast("int"))


def bounded(points: DataFrame, since=None, until=None, box: tuple | None = None, least_ft: float | None = None) -> DataFrame:
    """Points in [since, until), in (lat0, lat1, lon0, lon1) and from an altitude on, as comparisons that scans can take over."""
    if since is not None:
        points = points.where(F.col("time") >= F.lit(_utc(since)))
    if until is not None:
        points = points.where(F.col("time") < F.lit(_utc(until)))
    if box:
        points = points.where(F.col("lat").between(*box[:2]) & F.col("lon").between(*box[2:]))
    return points if least_ft is None else points.where(F.col("alt_ft") >= least_ft)


def write_day_store(points: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Points in one folder per UTC day, sorted by time in each file so that its row groups can be skipped."""
    rows = points.withColumn("day", utc_day("time"))
    rows.repartition("day", F.pmod(F.hash("transponder_id"), F.lit(16))).sortWithinPartitions("day", "time").write.mode(mode).partitionBy("day").parquet(path)


def day_store(spark: SparkSession, path: str) -> Source:
    """The store that write_day_store() leaves: other days are not read, and all bounds are pushed to the scan."""

    def fetch(since=None, until=None, box=None, least_ft=None) -> DataFrame:
        rows = spark.read.parquet(path)
        if since is not None:
            rows = rows.where(F.col("day") >= F.lit(_utc(since).date()))
        if until is not None:
            rows = rows.where(F.col("day") <= F.lit((_utc(until) - dt.timedelta(microseconds=1)).date()))
        return bounded(rows, since, until, box, least_ft).drop("day")

    return fetch


def recorded(spark: SparkSession, path: str, lines: bool = False) -> Source:
    """A recording as JSON, replayed as it is: the bounds are left to the reader. lines: one trajectory per line, not one array."""

    def fetch(since=None, until=None, box=None, least_ft=None) -> DataFrame:
        rows = spark.read.schema(TRAJECTORY).option("multiLine", not lines).json(path)
        return rows.select(*FLIGHT, F.explode("points").alias("p")).select(*FLIGHT, "p.*")

    return fetch


def around(source: Source, since, until, lat: float, lon: float, radius_km: float, least_ft: float, most_ft: float | None = None) -> DataFrame:
    """Points of any source near a site: the box of the radius goes to the source, all bounds are checked again after it."""
    import math

    dlat = radius_km / 111.0
    dlon = radius_km / (111.0 * max(0.01, math.cos(math.radians(lat))))
    box = (lat - dlat, lat + dlat, lon - dlon, lon + dlon)
    rows = bounded(source(since, until, box, least_ft), since, until, box, least_ft)
    if most_ft is not None:
        rows = rows.where(F.col("alt_ft") <= most_ft)
    return rows.where(haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) <= radius_km)


def nested(points: DataFrame) -> DataFrame:
    """One row per aircraft with its points by time; an aircraft without points has no row. Bound the time first."""
    rest = [c for c in points.columns if c not in FLIGHT and c != "time"]
    return points.groupBy(*FLIGHT).agg(F.array_sort(F.collect_list(F.struct("time", *rest))).alias("points"))


def write_tracks(points: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nested trajectories as JSON, one per line; recorded(lines=True) reads them."""
    nested(points).write.mode(mode).json(path)


def dated_file(spark: SparkSession, root: str, template: str, day: dt.date) -> str:
    """The file that a template such as "{date:%Y_%m_%d}_*.mp4" names under root: itself, else the first match of the pattern."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{template.format(date=day)}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        return path.toString()
    found = sorted(s.getPath().toString() for s in fs.globStatus(path) or [])
    if not found:
        raise FileNotFoundError(path.toString())
    return found[0]


def anchor(frames: DataFrame, index: str = "frame_idx", first: int = 0) -> DataFrame:
    """The row of the first frame, or none: the filter reaches the scan and reading stops at one row."""
    return frames.where(F.col(index) == first).limit(1)
