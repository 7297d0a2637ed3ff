"""Track points in one SQLite file per UTC day, read and written as a Spark data source with pushed bounds."""

from __future__ import annotations

import datetime as dt
import re
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from trackloom.sources.tracks import Source, bounded, utc_day

#: Short name of the format, and the columns of its files; times are microseconds since 1970 in the files.
FORMAT = "sqlite_days"
POINT = "callsign string, transponder_id string, aircraft_type string, orig string, dest string, time timestamp, lat double, lon double, alt_ft double, alt_gnss_ft double"
NAMES = [c.split()[0] for c in POINT.split(", ")]
#: Points in a file at most; a day with more has several files.
FILE_POINTS = 1_000_000
BATCH = 8_192
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
DAY_FILE = re.compile(r"(\d{4}-\d\d-\d\d)\.[0-9a-z-]+\.sqlite$")
#: Comparisons that a file answers itself.
SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _micros(t: dt.datetime) -> int:
    return ((t if t.tzinfo else t.replace(tzinfo=dt.UTC)) - EPOCH) // dt.timedelta(microseconds=1)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path inside it; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def opened(path: str) -> sqlite3.Connection:
    """A day file, read only: in place if it is local, else from its bytes."""
    store, inside = located(path)
    if isinstance(store, fs.LocalFileSystem):
        return sqlite3.connect(f"file:{quote(inside)}?mode=ro", uri=True)
    with store.open_input_file(inside) as f:
        db = sqlite3.connect(":memory:")
        db.deserialize(f.read())
        return db


@dataclass
class DayFile(InputPartition):
    path: str


class Reader(DataSourceReader):
    """One partition per day file; bounds become a WHERE of the file, and bounds of time choose the files."""

    def __init__(self, path: str):
        self.path, self.where, self.values = path, [], []
        self.first, self.last = dt.date.min, dt.date.max

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name not in NAMES:
                yield f
            elif isinstance(f, IsNotNull):
                self.where.append(f"{name} IS NOT NULL")
            elif isinstance(f, In):
                self.where.append(f"{name} IN ({', '.join('?' * len(f.value))})")
                self.values += [_micros(v) if name == "time" else v for v in f.value]
            elif type(f) in SIGNS:
                self.where.append(f"{name} {SIGNS[type(f)]} ?")
                self.values.append(_micros(f.value) if name == "time" else f.value)
                if name == "time":
                    self._bound(f, self.values[-1])
            else:
                yield f

    def _bound(self, f: Filter, t: int) -> None:
        if not isinstance(f, (LessThan, LessThanOrEqual)):
            self.first = max(self.first, (EPOCH + dt.timedelta(microseconds=t)).date())
        if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.last = min(self.last, (EPOCH + dt.timedelta(microseconds=t - isinstance(f, LessThan))).date())

    def partitions(self) -> list[DayFile]:
        store, inside = located(self.path)
        found = []
        for info in store.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
            m = DAY_FILE.search(info.base_name)
            if m and self.first <= dt.date.fromisoformat(m[1]) <= self.last:
                found.append(DayFile(f"{self.path.rstrip('/')}/{info.base_name}"))
        return sorted(found, key=lambda p: p.path)

    def read(self, partition: DayFile | None) -> Iterator[pa.RecordBatch]:
        kinds = [pa.timestamp("us", "UTC") if n == "time" else pa.float64() if " double" in c else pa.string() for n, c in zip(NAMES, POINT.split(", "))]
        if partition is None:  # no day is left
            return
        query = f"SELECT {', '.join(NAMES)} FROM points" + (" WHERE " + " AND ".join(self.where) if self.where else "")
        with closing(opened(partition.path)) as db:
            rows = db.execute(query, self.values)
            while some := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds)], NAMES)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    """Files get their names when the whole job ends well, so a lost task leaves no day half written."""

    def __init__(self, path: str, overwrite: bool, names: list[str]):
        self.path, self.overwrite, self.names = path.rstrip("/"), overwrite, names

    def write(self, iterator: Iterator) -> Written:
        store, inside = located(self.path)
        store.create_dir(inside, recursive=True)
        done, day, rows = [], None, []

        def flush() -> None:
            name = f"{day}.{uuid.uuid4().hex}.sqlite"
            with closing(sqlite3.connect(":memory:")) as db:
                db.execute(f"CREATE TABLE points ({', '.join(f'{n} INTEGER' if n == 'time' else n for n in NAMES)})")
                db.executemany(f"INSERT INTO points VALUES ({', '.join('?' * len(NAMES))})", rows)
                db.execute("CREATE INDEX by_time ON points (time)")
                db.commit()
                with store.open_output_stream(f"{inside}/_{name}.part") as f:
                    f.write(db.serialize())
            done.append((f"_{name}.part", name))
            rows.clear()

        for row in iterator:
            if row["time"] is None:
                raise ValueError("a point without a time belongs to no day")
            t = _micros(row["time"])
            now = (EPOCH + dt.timedelta(microseconds=t)).date()
            if rows and (now != day or len(rows) == FILE_POINTS):
                flush()
            day = now
            rows.append([t if n == "time" else row[n] if n in self.names else None for n in NAMES])
        if rows:
            flush()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, inside = located(self.path)
        old = store.get_file_info(fs.FileSelector(inside, allow_not_found=True)) if self.overwrite else []
        for part, name in (x for m in messages if m for x in m.files):
            store.move(f"{inside}/{part}", f"{inside}/{name}")
        for info in old:
            if DAY_FILE.search(info.base_name):
                store.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, inside = located(self.path)
        for part, _ in (x for m in messages if m for x in m.files):
            store.delete_file(f"{inside}/{part}")


class SqliteDays(DataSource):
    """Option path: the folder of day files."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return POINT

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        missing = {"time"} - set(schema.names) or set(schema.names) - set(NAMES)
        if missing:
            raise ValueError(f"columns do not fit points: {sorted(missing)}")
        return Writer(self.options["path"], overwrite, schema.names)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let Spark hand bounds to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteDays)


def write_day_files(points: DataFrame, path: str, mode: str = "append") -> None:
    """points (of POINT, time and any others of its columns) as files of one UTC day each; overwrite replaces all days."""
    register(points.sparkSession)
    day = utc_day("time")
    # sorted by day, a task writes one file after the other; a large day is dealt over several tasks
    rows = points.withColumn("_day", day).repartition("_day", "transponder_id").sortWithinPartitions("_day", "time").drop("_day")
    rows.write.format(FORMAT).mode(mode).option("path", path).save()


def day_files(spark: SparkSession, path: str) -> Source:
    """The day files as a track source: days outside of the bounds are not opened, the other bounds are asked of each file."""
    register(spark)

    def fetch(since=None, until=None, box=None, least_ft=None) -> DataFrame:
        return bounded(spark.read.format(FORMAT).load(path), since, until, box, least_ft)

    return fetch
