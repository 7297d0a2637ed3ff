"""The SQLite day files as a data source: round trip, pushed bounds, days that are not opened."""

import datetime as dt
import sqlite3

import pytest
from pyspark.sql import functions as F

from trackloom.sources import day_files, tracks

UTC = dt.UTC


@pytest.fixture(scope="module")
def points(spark):
    rows = []
    for d in range(1, 5):
        for i in range(60):
            t = dt.datetime(2024, 1, d, tzinfo=UTC) + dt.timedelta(minutes=24 * i, microseconds=i)
            rows.append((f"CS{i % 3}", f"t{i % 7}", None if i % 4 else "B738", None, "BOS", t, 42 + i / 100, -71 - i / 100, None if i % 9 == 0 else 25_000.0 + 100 * i, 25_000.5))
    return spark.createDataFrame(rows, day_files.POINT).repartition(3)


@pytest.fixture(scope="module")
def folder(points, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("days"))
    day_files.write_day_files(points, path)
    return path


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_round_trip(spark, points, folder):
    assert rows_of(day_files.day_files(spark, folder)()) == rows_of(points)
    assert day_files.day_files(spark, folder)().columns == day_files.NAMES


def test_bounds_equal_those_of_plain_rows(spark, points, folder):
    since, until = dt.datetime(2024, 1, 2, 6, tzinfo=UTC), dt.datetime(2024, 1, 3, tzinfo=UTC)
    for bounds in ({}, {"since": since}, {"until": until}, {"since": since, "until": until, "box": (42.1, 42.4, -71.35, -71.0), "least_ft": 26_000.0}):
        assert rows_of(day_files.day_files(spark, folder)(**bounds)) == rows_of(tracks.bounded(points, **bounds))
    some = day_files.day_files(spark, folder)().where(F.col("transponder_id").isin("t1", "t2") & F.col("aircraft_type").isNotNull() & F.col("callsign").startswith("CS1"))
    assert rows_of(some) == rows_of(points.where("transponder_id in ('t1', 't2') and aircraft_type is not null and callsign like 'CS1%'"))


def test_days_outside_are_not_opened(spark, points, folder, tmp_path):
    """Files of other days are broken here: only a reader that leaves them shut gives rows."""
    path = str(tmp_path / "broken")
    day_files.write_day_files(points, path)
    kept = [f for f in (tmp_path / "broken").iterdir() if f.name.startswith("2024-01-03.")]
    for f in (tmp_path / "broken").iterdir():
        if f not in kept:
            f.write_bytes(b"no database")
    source = day_files.day_files(spark, path)
    got = source(dt.datetime(2024, 1, 3, tzinfo=UTC), dt.datetime(2024, 1, 4, tzinfo=UTC))
    assert got.count() == 60 and got.rdd.getNumPartitions() == len(kept)
    with pytest.raises(Exception, match="not a database"):
        source(dt.datetime(2024, 1, 3, tzinfo=UTC), dt.datetime(2024, 1, 4, 1, tzinfo=UTC)).count()


def test_bounds_are_pushed(spark, folder):
    """Bounds that a file answers leave the plan's Filter; a pattern stays there."""
    got = day_files.day_files(spark, folder)(dt.datetime(2024, 1, 2, tzinfo=UTC), None, (42.0, 43.0, -72.0, -71.0), 1_000.0)
    plan = got.where("callsign like '%S1'")._jdf.queryExecution().executedPlan().toString()
    filters = "".join(x for x in plan.splitlines() if "Filter" in x and "BatchScan" not in x)
    assert "EndsWith" in filters and not [c for c in ("time", "lat", "lon", "alt_ft") if c in filters]


def test_modes_times_and_parts(spark, points, tmp_path, monkeypatch):
    path = str(tmp_path / "modes")
    one = points.where("transponder_id = 't1'")
    day_files.write_day_files(one, path)
    day_files.write_day_files(one, path)
    assert day_files.day_files(spark, path)().count() == 2 * one.count()
    day_files.write_day_files(one.select("time", "lat"), path, "overwrite")
    again = day_files.day_files(spark, path)()
    assert again.count() == one.count() and again.where("lon is not null").count() == 0
    assert day_files.day_files(spark, str(tmp_path / "nothing"))().count() == 0
    assert not list((tmp_path / "modes").glob("_*"))
    with pytest.raises(Exception, match="without a time"):
        day_files.write_day_files(one.withColumn("time", F.lit(None).cast("timestamp")), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="do not fit"):
        day_files.write_day_files(one.withColumn("speed", F.lit(1)), str(tmp_path / "bad"))
    # a day of many points has several files, each of one day
    writer = day_files.Writer(str(tmp_path / "parts"), False, day_files.NAMES)
    monkeypatch.setattr(day_files, "FILE_POINTS", 25)
    rows = [r for r in points.where("to_date(time) = '2024-01-02'").orderBy("time").collect()]
    message = writer.write(iter(rows))
    assert len(message.files) == 3
    writer.abort([message])
    assert not list((tmp_path / "parts").iterdir())
    message = writer.write(iter(rows))
    writer.commit([message, None])
    counts = [sqlite3.connect(f).execute("select count(*) from points").fetchone()[0] for f in (tmp_path / "parts").iterdir()]
    assert sorted(counts) == [10, 25, 25]


def test_a_store_that_is_not_local(spark, points, folder, monkeypatch):
    """Without a local path a file is read from its bytes."""
    reader = day_files.Reader(folder)
    part = reader.partitions()[0]
    here = sum(b.num_rows for b in reader.read(part))
    monkeypatch.setattr(day_files.fs, "LocalFileSystem", type("Other", (), {}))
    monkeypatch.setattr(day_files, "located", lambda p: (day_files.fs.FileSystem.from_uri(f"file://{p}")))
    assert sum(b.num_rows for b in reader.read(part)) == here > 0
