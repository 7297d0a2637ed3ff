"""Label exports: strict types with the place of the error, and ingestion into the episode table, all or none."""

import datetime as dt
import json

import pytest

from trackloom.operators import exports
from trackloom.sources import settings

DAY = "2026-04-08"


def export(labels=None, **more):
    return {"schema_version": 1, "date": DAY, "labeler_id": "ann", "labels": [{"episode_id": 1, "label": "contrail"}] if labels is None else labels} | more


def one(**fields):
    return export([{"episode_id": 1, "label": "contrail"}, {"episode_id": 2, "label": "unsure"} | fields])


CASES = [
    (export(), None),
    (export([]), None),
    (export(exported_at="x", measurements=[1]), None),
    (one(labeler_id="ann", persistence_rating=4, persistence="short", measurement_km=3, label_timestamp="2026-04-13T12:34:50.000Z", label_notes="clear"), None),
    (one(persistence_rating=None, persistence=None, measurement_km=None, label_timestamp=None, label_notes=None), None),
    (one(measurement_km=2.5), None),
    (one(label_timestamp="2026-04-13 12:34+02:00"), None),
    (export(schema_version=2), "schema_version"),
    (export(schema_version="1"), "schema_version"),
    (export(schema_version=1.0), None),
    (export(date="2026-04-09"), "date"),
    (export(date=20260408), "date"),
    (export(date="2026-13-40"), "date: no date"),
    (export(labeler_id=""), "labeler_id"),
    (export(labeler_id=7), "labeler_id"),
    (export(labels={}), "labels:"),
    ([1], "top level"),
    (one(episode_id=True), "labels[1].episode_id: no whole"),
    (one(episode_id=2.0), "labels[1].episode_id: no whole"),
    (one(episode_id="2"), "labels[1].episode_id: no whole"),
    (one(episode_id=1), "labels[1].episode_id: twice"),
    (one(label="bird"), 'labels[1].label: no known label: "bird"'),
    (one(label=None), "labels[1].label"),
    (one(labeler_id="bob"), "labels[1].labeler_id"),
    (one(labeler_id=None), "labels[1].labeler_id"),
    (one(persistence_rating=0), "labels[1].persistence_rating"),
    (one(persistence_rating=6), "labels[1].persistence_rating"),
    (one(persistence_rating=True), "labels[1].persistence_rating"),
    (one(persistence_rating=3.0), "labels[1].persistence_rating"),
    (one(persistence="forever"), "labels[1].persistence:"),
    (one(measurement_km="12"), "labels[1].measurement_km"),
    (one(measurement_km=True), "labels[1].measurement_km"),
    (one(label_timestamp="2026-04-13T12:34:50"), "labels[1].label_timestamp"),
    (one(label_timestamp="2026-04-33T12:34:50Z"), "labels[1].label_timestamp"),
    (one(label_timestamp=5), "labels[1].label_timestamp"),
    (one(label_notes=5), "labels[1].label_notes"),
    (export([{"episode_id": 1, "label": "x"}, {"episode_id": True}]), "labels[0].label"),
    (export(["a"]), "labels[0]: no object"),
]


def test_validation(spark):
    rows = [(i, json.dumps(p)) for i, (p, _) in enumerate(CASES)] + [(1_000, "{not json"), (1_001, None), (1_002, "")]
    got = {r["i"]: r for r in exports.validated(spark.createDataFrame(rows, "i int, payload string").repartition(3), "payload", DAY).collect()}
    for i, (p, want) in enumerate(CASES):
        error = got[i]["error"]
        assert (error is None) == (want is None) and (want is None or error.startswith(want)), (p, error)
        assert (got[i]["labels"] is None) == (error is not None)
    assert all(got[i]["error"] == "not valid JSON" for i in (1_000, 1_001, 1_002))


def test_records_are_normalised(spark):
    p = one(persistence_rating=4, persistence="short", measurement_km=3, label_timestamp="2026-04-13T12:34:50.5+02:00", label_notes="", odd=1)
    r = exports.validated(spark.createDataFrame([(json.dumps(p),)], "payload string"), "payload", DAY).first()["labels"][1]
    assert (r["episode_id"], r["label"], r["persistence_rating"], r["persistence"], r["measurement_km"], r["labeler_id"], r["label_notes"]) == (2, "unsure", 4, "short", 3.0, "ann", None)
    at = exports.validated(spark.createDataFrame([(json.dumps(p),)], "payload string"), "payload", DAY).selectExpr("unix_millis(labels[1].label_timestamp) as t").first()["t"]
    assert at == int(dt.datetime(2026, 4, 13, 10, 34, 50, 500_000, tzinfo=dt.UTC).timestamp() * 1_000)


@pytest.fixture
def table(spark, tmp_path):
    name = "labelled_episodes"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({settings.EPISODE}) USING parquet PARTITIONED BY (date) LOCATION '{tmp_path / 't'}'")
    t = dt.datetime(2026, 4, 8, 12)
    fresh = [(f"CS{i}", f"t{i}", t + dt.timedelta(minutes=i), 0.5, 100.0 + i, d) for d in (DAY, "2026-04-09") for i in range(3)]
    settings.insert_episodes(spark.createDataFrame(fresh, "callsign string, transponder_id string, onset timestamp, peak_score double, peak_contrail_length_m double, date string"), name, ["onset"])
    yield name
    spark.sql(f"DROP TABLE {name}")


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, p in files.items():
        (folder / f"{name}.json").write_text(json.dumps(p, indent=1))
    return str(folder)


def rows(spark, table):
    cols = "row_id, episode_id, callsign, label, labeler_id, persistence, peak_contrail_length_m, date"
    return sorted((tuple(r) for r in spark.sql(f"SELECT {cols} FROM {table}").collect()), key=str)


def test_ingestion(spark, table, tmp_path):
    before = rows(spark, table)
    assert [r[:3] for r in before] == [(i + 1, i + 1, f"CS{i % 3}") for i in range(6)]
    a = export([{"episode_id": 1, "label": "contrail", "persistence": "short"}, {"episode_id": 2, "label": "unsure"}, {"episode_id": 77, "label": "unsure"}])
    b = export([{"episode_id": 1, "label": "no_contrail"}], labeler_id="bob")
    assert exports.ingest(spark, table, write(tmp_path / "one", a=a, b=b), DAY) == {"ann": 3, "bob": 1}
    got = rows(spark, table)
    # the first labeler takes the open row; the other's copy has an id of its own and no length
    assert got == sorted([(1, 1, "CS0", "contrail", "ann", "short", 100.0, DAY), (7, 1, "CS0", "no_contrail", "bob", None, None, DAY), (2, 2, "CS1", "unsure", "ann", None, 101.0, DAY), *before[2:]], key=str)
    # relabelling is in place, and takes the values of the last label
    again = export([{"episode_id": 1, "label": "unsure"}, {"episode_id": 3, "label": "contrail"}])
    exports.ingest(spark, table, write(tmp_path / "two", a=again), DAY)
    assert rows(spark, table) == sorted([(1, 1, "CS0", "unsure", "ann", None, 100.0, DAY), (7, 1, "CS0", "no_contrail", "bob", None, None, DAY), (2, 2, "CS1", "unsure", "ann", None, 101.0, DAY), (3, 3, "CS2", "contrail", "ann", None, 102.0, DAY), *before[3:]], key=str)


def test_one_bad_file_stops_all(spark, table, tmp_path):
    before = rows(spark, table)
    folder = write(tmp_path / "mixed", a=export(), b=export([{"episode_id": 2, "label": "bird"}], labeler_id="bob"), c=export(date="2026-04-10"))
    with pytest.raises(ValueError, match=r"b\.json: labels\[0\]\.label: .*c\.json: date"):
        exports.ingest(spark, table, folder, DAY)
    assert rows(spark, table) == before
