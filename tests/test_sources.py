"""Track sources, settings, arrays, the episode table and daily runs."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import joins, sampling, timeseries
from trackloom.sources import files, settings, tracks
from trackloom.streaming.daily import daily_actions

POINT = "callsign string, transponder_id string, aircraft_type string, orig string, dest string, time timestamp, lat double, lon double, alt_ft double, alt_gnss_ft double"


def at(day, hour=0, minute=0):
    return dt.datetime(2026, 4, day, hour, minute, tzinfo=dt.UTC)


@pytest.fixture
def points(spark):
    rows = [("A1", "a", None, None, None, at(d, h), 42.0 + h / 100, -71.0, 30_000.0 + h, None) for d in (8, 9, 10) for h in (0, 12, 23)]
    rows += [("B2", "b", "B738", "BOS", "LHR", at(9, 12), 48.0, -71.0, 35_000.0, 35_100.0)]
    return spark.createDataFrame(rows, POINT)


def test_day_store_prunes_days_and_pushes_bounds(spark, points, tmp_path, capsys):
    path = str(tmp_path / "store")
    tracks.write_day_store(points, path)
    got = tracks.day_store(spark, path)(at(9), at(10), (41.0, 43.0, -72.0, -70.0), 30_001.0)
    assert sorted(r["alt_ft"] for r in got.collect()) == [30_012.0, 30_023.0]
    capsys.readouterr()
    got.explain("formatted")
    plan = capsys.readouterr().out.splitlines()
    pushed = next(x for x in plan if x.startswith("PushedFilters"))
    assert all(c in pushed for c in ("GreaterThanOrEqual(time", "LessThan(time", "(lat", "(lon", "GreaterThanOrEqual(alt_ft"))
    assert "day" in next(x for x in plan if x.startswith("PartitionFilters"))


def test_every_source_gives_the_same_tracks(spark, points, tmp_path):
    tracks.write_day_store(points, str(tmp_path / "store"))
    tracks.write_tracks(points, str(tmp_path / "json"))
    ask = (at(8, 12), at(10, 12), 42.0, -71.0, 50.0, 30_000.0, 30_020.0)
    out = []
    for source in (tracks.day_store(spark, str(tmp_path / "store")), tracks.recorded(spark, str(tmp_path / "json"), lines=True), lambda *_: points):
        rows = tracks.nested(tracks.around(source, *ask)).collect()
        out.append([(r["transponder_id"], [(p["time"], p["alt_ft"]) for p in r["points"]]) for r in rows])
    assert out[0] == out[1] == out[2]
    # the end of the time is left out, 23 hours are too high and the other aircraft is too far away
    assert out[0] == [("a", [(dt.datetime(2026, 4, d, h), 30_000.0 + h) for d, h in ((8, 12), (9, 0), (9, 12), (10, 0))])]


def test_recording_ignores_bounds_and_empty_stores_work(spark, points, tmp_path):
    tracks.write_tracks(points, str(tmp_path / "json"))
    assert tracks.recorded(spark, str(tmp_path / "json"), lines=True)(at(1), at(2), (0.0, 1.0, 0.0, 1.0), 1e9).count() == 10
    assert tracks.nested(points.limit(0)).count() == 0
    assert tracks.anchor(points.withColumn("frame_idx", F.lit(3))).count() == 0


def test_dated_file_prefers_the_exact_name(spark, tmp_path):
    for n in ("2026_04_08_b.mp4", "2026_04_08_a.mp4"):
        (tmp_path / n).write_text("")
    day = dt.date(2026, 4, 8)
    assert tracks.dated_file(spark, str(tmp_path), "{date:%Y_%m_%d}_b.mp4", day).endswith("_b.mp4")
    assert tracks.dated_file(spark, str(tmp_path), "{date:%Y_%m_%d}_*.mp4", day).endswith("_a.mp4")
    with pytest.raises(FileNotFoundError):
        tracks.dated_file(spark, str(tmp_path), "{date:%Y}.avi", day)


def test_settings_keep_known_fields_only(spark, tmp_path):
    (tmp_path / "s.yaml").write_text('{"detection": {"low": 3, "odd": 1}, "other": {"x": 1}, "ocr": null}')
    got = settings.read_settings(spark, str(tmp_path / "s.yaml"), {"detection": {"low": 1, "high": 9}, "ocr": {"least": 0.5}})
    assert got == {"detection": {"low": 3, "high": 9}, "ocr": {"least": 0.5}}


def test_arrays_round_trip(spark, tmp_path):
    np = pytest.importorskip("numpy")
    mask, k = np.arange(6).reshape(2, 3) % 2 == 0, np.array([1.5, -2.0])
    settings.write_arrays(spark, str(tmp_path / "a.npz"), mask=mask, k=k)
    got = {r["name"]: (r["shape"], r["values"]) for r in settings.read_arrays(spark, str(tmp_path / "*.npz")).collect()}
    assert got == {"mask": ([2, 3], [1.0, 0.0, 1.0, 0.0, 1.0, 0.0]), "k": ([2], [1.5, -2.0])}


def test_episode_table_grows_and_is_migrated(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS grown_episodes")
    spark.sql(f"CREATE TABLE grown_episodes (episode_id bigint, callsign string, date string) USING parquet PARTITIONED BY (date) LOCATION '{tmp_path / 'e'}'")
    settings.create_episodes(spark, "grown_episodes")
    fresh = spark.createDataFrame([("y", at(9), "2026-04-09"), ("x", at(8), "2026-04-08")], "callsign string, onset timestamp, date string")
    settings.insert_episodes(fresh, "grown_episodes", ["onset"])
    settings.insert_episodes(fresh, "grown_episodes", ["onset"])
    got = [(r["episode_id"], r["callsign"], r["label"]) for r in spark.table("grown_episodes").orderBy("episode_id").collect()]
    spark.sql("DROP TABLE grown_episodes")
    assert got == [(1, "x", None), (2, "y", None), (3, "x", None), (4, "y", None)]


def test_daily_actions_in_their_order(spark):
    days = [dt.date(2026, 4, d) for d in range(1, 6)]
    inputs = spark.createDataFrame([(days[0], 9, 0), (days[1], 9, 0), (days[2], 1, 99), (days[3], 9, 95)], "date date, bytes long, modified_s long")
    published = spark.createDataFrame([(days[0],), (days[0],)], "date date")
    run = lambda force: [r["action"] for r in daily_actions(inputs, published, F.lit(days[4]), 5, F.lit(100), 5, 10, force).orderBy("date").collect()]
    assert run(False) == ["published", "due", "small", "unstable", "missing"]
    assert run(True)[0] == "due"


@pytest.mark.parametrize("seed", range(3))
def test_farthest_points_against_a_loop(spark, seed):
    r = random.Random(seed)
    rows = [(k, i, r.randint(0, 9), r.randint(0, 9)) for k in ("a", None) for i in range(30)] + [("one", 1, 5, 5), ("same", 1, 2, 2), ("same", 2, 2, 2)]
    got = sampling.farthest_points(spark.createDataFrame(rows, "k string, i long, x int, y int"), "k", "i", "x", "y", 5, (4, 4)).collect()
    for key in {x[0] for x in rows}:
        mine = sorted(x[1:] for x in rows if x[0] == key)
        chosen = [min(mine, key=lambda p: (-((p[1] - 4) ** 2) - (p[2] - 4) ** 2, p[0]))]
        near = lambda p: min(math.dist(p[1:], c[1:]) for c in chosen)  # noqa: E731, B023
        while len(chosen) < 5 and max(map(near, mine)) > 0:
            chosen.append(min(mine, key=lambda p: (-near(p), p[0])))  # noqa: B023
        assert [x["i"] for x in sorted(got, key=lambda x: x["rank"]) if x["k"] == key] == [c[0] for c in chosen]


def test_near_equal_meets_across_cells(spark):
    a = spark.createDataFrame([("v", 0.3, 1), ("v", 0.999999, 2), ("w", 0.3, 3), (None, 0.3, 4)], "n string, x double, i int")
    b = spark.createDataFrame([("v", 0.1 + 0.2, 10), ("v", 1.0, 20), ("v", 0.300002, 30)], "n string, x double, j int")
    got = sorted((r["i"], r["j"]) for r in joins.near_equal(a, b, ["n"], "x", 1.5e-6).collect())
    assert got == [(1, 10), (2, 20)]


def test_lines_manifests_and_the_index_are_read_back(spark, tmp_path):
    rows = [("a", 1, 2.5, None), ("a", 3, None, [1.0, 2.0]), ("b", 2, 0.0, [])]
    df = spark.createDataFrame(rows, "owner string, id int, score double, line array<double>").repartition(3)
    files.write_lines(df, str(tmp_path / "lines"))
    back = files.read_lines(spark, str(tmp_path / "lines"), "owner string, id int, score double, line array<double>")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((o, i, s, x) for o, i, s, x in rows), key=str)
    files.write_manifests(df, str(tmp_path / "manifests"), "owner", ["id"])
    docs = spark.read.text(str(tmp_path / "manifests"))
    got = {r["owner"]: json.loads(r["value"])["episodes"] for r in docs.collect()}
    assert {o: [e["id"] for e in v] for o, v in got.items()} == {"a": [1, 3], "b": [2]} and got["a"][0] == {"id": 1, "score": 2.5}
    files.write_csv(df.limit(0), str(tmp_path / "none"), ["id", "owner"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "none")).collect()] == ["id,owner"]
    dates = spark.createDataFrame([("2026-04-08", 3, 1, "ann,bob"), ("2026-04-09-<b>", 2, 0, "")], "date string, episodes int, detected int, labelers string")
    page = files.index_page(dates, "Days & nights")
    assert page.index("2026-04-09-&lt;b&gt;") < page.index("2026-04-08") and "Days &amp; nights" in page and "labelled by ann,bob" in page and page.count("<li>") == 2
    with pytest.raises(ValueError, match="more than 1"):
        files.index_page(dates, "x", 1)


@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_thinning_does_not_depend_on_batches(spark, rows):
    r = random.Random(5)
    points = sorted({(k, r.randint(0, 200)) for k in range(6) for _ in range(40)}) + [(9, 5)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        got = sorted(map(tuple, timeseries.thin(spark.createDataFrame(points, "k int, t int").repartition(3), "k", "t", 17, []).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for k in {p[0] for p in points}:
        ts, due = sorted(t for c, t in points if c == k), None
        for i, t in enumerate(ts):
            if due is None or t >= due:
                want.append((k, t))
                due = t + 17
            elif i == len(ts) - 1:
                want.append((k, t))
    assert got == sorted(want)


def test_spans_that_may_come_close(spark):
    """All pairs that come within reach at any time of both are among them, and fewer than all overlapping ones."""
    r = random.Random(8)
    track = [(g, t, float(r.choice((0, 40, 300, 800)) + r.randint(0, 30))) for g in range(8) for t in sorted(r.sample(range(0, 1_000), 12))]
    ends = {g: (min(t for k, t, _ in track if k == g), max(t for k, t, _ in track if k == g)) for g in range(8)}
    spans = []
    for i in range(40):
        g = r.randrange(8)
        a, b = sorted(r.sample(range(ends[g][0], ends[g][1] + 1), 2))
        spans.append((i, g, a, b))
    s, p = spark.createDataFrame(spans, "i int, g int, lo int, hi int"), spark.createDataFrame(track, "g int, t int, x double").repartition(3)
    got = {(x["a"], x["b"]): x["overlap"] for x in joins.overlapping_near(s, p, "i", "g", "lo", "hi", "t", "x", 20, 100, 40.0).collect()}
    every = {(x["a"], x["b"]): x["overlap"] for x in joins.overlapping(s, "i", "g", "lo", "hi", 20, 100).collect()}

    def at(g, t):
        own = [(u, x) for k, u, x in track if k == g]
        for (t0, x0), (t1, x1) in zip(own, own[1:]):
            if t0 <= t <= t1:
                return x0 + (x1 - x0) * (t - t0) / (t1 - t0)
        return None

    by = {i: (g, a, b) for i, g, a, b in spans}
    close = {k for k in every if any(abs(at(by[k[0]][0], t) - at(by[k[1]][0], t)) <= 40 for t in range(max(by[k[0]][1], by[k[1]][1]), min(by[k[0]][2], by[k[1]][2]) + 1))}
    assert close <= set(got) < set(every) and all(every[k] == v for k, v in got.items())
