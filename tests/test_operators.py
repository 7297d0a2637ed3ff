"""Boundary cases and properties of the operators."""

import datetime as dt
import json
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackloom.functions import geo, text
from trackloom.operators import joins, labels, metrics, sampling, sessions, timeseries, tracker, vision
from trackloom.sources import files
from trackloom.streaming import sessions as streaming

T0 = dt.datetime(2024, 1, 1)


def rows(spark, points, key="a"):
    data = [(key, T0 + dt.timedelta(seconds=t), i, float(s), "n") for i, (t, s) in enumerate(points)]
    return spark.createDataFrame(data, "k string, t timestamp_ntz, id long, score double, name string")


@pytest.mark.parametrize("gap,count", [(30, 1), (30.001, 2)])
def test_gap_boundary(spark, gap, count):
    df = rows(spark, [(0, 1), (gap, 1)])
    assert sessions.episodes(df, "k", "t", "id", "score", "name", 1, 0.5, 30).count() == count


def test_smoothing_removes_spikes_and_keeps_runs(spark):
    spike = rows(spark, [(0, 0), (1, 1), (2, 0)])
    run = rows(spark, [(i, 1) for i in range(5)])
    assert sessions.episodes(spike, "k", "t", "id", "score", "name", 3, 0.5, 30).count() == 0
    assert sessions.episodes(run, "k", "t", "id", "score", "name", 3, 0.5, 30).first()["frame_count"] == 5
    assert sessions.episodes(run.limit(0), "k", "t", "id", "score", "name", 3, 0.5, 30).count() == 0


def test_peak_is_first_of_equals(spark):
    df = rows(spark, [(0, 0.6), (1, 0.9), (2, 0.9)])
    assert sessions.episodes(df, "k", "t", "id", "score", "name", 1, 0.5, 30).first()["peak_id"] == 1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=20), st.sampled_from([1, 3, 5]))
def test_rolling_median_low(spark, xs, window):
    got = sessions.rolling_median_low(rows(spark, enumerate(xs)), "k", ["t", "id"], "score", window).orderBy("id").collect()
    h = window // 2
    assert [r["smoothed"] for r in got] == [statistics.median_low(xs[max(0, i - h) : i + h + 1]) for i in range(len(xs))]


def test_upsample_leaves_short_and_long_gaps(spark):
    df = spark.createDataFrame([("a", 0, 0.0, None), ("a", 2, 2.0, 1.0), ("a", 10, 0.0, 1.0)], "k string, s long, v double, o double")
    got = timeseries.upsample(df, "k", "s", ["v", "o"], 5).orderBy("s").collect()
    assert [(r["s"], r["v"], r["o"], r["filled"]) for r in got] == [(0, 0.0, None, False), (1, 1.0, None, True), (2, 2.0, 1.0, False), (10, 0.0, 1.0, False)]


def test_thinning_keeps_first_and_last(spark):
    df = spark.createDataFrame([("a", t, t) for t in (0, 1, 2, 3, 4)], "k string, t long, x long")
    assert [r["x"] for r in timeseries.thin(df, "k", "t", 3, ["x"]).orderBy("x").collect()] == [0, 3, 4]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 5)), min_size=2, max_size=30))
def test_auc_and_youden(spark, xs):
    df = spark.createDataFrame([("d", p, float(s)) for p, s in xs], "day string, pos boolean, score double")
    pos, neg = [s for p, s in xs if p], [s for p, s in xs if not p]
    a = metrics.auc(df, ["day"], F.col("pos"), "score").first()["auc"]
    if not pos or not neg:
        assert a != a
        return
    assert a == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)))
    j = lambda t: sum(p >= t for p in pos) / len(pos) - sum(n >= t for n in neg) / len(neg)
    best = metrics.youden(df, ["day"], F.col("pos"), "score").first()
    assert best["j"] == pytest.approx(max(j(t) for t in {*(s for _, s in xs), 9}))
    assert j(best["threshold"]) == pytest.approx(best["j"])


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.083,), (1.0,), (0.0,)], "s double")
    got = metrics.histogram(df, F.col("s"), [0.0, 0.083, 0.167, 1.001]).orderBy("bin").collect()
    assert [r["n"] for r in got] == [1, 1, 1]


@pytest.mark.parametrize("n,f", [(10, 0.2), (7, 0.5), (5, 0), (5, 1), (1, 0.4)])
def test_assignment(spark, n, f):
    df = spark.range(n).withColumnRenamed("id", "at")
    m = min(n, round(n * f))
    shared = {int(k * n / m) for k in range(m)}
    want, turn = set(), 0
    for i in range(n):
        if i in shared:
            want |= {(i, "x"), (i, "y")}
        else:
            want.add((i, "xy"[turn % 2]))
            turn += 1
    assert {tuple(r) for r in sampling.assign(df, "at", n, ["x", "y"], f).collect()} == want
    with pytest.raises(ValueError):
        sampling.assign(df, "at", n, ["x"], 1.5)


def test_altitude_policy(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (None, None), (0.0, 500.0), (0.0, 200.0)], "g double, b double")
    got = [r[0] for r in df.select(geo.altitude(F.col("g"), F.col("b"), "auto", 200.0)).collect()]
    assert [(x["alt"], x["source"]) for x in got] == [(1.0, "gnss"), (2.0, "barometric"), (None, None), (500.0, "barometric"), (0.0, "gnss")]
    with pytest.raises(ValueError):
        geo.altitude(F.col("g"), F.col("b"), "other")


def test_site_is_its_own_origin(spark):
    lit = lambda *x: [F.lit(v) for v in x]
    here = spark.range(1).select(*geo.enu(*lit(42.0, -71.0, 10.0), 42.0, -71.0, 10.0)).first()
    north = spark.range(1).select(*geo.enu(*lit(42.01, -71.0, 10.0), 42.0, -71.0, 10.0)).first()
    assert max(map(abs, here)) < 1e-6 and north[1] > 1000 and abs(north[0]) < 1


def test_overlap_meets_naive_join(spark):
    rng = np.random.default_rng(3)
    data = [(i, int(i % 4), int(a), int(a + d)) for i, (a, d) in enumerate(zip(rng.integers(0, 500, 60), rng.integers(0, 120, 60)))]
    df = spark.createDataFrame(data, "id long, g long, lo long, hi long")
    want = {(a[0], b[0]) for a in data for b in data if a[0] < b[0] and a[1] != b[1] and min(a[3], b[3]) - max(a[2], b[2]) >= 10}
    got = [tuple(r)[:2] for r in joins.overlapping(df, "id", "g", "lo", "hi", 10, 50).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_tracker_projects_a_bad_read_and_anchors_anew():
    s = tracker.State()
    out = [tracker.step(s, i, 100.0 + i, True) for i in range(6)]
    assert [t for t, _ in out] == [100.0 + i for i in range(6)]
    assert tracker.step(s, 6, 5.0, True) == (106.0, "anomaly_projected")
    assert tracker.step(s, 7, None, False)[0] == 107.0
    got = [tracker.step(s, 8 + i, 500.0 + i, True) for i in range(3)]
    assert got[-1] == (502.0, "RE-ANCHORED")


def test_tracker_over_keys(spark):
    df = spark.createDataFrame([(k, i, float(i), True) for k in (1, 2) for i in range(4)], "k long, f long, t double, ok boolean")
    assert [r["believed"] for r in tracker.track(df, "k", "f", "t", "ok", 1.0).where("k = 2").orderBy("f").collect()] == [0.0, 1.0, 2.0, 3.0]


def test_timestamp_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.parse_overlay(F.lit("02/30/2026 10:00:00"))) is None
    assert one(text.parse_overlay(F.lit("02/28/2026 10:00:00"))) == dt.datetime(2026, 2, 28, 10)
    assert one(text.canonical_time(F.lit("12:05:00 AM"))) == "00:05:00" and one(text.canonical_time(F.lit("13:05:00 PM"))) is None
    assert one(text.stitch(F.array(F.lit("x"), F.lit("4/8/26"), F.lit("1:02:03")))) == "4/8/26 1:02:03"


def test_consensus_and_validation(spark):
    v = spark.createDataFrame([(1, "contrail", "a"), (1, "unsure", "b"), (2, "unsure", "a"), (3, "contrail", "a"), (3, "no_contrail", "b")], "i long, l string, r string")
    got = {r["i"]: (r["label"], r["conflict"], r["votes"]) for r in labels.consensus(v, "i", "l", "r").collect()}
    assert got == {1: ("contrail", False, 1), 3: (None, True, 2)}
    good = {"schema_version": 1, "date": "2026-04-08", "labeler_id": "a", "labels": [{"episode_id": 1, "label": "contrail", "label_timestamp": "2026-04-08T10:00:00Z"}]}
    docs = spark.createDataFrame([(json.dumps(good),), (json.dumps(good | {"date": "x"}),), ("not json",)], "p string")
    assert [bool(r["errors"]) for r in labels.validate(docs, "p", "2026-04-08").collect()] == [False, True, True]


def test_streak_is_found_and_masked():
    img = np.full((80, 120), 40.0)
    for x in range(10, 110):
        img[20 + x // 3 : 23 + x // 3, x] = 220
    hit = vision.detect(img)
    assert hit["score"] > 0.3 and hit["aligned_lines"]
    assert vision.detect(img, heading=108.0)["aligned_lines"] < hit["num_long_lines"] or vision.detect(img, heading=108.0)["score"] < hit["score"]
    assert vision.detect(img, mask=np.ones(img.shape, bool))["score"] == 0
    assert vision.detect(np.full((40, 40), 9.0))["score"] == 0


@pytest.mark.parametrize("name", sorted(vision.TRANSFORMS))
def test_transforms(name):
    img = np.random.default_rng(1).integers(0, 255, (40, 50, 3)).astype(np.uint8)
    out = vision.TRANSFORMS[name](img, img)
    assert out.shape == (40, 50) and np.isfinite(out).all()
    assert vision.apply_chain(img, [name, "unknown"]).dtype == np.uint8


def test_stream_equals_batch(spark, tmp_path):
    df = rows(spark, [(0, 1), (30, 1), (70, 0.2), (100, 1)]).unionByName(rows(spark, [(90_000, 0)]).withColumn("score", F.lit(0.6)))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    streaming.run_available(streaming.gap_sessions(stream, "k", "t", "score", "id", 0.5, 30), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("onset", "frame_count").collect())
    want = sorted(tuple(r) for r in sessions.episodes(df, "k", "t", "id", "score", "name", 1, 0.5, 30).select("onset", "frame_count").collect())
    assert got == want[: len(got)] and len(got) >= 2


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "d.jsonl"
    p.write_text('{"callsign": "x", "score": 0.5}\n\n{"callsign": \n')
    assert files.read_lines(spark, str(p), files.DETECTION, tolerant=True).count() == 1
    df = spark.createDataFrame([("2026-01-01", 1, "ann"), ("2026-01-01", 2, None), ("2026-01-02", 3, None)], "date string, id long, labeler_id string")
    table = str(tmp_path / "t")
    df.write.partitionBy("date").parquet(table)
    fresh = spark.createDataFrame([(9, None)], "id long, labeler_id string")
    files.replace_open_rows(spark, table, fresh, "2026-01-01")
    assert sorted(r["id"] for r in spark.read.parquet(table).collect()) == [1, 3, 9]
    files.write_csv(df.limit(0), str(tmp_path / "c"), ["id", "date"])
    assert "| 1 |" in files.markdown(df.select("id"), "t")
    files.write_manifests(df.withColumn("owner", F.lit("o")), str(tmp_path / "m"), "owner", ["id"])


def plain_clock(reads, spf):
    """(believed, status, refused) of one clock by the rules as they are told, without the step function's short cuts."""
    trusted, contender, last, refused, out = [], [], None, 0, []

    def near(f, t, a):
        return not (t - a[1] < 0 or t - a[1] > 10 * (f - a[0]) * spf or t - a[1] < (f - a[0]) * spf / 2)

    for f, t, ok in reads:
        guess = trusted[-1][1] + (f - trusted[-1][0]) * spf if trusted else (last or 0.0) + spf
        if len(trusted) < 5:
            if ok and (not trusted or near(f, t, trusted[-1])):
                trusted.append((f, t))
                last, status = t, f"building_history ({len(trusted)}/5)"
            else:
                last, status = guess, "building_history_invalid_ocr"
        elif ok and near(f, t, trusted[-1]) and t >= last:
            trusted, contender, last, status = trusted[-4:] + [(f, t)], [], t, "consistent"
        else:
            was, last, status = last, guess, "anomaly_projected"
            if ok and abs(t // 86_400 - trusted[-1][1] // 86_400) > 1:
                refused, contender = refused + 1, []
            elif ok and t >= was:
                contender = contender + [(f, t)] if contender and near(f, t, contender[-1]) else [(f, t)]
                if len(contender) == 3:
                    trusted, contender, last, status = contender, [], t, "RE-ANCHORED"
            else:
                contender = []
        out.append((last, status, refused))
    return out


def test_tracker_against_a_plain_clock(spark):
    import random

    r = random.Random(4)
    for _ in range(200):
        reads, shift = [], 0.0
        for f in range(r.randint(1, 60)):
            shift += r.choice([0.0] * 20 + [900.0, 40_000.0, 5 * 86_400.0])
            reads.append((f, f * 60.0 + shift + r.choice([0.0] * 9 + [-500.0, 3e5, 20.0]), r.random() > 0.1))
        state = tracker.State(60.0, 0.0, 60.0)
        assert [(*tracker.step(state, *x), state.refused) for x in reads] == plain_clock(reads, 60.0)


def test_days_come_from_the_context(spark):
    rows = [(1, i, float(x), "s", 0) for i, x in enumerate((80_000, 86_000, 87_000, 86_990, 170_000, 173_000))]
    got = tracker.dated(spark.createDataFrame(rows, "k long, f long, believed double, status string, refused long"), "k", "f", 100)
    assert [r["day"] for r in got.orderBy("f").collect()] == [100, 100, 101, 101, 101, 102]


def test_thinning_keeps_equal_last_rows(spark):
    rows = [(1, t, "x") for t in (0, 1, 5, 9, 10, 10)] + [(2, 7, "y"), (3, 0, "z"), (3, 3, "z")]
    got = timeseries.thin(spark.createDataFrame(rows, "k long, t long, v string"), "k", "t", 5, ["v"]).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "x"), (1, 5, "x"), (1, 10, "x"), (2, 7, "y"), (3, 0, "z"), (3, 3, "z")] or sorted(map(tuple, got)) == [(1, 0, "x"), (1, 5, "x"), (1, 10, "x"), (1, 10, "x"), (2, 7, "y"), (3, 0, "z"), (3, 3, "z")]


def test_nearest_without_tolerance(spark):
    rng = np.random.default_rng(5)
    left = [(i, int(rng.integers(0, 4)), int(rng.integers(0, 60))) for i in range(80)]
    right = [(int(rng.integers(0, 3)), int(rng.integers(0, 60)), 100 + i) for i in range(40)]
    got = joins.nearest(spark.createDataFrame(left, "id long, k long, t long"), spark.createDataFrame(right, "k long, u long, other long"), "k", "id", "t", "u", None, "other").collect()
    want = {}
    for i, k, t in left:
        near = [(abs(t - u), u, o) for kk, u, o in right if kk == k]
        if near:
            want[i] = min(near)[1:]
    assert {r["id"]: (r["u"], r["other"]) for r in got} == want and len(got) == len(want)


def test_unknown_labels_are_errors(spark):
    df = spark.createDataFrame([("contrail",), ("other",)], "label string")
    with pytest.raises(Exception, match="unknown label"):
        df.select(labels.checked(F.col("label"))).collect()


def test_observed_counts_come_with_the_first_action(spark):
    df, seen = metrics.observed(spark.range(10).toDF("x"), "counts", large=F.col("x") > 6)
    assert df.count() == 10 and seen.get == {"rows": 10, "large": 3}


def test_an_empty_day_is_removed(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = [(1, None, "2026-04-08"), (2, "ann", "2026-04-09")]
    spark.createDataFrame(rows, "id long, labeler_id string, date string").write.partitionBy("date").parquet(path)
    fresh = spark.createDataFrame([], "id long, labeler_id string")
    files.replace_open_rows(spark, path, fresh, "2026-04-08")
    assert [r["id"] for r in spark.read.parquet(path).collect()] == [2]


def test_upsert_copies_come_from_the_open_row(spark):
    table = spark.createDataFrame([(1, None, None, 5), (1, "b", "x", 9)], "item long, who string, label string, extra long")
    new = spark.createDataFrame([(1, "c", "y", 1)], "item long, who string, label string, at long")
    got = labels.upsert(table, new, "item", "who", "label", "at").collect()
    assert sorted((r["who"], r["label"], r["extra"]) for r in got) == [("b", "x", 9), ("c", "y", 5)]
