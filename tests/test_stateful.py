"""Stateful streams against their batch forms: several micro-batches, disorder, late rows, restarts from the checkpoint."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import sessions, tracker
from trackloom.streaming import stateful

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    stateful.use_rocksdb(spark)
    yield spark
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, build, batches, schema, folder, queries=None):
    """Rows of a stream over files, one micro-batch per file; each file is a run of its own, so state comes from the checkpoint."""
    progress = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        q = build(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        progress += q.recentProgress
    if queries is not None:
        queries += progress
    return spark.read.parquet(f"{folder}/out")


SCHEMA = "k string, t timestamp_ntz, id long, score double, name string"


def detections(seed, n=60, keys="ab"):
    r, rows, i = random.Random(seed), [], 0
    for k in keys:
        t = T0
        for _ in range(n):
            t += dt.timedelta(seconds=r.choice((0, 1, 5, 10, 29, 30, 31, 45)))
            rows.append((k, t, i, round(r.random(), 2), f"n{i % 4}"))
            i += 1
    return rows


def batch_of(spark, rows, window, gap):
    e = sessions.episodes(spark.createDataFrame(rows, SCHEMA), "k", "t", "id", "score", "name", window, 0.5, gap)
    return sorted((r["k"], r["session"], r["first_name"], r["onset"], r["end"], r["peak_score"], r["peak_id"], r["frame_count"]) for r in e.collect())


@pytest.mark.parametrize("window", [1, 3, 5])
def test_steps_equal_the_batch(spark, window):
    """The step class alone, fed in any order within the lateness."""
    rows = detections(window)
    got = []
    us = lambda t: int((t - T0) / dt.timedelta(microseconds=1))
    for k in "ab":
        mine, r = [x for x in rows if x[0] == k], random.Random(window)
        s, seen = stateful.Smoothed(window, 0.5, 30_000_000, 10**12), 0
        mine = [x for _, x in sorted((us(x[1]) + r.randint(0, 40_000_000), x) for x in mine)]
        out = []
        for x in mine:
            s.add(us(x[1]), x[2], x[3], x[4])
            seen = max(seen, us(x[1]))
            out += s.advance(seen - 40_000_001)
            s = stateful.Smoothed(window, 0.5, 30_000_000, 10**12, s.state())
        out += s.advance(seen + 10**12)
        assert s.empty() and s.due() is None
        got += [(k, o["session"], o["first_name"], T0 + dt.timedelta(microseconds=o["onset"]), T0 + dt.timedelta(microseconds=o["end"]), o["peak_score"], o["peak_id"], o["frame_count"]) for o in out]
    assert sorted(got) == batch_of(spark, rows, window, 30)


def test_smoothed_sessions_on_a_stream(rocks, tmp_path):
    """Disorder within the lateness, a restart after every batch, and one row that comes too late."""
    rows = detections(7, 40)
    r = random.Random(1)
    order = [x for _, _, x in sorted((x[1] + dt.timedelta(seconds=r.randint(0, 50)), x[2], x) for x in rows)]
    far = T0 + dt.timedelta(days=3)
    batches = [order[i : i + 20] for i in range(0, len(order), 20)]
    batches.append([("late", far, 900, 0.9, "x"), ("late", far + dt.timedelta(seconds=10), 901, 0.9, "x")])
    batches.append([("a", T0 + dt.timedelta(seconds=3), 902, 1.0, "too late"), ("late", far + dt.timedelta(days=9), 903, 0.1, "x")])
    batches.append([("late", far + dt.timedelta(days=18), 904, 0.1, "x")])
    seen = []
    build = lambda s: stateful.smoothed_sessions(s, "k", "t", "id", "score", "name", 3, 0.5, 30, "60 seconds", 86_400)
    got = run(rocks, build, batches, SCHEMA, str(tmp_path), seen).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("onset", "end")})
    out = sorted(tuple(x) for x in got.where("k <> 'late'").collect())
    assert out == batch_of(rocks, rows, 3, 30)
    late = got.where("k = 'late'").collect()
    assert [(x["onset"], x["end"], x["frame_count"]) for x in late] == [(far, far + dt.timedelta(seconds=10), 2)]
    assert sum(o["numRowsDroppedByWatermark"] for p in seen for o in p["stateOperators"]) == 1


def test_tracker_on_a_stream(rocks, tmp_path):
    """Three keys in six micro-batches, a restart after each, and frames that come again."""
    r, rows = random.Random(3), []
    for k in range(3):
        for f in range(90):
            t = 1_000.0 + f + (500 if f >= 50 else 0)
            bad = r.random()
            rows.append((k, f, None if bad < 0.1 else t - 300 if bad < 0.2 else t + 90_000 * 5 if bad < 0.25 else t, bad > 0.05))
    schema = "k int, f long, t double, ok boolean"
    batches = []
    for i in range(0, 90, 15):
        part = [x for x in rows if i <= x[1] < i + 15]
        r.shuffle(part)
        batches.append(part + ([(1, 3, 5.0, True), (1, 4, 6.0, True)] if i == 45 else []))
    got = run(rocks, lambda s: stateful.tracked_stream(s, "k", "f", "t", "ok", 1.0, 1_000.0), batches, schema, str(tmp_path))
    want = tracker.track(rocks.createDataFrame(rows, schema), "k", "f", "t", "ok", 1.0, 1_000.0)
    key = lambda x: (x[0], x[1])
    out = sorted(map(tuple, got.select("k", "frame", "believed", "status", "refused").collect()), key=key)
    assert out == sorted(map(tuple, want.collect()), key=key)
    assert {x["status"] for x in got.collect()} >= {tracker.PROJECTED, tracker.ANCHORED, tracker.CONSISTENT}
    assert {(x["k"], x["dropped"]) for x in got.where("frame = 89").collect()} == {(0, 0), (1, 2), (2, 0)}
