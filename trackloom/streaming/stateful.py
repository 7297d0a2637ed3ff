"""Operators with state of their own on streams: smoothed gap sessions and the clock tracker.

Both keep one row of state per key and need the RocksDB state store; use_rocksdb() sets it. The step functions are plain
classes, so a batch and a stream run the same rules.
"""

from __future__ import annotations

import datetime as dt
import json
from bisect import insort
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trackloom.operators import tracker

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Smoothed:
    """Rows of one key on their way to sessions; times in microseconds.

    `early` holds rows that the watermark has not passed, in order of (time, tie). Rows that it has passed are final: they go
    through a window of `window` rows, of which the half after a row is held in `ahead`, so a row waits for that many
    later ones. A pause of idle_us or more ends the timeline: the last rows are smoothed with what there is. Rows whose lower
    median clears the threshold make sessions, closed once the watermark and all waiting rows are over a gap past the last.
    """

    def __init__(self, window: int, threshold: float, gap_us: int, idle_us: int, state: dict | None = None):
        self.half, self.threshold, self.gap, self.idle = max(1, window) // 2, threshold, gap_us, max(idle_us, gap_us)
        s = state or {}
        self.early: list[list] = s.get("early", [])
        self.behind: list[float] = s.get("behind", [])
        self.ahead: list[list] = s.get("ahead", [])
        self.open: dict | None = s.get("open")
        self.nth: int = s.get("nth", 0)

    def state(self) -> dict:
        return {"early": self.early, "behind": self.behind, "ahead": self.ahead, "open": self.open, "nth": self.nth}

    def add(self, t: int, tie: int, score: float, name: str | None) -> None:
        insort(self.early, [t, tie, score, name], key=lambda r: r[:2])

    def _close(self) -> list[dict]:
        done, self.open = [self.open] if self.open else [], None
        return done

    def _keep(self, row: list) -> list[dict]:
        t, tie, score, name = row
        done = self._close() if self.open and t - self.open["end"] > self.gap else []
        if self.open is None:
            self.nth += 1
            self.open = {"session": self.nth, "first_name": name, "onset": t, "end": t, "peak_score": score, "peak_id": tie, "frame_count": 0}
        o = self.open
        o["end"], o["frame_count"] = t, o["frame_count"] + 1
        if score > o["peak_score"]:
            o["peak_score"], o["peak_id"] = score, tie
        return done

    def _smooth(self, least: int) -> list[dict]:
        """Judge waiting rows while more than `least` wait."""
        done = []
        while len(self.ahead) > least:
            row, *later = self.ahead[: self.half + 1]
            near = sorted([*self.behind, row[2], *(r[2] for r in later)])
            if near[(len(near) - 1) // 2] >= self.threshold:
                done += self._keep(row)
            self.behind = [*self.behind, row[2]][-self.half :] if self.half else []
            self.ahead = self.ahead[1:]
        return done

    def _end(self) -> list[dict]:
        done = self._smooth(0) + self._close()
        self.behind = []
        return done

    def advance(self, watermark: int) -> list[dict]:
        """Sessions that are closed now that no row up to the watermark can come any more."""
        done = []
        while self.early and self.early[0][0] <= watermark:
            row = self.early.pop(0)
            if self.ahead and row[0] - self.ahead[-1][0] >= self.idle:
                done += self._end()
            self.ahead.append(row)
            done += self._smooth(self.half)
        last = self.ahead[-1][0] if self.ahead else None
        if last is not None and not self.early and watermark - last >= self.idle:
            done += self._end()
        if self.open and watermark > self.open["end"] + self.gap and not any(r[0] <= self.open["end"] + self.gap for r in self.ahead):
            done += self._close()
        return done

    def due(self) -> int | None:
        """The watermark at which there is something to do, if no row comes before."""
        times = [self.early[0][0]] if self.early else []
        if self.ahead and not self.early:
            times.append(self.ahead[-1][0] + self.idle)
        if self.open and not any(r[0] <= self.open["end"] + self.gap for r in self.ahead):
            times.append(self.open["end"] + self.gap + 1)
        return min(times, default=None)

    def empty(self) -> bool:
        return not (self.early or self.ahead or self.open)


def _micros(t: pd.Series) -> list[int]:
    return ((t if t.dt.tz is None else t.dt.tz_convert("UTC").dt.tz_localize(None)) - pd.Timestamp(0)).dt.floor("us").astype("timedelta64[us]").astype("int64").tolist()


class SessionProcessor(StatefulProcessor):
    def __init__(self, key: str, *rules):
        self.key, self.rules = key, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("sessions", "state string")

    def _run(self, key: tuple, s: Smoothed, watermark_ms: int) -> Iterator[pd.DataFrame]:
        done = s.advance(watermark_ms * 1_000)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if (due := s.due()) is not None:
            self.handle.registerTimer(max(-(-due // 1_000), watermark_ms + 1))
        # the number of the last session is kept
        self.rows.update((json.dumps(s.state()),))
        if done:
            out = pd.DataFrame(done)
            for c in ("onset", "end"):
                out[c] = [EPOCH + dt.timedelta(microseconds=t) for t in out[c]]
            out.insert(0, self.key, key[0])
            yield out[[self.key, "session", "first_name", "onset", "end", "peak_score", "peak_id", "frame_count"]]

    def _state(self) -> Smoothed:
        return Smoothed(*self.rules, json.loads(self.rows.get()[0]) if self.rows.exists() else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = self._state()
        for pdf in rows:
            for row in zip(_micros(pdf["t"]), pdf["tie"].tolist(), pdf["score"].tolist(), pdf["name"].tolist()):
                s.add(*row)
        yield from self._run(key, s, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._run(key, self._state(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def smoothed_sessions(stream: DataFrame, key: str, t: str, tie: str, score: str, name: str, window: int, threshold: float, gap_s: float, late: str = "1 hour", idle_s: float = 86_400.0) -> DataFrame:
    """Episodes of a stream as operators.sessions.episodes() has them of a table: (key, session, first_name, onset, end, ...).

    Rows may come in any order within `late`; later ones are dropped and counted in the query's progress. A row is smoothed
    with the rows after it, so it waits for them, idle_s at most; a pause that long splits the smoothing as well. Rows
    without a key, time, tie or score take no part.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, F.col(t).cast("timestamp").alias("t"), F.col(tie).cast("long").alias("tie"), F.col(score).cast("double").alias("score"), F.col(name).cast("string").alias("name"))
    rows = rows.where(" and ".join(f"`{c}` is not null" for c in (key, "t", "tie", "score"))).withWatermark("t", late)
    out = f"{key} {kind}, session long, first_name string, onset timestamp, end timestamp, peak_score double, peak_id long, frame_count long"
    processor = SessionProcessor(key, window, threshold, int(gap_s * 1e6), int(idle_s * 1e6))
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


class ClockProcessor(StatefulProcessor):
    def __init__(self, key: str, spf: float, start: float, interval: float):
        self.key, self.rules = key, (spf, start, interval)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = json.loads(self.clock.get()[0]) if self.clock.exists() else {"frame": None, "dropped": 0, "clock": None}
        state = tracker.State(*self.rules) if held["clock"] is None else tracker.State(**held["clock"])
        state.trusted, state.contender = [tuple(x) for x in state.trusted], [tuple(x) for x in state.contender]
        out = []
        for frame, t, ok in sorted((r for pdf in rows for r in zip(pdf["frame"].tolist(), pdf["t"].tolist(), pdf["ok"].tolist())), key=lambda r: r[0]):
            if held["frame"] is not None and frame <= held["frame"]:
                held["dropped"] += 1
                continue
            held["frame"] = frame
            out.append((key[0], frame, *tracker.step(state, int(frame), t, bool(ok)), state.refused, held["dropped"]))
        held["clock"] = asdict(state)
        self.clock.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=[self.key, "frame", "believed", "status", "refused", "dropped"])

    def close(self) -> None:
        pass


def tracked_stream(stream: DataFrame, key: str, frame: str, t: str, ok: str, spf: float, start: float = 0.0, interval: float | None = None) -> DataFrame:
    """operators.tracker.track() on a stream: (key, frame, believed, status, refused, dropped).

    Frames of a key that come in one micro-batch are put in order; one that is not beyond the last frame seen is dropped, as
    its time was told already, and counted in `dropped` of the rows that follow.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, F.col(frame).cast("long").alias("frame"), F.col(t).cast("double").alias("t"), F.coalesce(F.col(ok), F.lit(False)).alias("ok")).where(f"`{key}` is not null and frame is not null")
    processor = ClockProcessor(key, spf, start, spf if interval is None else interval)
    out = f"{key} {kind}, frame long, believed double, status string, refused long, dropped long"
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="None")
