"""A trust-but-verify clock tracker as a pure step function, run over ordered rows in batch or as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400.0


#: Trusted reads that are kept, and contenders in a row that make a new anchor.
HISTORY, ANCHOR = 5, 3
#: Times that frames say may be exceeded by this factor; dates may differ by so many days.
JUMP, DAYS_APART = 10, 1
#: The states that readers of the clock files know.
BUILDING, INVALID, CONSISTENT, PROJECTED, ANCHORED = "building_history", "building_history_invalid_ocr", "consistent", "anomaly_projected", "RE-ANCHORED"


@dataclass
class State:
    """Trusted (frame, time) pairs, contenders for a new anchor, the last output, and how many reads were refused for their date."""

    spf: float = 1.0
    start: float = 0.0
    interval: float = 1.0
    trusted: list = field(default_factory=list)
    contender: list = field(default_factory=list)
    last: float | None = None
    refused: int = 0


def consistent(frame: int, t: float, anchor: tuple, spf: float) -> bool:
    """Time passed since the anchor is between half and JUMP times what the frames say."""
    want, got = (frame - anchor[0]) * spf, t - anchor[1]
    return max(0.0, want / 2) <= got <= JUMP * want


def step(s: State, frame: int, t: float | None, ok: bool) -> tuple[float, str]:
    """The time to believe for a frame, and why."""
    read = t if ok and t is not None and t == t else None
    anchor = s.trusted[-1] if s.trusted else None
    fits = read is not None and (anchor is None or consistent(frame, read, anchor, s.spf))
    forward = read is not None and (s.last is None or read >= s.last)
    if anchor:
        guess = anchor[1] + (frame - anchor[0]) * s.spf
    else:
        guess = (s.start if s.last is None else s.last) + s.interval

    def believe(value: float, why: str) -> tuple[float, str]:
        s.last = value
        return value, why

    if len(s.trusted) < HISTORY:
        if not fits:
            return believe(guess, INVALID)
        s.trusted.append((frame, read))
        return believe(read, f"{BUILDING} ({len(s.trusted)}/{HISTORY})")
    if fits and forward:
        s.trusted, s.contender = [*s.trusted[1 - HISTORY :], (frame, read)], []
        return believe(read, CONSISTENT)
    if read is not None and abs(read // DAY - anchor[1] // DAY) > DAYS_APART:
        s.refused += 1
        s.contender = []
    elif forward:
        grows = s.contender and consistent(frame, read, s.contender[-1], s.spf)
        s.contender = [*s.contender, (frame, read)] if grows else [(frame, read)]
        if len(s.contender) >= ANCHOR:
            s.trusted, s.contender = s.contender, []
            return believe(read, ANCHORED)
    else:
        s.contender = []
    return believe(guess, PROJECTED)


def track(df: DataFrame, key: str, frame: str, t: str, ok: str, spf: float, start: float = 0.0, interval: float | None = None) -> DataFrame:
    """(key, frame, believed, status, refused) in order of frame; one key's rows stream through one task, only the state is held.

    Times are seconds; interval is the step before there is any trusted read (spf unless given). refused counts the
    reads so far whose date was too far off.
    """
    kind, rows = df.schema[key].dataType.simpleString(), df.select(key, frame, t, ok)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for pdf in batches:
            out = []
            for k, f, x, good in pdf.itertuples(index=False):
                if k != now:
                    now, state = k, State(spf, start, spf if interval is None else interval)
                out.append((k, f, *step(state, int(f), x, bool(good)), state.refused))
            yield pd.DataFrame(out, columns=[key, frame, "believed", "status", "refused"])

    return rows.repartition(key).sortWithinPartitions(key, frame).mapInPandas(run, f"{key} {kind}, {frame} long, believed double, status string, refused long")


def dated(tracked: DataFrame, key: str, frame: str, seed_day: int) -> DataFrame:
    """tracked with day: the seed day (days since 1970) and a day more each time the believed time of day falls by over half a day."""
    order = Window.partitionBy(key).orderBy(frame)
    second = F.pmod(F.floor("believed"), F.lit(86_400))
    rows = tracked.withColumn("_second", second).withColumn("_fell", (F.col("_second") + 43_200 < F.lag("_second").over(order)).cast("int"))
    return rows.withColumn("day", (F.lit(seed_day) + F.sum(F.coalesce("_fell", F.lit(0))).over(order)).cast("long")).drop("_second", "_fell")
