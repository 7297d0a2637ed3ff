"""Chat transcripts: a hidden Markov model over speaker marks and line features recovers roles, turns are rendered anew."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
#: Labelled conversations that the model is fitted on, chosen by hash order.
TRAIN_CONVERSATIONS = 2_000
#: Speaker marks that transcripts use, by role.
MARKS = {
    "system": ("system", "sys", "instruction", "instructions"),
    "user": ("user", "human", "me", "q", "question", "customer"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "agent"),
}
_ROLE_OF = {m: i for i, r in enumerate(ROLES) for m in MARKS[r]}
#: Turns that the prior of speaker marks counts for.
MARK_PRIOR = 100
MARK = re.compile(r"^[\s#>*\[<|]*(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")[\s\]>*|]*:[*\s]*", re.IGNORECASE)


def features(text: str) -> tuple[int, int, int, int, int]:
    """Mark (0: none), length in powers of two, lines, question at the end, list or code inside."""
    m = MARK.match(text)
    mark = 1 + _ROLE_OF[m[1].lower()] if m else 0
    body = text[m.end() :] if m else text
    return mark, min(15, len(body).bit_length()), min(4, body.count("\n")), int(body.rstrip().endswith("?")), int(bool(re.search(r"(^|\n)(\s*[-*] |\d+\. |```)", body)))


SIZES = (4, 16, 5, 2, 2)


class Model:
    """Start, step and feature probabilities by counts with add-one smoothing; unmarked and marked turns alike.

    counts has (table, i, j, n): "start" of role i, "step" from role i to j, feature number "0" to "4" of role i with value j.
    """

    def __init__(self, counts: Iterable[tuple[str, int, int, int]]):
        start, step = np.ones(3), np.ones((3, 3))
        seen = [np.ones((3, n)) for n in SIZES]
        for table, i, j, n in counts:
            if table == "start":
                start[i] += n
            elif table == "step":
                step[i, j] += n
            else:
                seen[int(table)][i, j] += n
        # before any count a mark names its role but for slips
        marked = np.full((3, 4), 0.01) + np.eye(3, 4, 1) * 0.45
        marked[:, 0] = 0.5
        seen[0] += MARK_PRIOR * marked - 1
        norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        self.start, self.step = norm(start), norm(step)
        self.seen = [*map(norm, seen)]

    def emit(self, text: str) -> np.ndarray:
        return sum(t[:, v] for t, v in zip(self.seen, features(text)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of starts, steps and features of the labelled turns of one task, which come conversation by conversation."""
    seen, conv, last = Counter(), object(), None
    for batch in batches:
        for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("c", "r", "x"))):
            if c != conv:
                conv, last = c, None
            if role not in ROLES:
                last = None
                continue
            r = ROLES.index(role)
            seen[("start", r, 0) if last is None else ("step", last, r)] += 1
            for k, v in enumerate(features(text or "")):
                seen[str(k), r, v] += 1
            last = r
    rows = [(*k, n) for k, n in sorted(seen.items())]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["t", "i", "j", "n"])


class Decoder:
    """Viterbi over turns that come one by one; keeps one row of three back pointers per turn."""

    def __init__(self, model: Model):
        self.model, self.score, self.back = model, None, []

    def add(self, text: str) -> None:
        e = self.model.emit(text)
        if self.score is None:
            self.score, came = self.model.start + e, [0, 1, 2]
        else:
            ways = self.score[:, None] + self.model.step
            came = ways.argmax(axis=0)
            self.score = ways.max(axis=0) + e
        self.back.append(bytes(int(x) for x in came))

    def roles(self) -> list[str]:
        at, out = int(self.score.argmax()) if self.back else 0, []
        for came in reversed(self.back):
            out.append(ROLES[at])
            at = came[at]
        return out[::-1]


def unmarked(role: str, text: str) -> str:
    """text without the speaker mark at its start, if that is the role's; words that look like another role's mark stay."""
    m = MARK.match(text)
    return (text[m.end() :] if m and ROLES[_ROLE_OF[m[1].lower()]] == role else text).strip()


def render(role: str, text: str) -> str:
    """The canonical turn: the role is named once; a mark of that role is gone."""
    return f"<|{role}|>\n{unmarked(role, text)}\n<|end|>\n"


def turns_of(text: str, blank_lines: bool) -> list[str]:
    """A text cut into turns: one begins at a line with a mark and, with blank_lines, after a blank line."""
    parts: list[str] = []
    blank = True
    for line in text.split("\n"):
        if blank_lines and not line.strip():
            blank = True
            continue
        if not parts or MARK.match(line) or (blank_lines and blank):
            parts.append(line)
        else:
            parts[-1] += "\n" + line
        blank = False
    return parts or [""]


def parse_transcript(text: str, model: Model) -> list[tuple[str, str]]:
    """A whole transcript as (role, turn): unmarked parts with the role of the part before belong to its turn."""
    parts = turns_of(text or "", True)
    decoder = Decoder(model)
    for p in parts:
        decoder.add(p)
    out: list[tuple[str, str]] = []
    for role, p in zip(decoder.roles(), parts):
        body = unmarked(role, p)
        if out and out[-1][0] == role and not MARK.match(p):
            out[-1] = (role, out[-1][1] + "\n\n" + body)
        else:
            out.append((role, body))
    return out


def fit(conversations: DataFrame, most: int = TRAIN_CONVERSATIONS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_turns: int = 64) -> Model:
    """Fit on the first most_turns turns of at most `most` conversations in hash order; only counts reach the driver.

    Rows without a conversation id, a turn number or a known role teach nothing.
    """
    some = conversations.select(F.col(conv_col).alias("c")).where("c is not null").distinct().orderBy(F.xxhash64("c"), "c").limit(most)
    rows = conversations.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.col(role_col).alias("r"), F.col(text_col).alias("x")).where(F.col("t").between(0, most_turns - 1))
    rows = rows.join(F.broadcast(some), "c").repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")
    counts = rows.mapInArrow(_count, "t string, i int, j int, n long").groupBy("t", "i", "j").agg(F.sum("n").alias("n"))
    return Model(sorted(map(tuple, counts.collect())))


OUT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int64()), ("given", pa.string()), ("role", pa.string()), ("rendered", pa.string())])


def _decode(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, decoder, conv = [], Decoder(model), object()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal decoder
            rows = [(c, t, k, g, role, render(role, x)) for (c, t, k, g, x), role in zip(held, decoder.roles())]
            held.clear()
            decoder = Decoder(model)
            for at in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[at : at + 512]), OUT)], schema=OUT)

        for batch in batches:
            for c, t, g, x in zip(*(batch.column(n).to_pylist() for n in ("c", "t", "g", "x"))):
                if c is None or c != conv:
                    yield from flush()
                    conv = c
                for k, part in enumerate(turns_of(x or "", False)):
                    held.append((c, t, k, g, part))
                    decoder.add(part)
        yield from flush()

    return run


def recover_roles(turns: DataFrame, model: Model, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str | None = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, part, given (the role column, if any), role by Viterbi and the rendered turn, one row per part of a turn.

    A turn whose text holds further lines with speaker marks is cut there; most turns have one part. A conversation is
    decoded in one task, in order of turn, text. Null text is empty and rendered as an empty turn; a row without a conversation
    id is a conversation of its own; repeated turns are turns; ties go to the earlier role of ROLES; no rows give no
    rows; other columns are not read.
    """
    given = F.col(role_col).cast("string") if role_col else F.lit(None).cast("string")
    rows = turns.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), given.alias("g"), F.col(text_col).cast("string").alias("x"))
    rows = rows.repartition(F.coalesce("c", F.xxhash64("t", "x"))).sortWithinPartitions("c", "t", "x")
    return rows.mapInArrow(_decode(model), "conv_id long, turn long, part long, given string, role string, rendered string")
