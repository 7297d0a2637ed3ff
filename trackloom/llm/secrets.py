"""Secret scans by grammar inference.

Credentials that the fixed patterns label are turned into prefix trees over character classes; statistically compatible
states are merged (Hoeffding bounds, red-blue order) into probabilistic automata, one per label and one each for ordinary
words and for ordinary tokens with digits. States are compatible if the next symbols, the ends and the lengths that are left
agree: branches of a prefix tree have few visits each, but the lengths of all that is below a state are told apart by few, so
a format keeps its length. Every other candidate token is scored by its format's likelihood against the ordinary one: whole,
and, if it is not accepted whole, in every stretch of it.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import materialize

#: Kinds of spans in the order in which spans that begin together are listed.
KINDS = ("assign", "access", "hex", "grammar")
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
ASSIGN = re.compile(rf"""({_EITHER}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "api")
#: Candidates: runs of credential characters, as long as the shortest labelled value or longer. Ordinary ones are of kind
#: WORD if they have no digit.
SHORTEST = 6
CANDIDATE, DIGIT = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"), re.compile("[0-9]")
WORD = "word"
#: Labelled values per automaton, chosen by hash order over all documents.
TRAIN_VALUES = 400
#: Bits per character by which a format must beat ordinary tokens, and by which it may fall short of its weakest label; with
#: n labels, by 1 / n more.
MARGIN, SLACK = 0.5, 0.1
#: Bits in all by which a format must beat ordinary tokens; a stretch of a run of n must do so by log2(n) more.
EVIDENCE = 8.5
#: Character classes as numbers.
SYMBOLS = "xlUd+/_=-."
_CLASS = {ord(c): "x" if "a" <= c <= "f" else "l" if c.islower() else "U" if c.isupper() else "d" for c in "".join(map(chr, range(128))) if c.isalnum()}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind index, end) of the fixed patterns by start, then kind; offsets in code points."""
    out = []
    low = text.lower()
    if (":" in text or "=" in text) and any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _value(text: str, span: tuple[int, int, int]) -> str:
    start, kind, end = span
    if kind:
        return text[start:end]
    return ASSIGN.match(text, start, end)[2]


def classes(value: str) -> str:
    """A value over character classes: hexadecimal letters, other lower case, upper case, digits, and marks as they are."""
    return value.translate(_CLASS)


class Automaton:
    """A probabilistic deterministic automaton learned by merging prefix-tree states."""

    def __init__(self, words: Iterable[str], alpha: float = 0.01):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends, self.total, self.left = [0], [0], [Counter()]
        self.alpha = alpha
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for word in sorted(words):
            at = 0
            for i, c in enumerate(word):
                self.total[at] += 1
                self.left[at][len(word) - i] += 1
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = self._state()
                at = self.next[at][c]
            self.total[at] += 1
            self.left[at][0] += 1
            self.ends[at] += 1
        self._merge_all()

    def _state(self) -> int:
        self.next.append({})
        self.count.append({})
        self.ends.append(0)
        self.total.append(0)
        self.left.append(Counter())
        return len(self.next) - 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _lengths_differ(self, a: int, b: int) -> bool:
        """Whether the distributions of what is left of the words differ somewhere."""
        n, m, f, g = self.total[a], self.total[b], 0, 0
        if max(self.left[a]) < min(self.left[b]) or max(self.left[b]) < min(self.left[a]):
            # all of one before all of the other, by chance alone
            return 2 / math.comb(n + m, n) < self.alpha
        for x in sorted(self.left[a].keys() | self.left[b].keys()):
            f, g = f + self.left[a][x], g + self.left[b][x]
            if self._differ(f, n, g, m):
                return True
        return False

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total[a], self.total[b]
            if not n or not m:
                continue
            if self._differ(self.ends[a], n, self.ends[b], m) or self._lengths_differ(a, b):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                if self._differ(self.count[a].get(c, 0), n, self.count[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            self.left[a] += self.left[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge_all(self) -> None:
        red = [0]
        while True:
            known = set(red)
            blue = [(-self.total[t], r, c, t) for r in red for c, t in sorted(self.next[r].items()) if t not in known]
            if not blue:
                break
            _, parent, c, state = min(blue)
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
        self._tables(red)

    def _tables(self, red: list[int]) -> None:
        """log2 likelihood and next state by state and symbol, log2 likelihood of the end by state and whether a word ended there.

        An unseen symbol leads on to the most frequent next state, so that the length is kept; where words only end, it leads
        into the last state, from which nothing is likely.
        """
        number, sink = {r: i for i, r in enumerate(red)}, len(red)
        rare = [math.log2(0.5 / (self.total[r] + 8)) for r in red] + [math.log2(0.5 / (self.total[0] + 8))]
        self.step, self.to, self.end = np.repeat(np.array(rare)[:, None], len(SYMBOLS), axis=1), np.full((sink + 1, len(SYMBOLS)), sink), np.array(rare)
        self.stops = np.array([self.ends[r] > 0 for r in red] + [False])
        for r, i in number.items():
            count, n = self.count[r], self.total[r] + 8
            self.end[i] = math.log2((self.ends[r] + 0.5) / n)
            if count:
                self.to[i] = number[self.next[r][max(sorted(count), key=count.get)]]
            for c, t in self.next[r].items():
                at = SYMBOLS.find(c)
                self.step[i, at], self.to[i, at] = math.log2((count[c] + 0.5) / n), number[t]

    def read(self, word: str) -> tuple[float, bool]:
        """Mean log2 likelihood per character, the end included, and whether some labelled word ended in that state."""
        at, sum_ = 0, 0.0
        for c in word:
            c = SYMBOLS.find(c)
            sum_ += self.step[at, c]
            at = self.to[at, c]
        return float(sum_ + self.end[at]) / (len(word) + 1), bool(self.stops[at])

    def bits(self, word: str) -> float:
        return self.read(word)[0]


class Scorer:
    """Formats against ordinary tokens. labelled has (kind, value); kinds "" and WORD are ordinary."""

    def __init__(self, labelled: Iterable[tuple[str, str]]):
        by: dict[str, list[str]] = {}
        for kind, value in labelled:
            by.setdefault(kind, []).append(classes(value))
        self.formats = {k: Automaton(v) for k, v in by.items() if k not in ("", WORD)}
        self.ordinary = [Automaton(by[k]) for k in ("", WORD) if k in by] or [Automaton(["llllllll"])]
        self.least = {k: min(a.bits(w) for w in by[k]) - SLACK - 1 / len(by[k]) for k, a in self.formats.items()}
        self.known: dict[str, list[tuple[int, int]]] = {}

    def is_secret(self, value: str) -> bool:
        """Whether a format accepts the whole value."""
        word = classes(value)
        plain = max(a.bits(word) for a in self.ordinary)
        least = plain + max(MARGIN, EVIDENCE / (len(word) + 1))
        return any((b := a.read(word))[1] and b[0] >= max(least, self.least[k]) for k, a in self.formats.items())

    def secrets(self, value: str) -> list[tuple[int, int]]:
        """(start, end) of the secrets in a run: all of it, or the stretches of it that a format accepts."""
        word = classes(value)
        if (out := self.known.get(word)) is None:
            out = [(0, len(word))] if self.is_secret(value) else self._inside(word)
            if len(self.known) > 200_000:
                self.known.clear()
            if len(word) <= 256:
                self.known[word] = out
        return out

    def _inside(self, word: str) -> list[tuple[int, int]]:
        """The stretches of a run that a format accepts, of any length and from any start; of overlapping ones the likeliest.

        A format's automaton is entered before every character; of the stretches that reach one state the one that is most
        ahead of ordinary tokens goes on, so time and memory grow with the run's length times the number of states.
        """
        code, found = [SYMBOLS.find(c) for c in word], []
        plain, ends = np.full(len(word), -np.inf), np.full(len(word), -np.inf)
        for a in self.ordinary:
            state = 0
            for t, c in enumerate(code):
                plain[t] = max(plain[t], a.step[state, c])
                state = a.to[state, c]
                ends[t] = max(ends[t], a.end[state])
        for k, a in self.formats.items():
            ahead = a.step[:, code].max(axis=0) - plain
            least = EVIDENCE + math.log2(len(word))
            if ahead[ahead > 0].sum() < least:
                continue
            lead, bits, since = np.full(len(a.end), -np.inf), np.zeros(len(a.end)), np.zeros(len(a.end), np.int64)
            for t, c in enumerate(code):
                if lead[0] < 0:
                    lead[0], bits[0], since[0] = 0.0, 0.0, t
                new = lead + a.step[:, c] - plain[t]
                by = np.argsort(new, kind="stable")
                to = a.to[by, c]  # the last one written, which is most ahead, stays
                lead, old, start = np.full(len(new), -np.inf), bits, since
                bits, since = np.zeros(len(new)), np.zeros(len(new), np.int64)
                lead[to], bits[to], since[to] = new[by], (old + a.step[:, c])[by], start[by]
                size = t + 2 - since
                hit = a.stops & (lead + a.end - ends[t] >= np.maximum(least, MARGIN * size)) & (bits + a.end >= self.least[k] * size)
                found += [(-float((bits[i] + a.end[i]) / size[i]), int(since[i]), t + 1) for i in np.flatnonzero(hit)]
        out: list[tuple[int, int]] = []
        for _, start, end in sorted(found):
            i = bisect_left(out, (start, end))
            if (i == 0 or out[i - 1][1] <= start) and (i == len(out) or end <= out[i][0]):
                out.insert(i, (start, end))
        return out


def runs(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, rests) of the candidates that are not inside base spans; rests are the parts outside those, from SHORTEST on."""
    at = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        rests, left, touched, i = [], start, False, at
        while i < len(spans) and spans[i][0] < end:
            rests.append((left, spans[i][0]))
            left, touched, i = spans[i][1], True, i + 1
        rests.append((left, end))
        if any(s < e for s, e in rests):
            yield start, end, [(s, e) for s, e in rests if e - s >= SHORTEST] if touched else [(start, end)]


def joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The base spans by start, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s, _, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, plain = set(), set()
        for text in batch.column("text").to_pylist():
            text = text or ""
            spans = base_spans(text)
            found.update((KINDS[span[1]], _value(text, span)) for span in spans)
            if spans:
                plain.update(text[s:e] for s, e, rests in runs(text, joined(spans)) if rests == [(s, e)])
            else:
                plain.update(CANDIDATE.findall(text))
        rows = sorted(found) + sorted(("" if DIGIT.search(v) else WORD, v) for v in plain)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["kind", "value"])


def labelled_values(rows: DataFrame, most: int = TRAIN_VALUES) -> list[tuple[str, str]]:
    """At most `most` values per label in hash order: the fixed patterns label credentials, other candidates are ordinary."""
    both = materialize(rows.select("text").mapInArrow(_label, "kind string, value string").distinct(), "labelled")
    out = []
    for kind in ("", WORD, *KINDS[:3]):
        out += [tuple(r) for r in both.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(most).collect()]
    return out


def _score(scorer: Scorer):
    def scan(text: str) -> tuple:
        spans = base_spans(text)
        listed = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        counts = [sum(k == i for _, k, _ in spans) for i in range(3)]
        more = []
        # without a base span a run's verdict depends on its value alone, so equal runs are judged once
        found = scorer.formats and (spans or any(map(scorer.secrets, set(CANDIDATE.findall(text)))))
        for start, end, rests in runs(text, joined(spans)) if found else ():
            if rests != [(start, end)] and scorer.is_secret(text[start:end]):
                more.append((start, 3, end))
            else:
                more += [(s + x, 3, s + y) for s, e in rests for x, y in scorer.secrets(text[s:e])]
        every = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans + more))
        return *counts, hashlib.sha256(listed.encode()).hexdigest(), every, len(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_grammar"]
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                rows = [scan(text or "") for text in few.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([few.column("id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], ["id", *names])

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_values: int = TRAIN_VALUES) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_grammar: one row per row of docs.

    spans lists kind:start:end of the fixed patterns and of the candidates that the automata accept, by start and kind;
    offsets are code points. The automata are fitted on at most train_values labelled values per kind; everything else covers
    all texts and candidates whole. Of a candidate that is not accepted whole, the accepted stretches are listed; of one that
    extends past base spans, all of it or its rests. docs is read twice. Null text is empty and has no spans; repeated
    rows get equal results; no rows give no rows; other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_grammar long"
    return rows.mapInArrow(_score(Scorer(labelled_values(rows, train_values))), out)
