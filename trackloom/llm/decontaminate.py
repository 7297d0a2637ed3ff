"""Benchmark decontamination by a prefix-filtered set join of item windows with documents.

A window's set is its shingles. Documents are read twice. The first pass counts the items' shingles over all documents; the
rarest one of a window is its necessary prefix, as a window that is contained whole has all of its shingles. The second pass
looks prefix shingles up; each occurrence and its offset fix the place of an item-sized window, which must lie inside the
document (length and position) and is then compared as text. Windows that meet in a document are joined by their text, so no
pair is made that is not an occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import lookup, materialize

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 10, 3
#: Bits of a filter per shingle, bits of one of its pages, and the most bits (32 MB); only false lookups grow beyond.
FILTER_BITS, PAGE_BITS, MOST_BITS = 256, 32_768, 1 << 28
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20
#: A-Z lower-cased; ASCII letters, digits and all other characters' bytes make words, the rest is blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """_BASE and its inverse modulo 2**64 to the powers 0 to n."""
    if len(_powers[0]) <= n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(2 * n + 1, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts (UTF-8), laid end to end: the text of each, its place in `low`, and a hash."""

    def __init__(self, texts: list[bytes]):
        self.low = b"".join(texts).translate(FOLD)
        sizes = np.array([len(t) for t in texts], np.int64)
        at = np.concatenate(([0], np.cumsum(sizes)))
        code = np.frombuffer(self.low, np.uint8)
        inside = code != 32
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        # words do not go on from one text to the next
        heads, tails = at[:-1][sizes > 0], at[1:][sizes > 0] - 1
        first[heads], last[tails] = inside[heads], inside[tails]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(at, self.start, "right") - 1
        self.count = np.bincount(self.text, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count
        self.hash = np.zeros(len(self.start), np.uint64)
        cuts = [*np.unique(np.searchsorted(self.start, np.arange(0, len(code), BLOCK))), len(self.start)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            lo, s, e = self.start[a], self.start[a:b] - self.start[a], self.end[a:b] - self.start[a]
            power, inverse = _power(int(e[-1]))
            sums = np.zeros(e[-1] + 1, np.uint64)
            np.cumsum(code[lo : lo + e[-1]] * power[: e[-1]], out=sums[1:])
            self.hash[a:b] = _mix((sums[e] - sums[s]) * inverse[s])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of the runs of k words of one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = h * np.uint64(_BASE) + self.hash[j : j + n]
        at = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
        return at, _mix(h[at]).view(np.int64)

    def words(self, a: int, b: int) -> str:
        """The words from number a to b, with single blanks between."""
        return b" ".join(self.low[self.start[a] : self.end[b - 1]].split()).decode()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Some rows and their words, about BLOCK bytes of text at a time; a longer text comes alone."""
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        at, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > BLOCK:
                yield batch.slice(at, i - at), Words(texts[at:i])
                at, size = i, 0
            size += len(t)
        if at < len(texts):
            yield batch.slice(at), Words(texts[at:])


def _windows(size: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in _chunks(batches):
            by = [dict(zip(*map(np.ndarray.tolist, w.shingles(j)))) for j in range(1, k + 1)]
            rows = []
            for item, n, first in zip(batch.column("item").to_pylist(), w.count.tolist(), w.first.tolist()):
                m = min(size, n)
                j = min(k, m)
                for a in range(first, first + n - m + 1) if n else ():
                    rows.append((item, w.words(a, a + m), m, [by[j - 1][x] for x in range(a, a + m - j + 1)]))
            yield pa.RecordBatch.from_pydict({"item": pa.array([r[0] for r in rows], pa.string()), "window": pa.array([r[1] for r in rows], pa.string()), "words": pa.array([r[2] for r in rows], pa.int32()), "tokens": pa.array([r[3] for r in rows], pa.list_(pa.int64()))})

    return run


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, window, words, tokens): every window of `window` words of each item, a shorter item whole, with its shingles' hashes."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_windows(window, shingle), "item string, window string, words int, tokens array<long>").distinct()


def _bitmap(tokens: DataFrame) -> Broadcast:
    """A filter of all tokens that every task gets: MOST_BITS at most."""
    n = tokens.count()
    bits = max(PAGE_BITS, min(MOST_BITS, 1 << (FILTER_BITS * n).bit_length()))
    place = F.col("token").bitwiseAND(bits - 1)
    pages = tokens.select(place.bitwiseAND(PAGE_BITS - 1).alias("bit"), F.shiftrightunsigned(place, PAGE_BITS.bit_length() - 1).alias("page")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pages.toLocalIterator():
        out[r["page"] * PAGE_BITS // 8 : (r["page"] + 1) * PAGE_BITS // 8] = np.frombuffer(r["map"], np.uint8)
    return tokens.sparkSession.sparkContext.broadcast(out)


def _passing(filter_: Broadcast, tokens: np.ndarray) -> np.ndarray:
    bits = filter_.value
    place = tokens & (8 * len(bits) - 1)
    return np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)


def _count(filter_: Broadcast, lengths: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w in _chunks(batches):
            found = [t[_passing(filter_, t)] for _, t in map(w.shingles, lengths)]
            token, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict({"token": pa.array(token, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


NEAR = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int32()), ("since", pa.int32()), ("near", pa.string())]))


def _scan(filter_: Broadcast, lengths: list[int], size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in _chunks(batches):
            found = [[] for _ in range(batch.num_rows)]
            for k in lengths:
                at, tokens = w.shingles(k)
                for i in _passing(filter_, tokens).tolist():
                    p = int(at[i])
                    t = int(w.text[p])
                    lo = int(w.first[t])
                    a, b = max(lo, p - size + k), min(lo + int(w.count[t]), p + size)
                    found[t].append({"token": int(tokens[i]), "at": p - lo, "since": a - lo, "near": w.words(a, b)})
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "id": batch.column("id"), "n_words": pa.array(w.count, pa.int64()), "found": pa.array(found, NEAR)})

    return run


def hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(row, id, n_words) of every document, and (row, start, words, items) of every window that occurs in one; repeats are possible."""
    windows = materialize(item_windows(items, item_col, item_text_col, window, shingle), "item-windows")
    each = windows.dropDuplicates(["window"]).select("window", "words", F.posexplode("tokens").alias("offset", "token"))
    lengths = sorted(min(shingle, r[0]) for r in windows.select("words").distinct().collect())  # `window` rows at most
    lengths = sorted(set(lengths)) or [shingle]
    text = F.col(text_col).cast("string").alias("text")
    seen = docs.select(text).mapInArrow(_count(_bitmap(each.select("token").distinct()), lengths), "token long, n long")
    seen = materialize(seen.groupBy("token").agg(F.sum("n").alias("n")), "token-counts")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("least")
    prefix = each.join(seen, "token", "left").groupBy("window", "words").agg(rarest)
    prefix = prefix.groupBy("least.token").agg(F.max("least.n").alias("n"), F.collect_set(F.struct("least.offset", "words")).alias("places"))
    prefix = materialize(prefix.where("n > 0"), "prefixes")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text)
    out = "row long, id long, n_words long, found array<struct<token:long,at:int,since:int,near:string>>"
    scan = materialize(rows.mapInArrow(_scan(_bitmap(prefix.select("token")), lengths, window), out), "scanned")
    met = lookup(scan.select("row", F.inline("found")), prefix, "token", "n", "inner")
    met = met.select("row", "at", "since", F.split("near", " ").alias("near"), F.inline("places"))
    met = met.withColumn("start", F.col("at") - F.col("offset")).where("start >= since and start - since + words <= size(near)")
    met = met.select("row", "start", "words", F.array_join(F.slice("near", F.col("start") - F.col("since") + 1, F.col("words")), " ").alias("window"))
    met = materialize(met, "placed-windows")
    known = windows.groupBy("window").agg(F.collect_set("item").alias("items"))
    known = materialize(known.join(met.groupBy("window").agg(F.count(F.lit(1)).alias("n")), "window"), "met-windows")
    return scan.select("row", "id", "n_words"), lookup(met, known, "window", "n", "inner").select("row", "start", "words", "items")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of docs.

    A word is hit if an item's window of `window` words (the whole item if it has fewer) occurs there. n_items counts the items
    that have such a window, items_sha256 is the digest of their ids sorted as strings and joined by commas. Null texts
    have no words and hit nothing, as do items without words; an item without an id marks words and is not listed; repeated
    rows of docs get equal results, repeated items count once; no rows give no rows, without items nothing is hit; other
    columns are not read. A document's items are gathered in one row, as its digest needs them all.
    """
    base, found = hits(docs, items, id_col, text_col, item_col, item_text_col, window, shingle)
    found = materialize(found, "window-hits")
    # words that no earlier window of the row covers
    before = F.max(F.col("start") + F.col("words")).over(Window.partitionBy("row").orderBy("start", "words").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("start") + F.col("words") - F.greatest("start", F.coalesce(before, F.lit(0))))
    covered = found.select("row", new.alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    listed = found.select("row", F.explode("items").alias("item")).groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    all_ = base.join(covered, "row", "left").join(listed, "row", "left")
    return all_.select(
        "id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.array_size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
