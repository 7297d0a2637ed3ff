"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is folded into parity sketches: every shingle flips one bit, so the Hamming distance
of two sketches is at most the size of the symmetric difference. Two sets with Jaccard similarity s or more differ in at
most (1 - s) / (1 + s) of their sizes' sum. Sets are dealt into bands by size (2**r up to 2**(r + 1) - 1); a set near the
upper end of its band also visits the bands where larger partners may lie. In a band, the shingles are dealt into blocks by
hash, and a block's value is the XOR of its shingles' hashes (the parities of one wide, sparse bit row). Two similar sets
differ in at most d blocks, so they share all the others, and by the pigeonhole principle each of them may send only its
d + 1 rarest blocks: those without common shingles, and of these the fullest, which two sets hardly share by chance.
Sets that share a sent block are candidates. Sizes reject most that are not similar, then sketches; texts decide.

Equal sets are one class from the start. A block that two classes send is a pair. Of more, one leads and is compared with
each other one. Jaccard distance is a metric, so what is near the leader needs no comparison with what is far from it, and
what is connected needs none at all; only the rest of a block's classes is compared again, under a new leader. In blocks that
are still open at last, the sketches of their members meet in order of size, inside one task a cell, and no pair leaves
it unless the sketches allow a link. Groups of copies are never expanded into all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import components, freed, lookup, materialize, without

WIDTH = 5
#: Similarity as a fraction: PART / WHOLE.
PART, WHOLE = 75, 100
HEAVY_BITS = 20
#: Buckets of shingle hashes that are remembered as heavy; a bound, and only an order of blocks depends on it.
HEAVY_BUCKETS = 65_536
#: A block that more classes than this may send is dealt over several tasks.
HOT_BLOCK = 10_000
#: Rounds of comparison with leaders before the classes of blocks that are still open meet each other in cells.
ROUNDS = 1
#: Classes of a block that one cell holds; larger blocks are split into parts, and each two parts meet in a cell.
CELL = 20_000
CACHE = 400_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_ONE = np.uint64(1)
_S = tuple(np.uint64(x) for x in (30, 27, 31, 32, 44))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = value
        return value


_hashes = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits."""
    x = (x ^ (x >> _S[0])) * _M2
    x = (x ^ (x >> _S[1])) * _M3
    return x ^ (x >> _S[2])


class Sets:
    """Sets of shingle hashes laid end to end: set i is flat[starts[i] : starts[i] + sizes[i]], sorted and distinct."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes
        self.starts = np.cumsum(sizes) - sizes

    def __len__(self) -> int:
        return len(self.sizes)

    def one(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i] : self.starts[i] + self.sizes[i]]

    def pick(self, of: np.ndarray) -> Sets:
        """The sets where the mask is true."""
        return self if of.all() else Sets(self.flat[np.repeat(of, self.sizes)], self.sizes[of])


def _runs(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mask of the places where a new value or a new set begins."""
    new = np.empty(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    new[starts[starts < len(x)]] = True
    return new


def shingles(texts: list[bytes | None], width: int = WIDTH) -> Sets:
    """64-bit hashes of the word shingles of UTF-8 texts; bytes.split() and lower() are ASCII only.

    A text with fewer words than width has one shingle, the whole sequence; one without words has none.
    """
    words = [t.lower().split() if t else () for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    w = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(n.sum()))
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    begins = np.cumsum(n) - n
    x = np.empty(int(counts.sum()), np.uint64)
    starts = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        if len(w) >= width:
            # every window of the words laid end to end; those that cross from one text to the next are left out
            rolled = np.full(len(w) - width + 1, width, np.uint64) * _M1
            for j in range(width):
                rolled = mix(rolled + w[j : len(w) - width + 1 + j])
            long = n >= width
            inside = np.repeat(begins[long] - (np.cumsum(counts[long]) - counts[long]), counts[long]) + np.arange(int(counts[long].sum()))
            x[np.repeat(long, counts)] = rolled[inside]
        for i in np.flatnonzero((n > 0) & (n < width)):
            y = np.full(1, n[i], np.uint64) * _M1
            for j in range(n[i]):
                y = mix(y + w[begins[i] + j])
            x[starts[i]] = y[0]
    for a, b in zip(starts.tolist(), (starts + counts).tolist()):
        x[a:b].sort()
    if not len(x):
        return Sets(x, counts)
    new = _runs(x, starts)
    ends = np.concatenate(([0], np.cumsum(new)))
    return Sets(x[new], ends[starts + counts] - ends[starts])


def set_class(s: np.ndarray) -> int:
    """The identity of a set: a signed 64-bit hash of its sorted shingles."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def most_apart(total: int, part: int, whole: int) -> int:
    """Largest symmetric difference of two sets whose sizes add up to total and whose similarity is part / whole at least."""
    return total * (whole - part) // (whole + part)


class Band:
    """Blocks and sketch width of size band r."""

    def __init__(self, r: int, part: int, whole: int):
        self.r, self.part, self.whole = r, part, whole
        self.last = 2 ** (r + 1) - 1
        self.blocks = 3 * (most_apart(2 * self.last, part, whole) + 1) // 2
        self.bits = max(64, 2 ** (r + 1))

    def sends(self, n: np.ndarray) -> np.ndarray:
        """Blocks that a set of n shingles sends here: one more than it may differ in from any partner."""
        return most_apart(n + np.minimum(n * self.whole // self.part, self.last), self.part, self.whole) + 1


def bands(sizes: np.ndarray, part: int, whole: int) -> Iterator[tuple[Band, np.ndarray]]:
    """(band, mask of the sets that visit it): a set visits its own band and those where a larger partner may lie."""
    own = np.frexp(sizes)[1] - 1
    most = np.frexp(sizes * whole // part)[1] - 1
    for r in range(int(own[sizes > 0].min(initial=64)), int(most.max(initial=-1)) + 1):
        of = (own <= r) & (r <= most) & (sizes > 0)
        if of.any():
            yield Band(r, part, whole), of


def sketches(sets: Sets, bits: int) -> list[bytes]:
    """Parity bits of each set: every shingle flips one."""
    with np.errstate(over="ignore"):
        at = ((mix(sets.flat ^ _M1) >> _S[3]) & np.uint64(bits - 1)).astype(np.int64)
    at += np.repeat(np.arange(len(sets)) * bits, sets.sizes)
    raw = np.packbits((np.bincount(at, minlength=bits * len(sets)) & 1).astype(np.uint8)).tobytes()
    return [raw[i : i + bits // 8] for i in range(0, len(raw), bits // 8)]


def block_keys(sets: Sets, band: Band, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, index of the set, how many shingles as common as its rarest one there may be) of the blocks that sets send in a band.

    A set sends the d + 1 first ones by commonness, then the fullest, then by key, an order that all sets share; blocks
    without shingles come last.
    """
    k = np.uint64(band.blocks)
    with np.errstate(over="ignore"):
        block = ((sets.flat >> _S[3]) * k) >> _S[3]
        starts = np.flatnonzero(_runs(block, sets.starts))
        salt = np.uint64(band.r + 1) * _M3
        keys = mix(np.bitwise_xor.reduceat(mix(sets.flat), starts) ^ mix((block[starts] + np.uint64(1)) * _M1 + salt))
        common = np.minimum.reduceat(heavy[(sets.flat >> _S[4]).astype(np.int64)], starts)
        full = np.diff(np.append(starts, len(sets.flat)))
        of = np.repeat(np.arange(len(sets)), sets.sizes)[starts]
        # one sort: the set, commonness by its leading bits, fullness; the key decides among equals
        rank = (of.astype(np.uint64) << np.uint64(40)) | (np.minimum(common, 0xFFFF_FFFF).astype(np.uint64) << np.uint64(8)) | (255 - np.minimum(full, 255)).astype(np.uint64)
        order = np.lexsort((keys, rank))
        sends, has = band.sends(sets.sizes), np.bincount(of, minlength=len(sets))
        nth = np.arange(len(order)) - np.repeat(np.cumsum(has) - has, has)
        order = order[nth < np.repeat(sends, has)]
        keys_, of_, common_ = [keys[order]], [of[order]], [common[order]]
        for i in np.flatnonzero(sends > has):
            mine = block[starts[of == i]]
            none = np.setdiff1d(np.arange(band.blocks, dtype=np.uint64), mine)
            empty = np.sort(mix(mix((none + np.uint64(1)) * _M1 + salt)))[: sends[i] - has[i]]
            keys_.append(empty)
            of_.append(np.full(len(empty), i))
            common_.append(np.full(len(empty), HOT_BLOCK))
    return np.concatenate(keys_), np.concatenate(of_), np.concatenate(common_)


def _slices(batch: pa.RecordBatch, column: str, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of so many rows or, but for one row, so many bytes of a column at most."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, end - at)
        at = end


SETS = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("band", pa.int32()), ("bits", pa.binary()), ("bucket", pa.int32()), ("count", pa.int64())])
SETS_DDL = "id long, mark long, n long, cls long, band int, bits binary, bucket int, count long"


def _rows(**columns) -> pa.RecordBatch:
    """Rows of SETS; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in SETS], schema=SETS)


def _describe(width: int, part: int, whole: int):
    """Per document its set's size and class; per new class and band a sketch; buckets of shingles that are common in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, total = np.zeros(1 << HEAVY_BITS, np.uint32), set(), 0
        for batch in batches:
            for few in _slices(batch, "text"):
                sets = shingles(few.column("text").to_pylist(), width)
                classes, fresh = [], np.zeros(len(sets), bool)
                for i in range(len(sets)):
                    cls = set_class(sets.one(i)) if sets.sizes[i] else None
                    classes.append(cls)
                    if cls is not None and cls not in seen:
                        seen.add(cls)
                        fresh[i] = True
                yield _rows(id=few.column("id"), mark=few.column("mark"), n=sets.sizes, cls=classes)
                if fresh.any():
                    new, mine = sets.pick(fresh), np.array([c for c, f in zip(classes, fresh) if f])
                    counts += np.bincount((new.flat >> _S[4]).astype(np.int64), minlength=1 << HEAVY_BITS).astype(np.uint32)
                    total += len(new.flat)
                    for band, of in bands(new.sizes, part, whole):
                        yield _rows(cls=mine[of], band=np.full(int(of.sum()), band.r), bits=sketches(new.pick(of), band.bits))
        many = np.flatnonzero(counts > max(8, 8 * total // len(counts)))
        many = many[np.argsort(counts[many])[::-1][:HEAVY_BUCKETS]]
        if len(many):
            yield _rows(bucket=many, count=counts[many])

    return run


def _send(heavy, width: int, part: int, whole: int):
    """(cls, key) of the blocks that each class sends; the last bit of a key says that it may be hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.zeros(1 << HEAVY_BITS, np.int64), set()
        for bucket, count in heavy.value:
            table[bucket] = count
        for batch in batches:
            for few in _slices(batch, "text"):
                sets = shingles(few.column("text").to_pylist(), width)
                classes = np.array([set_class(sets.one(i)) if n else 0 for i, n in enumerate(sets.sizes)], np.int64)
                fresh = np.array([bool(n) and c not in seen and not seen.add(c) for c, n in zip(classes.tolist(), sets.sizes)], bool)
                new, mine = sets.pick(fresh), classes[fresh]
                for band, of in bands(new.sizes, part, whole):
                    keys, at, common = block_keys(new.pick(of), band, table)
                    keys = (keys & ~_ONE) | (common > HOT_BLOCK).astype(np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(mine[of][at]), pa.array(keys.view(np.int64))], ["cls", "key"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cls, key) in order of key, class become (a, b) for a block of two classes and (a, key) for one of more.

    Blocks of one class go. Hot ones, which lie in several tasks, and the parts of those over HOT_BLOCK rows all stay.
    """
    empty = np.empty(0, np.int64)
    key, cls, big = empty, empty, None
    for batch in chain(batches, [None]):
        if batch is not None:
            key, cls = np.concatenate((key, batch.column("key").to_numpy())), np.concatenate((cls, batch.column("cls").to_numpy()))
            if not len(key):
                continue
            # the last block may go on in the next batch
            end = int(np.searchsorted(key, key[-1], "left"))
            if len(key) - end > HOT_BLOCK:
                big, end = int(key[-1]), len(key)
        else:
            end = len(key)
        k, c, key, cls = key[:end], cls[:end], key[end:], cls[end:]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        k, c = k[new], c[new]
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else empty
        size = np.diff(np.append(starts, len(k)))
        kept = (k[starts] & 1 > 0) | (k[starts] == big if big is not None else False)
        two, many = starts[(size == 2) & ~kept], np.repeat((size > 2) | kept, size)
        # a pair that shares many blocks is told once a batch
        pairs = np.unique(np.stack((c[two], c[two + 1])), axis=1) if len(two) else np.empty((2, 0), np.int64)
        n = pairs.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((pairs[0], c[many]))), pa.array(np.concatenate((pairs[1], k[many] * 0)), mask=np.arange(n + many.sum()) >= n), pa.array(np.concatenate((pairs[0] * 0, k[many])), mask=np.arange(n + many.sum()) < n)],
            ["a", "b", "key"],
        )


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _near(part: int, whole: int):
    """far of each pair: 0 if the sketches allow a link, 2 if they prove that neither can be near what is near the other, else 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("na", "nb"))
            apart = np.abs(n - m)
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                if x is not None and y is not None:
                    apart[i] = max(apart[i], _apart(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
            far = np.where(apart <= most_apart(n + m, part, whole), 0, np.where(apart <= most_apart(n + m, max(1, 2 * part - whole), whole), 1, 2))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(far, pa.int32())], ["a", "b", "far"])

    return run


class _Held:
    """Sketches by size, with (class, size, root, part) of each; those that are too small for what comes are left behind."""

    def __init__(self, words: int):
        self.bits, self.about = np.empty((8, words), np.uint64), np.empty((8, 4), np.int64)
        self.first = self.last = 0

    def add(self, bits: np.ndarray, about: tuple[int, int, int, int]) -> None:
        if self.last == len(self.bits):
            kept = self.last - self.first
            for name in ("bits", "about"):
                old = getattr(self, name)
                new = np.empty((max(8, 2 * kept), old.shape[1]), old.dtype)
                new[:kept] = old[self.first : self.last]
                setattr(self, name, new)
            self.first, self.last = 0, kept
        self.bits[self.last], self.about[self.last] = bits, about
        self.last += 1

    def near(self, bits: np.ndarray, about: tuple[int, int, int, int], across: bool, part: int, whole: int) -> list[int]:
        """Classes of other roots (and, across, of the other part) whose sketches allow a link."""
        _, n, root, mine = about
        while self.first < self.last and n - self.about[self.first, 1] > most_apart(n + int(self.about[self.first, 1]), part, whole):
            self.first += 1
        old = self.about[self.first : self.last]
        meets = old[:, 2] != root
        if across:
            meets &= old[:, 3] != mine
        at = np.flatnonzero(meets)
        if not len(at):
            return []
        old = old[at]
        return old[_apart(self.bits[self.first + at], bits) <= most_apart(old[:, 1] + n, part, whole), 0].tolist()


def _cells(part: int, whole: int):
    """Pairs (a, b) of different roots in a cell whose sketches allow a link. Rows come by cell and size: a set meets those before
    it that are not too small for it; the members of the cell's largest component (held) do not meet each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, large, others = None, None, None
        for batch in batches:
            found = set()
            cols = [batch.column(c).to_pylist() for c in ("g", "band", "lo", "hi", "part", "cls", "n", "root", "held", "bits")]
            for g, band, lo, hi, mine, cls, n, root, is_large, bits in zip(*cols):
                row, about = np.frombuffer(bits, np.uint64), (cls, n, root, mine)
                if cell != (g, band, lo, hi):
                    cell, large, others = (g, band, lo, hi), _Held(len(row)), _Held(len(row))
                # sets of the band below meet each other there, and sets of one part in that part's own cell
                if n >= 1 << band:
                    for held in (others,) if is_large else (large, others):
                        found.update((min(c, cls), max(c, cls)) for c in held.near(row, about, lo != hi, part, whole))
                (large if is_large else others).add(row, about)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*sorted(found))], ["a", "b"])

    return run


def _verify(width: int, part: int, whole: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            for few in _slices(batch, "y", 128):
                a, b, x = (few.column(c).to_pylist() for c in ("a", "b", "x"))
                others, links = shingles(few.column("y").to_pylist(), width), []
                for i, j, p, at in zip(a, b, x, range(len(a))):
                    if last != i:
                        last, kept = i, shingles([p], width).flat
                    s = others.one(at)
                    both = len(np.intersect1d(kept, s, assume_unique=True))
                    if whole * both >= part * (len(kept) + len(s) - both):
                        links.append((i, j))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    return run


def _classed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for few in _slices(batch, "text"):
                texts = few.column("text").to_pylist()
                sets = shingles(texts, width)
                out = [(cls, t) for i, t in enumerate(texts) if sets.sizes[i] and (cls := set_class(sets.one(i))) not in seen and not seen.add(cls)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["cls", "text"])

    return run


def _band_of(n: Column) -> Column:
    return (F.length(F.bin(n)) - 1).cast("int")


class Join:
    """The steps of the join over one documents table; texts must be functions of ids among equal sets."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, part: int, whole: int):
        self.shape = width, part, whole
        self.spark = docs.sparkSession
        text = F.col(text_col).cast("string")
        self.texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"))
        rows = materialize(self.texts.mapInArrow(freed(_describe(*self.shape)), SETS_DDL), "sets")
        self.docs = rows.where("band is null and bucket is null").select("id", "mark", "n", "cls")
        self.heavy = rows.where("bucket is not null").groupBy("bucket").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "bucket").limit(HEAVY_BUCKETS)
        self.sketches = rows.where("band is not null").select("cls", "band", "bits")
        self.classes = materialize(
            self.docs.where("cls is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("size")), "classes"
        )

    def buckets(self) -> tuple[DataFrame, DataFrame]:
        """(pairs, rows): a, na, b, nb of the blocks that two classes send, and key, cls, n of those that more may send."""
        heavy = self.spark.sparkContext.broadcast([tuple(r) for r in self.heavy.collect()])
        keys = self.texts.select("text").mapInArrow(freed(_send(heavy, *self.shape)), "cls long, key long")
        # the rows of a hot block are dealt by class as well
        keys = keys.repartition(F.when(F.col("key").bitwiseAND(1) == 0, F.col("key")).otherwise(F.xxhash64("key", F.pmod("cls", F.lit(1_024)))))
        found = materialize(keys.sortWithinPartitions("key", "cls").mapInArrow(freed(_meet), "a long, b long, key long"), "buckets")
        size = lambda c, n: self.classes.select(F.col("cls").alias(c), F.col("n").alias(n))
        pairs = found.where("b is not null").select("a", "b").distinct().join(size("b", "nb"), "b").join(size("a", "na"), "a")
        return pairs.select("a", "na", "b", "nb"), one_of_equal(found.where("key is not null").select("key", F.col("a").alias("cls")).join(size("cls", "n"), "cls"))

    def reach(self, a: Column, b: Column, part: int) -> Column:
        """Whether sizes alone allow similarity part."""
        whole = self.shape[2]
        return F.abs(a - b) <= F.floor((a + b) * F.lit(whole - part) / F.lit(whole + part))

    def wide(self, a: Column, b: Column) -> Column:
        return self.reach(a, b, max(1, 2 * self.shape[1] - self.shape[2]))

    def judge(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, na, b, nb) of classes with far: 0 similar, 2 surely too far apart for links of one to reach the other, else 1."""
        pairs = materialize(pairs.withColumn("band", _band_of(F.greatest("na", "nb"))), "pairs")
        used = pairs.select(F.col("a").alias("cls"), "band").union(pairs.select(F.col("b").alias("cls"), "band")).distinct()
        bits = self.bits(materialize(used, "used"), "cls", "band")
        side = lambda c, name: bits.select(F.col("cls").alias(c), "band", F.col("bits").alias(name))
        both = pairs.join(side("b", "y"), ["b", "band"], "left").join(side("a", "x"), ["a", "band"], "left")
        seen = materialize(both.select("a", "na", "x", "b", "nb", "y").mapInArrow(freed(_near(*self.shape[1:])), "a long, b long, far int"), "near")
        links = self.confirm(seen.where("far = 0").select("a", "b"))
        far = F.when(F.col("far") > 0, F.col("far")).when(F.col("linked"), F.lit(0)).otherwise(F.lit(1))
        return seen.join(links.withColumn("linked", F.lit(True)), ["a", "b"], "left").select("a", "b", far.alias("far"))

    def bits(self, used: DataFrame, *by: str) -> DataFrame:
        """The sketches of the classes (and bands) in used, each once."""
        return materialize(self.sketches.join(used, list(by), "left_semi").dropDuplicates(["cls", "band"]), "sketches")

    def confirm(self, near: DataFrame) -> DataFrame:
        """The pairs whose texts have similar sets."""
        # texts that are needed: one row per class, whatever number of pairs it is in
        used = near.select(F.col("a").alias("cls")).union(near.select(F.col("b").alias("cls"))).distinct()
        used = materialize(used.join(self.classes.select("cls", "rep"), "cls"), "used")
        if used.isEmpty():
            return near
        found = self.texts.join(used.select("rep"), F.col("id").eqNullSafe(F.col("rep")), "left_semi").select("id", "text").mapInArrow(freed(_classed(self.shape[0])), "cls long, text binary")
        found = materialize(found.join(used.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.min("text").alias("text")), "texts")
        both = near.join(found.select(F.col("cls").alias("b"), F.col("text").alias("y")), "b").join(found.select(F.col("cls").alias("a"), F.col("text").alias("x")), "a")
        return materialize(both.select("a", "b", "x", "y").mapInArrow(freed(_verify(*self.shape)), "a long, b long"), "links")

    def within(self, open_: DataFrame) -> DataFrame:
        """Near pairs (a, b) of different components in open blocks, by comparing their members' sketches in cells.

        Blocks with the same least class mostly overlap: together they are one group, so a sketch is sent once for all of them.
        """
        group = open_.groupBy("key").agg(F.min("cls").alias("g"))
        rows = materialize(open_.join(group, "key").select("g", "cls", "n", "root").distinct(), "groups")
        # members of a group's largest component only meet the others
        large = rows.groupBy("g", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("g").agg(F.max(F.struct("c", "root"))["root"].alias("large"))
        rows = rows.join(large, "g").select("g", "cls", "n", "root", (F.col("root") == F.col("large")).alias("held"))
        rows = rows.join(self.bits(materialize(rows.select("cls").distinct(), "used"), "cls"), "cls")
        rows = materialize(rows, "sketched")
        parts = rows.groupBy("g", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL)).cast("int").alias("parts"))
        rows = rows.join(parts, ["g", "band"]).withColumn("part", F.pmod(F.xxhash64("cls"), "parts").cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
        cell = ["g", "band", "lo", "hi"]
        rows = rows.repartition(*cell).sortWithinPartitions(*cell, "n", "cls").select(*cell, "part", "cls", "n", "root", "held", "bits")
        return rows.mapInArrow(freed(_cells(*self.shape[1:])), "a long, b long").distinct()

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(docs with mark, n and cls, root of each class that has a link)."""
        pairs, open_ = self.buckets()
        judged = materialize(self.judge(pairs.where(self.wide(F.col("na"), F.col("nb")))), "judged")
        roots = self.roots(judged)
        open_ = self.still_open(open_, roots)
        for nth in range(ROUNDS):
            if open_.isEmpty():
                return self.docs, roots
            # the class with the most company in all its blocks leads
            sizes = open_.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
            degree = open_.join(sizes, "key").groupBy("cls").agg(F.sum("size").alias("degree"))
            lead = open_.join(degree, "cls").groupBy("key").agg(F.max(F.struct("degree", "cls", "n")).alias("lead")).select("key", F.col("lead.cls").alias("leader"), F.col("lead.n").alias("m"))
            rows = open_.join(lead, "key").where("cls <> leader").withColumn("wide", self.wide(F.col("n"), F.col("m")))
            rows = rows.withColumns({"a": F.least("cls", "leader"), "b": F.greatest("cls", "leader")})
            rows = materialize(rows.withColumns({"na": F.when(F.col("a") == F.col("cls"), F.col("n")).otherwise(F.col("m")), "nb": F.when(F.col("a") == F.col("cls"), F.col("m")).otherwise(F.col("n"))}), "led")
            new = rows.where("wide").select("a", "na", "b", "nb").distinct().join(judged, ["a", "b"], "left_anti")
            judged = materialize(judged.unionByName(self.judge(new)), "judged")
            roots = self.roots(judged)
            # the near meet those in between, those in between meet the far; each part is a block of the next round
            rows = rows.join(judged, ["a", "b"], "left").withColumn("far", F.coalesce("far", F.lit(2)))
            side = F.explode(F.when(F.col("far") == 1, F.array(F.lit(0), F.lit(2))).otherwise(F.array("far")))
            rows = rows.select(F.col("key").alias("old"), "cls", "n", side.alias("side"))
            open_ = self.still_open(rows.select(F.xxhash64("old", "side", F.lit(nth)).alias("key"), "cls", "n"), roots)
        if open_.isEmpty():
            return self.docs, roots
        near = materialize(self.within(open_).join(judged, ["a", "b"], "left_anti"), "near")
        links = judged.where("far = 0").select("a", "b").union(self.confirm(near))
        return self.docs, materialize(components(links, "a", "b"), "roots")

    def roots(self, judged: DataFrame) -> DataFrame:
        return materialize(components(judged.where("far = 0"), "a", "b"), "roots")

    def still_open(self, rows: DataFrame, roots: DataFrame) -> DataFrame:
        """Blocks whose classes are not all connected, with roots; of blocks with equal members one."""
        rows = rows.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        rows = materialize(rows.select("key", "cls", "n", "root"), "members")
        span = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        return materialize(one_of_equal(rows.join(span, "key", "left_semi")), "open")


def one_of_equal(rows: DataFrame) -> DataFrame:
    """The rows of one key of each set of keys that have the same classes."""
    members = rows.groupBy("key").agg(F.bit_xor(F.xxhash64("cls")).alias("x"), F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("s"))
    return rows.join(members.groupBy("x", "c", "s").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def _classified(docs: DataFrame, id_col: str, text_col: str, width: int, part: int, whole: int) -> DataFrame:
    """id, mark (a hash of the text), n, and component_id and first (the class that holds it) where the class has company."""
    join = Join(docs, id_col, text_col, width, part, whole)
    docs_, roots = join.run()
    group = join.classes.select("cls", "rep", "size").join(roots.withColumnRenamed("node", "cls"), "cls", "left").where("size > 1 or root is not null")
    group = group.withColumn("root", F.coalesce("root", "cls"))
    least = group.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep", "cls")).alias("least"))
    members = group.join(least, "root").select("cls", F.col("least.rep").alias("component_id"), F.col("least.cls").alias("first"), "size")
    return lookup(materialize(docs_, "docs"), materialize(members, "members"), "cls", "size")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, part: int = PART, whole: int = WHOLE) -> DataFrame:
    """id, n_shingles and component_id (smallest id reachable over links, own included), one row per row of docs.

    Two documents link when whole * |A and B| >= part * |A or B| over their distinct width-word shingles; with fewer words
    the whole sequence is one shingle. Null, empty and blank texts have no shingles and link with nothing; equal texts
    link; repeated rows give repeated rows; a null id never becomes a component_id unless its component has no other.
    Shingles are compared by 64-bit hashes. No rows give no rows; other columns of docs are not read.
    """
    found = _classified(docs, id_col, text_col, width, part, whole)
    return found.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, part: int = PART, whole: int = WHOLE) -> DataFrame:
    """docs with one document of each component: the one with the smallest id, then the least text hash; all columns as they were.

    Rows are told apart by id and text. Of repeated rows (equal id and text) and of rows whose texts have equal sets and equal
    ids one stays; rows that only share an id are documents of their own. A component whose ids are all null keeps one
    row too. Null, empty and blank texts have no copies and stay, repeated ones as well.
    """
    found = materialize(_classified(docs, id_col, text_col, width, part, whole).where("first is not null"), "companies")
    # the row that stays: of the class that holds the component's id, the one with the id and the least mark
    stays = found.where(F.col("cls") == F.col("first")).where(F.col("id").eqNullSafe(F.col("component_id")))
    stays = stays.groupBy("first").agg(F.min("mark").alias("mark"), F.first("component_id").alias("id"), F.count(F.lit(1)).alias("rows"))
    stays = materialize(stays.select("id", "mark", "rows"), "stays")
    every = found.select("id", "mark").distinct()
    gone = every.join(stays, every["id"].eqNullSafe(stays["id"]) & (every["mark"] == stays["mark"]), "left_anti")
    return without(docs, gone, stays.where("rows > 1").select("id", "mark"), id_col, text_col)
