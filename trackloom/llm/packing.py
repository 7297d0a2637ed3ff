"""Packing documents into fixed-length sequences with a bounded number of open windows per partition."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import freed, materialize

WINDOW = 2_048
END = 1
#: Open windows per partition, and the least gap that is worth a cut.
OPEN, LEAST_CUT = 32, 32
#: Partitions (then groups) whose leftovers one task merges.
FAN_IN = 64
#: Chunks of text kept per worker and their most bytes, bytes of text looked up at once, and new chunks encoded at once.
CACHE, LONGEST = 400_000, 64
STRETCH, AT_ONCE = 2_000_000, 5_000
#: Bytes of text that a task gets from Spark at once, as far as rows allow.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_tokenizers: dict[str, Words] = {}


def _bytes(members: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(members))


#: Bytes of marks, and first bytes of characters that are visible in every version of Unicode.
MARK = _bytes(b"#*$%&|<>.,;:!?")
VISIBLE = _bytes(bytes(range(0x21, 0x7F)) + bytes(range(0xC3, 0xE1)) + bytes(range(0xE4, 0xF5)))
#: Pairs of bytes that end with a letter which every version of Unicode knows.
LETTER = np.zeros((256, 256), bool)
LETTER[:, [c for c in range(128) if chr(c).isalpha()]] = True
for _c in filter(str.isalpha, map(chr, range(0xC0, 0x250))):
    LETTER[tuple(_c.encode())] = True


def cuts(text: np.ndarray) -> np.ndarray:
    """Where a unit always begins in text (UTF-8), as a flag per byte.

    The pre-tokenizer of a byte-level vocabulary always starts a new unit at a single space between visible characters, around
    a line feed between visible characters, and where marks follow a letter.
    """
    out = np.zeros(len(text) + 1, bool)

    def between(gap: int) -> np.ndarray:
        at = np.flatnonzero(text == gap)
        at = at[(at > 0) & (at < len(text) - 1)]
        first = at - 1
        for _ in range(3):
            first -= (text[first] & 0xC0 == 0x80) & (first > 0)
        return at[VISIBLE[text[first]] & VISIBLE[text[at + 1]]]

    out[between(0x20)] = True
    feeds = between(0x0A)
    out[feeds] = out[feeds + 1] = True
    marks = np.flatnonzero(MARK[text])
    out[marks[LETTER[text[np.maximum(marks - 2, 0)], text[np.maximum(marks - 1, 0)]] & (marks > 0)]] = True
    return out[:-1]


class Words:
    """Token ids of a byte-level BPE, kept per chunk of text: texts are cut where a unit always begins, so that of each distinct
    chunk the ids are found once. New chunks are encoded many at a time, with line feeds between.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.bpe = Tokenizer.from_file(path)
        self.special = [t.content for t in self.bpe.get_added_tokens_decoder().values()]
        self.feed = np.frombuffer(self.whole("\n"), "<u4")
        self.chunks, self.lists = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32()))

    def whole(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        return np.array(self.bpe.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _joined(self, new: list[str]) -> pa.ListArray:
        """Ids of each chunk, where a line feed before or after each is a unit of its own."""
        text = "\n".join(new)
        if len(self.feed) == 1 and not any(s in text for s in self.special):
            ids = np.array(self.bpe.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.feed[0]), len(ids))
            if len(ends) == len(new):
                offsets = np.append(0, ends - np.arange(len(new))).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.delete(ids, ends[:-1])))
        return self._each(new)

    def _each(self, new: list[str]) -> pa.ListArray:
        return pa.array([np.frombuffer(self.whole(c), "<u4") for c in new], self.lists.type)

    def encoded(self, new: pa.StringArray) -> pa.ListArray:
        """Ids of each chunk."""
        texts = new.to_pylist()
        plain = np.array([c.isprintable() and c != " " and " " not in c[1:] for c in texts], bool)
        order, n, parts = np.argsort(~plain, kind="stable"), int(plain.sum()), [self.lists.slice(0, 0)]
        for at in range(0, n, AT_ONCE):
            parts.append(self._joined([texts[i] for i in order[at : min(at + AT_ONCE, n)]]))
        parts.append(self._each([texts[i] for i in order[n:]]))
        return pa.concat_arrays(parts).take(pa.array(np.argsort(order)))

    def ids(self, text: str) -> np.ndarray:
        return self.many(pa.array([text]))[0]

    def many(self, texts: pa.StringArray) -> list[np.ndarray]:
        """Ids of each of one or more texts, as little-endian 32-bit numbers; none is null."""
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if ends[0] == ends[-1]:
            return [np.zeros(0, "<u4")] * len(texts)
        raw, ends = texts.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])), ends - ends[0]
        begins = cuts(np.frombuffer(raw, np.uint8))
        for s in self.special:
            for i in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)):
                begins[ends[i] : ends[i + 1]] = False
        begins[ends[:-1][ends[:-1] < len(begins)]] = True
        at = np.append(np.flatnonzero(begins), len(begins)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), raw).dictionary_encode()
        slot = pc.index_in(chunks.dictionary, self.chunks).fill_null(-1).to_numpy().copy()
        new = chunks.dictionary.filter(pa.array(slot < 0))
        slot[slot < 0] = len(self.chunks) + np.arange(len(new))
        lists = self.encoded(new)
        found = pa.concat_arrays([self.lists, lists]).take(pa.array(slot[chunks.indices.to_numpy()]))
        short = pc.less(pc.binary_length(new), LONGEST)
        room = CACHE - len(self.chunks)
        if len(new) and room > 0:
            self.chunks = pa.concat_arrays([self.chunks, new.filter(short).slice(0, room)])
            self.lists = pa.concat_arrays([self.lists, lists.filter(short).slice(0, room)])
        flat, bounds = found.flatten().to_numpy().astype("<u4", copy=False), found.offsets.to_numpy()[np.searchsorted(at, ends)]
        return [flat[i:j] for i, j in zip(bounds.tolist(), bounds[1:].tolist())]


def stretches(texts: pa.StringArray) -> Iterator[pa.StringArray]:
    """Consecutive slices of STRETCH bytes at most, or of one text."""
    sizes, at, n = pc.binary_length(texts).to_pylist(), 0, 0
    for i, size in enumerate(sizes):
        if i > at and n + size > STRETCH:
            yield texts.slice(at, i - at)
            at, n = i, 0
        n += size
    if at < len(texts):
        yield texts.slice(at)


def tokenizer(path: str) -> Words:
    """One per Python worker; path is a file on every executor."""
    if path not in _tokenizers:
        _tokenizers[path] = Words(path)
    return _tokenizers[path]


class Open:
    """Open windows ordered by free space."""

    def __init__(self, window: int):
        self.window, self.free, self.held = window, [], []

    def add(self, free: int, pieces: list) -> None:
        at = bisect.bisect_left(self.free, free)
        self.free.insert(at, free)
        self.held.insert(at, pieces)

    def take(self, at: int) -> tuple[int, list]:
        return self.free.pop(at), self.held.pop(at)

    def best(self, length: int) -> int | None:
        """The window with the least space that holds length."""
        at = bisect.bisect_left(self.free, length)
        return at if at < len(self.free) else None


PIECES = pa.schema(
    [("doc_row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("closed", pa.bool_())]
)


def _pack(encode: Callable[[], Callable[[pa.StringArray], list[np.ndarray]]], window: int, n_open: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = encode(), TaskContext.get().partitionId()
        rows, opened, nth, sequence = [], Open(window), part << 32, part << 32

        def emit(pieces: list, closed: bool = True) -> None:
            nonlocal sequence
            at = 0
            for piece in pieces:
                rows.append((*piece, sequence, at, part, closed))
                at += piece[3]
            sequence += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), PIECES)], schema=PIECES)
            rows.clear()
            return out

        for batch in batches:
            at = 0
            for texts in stretches(batch.column(1).cast(pa.string()).fill_null("")):
                docs = batch.column(0).slice(at, len(texts)).to_pylist()
                at += len(texts)
                for doc, ids in zip(docs, ids_of(texts)):
                    ids = np.append(ids, np.uint32(END)).astype("<u4", copy=False)
                    n, start = len(ids), 0

                    def piece(length: int) -> tuple:
                        nonlocal start
                        start += length
                        return nth, doc, start - length, length, zlib.crc32(ids[start - length : start]), n

                    while n - start >= window:
                        emit([piece(window)])
                    while start < n:
                        best = opened.best(n - start)
                        if best is None and len(opened.free) >= n_open:
                            # none fits: the fullest leaves, filled up first if its gap is worth a cut
                            free, pieces = opened.take(0)
                            emit(pieces + [piece(free)] if free >= LEAST_CUT else pieces)
                            continue
                        free, pieces = opened.take(best) if best is not None else (window, [])
                        free -= n - start
                        pieces.append(piece(n - start))
                        emit(pieces) if not free else opened.add(free, pieces)
                    nth += 1
                if rows:
                    yield flush()
        for pieces in opened.held:
            emit(pieces, False)
        if rows:
            yield flush()

    return run


def _merge(window: int, level: int, last: bool):
    """Best-fit decreasing over the leftover windows of one group; full ones close, and at the last level all do."""

    def run(table: pa.Table) -> pa.Table:
        group, rows = table.column("group")[0].as_py(), table.select(PIECES.names[:6]).to_pylist()
        rows.sort(key=lambda x: (-x["length"], x["doc_row"], x["start"]))
        opened = Open(window)
        for row in rows:
            best = opened.best(row["length"])
            free, pieces = opened.take(best) if best is not None else (window, [])
            opened.add(free - row["length"], [*pieces, row])
        out, sequence = [], (level << 56) | (group << 32)
        for nth, (free, pieces) in enumerate(zip(opened.free, opened.held)):
            at = 0
            for row in pieces:
                out.append(row | {"sequence_id": sequence, "offset": at, "part": group, "closed": last or nth < len(opened.free) - OPEN or not free})
                at += row["length"]
            sequence += 1
        return pa.Table.from_pylist(out, schema=PIECES)

    return run


def _ddl() -> str:
    return ", ".join(f"{f.name} {'boolean' if f.type == pa.bool_() else 'long'}" for f in PIECES).replace("offset", "`offset`")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, n_open: int = OPEN) -> DataFrame:
    """One row per piece: doc_row (a row of docs), doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A row's ids are its text's, then END. Rows longer than a window first fill whole windows. The rest goes into the open
    window of its partition with the least space that holds it; if none does and n_open are open, the fullest is emitted,
    filled with a cut of the row when its gap is LEAST_CUT or more. The windows left open at the end are merged over
    groups of FAN_IN partitions, level by level. Null text is empty and gives one piece of one id; repeated rows and ids are
    packed each (doc_row tells them apart); null ids stay null; no rows give no pieces; other columns are not read.
    """
    encode = lambda: tokenizer(tokenizer_path).many
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(rows.mapInArrow(freed(_pack(encode, window, n_open)), _ddl()), "pieces", BATCH)
    done, left, level = pieces.where("closed"), pieces.where("not closed"), 0
    groups = (left.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        level, groups = level + 1, -(-groups // FAN_IN)
        merged = left.withColumn("group", F.floor(F.col("part") / FAN_IN)).groupBy("group").applyInArrow(_merge(window, level, groups == 1), _ddl())
        merged = materialize(merged, f"leftovers-{level}")
        done, left = done.unionByName(merged.where("closed")), merged.where("not closed")
        if groups == 1:
            return done.drop("part", "closed")
