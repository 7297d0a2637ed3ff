"""Exact dedup by a log-structured merge index, with DataFrame functions only.

Rows are logged as (row, id, length, digest). Every memtable_rows consecutive log rows are one memtable, flushed as a run:
one entry per digest, sorted by digest, in Parquet files that carry min/max fences and Bloom filters on the digest.
Compaction merges runs into one entry per digest, which keeps the best row and the count, and builds the index's filter: a
bitmap with a bit per digest. A hit (a digest with more than one row) is verified byte by byte; the filter is asked before
any text moves, so only hits and a few false ones do. Digests whose texts differ are split into one entry per text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import lookup, materialize, no_space, without

Digest = Callable[[Column], Column]
#: Bits of the filter per digest, bits of one of its pages, and the largest filter that is sent to every task.
FILTER_BITS, PAGE_BITS, SENT_BYTES = 16, 32_768, 32 << 20


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def log(docs: DataFrame, id_col: str, text_col: str, digest: Digest) -> DataFrame:
    """The write-ahead log: one small row per document."""
    norm = no_space(F.col(text_col))
    return materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("long").alias("id"),
            F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("len"),
            F.xxhash64(F.col(text_col).cast("string")).alias("mark"),
            digest(norm).alias("digest"),
        ),
        "lsm-log",
    )


def flush(wal: DataFrame, memtable_rows: int) -> DataFrame:
    """Sorted runs with filters. best orders by length, then smallest id (null last), then first row."""
    part, at = F.shiftrightunsigned("row", 33), F.col("row").bitwiseAND((1 << 33) - 1)
    best = F.struct("len", F.col("id").isNotNull().alias("has"), F.bitwise_not("id").alias("nid"), F.bitwise_not("row").alias("nrow"))
    runs = (
        wal.withColumn("run", F.struct(part.alias("part"), F.floor(at / memtable_rows).alias("nth")))
        .repartition("run")
        .groupBy("run", "digest")
        .agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("n"))
        .sortWithinPartitions("run", "digest")
    )
    return materialize(runs, "lsm-run", **{"parquet.bloom.filter.enabled#digest": "true"})


def compact(runs: DataFrame) -> DataFrame:
    """Merge runs: one entry per digest; of its rows the best stays, counts add up."""
    merged = runs.groupBy("digest").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    return materialize(merged.where("n > 1").sortWithinPartitions("digest"), "lsm-index", **{"parquet.bloom.filter.enabled#digest": "true"})


def asked(texts: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """The rows of texts whose digest the index's filter has; all rows if the filter of n digests would pass SENT_BYTES."""
    bits = max(PAGE_BITS, 1 << (FILTER_BITS * n - 1).bit_length() if n else 0)
    if bits // 8 > SENT_BYTES:
        return texts
    # never null, so that the join needs no check for which the digest would be computed once more
    place = F.xxhash64("digest").bitwiseAND(bits - 1)
    bit, page = place.bitwiseAND(PAGE_BITS - 1), F.shiftrightunsigned(place, PAGE_BITS.bit_length() - 1)
    pages = materialize(index.select(bit.alias("bit"), page.alias("page")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bitmap")), "lsm-filter")
    rows = texts.withColumns({"bit": bit, "page": page}).join(F.broadcast(pages), "page")
    byte = F.conv(F.hex(F.substring("bitmap", F.shiftright("bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.where(F.call_function("shiftright", byte, F.col("bit").bitwiseAND(7).cast("int")).bitwiseAND(1) == 1).select(*texts.columns)


def collisions(docs: DataFrame, index: DataFrame, text_col: str, digest: Digest) -> DataFrame:
    """Digests of the index under which different texts lie, by comparing the bytes of every hit.

    A group's texts are equal when its smallest and its largest text are. Both combine before the shuffle, so a group
    sends two texts per task at most. The few texts that only the filter takes for hits are alone under their digest.
    """
    norm = no_space(F.col(text_col))
    texts = asked(docs.select(digest(norm).alias("digest"), F.col(text_col).alias("text")), index, index.count())
    norm = no_space(F.col("text"))
    return texts.groupBy("digest").agg(F.min(norm).alias("lo"), F.max(norm).alias("hi")).where("lo <> hi").select("digest")


def _entries(docs: DataFrame, id_col: str, text_col: str, digest: Digest, memtable_rows: int) -> DataFrame:
    """The log with the entry of each digest that has one: best_id, best_row, n."""
    wal = log(docs, id_col, text_col, digest)
    index = compact(flush(wal, memtable_rows))
    bad = materialize(collisions(docs, index, text_col, digest), "lsm-collisions")
    if not bad.isEmpty():
        # a digest holds different texts: give each text of such a digest a longer digest, and index again
        norm = no_space(F.col(text_col))
        wide = F.concat(F.lit("x"), F.sha2(norm, 512), F.sha2(F.reverse(norm), 512))
        return _entries(docs, id_col, text_col, lambda _: wide, memtable_rows)
    entry = index.select("digest", F.bitwise_not("best.nid").alias("best_id"), F.bitwise_not("best.nrow").alias("best_row"), "n")
    found = lookup(wal, entry, "digest", "n")
    return found.withColumn("kept", F.col("n").isNull() | (F.col("row") == F.col("best_row")))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Digest = sha256,
    memtable_rows: int = 100_000,
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, n_chars, digest of the text without ASCII white space.

    Of equal texts the longest original stays, then the smallest id, then the first row; null ids come last.
    Null text is empty, so empty and null texts form one group. Repeated rows are copies: one of them stays.
    No rows give no rows; other columns of docs are not read.
    """
    found = _entries(docs, id_col, text_col, digest, memtable_rows)
    return found.select(
        F.col("id"),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        "kept",
        F.col("len").alias("n_chars"),
        F.col("digest"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup() drops, all columns as they were.

    Rows are told apart by id and text; of repeated rows, which may differ in other columns, the first by their values as
    JSON stays. Empty tables stay empty.
    """
    found = materialize(_entries(docs, id_col, text_col, sha256, 100_000).where("n > 1").select("id", "mark", "kept"), "lsm-copies")
    per = found.groupBy("id", "mark").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    per = materialize(per, "lsm-verdicts")
    return without(docs, per.where("not kept").select("id", "mark"), per.where("kept and rows > 1").select("id", "mark"), id_col, text_col)
