"""Shared folder, lineage cuts and skew-safe lookups for the operators of this package."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts spell it.
SPACE = r"[\x20\x09-\x0D]"
OWN_FOLDER = "/tmp/checkpoints/trackloom"
#: Whether Spark drops the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key is hot when it has at least 1 / HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 10_000
#: Edges of which one task finds the components in its memory.
FOREST_EDGES = 250_000


#: Tables that the present step of a pipeline writes (None outside of one), and those that each step has left.
_writing: list[str] | None = None
_left: dict[int, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where it is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or OWN_FOLDER).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, settings: dict[str, str] | None = None, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends at files that survive executors.

    The shuffle files of the write are dropped when it ends, as nothing can read them again. settings hold while it runs.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if _writing is not None:
        _writing.append(path)
    settings = {CLEANUP: "true"} | (settings or {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**options).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def freed(run: Batches) -> Batches:
    """run for mapInArrow, with memory that the Python worker has freed given back to the system before and after.

    Spark keeps idle workers for the next stage. What their allocators hold counts while other steps run.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        yield from run(batches)
        _give_back()

    return tidied


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


@contextmanager
def step(docs: DataFrame, nth: int) -> Iterator[None]:
    """The nth step of a pipeline, whose docs are the written result of the step before: that one's own tables go now.

    If docs still reads one of them, as an unwritten result does, they stay.
    """
    global _writing
    gone = _left.pop(nth - 1, [])
    if gone and {p.rsplit("/", 1)[-1] for p in gone}.isdisjoint(x for f in docs.inputFiles() for x in f.rsplit("/", 2)[-2:-1]):
        jvm = docs.sparkSession.sparkContext._jvm
        for p in gone:
            folder = jvm.org.apache.hadoop.fs.Path(p)
            folder.getFileSystem(docs.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _writing = []
    try:
        yield
        _left[nth] = _writing
    finally:
        _writing = None


def no_space(text: Column) -> Column:
    """text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def n_words(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE + "+"), "")), F.lit(0)).cast("long")


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, mark): each row as one struct, so that no column of docs clashes, with its id and a hash of its text."""
    return docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & (left["mark"] == right["mark"])


def without(docs: DataFrame, gone: DataFrame, twice: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows whose (id, mark) is in gone, and with one of the rows of each (id, mark) in twice.

    Of the rows in twice, which may differ in other columns, the first by their values as JSON stays.
    """
    rows = marked(docs, id_col, text_col)
    kept = rows.join(gone, same_row(rows, gone), "left_anti")
    if twice.isEmpty():
        return kept.select("row.*")
    twice = materialize(twice, "twice")
    once = rows.join(twice, same_row(rows, twice), "left_semi").groupBy("id", "mark").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.join(twice, same_row(kept, twice), "left_anti").select("row").unionByName(once.select("row")).select("row.*")


def split_hot(keys: DataFrame, weight: str, total: int) -> tuple[DataFrame | None, DataFrame]:
    """(hot, cold) keys. weight sums up to total at most, so at most HOT_SHARE keys are hot; None if there are none."""
    least = max(1_000, total // HOT_SHARE)
    hot, cold = keys.where(F.col(weight) > least), keys.where(F.col(weight) <= least)
    return (None, keys) if hot.isEmpty() else (hot, cold)


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "left") -> DataFrame:
    """Left or inner join of two written tables, where right has one row per key and weight is how many rows of left have it.

    The hot keys are broadcast and their rows stay where they are; the rest is joined by shuffle, where no key is large.
    A null key meets nothing.
    """
    hot, cold = split_hot(right, weight, right.agg(F.sum(weight)).first()[0] or 0)
    if hot is None:
        return left.join(right, key, how)
    there = left.join(F.broadcast(hot), key, "inner")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return there.unionByName(rest)


def _fold(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least node that it is connected with here) for each FOREST_EDGES edges or less: same components, no cycles."""

    def stars(parent: dict[int, int]) -> pa.RecordBatch:
        rows = [(x, y) for x in parent if (y := top(parent, x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["u", "v"])

    def top(parent: dict[int, int], x: int) -> int:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = parent[y]
            x = y
        return x

    parent, n = {}, 0
    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = top(parent, u), top(parent, v)
            parent[max(x, y)] = min(x, y)
            n += 1
            if n >= FOREST_EDGES:
                yield stars(parent)
                parent, n = {}, 0
    yield stars(parent)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the undirected links: root is the smallest node of its component.

    Each task first reduces its edges to a forest. Up to FOREST_EDGES edges that is the whole job, in one task of bounded size.
    Beyond, alternating large-star and small-star rounds follow; every round is cut by a written table, nothing goes to the
    driver but a count and a checksum. Repeated links and loops change nothing; no links give no rows.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    few = (n := edges.count()) <= FOREST_EDGES
    edges = edges.coalesce(1) if few else edges.repartition(-(-n // FOREST_EDGES), "v")
    edges = materialize(edges.mapInArrow(freed(_forest), "u long, v long"), "edges")
    seen = None
    while not few and (now := _fold(edges)) != seen:
        seen = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(least).where("u <> v").distinct(), "edges")
    root = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return root.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))
