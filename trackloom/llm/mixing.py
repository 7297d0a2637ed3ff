"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import lookup, marked, materialize, n_words, same_row

#: Slot t lies at frac(t / golden ratio), in steps of 2**-31; PHI is odd, so the first 2**31 points all differ.
ONE = 1 << 31
PHI = 1_327_217_885
#: The table of up to so many sources is sent to every task; that of more meets the points by a shuffle on cells.
SENT_SOURCES = 100_000
CELLS = 4_096
#: Words that one partition of the mixed documents holds, about.
PARTITION_WORDS = 4_000_000


def targets(sizes: DataFrame, weights: tuple[float, ...], total_share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources take weights in turn by code point, null last, and share total_share of all sizes; a target stops at
    max_epochs times its source's size and the excess is reshared by weight. The fixed point is min(cap, level * weight)
    with one level for all sources, found by walking the sources in order of cap / weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    s = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    here = order.rowsBetween(0, Window.unboundedFollowing)
    want = F.lit(float(total_share)) * F.sum("source_size").over(everything)
    s = s.withColumn("level", (want - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(here))
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct(F.row_number().over(order).alias("nth"), "level"))
    level = F.min(fits).over(everything)["level"]
    target = F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def blocks(docs: DataFrame, block_words: int, seed: int) -> DataFrame:
    """(key, block, row, start, length, at): the shuffled documents of each source laid end to end and cut every block_words.

    Running sums go over buckets of the shuffle order first and inside a bucket then, so no window holds a whole source.
    """
    d = docs.where("size > 0").withColumn("order", F.xxhash64(F.lit(seed), F.coalesce("id", "row"), F.col("id").isNull()))
    count = docs.count()
    bits = max(0, (count // 4_096).bit_length())
    d = d.withColumn("bucket", F.shiftrightunsigned("order", 64 - bits) if bits else F.lit(0).cast("long"))
    sums = d.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "bucket", F.coalesce(F.sum("words").over(up_to), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "bucket").orderBy("order", "row").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["key", "bucket"])
    d = d.select("key", "row", "size", (F.col("base") + F.col("own")).alias("at"))
    b = F.lit(block_words).cast("long")
    d = d.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))))
    begin = F.greatest("at", F.col("block") * b)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b)
    return d.select("key", "block", "row", (begin - F.col("at")).alias("start"), (end - begin).alias("length"), begin.alias("at"))


def schedule(spark, plan: DataFrame, block_words: int) -> DataFrame:
    """(slot, key, block, epoch, limit): golden-ratio points mapped through the cumulative weights, ranked per source.

    plan has (key, source_size, target, need), need being the slots that reach the target. Slot t of a source's rank r
    takes block r modulo its number of blocks; a slot past the target is left out, and limit is where the last one ends.
    A source that the points meet less than need times gets its missing ranks as further slots behind all points.
    """
    n = plan.agg(F.sum("need"), F.count(F.lit(1))).first()
    if not n[0]:
        return spark.createDataFrame([], "slot long, key string, block long, epoch long, `limit` long")
    slots = int(n[0] + n[1] * (4 + 2 * int(n[0]).bit_length()))
    up_to = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    p = plan.where("need > 0").withColumn("hi", F.sum("need").over(up_to) / F.lit(float(n[0])))
    p = p.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("key")), F.lit(0.0)))
    p = p.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS).cast("int"), F.lit(CELLS)))))
    p = materialize(p, "weights")
    points = spark.range(slots).select(F.col("id").alias("slot"))
    points = points.withColumn("u", (F.col("slot") % ONE) * PHI % ONE / float(ONE))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    hit = (points["cell"] == p["cell"]) & (points["u"] >= p["lo"]) & (points["u"] < p["hi"])
    placed = points.join(F.broadcast(p) if n[1] <= SENT_SOURCES else p, hit).select("slot", "key", "source_size", "target")
    # rank per source: counts of chunks of slots first, then the rank inside a chunk
    placed = placed.withColumn("chunk", F.shiftright("slot", 12))
    counts = materialize(placed.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n")), "slot-counts")
    short = plan.join(counts.groupBy("key").agg(F.sum("n").alias("have")), "key", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    short = short.where("need > have").withColumn("before", F.sum(F.col("need") - F.col("have")).over(up_to) - F.col("need"))
    short = short.withColumn("rank", F.explode(F.sequence("have", F.col("need") - 1)))
    short = short.select((F.lit(slots) + F.col("before") + F.col("rank")).alias("slot"), "key", "source_size", "target", "rank")
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("key", "chunk").orderBy("slot")
    r = placed.withColumn("own", F.row_number().over(inside) - 1).join(counts.select("key", "chunk", "base"), ["key", "chunk"])
    r = r.select("slot", "key", "source_size", "target", (F.col("base") + F.col("own")).alias("rank")).unionByName(short)
    per = F.ceil(F.col("source_size") / F.lit(block_words))
    r = r.withColumn("epoch", F.floor(F.col("rank") / per)).withColumn("block", F.col("rank") - F.col("epoch") * per)
    begin = F.col("epoch") * F.col("source_size") + F.col("block") * block_words
    limit = F.round("target").cast("long")
    return r.where(begin < limit).select("slot", "key", "block", "epoch", (limit - F.col("epoch") * F.col("source_size")).alias("limit"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        _key(F.col(source_col).cast("string")).alias("key"),
        n_words(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(text_col).cast("string")).alias("mark"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    total_share: float = 1.5,
    max_epochs: float = 2.0,
    block_words: int = 2_048,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, plan, pieces): the sized rows, the source table with targets, and the mix.

    pieces has one row per slot and document part: slot (the mix's order), key, row, epoch, start and length in words.
    A source's pieces add up to its rounded target, a document's to max_epochs times its size at most.
    Null text has size 0 and is never taken; a null source is a source of its own and sorts last; repeated rows are
    documents of their own; no rows give empty tables. The result depends on rows and seed only, not on partitions,
    but for the order among rows that share an id or have none.
    """
    rows = materialize(sized(docs, id_col, text_col, source_col), "sized")
    sizes = rows.groupBy("source", "key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    sizes = materialize(sizes, "source-sizes")
    plan = materialize(targets(sizes, weights, total_share, max_epochs).join(sizes.select("key", "n_rows", F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "targets")
    per = F.ceil(F.col("source_size") / F.lit(block_words))
    whole = F.floor(F.round("target") / F.greatest("source_size", F.lit(1)))
    need = F.when(F.col("source_size") > 0, whole * per + F.ceil((F.round("target") - whole * F.col("source_size")) / block_words)).otherwise(0)
    plan = plan.withColumn("need", need.cast("long"))
    slots = schedule(docs.sparkSession, plan.select("key", "source_size", "target", "need"), block_words)
    pieces = slots.join(blocks(rows, block_words, seed), ["key", "block"])
    taken = F.least("length", F.col("limit") - F.col("at")).alias("length")
    pieces = pieces.where("at < limit").select("slot", "key", "row", "epoch", "start", taken)
    return rows, plan, materialize(pieces, "mix-pieces")


def taken_words(rows: DataFrame, plan: DataFrame, pieces: DataFrame) -> DataFrame:
    """id, size, source_size, target, taken and epochs (words taken in each) per row."""
    taken = pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    per_source = plan.select("key", "source_size", "target", "n_rows")
    return lookup(rows, per_source, "key", "n_rows").join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as documents: one row per document and epoch, its text cut after the last word taken there, in the order of slots.

    Columns as in docs; n_chars, if there, follows the text. A document that the mix does not reach is left out, as are null
    and blank texts. Repeated rows (equal id, source and text) are documents of their own; they are numbered by their
    values as JSON. The rows are dealt into partitions by slot and sorted there, so that files hold the schedule's order.
    """
    rows, _, pieces = mix(docs, id_col, text_col, source_col, **options)
    parts = pieces.groupBy("row", "epoch").agg(F.max(F.col("start") + F.col("length")).alias("end"), F.min("slot").alias("slot"))
    names = rows.where("size > 0").select("row", "id", "mark", "key", "size")
    many = materialize(names.groupBy("id", "mark", "key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "repeated")
    repeated = not many.isEmpty()
    if repeated:
        again = names.join(many, same_row(names, many) & (names["key"] == many["key"]), "left_semi").select("row", F.row_number().over(Window.partitionBy("id", "mark", "key").orderBy("row")).alias("nth"))
        parts = parts.join(again, "row", "left")
    parts = names.join(parts, "row").groupBy("id", "mark", "key", "size", F.coalesce("nth", F.lit(1)).alias("nth") if repeated else F.lit(1).alias("nth"))
    parts = materialize(parts.agg(F.collect_list(F.struct("slot", "end")).alias("parts")), "mixed-parts")
    keyed = marked(docs, id_col, text_col).withColumns({"key": _key(F.col(f"row.`{source_col}`").cast("string")), "nth": F.lit(1)})
    if repeated:
        again = same_row(keyed, many) & (keyed["key"] == many["key"])
        nth = F.row_number().over(Window.partitionBy("id", "mark", "key").orderBy(F.to_json("row")))
        keyed = keyed.join(many, again, "left_anti").unionByName(keyed.join(many, again, "left_semi").withColumn("nth", nth))
    df = keyed.join(parts, same_row(keyed, parts) & (keyed["key"] == parts["key"]) & (keyed["nth"] == parts["nth"]))
    df = df.select("row", "size", F.explode("parts").alias("part"))
    text = F.col(f"row.`{text_col}`")
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("part.end") >= F.col("size"), text).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("part.end").cast("int")), ""))
    df = df.select(F.col("row").withField(f"`{text_col}`", cut).alias("row"), "part.slot")
    if "n_chars" in docs.columns:
        df = df.withColumn("row", F.col("row").withField("n_chars", F.length(F.col(f"row.`{text_col}`")).cast("long")))
    about = pieces.agg(F.max("slot"), F.sum("length")).first()
    n = max(1, -(-(about[1] or 0) // PARTITION_WORDS))
    df = df.repartitionById(n, F.least(F.floor(F.col("slot") * n / ((about[0] or 0) + 1)), F.lit(n - 1)).cast("int"))
    return df.sortWithinPartitions("slot").select("row.*")
