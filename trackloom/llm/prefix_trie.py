"""Conversation prefix trie by partition refinement.

All conversations start in one class, the root. Classes with two members or more are split by the next turn, a stride of turns
per round: a running digest names the prefix of every depth, so a round splits a class at all its depths at once. Classes of
one member are retired; their tails are unary chains, emitted row by row. Totals are folded back over the members of the split
classes: a node's value goes to the node's smallest member, and a class adds up what its members hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import lookup, materialize

#: Turns of the first round, doubled from round to round, and the most of a round.
STRIDE, MOST_STRIDE = 8, 4096
#: Conversation ids in one piece of a node's list.
PIECE = 10_000
#: A prefix that is shared is the first h turns of the first conversation of a group of five; h is under nine.
GROUP, HEADS = 5, 9


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of each row among those of its conversation in this task, which come together."""
    conv, n = None, 0
    for batch in batches:
        nth = []
        for c in batch.column("c").to_pylist():
            conv, n = (c, n + 1) if c == conv else (c, 1)
            nth.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int64())], [*batch.schema.names, "nth"])


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, pos, digest, bytes): the turns of each conversation, numbered from 1 by turn, null first, ties by digest of role and text.

    Rows are dealt by ranges of all of the order, so a conversation may lie in many tasks; what a task lacks is how many of its
    first conversation's turns lie in tasks before it, one number per task.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = materialize(rows.where("c is not null").withColumn("u", F.monotonically_increasing_id()), "turn-digests")
    order = [F.col("c"), F.col("t").asc_nulls_first(), F.col("digest"), F.col("u")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "digest", "bytes", F.spark_partition_id().alias("task"))
    rows = materialize(rows.mapInArrow(_number, "c long, digest binary, bytes long, task int, nth long"), "turns")
    per = rows.groupBy("task", "c").agg(F.max("nth").alias("n"))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    # a task has one conversation at most that began before it
    begun = per.select("task", "c", before.alias("before")).where("before > 0")
    return rows.join(F.broadcast(begun), ["task", "c"], "left").select("c", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "bytes")


def shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, len) and their turns (c, d, digest, bytes, len) once each has taken over the head of its group's first.

    turns are ordered_turns(). Conversation c gets the first h turns of c - c % GROUP and keeps its own after its first h,
    h = crc32(c) % HEADS.
    """
    turns = materialize(turns, "ordered-turns")
    size = turns.groupBy("c").agg(F.max("pos").alias("own"))
    convs = size.select("c", "own", (F.crc32(F.col("c").cast("string")) % HEADS).alias("h"), (F.col("c") - F.col("c") % GROUP).alias("b"))
    first = size.select(F.col("c").alias("b"), F.col("own").alias("base"))
    head = F.least("h", F.coalesce("base", F.lit(0)))
    convs = convs.join(first, "b", "left").select("c", "own", "h", "b", head.alias("head"), (head + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("len"))
    convs = materialize(convs, "conversations")
    tails = lookup(turns, convs.select("c", "own", "h", "head", "len"), "c", "own", "inner").where("pos > h")
    tails = tails.select("c", (F.col("pos") - F.col("h") + F.col("head")).alias("d"), "digest", "bytes", "len")
    heads = turns.where(f"pos < {HEADS}").select(F.col("c").alias("b"), F.col("pos").alias("d"), "digest", "bytes")
    heads = convs.join(heads, "b").where("d <= head").select("c", "d", "digest", "bytes", "len")
    return convs.select("c", "len"), tails.unionByName(heads)


def _chain(depth: int):
    """Digests of prefixes: rows come by (c, d), the row of a conversation at `depth` has the digest of the prefix so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, key = None, b""
        for batch in batches:
            keys, keep = [], []
            for c, d, digest in zip(*(batch.column(n).to_pylist() for n in ("c", "d", "digest"))):
                if c != conv:
                    conv, key = c, b""
                key = digest if d == depth else hashlib.sha256(key + digest).digest()
                keys.append(key)
                keep.append(d != depth)
            out = pa.RecordBatch.from_arrays([batch.column("c"), batch.column("d"), pa.array(keys, pa.binary()), batch.column("bytes"), batch.column("len")], ["c", "d", "key", "bytes", "len"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return run


def refine(convs: DataFrame, turns: DataFrame, stride: int = STRIDE) -> tuple[DataFrame, DataFrame]:
    """Classes (conv, d, n, bytes, longest) of two members or more, and their members (c, d, conv, len).

    conv is the smallest member, bytes those of the class's last turn, longest the most turns of a member. A round takes the
    next turns of conversations that share all turns so far with another one and go on.
    """
    n, least, longest = convs.agg(F.count(F.lit(1)), F.min("c"), F.max("len")).first()
    root = convs.select(F.lit(least).cast("long").alias("conv"), F.lit(0).cast("long").alias("d"), F.lit(n).alias("n"), F.lit(0).cast("long").alias("bytes"), F.lit(longest).cast("long").alias("longest")).limit(1)
    nodes, members = [root.where(F.col("n") > 1)], [convs.select("c", F.lit(0).cast("long").alias("d"), F.lit(least).cast("long").alias("conv"), "len").where(F.lit(n > 1))]
    depth, active = 0, convs.where(F.lit(n > 1) & (F.col("len") > 0)).select("c", F.unhex(F.lit("")).alias("digest"), "len")
    while not active.isEmpty():
        rows = turns.where((F.col("d") > depth) & (F.col("d") <= depth + stride))
        rows = rows.join(active.select("c"), "c", "left_semi") if depth else rows
        rows = rows.unionByName(active.select("c", F.lit(depth).cast("long").alias("d"), "digest", F.lit(0).cast("long").alias("bytes"), "len"))
        rows = rows.repartition("c").sortWithinPartitions("c", "d")
        chained = materialize(rows.mapInArrow(_chain(depth), "c long, d long, key binary, bytes long, len long"), "prefixes")
        classes = chained.groupBy("key", "d").agg(F.min("c").alias("conv"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"), F.max("len").alias("longest"))
        classes = materialize(classes.where("n > 1"), "classes")
        nodes.append(classes.select("conv", "d", "n", "bytes", "longest"))
        found = materialize(lookup(chained.select("c", "d", "key", "len"), classes.select("key", "conv", "n"), "key", "n", "inner"), "members")
        members.append(found.select("c", "d", "conv", "len"))
        depth, stride = depth + stride, min(MOST_STRIDE, 2 * stride)
        active = found.where((F.col("d") == depth) & (F.col("len") > depth)).select("c", F.col("key").alias("digest"), "len")
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, members)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, d, first, ids): the sorted members of nodes in pieces of at most PIECE ids."""

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"conv": pa.array([node[0]], pa.int64()), "d": pa.array([node[1]], pa.int64()), "first": pa.array(ids[:1], pa.int64()), "ids": [",".join(map(str, ids))]})

    node, ids = None, []
    for batch in batches:
        for conv, d, c in zip(*(batch.column(n).to_pylist() for n in ("conv", "d", "c"))):
            if ids and (node != (conv, d) or len(ids) == PIECE):
                yield piece()
                ids = []
            node = conv, d
            ids.append(c)
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, d, ends): the digest of each node's pieces, which come in order; only its state is held."""

    def rows(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv", "d", "ends"])

    node, state, done = None, hashlib.sha256(), []
    for batch in batches:
        for conv, d, ids in zip(*(batch.column(n).to_pylist() for n in ("conv", "d", "ids"))):
            if node == (conv, d):
                state.update(b",")
            else:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (conv, d), hashlib.sha256()
            state.update(ids.encode())
        yield rows(done)
        done = []
    if node:
        yield rows([(*node, state.hexdigest())])


def _ends(members: DataFrame) -> DataFrame:
    """(conv, d, ends): digest of the ids of the members that end at a node. A hot node's ids travel in pieces."""
    rows = members.where("len = d").select("conv", "d", "c")
    rows = rows.repartitionByRange("conv", "d", "c").sortWithinPartitions("conv", "d", "c").mapInArrow(_pieces, "conv long, d long, first long, ids string")
    return rows.repartition("conv", "d").sortWithinPartitions("conv", "d", "first").mapInArrow(_digests, "conv long, d long, ends string")


def _below(nodes: DataFrame, *values: str) -> DataFrame:
    """nodes with <value>_below: the sum of a value over the nodes of the same conv at this depth and below it.

    Blocks of MOST_STRIDE depths are summed first, so no window holds all nodes of a conversation.
    """
    rows = nodes.withColumn("block", F.floor(F.col("d") / MOST_STRIDE))
    block = rows.groupBy("conv", "block").agg(*(F.sum(v).alias(v) for v in values))
    later = Window.partitionBy("conv").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    block = block.select("conv", "block", *(F.coalesce(F.sum(v).over(later), F.lit(0)).alias(f"{v}_later") for v in values))
    here = Window.partitionBy("conv", "block").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *(F.sum(v).over(here).alias(f"{v}_here") for v in values)).join(block, ["conv", "block"])
    return rows.select(*nodes.columns, *((F.col(f"{v}_here") + F.col(f"{v}_later")).alias(f"{v}_below") for v in values))


def fold(convs: DataFrame, turns: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node of the trie from the refined classes and the tails of conversations that are alone."""
    nodes = materialize(nodes.withColumns({"leaf": (F.col("longest") == F.col("d")).cast("long"), "saved": (F.col("n") - 1) * F.col("bytes")}), "shared-nodes")
    last = members.groupBy("c").agg(F.max(F.struct("d", "conv")).alias("last"))
    own = nodes.groupBy("conv").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved")).withColumnRenamed("conv", "c")
    zero = lambda x: F.coalesce(x, F.lit(0))
    each = convs.join(last, "c", "left").join(own, "c", "left")
    shared = F.coalesce("last.d", F.lit(-1))
    each = each.select("c", "len", shared.alias("shared"), F.col("last.conv").alias("last"), (zero("leaves") + (F.col("len") > shared).cast("long")).alias("leaves"), zero("saved").alias("saved"), (shared + 1).alias("rows"))
    each = materialize(each, "members-totals")
    held = lookup(members.select("c", "d", "conv"), each.select("c", "len", "shared", "leaves", "saved", "rows"), "c", "rows", "inner")
    other, alone = F.col("c") != F.col("conv"), (F.col("shared") == F.col("d")) & (F.col("len") > F.col("d"))
    tail = (F.col("len") > F.col("shared")).cast("long")
    held = held.groupBy("conv", "d").agg(
        F.sum(F.when(other, F.col("leaves")).otherwise(tail)).alias("leaves"),
        F.sum(F.when(other, F.col("saved")).otherwise(0)).alias("rest"),
        F.sum(alone.cast("long")).alias("chains"),
    )
    up = members.select(F.col("c").alias("conv"), (F.col("d") + 1).alias("d"), F.col("conv").alias("parent"))
    split = _below(nodes, "leaf", "saved").join(up, ["conv", "d"], "left")
    split = materialize(split, "split-nodes")
    children = split.where("parent is not null").groupBy(F.col("parent").alias("conv"), (F.col("d") - 1).alias("d")).agg(F.count(F.lit(1)).alias("splits"))
    none = F.sha2(F.lit(""), 256)
    split = split.join(held, ["conv", "d"]).join(children, ["conv", "d"], "left").join(_ends(members), ["conv", "d"], "left")
    split = split.select(
        F.col("conv").alias("conv_id"),
        F.col("d").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        (zero("splits") + F.col("chains")).alias("n_children"),
        (F.col("leaf_below") + F.col("leaves")).alias("n_leaves"),
        (F.col("saved_below") + F.col("rest")).alias("saved_tokens"),
        F.coalesce("ends", none).alias("ends_sha256"),
    )
    chains = lookup(turns.select("c", "d"), each.select("c", "len", "shared", "last"), "c", "len", "inner").where("d > shared").select("c", "d", "len", "shared", "last")
    chains = chains.unionByName(each.where("shared < 0").select("c", F.lit(0).cast("long").alias("d"), "len", "shared", "last"))
    chains = chains.select(
        F.col("c").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("d") == 0, None).when(F.col("d") > F.col("shared") + 1, F.col("c")).otherwise(F.col("last")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        (F.col("d") < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("d") == F.col("len"), F.sha2(F.col("c").cast("string"), 256)).otherwise(none).alias("ends_sha256"),
    )
    return split.unionByName(chains)


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stride: int = STRIDE) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node of the trie.

    A node at depth d is a distinct sequence of the first d turns (role, text) of the conversations of shared_heads(); conv_id
    is its smallest member. saved_tokens counts UTF-8 bytes of turns that need no second copy. Turns are ordered by turn,
    null first, ties by digest of role and text; null role or text is empty; repeated rows are turns; rows without a
    conversation id take no part; no rows give no nodes; other columns are not read.
    """
    convs, rebuilt = shared_heads(ordered_turns(turns, conv_col, turn_col, role_col, text_col))
    rebuilt = materialize(rebuilt, "rebuilt-turns")
    nodes, members = refine(convs, rebuilt, stride)
    return fold(convs, rebuilt, nodes, members)
