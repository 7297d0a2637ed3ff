"""Hard-negative mining with vantage-point trees over norm-augmented vectors.

A coordinate sqrt(M^2 - |x|^2), where M is the largest norm, makes all rows equally long; an anchor has 0 there. Then
|a - x|^2 = |a|^2 + M^2 - 2 <a, x>: the higher score is the nearer row, and a window of scores is an annulus of distances.

The rows of the table are dealt into cells by the upper levels of a tree, fitted on a bounded sample; every row is indexed, and
each cell knows the exact distances of its rows to the vantage points above it. Cells are cut into parts of bounded size, and a
task builds the lower tree of its part. An anchor goes to the parts that may hold what it looks for: first its nearest rows of
the same label, then rows of other labels inside the annuli. There the tree is walked nearest first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from trackloom.llm.common import materialize

#: Rows of the sample that the upper tree is fitted on, its most cells, rows of a part, rows of a leaf and anchors that one
#: task asks for at most. Results do not depend on them.
SAMPLE, MOST_CELLS, PART_ROWS, LEAF_ROWS, BLOCK_ANCHORS = 4096, 1024, 4096, 512, 20_000
#: Labels that are listed for a cell; one with more may hold any.
MOST_LABELS = 256
#: Components become floor(SCALE * x).
SCALE = 256
#: Squared lengths stay below this, so that a hundred times an inner product is a long.
MOST_SQUARE = float(1 << 56)
#: Ends of windows without an end.
NO_LEAST, NO_MOST = -(1 << 62), 1 << 62
WINDOWS = "array<struct<lo:long,hi:long>>"
#: Relative error that float distances may have in bounds; rows are compared by whole numbers.
LOOSE = 1e-9

Tree = list[tuple[np.ndarray, float] | None]


def quantised(rows: DataFrame, id_col: str, label_col: str, vector_col: str, label: Column, anchor: Column) -> DataFrame:
    """(row, id, label, q, asks): the rows that take part, components as whole numbers."""
    x = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")))
    square = F.aggregate(x, F.lit(0.0), lambda s, v: s + (SCALE * v.cast("double")) ** 2)
    kept = rows.where(fine).where(square < MOST_SQUARE)
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), q.cast("array<long>").alias("q"), F.coalesce(anchor, F.lit(False)).alias("asks"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of whole numbers; shorter ones are filled up with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = np.asarray(column.flatten())
    return out


def _augmented(q: np.ndarray, most: int) -> np.ndarray:
    x = q.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0.0, float(most) - (x * x).sum(axis=1)))[:, None]])


def _distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - point) ** 2).sum(axis=1))


def fit(sample: np.ndarray, depth: int) -> Tree:
    """The upper tree as a heap of depth levels: (vantage point, radius), each the median distance of the rows below."""
    tree: Tree = [None] * ((1 << depth) - 1)
    parts = {0: np.arange(len(sample))}
    for node in range(len(tree)):
        at = parts.pop(node)
        if not len(at):
            tree[node] = sample[0], 0.0
            parts[2 * node + 1] = parts[2 * node + 2] = at
            continue
        # the row farthest from the first one: distances from the rim differ most
        point = sample[at[_distances(sample[at], sample[at[0]]).argmax()]]
        d = _distances(sample[at], point)
        radius = float(np.median(d))
        tree[node] = point, radius
        parts[2 * node + 1], parts[2 * node + 2] = at[d <= radius], at[d > radius]
    return tree


def route(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row, and its distances to the vantage points on the way."""
    depth = (len(tree) + 1).bit_length() - 1
    node, way = np.zeros(len(x), np.int64), np.zeros((len(x), depth))
    for level in range(depth):
        for n in np.unique(node):
            at = np.flatnonzero(node == n)
            point, radius = tree[n]
            way[at, level] = d = _distances(x[at], point)
            node[at] = 2 * n + 1 + (d > radius)
    return node - len(tree), way


def _route(tree: Tree, dims: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, way = route(tree, _augmented(_matrix(batch.column("q"), dims), most))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(list(way), pa.list_(pa.float64()))], [*batch.schema.names, "cell", "way"])

    return run


class Cells:
    """What cells hold: distances of their rows to the vantage points above them, labels and parts."""

    def __init__(self, tree: Tree, rows: list):
        self.tree, depth = tree, (len(tree) + 1).bit_length() - 1
        self.cell = np.array([r["cell"] for r in rows], np.int64)
        self.parts = np.array([r["parts"] for r in rows], np.int64)
        self.lo, self.hi = np.array([r["lo"] for r in rows]).reshape(len(rows), depth), np.array([r["hi"] for r in rows]).reshape(len(rows), depth)
        self.labels = [set(r["labels"]) if len(r["labels"]) <= MOST_LABELS else None for r in rows]
        self.nodes = np.array([[((c + len(tree) + 1) >> (depth - k)) - 1 for k in range(depth)] for c in self.cell], np.int64).reshape(len(rows), depth)

    def may_hold(self, i: int, label: int, same: bool) -> bool:
        """Whether the i-th cell may hold a row of that label, or of another one."""
        have = self.labels[i]
        return have is None or bool(have & {label} if same else have - {label})

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most distance from a that a row of each cell can have."""
        if not self.tree:
            return np.zeros(len(self.cell)), np.full(len(self.cell), np.inf)
        d = np.array([np.sqrt(((a - p) ** 2).sum()) for p, _ in self.tree])[self.nodes]
        return np.maximum(0, np.maximum(d - self.hi, self.lo - d).max(axis=1)), (d + self.hi).min(axis=1)


class Part:
    """The lower tree of some rows: median splits at a rim point, with each side's least and most distance to it."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, most: int):
        x = _augmented(q, most)
        self.nodes: list[tuple] = []  # (point, inner, inner lo, hi, outer, lo, hi) or (first, last) of a leaf
        order = np.arange(len(q))

        def build(a: int, b: int) -> int:
            at = len(self.nodes)
            self.nodes.append((a, b))
            if b - a <= LEAF_ROWS:
                return at
            part = order[a:b]
            point = x[part[_distances(x[part], x[part[0]]).argmax()]]
            d = _distances(x[part], point)
            by = np.argsort(d, kind="stable")
            order[a:b], d, mid = part[by], d[by], (b - a) // 2
            inner, outer = build(a, a + mid), build(a + mid, b)
            self.nodes[at] = point, inner, d[0], d[mid - 1], outer, d[mid], d[-1]
            return at

        build(0, len(q))
        self.row, self.ids, self.labels, self.q = row[order], ids[order], labels[order], q[order]
        # whole numbers below 2**53 are exact as floats, whose products are faster
        self.q = self.q.astype(np.float64) if most < 1 << 53 else self.q

    def nearest_first(self, anchor: np.ndarray, most: int, same: bool, label: int, row: int, wanted: "Wanted") -> Iterator[tuple[int, int, int]]:
        """(score, id, row) of the rows whose label is the anchor's, or is not, in order, as far as `wanted` asks for them.

        The heap holds subtrees by the most score that they can have and rows by their score, so a row that comes up is
        before all that are left. A subtree whose scores are all outside of what is wanted is left out.
        """
        a = np.append(anchor.astype(np.float64), 0.0)
        x = anchor.astype(self.q.dtype)
        # least and most score inside of distances lo to hi, widened by what floats may be off
        whole = int(anchor @ anchor) + most
        off = 1 + LOOSE * whole
        heap: list[tuple] = [(-np.inf, 0, 0, 0, 0.0, np.inf)]
        while heap:
            key, kind, one, two, lo, hi = heapq.heappop(heap)
            if kind:
                yield -key, one, two
                if not wanted.open():
                    return
                continue
            if not wanted.meets((whole - hi * hi) / 2 - off, (whole - lo * lo) / 2 + off):
                continue
            node = self.nodes[one]
            if len(node) == 2:
                s = (self.q[node[0] : node[1]] @ x).astype(np.int64)
                least, last = wanted.reach()
                at = np.flatnonzero(((self.labels[node[0] : node[1]] == label) == same) & (s >= least) & (s <= last) & (self.row[node[0] : node[1]] != row))
                at = at[np.lexsort((self.row[node[0] + at], self.ids[node[0] + at], -s[at]))]
                for i in at[wanted.first(s[at])].tolist():
                    heapq.heappush(heap, (-int(s[i]), 1, int(self.ids[node[0] + i]), int(self.row[node[0] + i]), 0.0, 0.0))
                continue
            point, inner, in_lo, in_hi, outer, out_lo, out_hi = node
            d = float(np.sqrt(((a - point) ** 2).sum()))
            for child, p, q in ((inner, in_lo, in_hi), (outer, out_lo, out_hi)):
                least, far = max(lo, d - q, p - d), min(hi, d + q)
                heapq.heappush(heap, (-((whole - least * least) / 2 + off), 0, child, 0, least, far))


class Wanted:
    """Windows of scores, each open until it has k rows. Rows come in falling order of score."""

    def __init__(self, windows: list[tuple[int, int]], k: int):
        self.windows, self.k, self.left = windows, k, [k] * len(windows)

    def open(self) -> bool:
        return any(self.left)

    def meets(self, lo: float, hi: float) -> bool:
        return any(n and lo <= b and hi >= a for (a, b), n in zip(self.windows, self.left))

    def reach(self) -> tuple[int, int]:
        """Least and most score of the open windows."""
        some = [w for w, n in zip(self.windows, self.left) if n]
        return min(a for a, _ in some), max(b for _, b in some)

    def first(self, s: np.ndarray) -> list[int]:
        """Of falling scores, those among the first that each open window still lacks."""
        got: set[int] = set()
        for (a, b), n in zip(self.windows, self.left):
            i, j = np.searchsorted(-s, (-b, -a + 1)) if n else (0, 0)
            got.update(range(int(i), min(int(j), int(i) + n)))
        return sorted(got)

    def take(self, s: int) -> list[int]:
        """The windows that take a row of score s."""
        got = [i for i, ((a, b), n) in enumerate(zip(self.windows, self.left)) if n and a <= s <= b]
        for i in got:
            self.left[i] -= 1
        return got


def _seed(some: list[Row], dims: int, k: int):
    """Anchors with the window of their positives: no less than the k-th score of their label in the sample."""
    rows, labels = np.array([r["row"] for r in some], np.int64), np.array([r["label"] for r in some], np.int64)
    q = _padded(some, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = []
            for row, label, a in zip(batch.column("row").to_pylist(), batch.column("label").to_pylist(), _matrix(batch.column("q"), dims)):
                s = np.sort((q @ a)[(labels == label) & (rows != row)])
                windows.append([{"lo": int(s[-k]) if len(s) >= k else NO_LEAST, "hi": NO_MOST}])
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(windows, kind)], [*batch.schema.names, "windows"])

    return run


def _padded(some: list[Row], dims: int) -> np.ndarray:
    return np.array([r["q"] + [0] * (dims - len(r["q"])) for r in some], np.int64).reshape(len(some), dims)


def _send(cells: Cells, dims: int, most: int, same: bool):
    """Anchors to the parts that can hold what they want: (part, anchor columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("q"), dims)
            a = np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
            at, cell, salt = [], [], []
            for i, (label, windows) in enumerate(zip(batch.column("label").to_pylist(), batch.column("windows").to_pylist())):
                lo, hi = cells.bounds(a[i])
                whole = int(q[i] @ q[i]) + most
                off = 1 + LOOSE * whole
                top, low = (whole - lo * lo) / 2 + off, (whole - hi * hi) / 2 - off
                ok = np.zeros(len(lo), bool)
                for x in windows:
                    ok |= (top >= x["lo"]) & (low <= x["hi"]) & (x["lo"] <= x["hi"])
                for c in np.flatnonzero(ok).tolist():
                    if cells.may_hold(c, label, same):
                        n = int(cells.parts[c])
                        at += [i] * n
                        cell += [int(cells.cell[c])] * n
                        salt += range(n)
            sent = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(salt, pa.int64()), *sent.columns], ["cell", "salt", *batch.schema.names])

    return run


FOUND = pa.schema([("anchor", pa.int64()), ("window", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])


def _search(dims: int, most: int, k: int, same: bool):
    """Parts one after the other: their rows first, then the anchors that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, part = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(n).to_pylist() for n in ("cell", "salt", "block", "asks"))))
            a = 0
            while a < len(keys):
                b = a
                while b < len(keys) and keys[b] == keys[a]:
                    b += 1
                if keys[a][:3] != at:
                    at, held, part = keys[a][:3], [], None
                some = batch.slice(a, b - a)
                if not keys[a][3]:
                    held.append(some.select(["row", "id", "label", "q"]))
                elif held:
                    if part is None:
                        rows = pa.Table.from_batches(held)
                        part = Part(*(rows.column(n).to_numpy() for n in ("row", "id", "label")), _matrix(rows.column("q"), dims), most)
                    yield ask(part, some)
                a = b

    def ask(part: Part, some: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row, label, q, windows in zip(some.column("row").to_pylist(), some.column("label").to_pylist(), _matrix(some.column("q"), dims), some.column("windows").to_pylist()):
            wanted = Wanted([(x["lo"], x["hi"]) for x in windows], k)
            for s, i, r in part.nearest_first(q, most, same, label, row, wanted):
                out += [(row, w, s, i, r) for w in wanted.take(s)]
                if not wanted.open():
                    break
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(5)], schema=FOUND)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor's window over all parts, with rank from 1; a task sends k of a window at most."""
    nth = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id", "row"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)


def _hundredth(x: Column) -> Column:
    """x / 100 as a whole number, rounded down."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def hard_negatives(
    rows: DataFrame,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    anchor: Column | None = None,
    label: Column | None = None,
    k: int = 5,
    low: int = 80,
    high: int = 100,
    part_rows: int = PART_ROWS,
    sample: int = SAMPLE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which `anchor` holds (default: all). An anchor's positives are its first k other rows of its label
    by score, ties by smaller id; for each of them come the first k rows of other labels whose score is low to high percent of
    the positive's, ends included; a negative score leaves no room between the two. Scores are inner products of the components
    floor(256 x). label is the label to go by (default: label_col).

    Rows without an id, a label or a vector, or with a null, NaN or infinite component take no part, nor do those whose
    squared length passes 2**56, as their scores are no longs. Shorter vectors count as filled up with 0. Rows that share an id
    are rows, each an anchor and a candidate of the other. No rows give no rows; other columns are not read.
    """
    label = F.col(label_col) if label is None else label
    base = materialize(quantised(rows, id_col, label_col, vector_col, label, F.lit(True) if anchor is None else anchor), "vectors")
    square = F.aggregate("q", F.lit(0).cast("long"), lambda s, v: s + v * v)
    total, asking, most, dims = base.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(square), F.max(F.size("q"))).first()
    most, dims = most or 0, max(1, dims or 0)
    depth = max(0, min(MOST_CELLS, -(-total // part_rows)) - 1).bit_length()
    some = base.orderBy(F.xxhash64("id", "row"), "row").limit(sample).select("row", "label", "q").collect()
    tree = fit(_augmented(_padded(some, dims), most), depth)
    named = "row long, id long, label long, q array<long>, asks boolean"
    dealt = materialize(base.mapInArrow(_route(tree, dims, most), f"{named}, cell long, way array<double>"), "cells")
    ends = [f(F.col("way")[i]).alias(f"{x}{i}") for x, f in (("lo", F.min), ("hi", F.max)) for i in range(depth)]
    per = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("parts"), *ends)
    nth = F.row_number().over(Window.partitionBy("cell").orderBy("label"))
    some_labels = dealt.select("cell", "label").distinct().withColumn("nth", nth).where(F.col("nth") <= MOST_LABELS + 1)
    per = per.join(some_labels.groupBy("cell").agg(F.collect_list("label").alias("labels")), "cell")
    lists = [F.array(*(F.col(f"{x}{i}") for i in range(depth))).cast("array<double>").alias(x) for x in ("lo", "hi")]
    # a row per cell, MOST_CELLS at most
    per = materialize(per.select("cell", "parts", "labels", *lists), "cell-bounds")
    cells = Cells(tree, per.collect())
    blocks = max(1, -(-asking // BLOCK_ANCHORS))
    columns = ["cell", "salt", "block", "asks", "row", "id", "label", "q", "windows"]
    there = dealt.join(F.broadcast(per.select("cell", "parts")), "cell").withColumns(
        {"salt": F.pmod(F.xxhash64("row"), F.col("parts")), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "asks": F.lit(False), "windows": F.lit(None).cast(WINDOWS)}
    )

    def search(anchors: DataFrame, same: bool, name: str) -> DataFrame:
        sent = anchors.select("row", "id", "label", "q", "windows").mapInArrow(_send(cells, dims, most, same), f"cell long, salt long, row long, id long, label long, q array<long>, windows {WINDOWS}")
        sent = sent.withColumns({"block": F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"), "asks": F.lit(True)})
        both = there.select(columns).unionByName(sent.select(columns)).repartition("cell", "salt", "block").sortWithinPartitions("cell", "salt", "block", "asks", "row")
        found = both.mapInArrow(_search(dims, most, k, same), "anchor long, window long, score long, id long, row long")
        return materialize(_ranked(found, k), name)

    asked = dealt.where("asks").select("row", "id", "label", "q")
    seeds = asked.mapInArrow(_seed(some, dims, k), f"row long, id long, label long, q array<long>, windows {WINDOWS}")
    positives = search(seeds, True, "positives").groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    # low * p <= 100 * s <= high * p over whole numbers
    window = F.transform("positives", lambda p: F.struct((-_hundredth(-low * p["score"])).alias("lo"), _hundredth(high * p["score"]).alias("hi")))
    anchors = materialize(asked.join(positives, asked["row"] == positives["anchor"]).select("row", "id", "label", "q", window.alias("windows"), "positives"), "anchors")
    p = F.get("positives", F.col("window").cast("int"))
    out = search(anchors, False, "negatives").select(F.col("anchor").alias("row"), "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(anchors.select("row", F.col("id").alias("anchor_id"), "positives"), "row")
    return out.select("anchor_id", p["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", p["score"].alias("positive_score"), "negative_score")
