"""Masks as tables of runs (y, x0, x1): outlines from path text, fill, union, growth, cells and lines on a mask, outlines of a mask."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A command letter or a number of a path.
TOKEN = re.compile(r"([A-Za-z])|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")
#: Numbers that a command takes at a time; upper case is absolute, lower case relative.
TAKES = {"m": 2, "l": 2, "h": 1, "v": 1, "z": 0}


def outlines_of(path: str) -> Iterator[list[tuple[float, float]]]:
    """The closed outlines of a path of straight segments, three corners or more each.

    Further numbers repeat a command, after a move as lines. A relative move that begins an outline counts from the origin.
    An outline ends at z or with the text; other commands than m, l, h, v and z are an error.
    """
    x = y = 0.0
    corners: list[tuple[float, float]] = []
    command, held = "", []
    for letter, number in TOKEN.findall(path):
        if letter:
            if letter.lower() not in TAKES:
                raise ValueError(f"unsupported path command {letter!r}: outlines have straight segments only")
            if held:
                raise ValueError(f"path command {command!r} lacks a number")
            command = letter
            if command in "zZ":
                if len(corners) >= 3:
                    yield corners
                corners = []
            continue
        held.append(float(number))
        need = TAKES.get(command.lower())
        if not need:
            raise ValueError("a number without a path command")
        if len(held) < need:
            continue
        kind, origin = command.lower(), command.isupper() or (command == "m" and not corners)
        dx, dy = {"h": (held[0], None), "v": (None, held[0])}.get(kind) or held
        x = x if dx is None else dx if origin else x + dx
        y = y if dy is None else dy if origin else y + dy
        corners.append((x, y))
        held = []
        command = {"m": "l", "M": "L"}.get(command, command)
    if held:
        raise ValueError(f"path command {command!r} lacks a number")
    if len(corners) >= 3:
        yield corners


class PathCorners:
    """Table function: (outline, corner, x, y) of a path; a text that does not begin with a move, or null, has no rows."""

    def eval(self, path: str):  # noqa: A003
        if path and path.lstrip()[:1] in ("m", "M"):
            for outline, corners in enumerate(outlines_of(path)):
                for corner, (x, y) in enumerate(corners):
                    yield outline, corner, x, y


def path_corners(paths: DataFrame, key: str, path: str) -> DataFrame:
    """(key, outline, corner, x, y): one row per corner of every path."""
    spark = paths.sparkSession
    spark.udtf.register("path_corners", F.udtf(PathCorners, returnType="outline int, corner int, x double, y double"))
    return spark.sql("SELECT p.k AS {key}, c.* FROM {paths} p, LATERAL path_corners(p.d) c".replace("{key}", f"`{key}`"), paths=paths.select(F.col(key).alias("k"), F.col(path).alias("d")))


def drawing_corners(drawings: DataFrame, key: str, text: str, width: int, height: int) -> DataFrame:
    """(key, outline, corner, x, y) of hand-drawn SVG masks, scaled to a frame and rounded to cells.

    Outlines are numbered over all paths of a drawing; one without width and height is an error.
    """
    svg = r"(?s)<svg[^>]*\bwidth=\"([0-9.]+)\"[^>]*\bheight=\"([0-9.]+)\""
    size = [F.regexp_extract(text, svg, i) for i in (1, 2)]
    wrong = F.raise_error(F.concat(F.lit("no width and height in drawing "), F.col(key).cast("string")))
    paths = drawings.select(F.col(key).alias("k"), *[F.when(s != "", s.cast("double")).otherwise(wrong.cast("double")).alias(n) for s, n in zip(size, ("w", "h"))], F.posexplode(F.regexp_extract_all(text, F.lit(r'\bd="([^"]+)"'), F.lit(1))).alias("nth", "d"))
    corners = path_corners(paths.select(F.struct("k", "nth", "w", "h").alias("p"), "d"), "p", "d")
    outline = F.col("p.nth").cast("long") * 1_000_000 + F.col("outline")
    # halves go to the even cell
    return corners.select(F.col("p.k").alias(key), outline.alias("outline"), "corner", F.bround(F.col("x") * width / F.col("p.w")).cast("long").alias("x"), F.bround(F.col("y") * height / F.col("p.h")).cast("long").alias("y"))


def _floor_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a - F.pmod(a, b), b)


def merged(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (keys, y, x0, x1) that touch or overlap as one."""
    order = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    before = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = runs.select(*keys, "y", "x0", "x1").distinct().withColumn("_new", F.when(F.col("x0") <= before + 1, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(order))
    return rows.groupBy(*keys, "y", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")


def filled(corners: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (keys, y, x0, x1) of the cells inside outlines (even-odd) or on them; corners are whole numbers.

    Each edge is listed for the lines that it crosses; the crossings of a line, in order, open and close runs. Edges count from
    their lower end up to, but without, the upper one; level edges and corners are runs of their own. x is kept as a fraction
    of whole numbers, so no cell on an outline is lost to rounding.
    """
    of = Window.partitionBy(*keys, "outline").orderBy("corner")
    whole = Window.partitionBy(*keys, "outline").orderBy("corner").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = corners.select(*keys, "outline", "corner", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    edges = c.select(*keys, "outline", "x", "y", *[F.coalesce(F.lead(v).over(of), F.first(v).over(whole)).alias(f"{v}1") for v in ("x", "y")])
    up = F.col("y") < F.col("y1")
    slanted = edges.where("y <> y1").select(*keys, "outline", *[F.when(up, F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in (("xa", "x", "x1"), ("ya", "y", "y1"), ("xb", "x1", "x"), ("yb", "y1", "y"))])
    lines = slanted.select("*", F.explode(F.sequence(F.col("ya"), F.col("yb") - 1)).alias("line"))
    dy = F.col("yb") - F.col("ya")
    top = F.col("xa") * dy + (F.col("line") - F.col("ya")) * (F.col("xb") - F.col("xa"))
    crossing = F.struct((top / dy).alias("at"), (-_floor_div(-top, dy)).alias("up"), _floor_div(top, dy).alias("down"))
    rows = lines.groupBy(*keys, "outline", F.col("line").alias("y")).agg(F.array_sort(F.collect_list(crossing)).alias("c"))
    pair = F.expr("transform(sequence(0, cast(size(c) / 2 as int) - 1), i -> struct(c[2 * i].up as x0, c[2 * i + 1].down as x1))")
    inside = rows.select(*keys, "y", F.inline(pair)).where("x0 <= x1")
    level = edges.select(*keys, "y", F.least("x", F.when(F.col("y") == F.col("y1"), F.col("x1")).otherwise(F.col("x"))).alias("x0"), F.greatest("x", F.when(F.col("y") == F.col("y1"), F.col("x1")).otherwise(F.col("x"))).alias("x1"))
    return merged(inside.unionByName(level), keys)


def clipped(runs: DataFrame, width: int, height: int) -> DataFrame:
    """Runs inside a frame."""
    rows = runs.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x1") >= 0) & (F.col("x0") < width))
    return rows.withColumns({"x0": F.greatest(F.col("x0"), F.lit(0)), "x1": F.least(F.col("x1"), F.lit(width - 1))})


def grown(runs: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Runs grown by an ellipse of 2 * radius + 1 cells: a run widens and reaches radius lines up and down."""
    if radius <= 0:
        return merged(runs, keys)
    reach = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(round((radius * radius - d * d) ** 0.5)).alias("w")) for d in range(-radius, radius + 1)])
    rows = runs.select(*keys, "y", "x0", "x1", F.inline(reach))
    return merged(rows.select(*keys, (F.col("y") + F.col("d")).alias("y"), (F.col("x0") - F.col("w")).alias("x0"), (F.col("x1") + F.col("w")).alias("x1")), keys)


def runs_of_cells(cells: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Cells as runs."""
    return merged(cells.select(*keys, F.col(y).cast("long").alias("y"), F.col(x).cast("long").alias("x0"), F.col(x).cast("long").alias("x1")), keys)


def on_mask(points: DataFrame, runs: DataFrame, keys: list[str], x: str = "x", y: str = "y", out: str = "masked") -> DataFrame:
    """points with whether their cell lies in the mask of their keys; merged runs hold a cell once."""
    r = runs.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("y").alias("_y"), "x0", "x1")
    same = F.col(y) == F.col("_y")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    rows = points.join(r, same & F.col(x).between(F.col("x0"), F.col("x1")), "left")
    return rows.select(*points.columns, F.col("x0").isNotNull().alias(out))


# --- outlines of masks: helpers for the runs of one mask ---

#: Neighbours clockwise, from the left one on.
AROUND = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))


def regions(runs: np.ndarray) -> np.ndarray:
    """A number per run (y, x0, x1; sorted): runs that touch, also over corners, have one. Union-find over neighbouring lines."""
    parent = list(range(len(runs)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above = 0
    for i, (y, x0, x1) in enumerate(runs.tolist()):
        while above < i and (runs[above][0] < y - 1 or (runs[above][0] == y - 1 and runs[above][2] < x0 - 1)):
            above += 1
        k = above
        while k < i and runs[k][0] == y - 1 and runs[k][1] <= x1 + 1:
            a, b = top(i), top(k)
            parent[max(a, b)] = min(a, b)
            k += 1
    return np.array([top(i) for i in range(len(runs))])


def border(cells: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The outer border of a connected set of cells (x, y), clockwise from its first cell, corners only."""
    start = min(cells, key=lambda c: (c[1], c[0]))
    at, back, walk, first = start, 0, [start], None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            nxt = at[0] + AROUND[d][0], at[1] + AROUND[d][1]
            if nxt in cells:
                break
        else:
            return walk
        if first is None:
            first = nxt
        elif at == start and nxt == first:
            break
        at, back = nxt, (d + 4) % 8
        walk.append(at)
    walk.pop()  # the start again
    turns = [p for a, p, b in zip([walk[-1], *walk], walk, [*walk[1:], walk[0]]) if (p[0] - a[0], p[1] - a[1]) != (b[0] - p[0], b[1] - p[1])]
    return turns or walk


def simplified(points: list[tuple[int, int]], tolerance: float) -> list[tuple[int, int]]:
    """A closed line without the corners that are within tolerance of what stays (Douglas-Peucker from its farthest pair)."""
    if tolerance <= 0 or len(points) < 4:
        return points
    p = np.array(points, float)
    far = int(((p - p[0]) ** 2).sum(axis=1).argmax())
    keep, todo = {0, far}, [(0, far), (far, len(p))]
    closed = np.vstack([p, p[:1]])
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, q = closed[b] - closed[a], closed[a + 1 : b] - closed[a]
        long = np.hypot(*d)
        off = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / long if long else np.hypot(q[:, 0], q[:, 1])
        i = int(off.argmax())
        if off[i] > tolerance:
            keep.add(a + 1 + i)
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return [points[i] for i in sorted(keep)]


def area(points: list[tuple[int, int]]) -> float:
    x, y = np.array(points, float).T
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def outlines(runs: DataFrame, key: str, tolerance: float = 4.0, least_area: float = 64.0) -> DataFrame:
    """(key, outline, corner, x, y): the outer borders of each mask's regions, simplified; small regions are left out.

    A mask is one image, whose runs one task reads. A border runs through the centres of the outermost cells, so filled()
    gives a region without holes back at tolerance 0.
    """
    kind = runs.schema[key].dataType.simpleString()

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x0"])
        table = pdf[["y", "x0", "x1"]].to_numpy()
        label, out = regions(table), []
        nth = 0
        for r in np.unique(label):
            cells = {(x, int(y)) for y, x0, x1 in table[label == r] for x in range(int(x0), int(x1) + 1)}
            line = border(cells)
            if least_area > 0 and area(line) < least_area:
                continue
            line = simplified(line, tolerance)
            if least_area > 0 and len(line) < 3:
                continue
            out += [(pdf[key].iloc[0], nth, i, *p) for i, p in enumerate(line)]
            nth += 1
        return pd.DataFrame(out, columns=[key, "outline", "corner", "x", "y"])

    return runs.select(key, "y", "x0", "x1").groupBy(key).applyInPandas(of, f"{key} {kind}, outline int, corner int, x long, y long")
