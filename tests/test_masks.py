"""Masks: path text, fill against point-in-polygon, growth, outlines and back."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import masks

SVG = '<svg width="100" height="50" viewBox="0 0 100 50">\n<path d="m 10,30 5,2 h 10 v -4 L 40,30 5,8 Z" style="fill:#ffffff"/>\n</svg>'


def test_paths():
    assert list(masks.outlines_of("m 10,30 5,2 h 10 v -4 L 40,30 5,8 Z")) == [[(10, 30), (15, 32), (25, 32), (25, 28), (40, 30), (5, 8)]]
    two = list(masks.outlines_of("M0 0H4V4H0z m 1,1 2,0 0,2 M9 9 L 10 10"))
    assert two == [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (9, 9), (10, 10)]]
    assert list(masks.outlines_of("m 0,0 1,1 z")) == [] and list(masks.outlines_of("M-1.5.5-2-3l1e1,0")) == [[(-1.5, 0.5), (-2, -3), (8, -3)]]
    for bad in ("m 0,0 c 1,1 2,2 3,3 Z", "m 0 0 1", "m 0 0 1 z", "m 0 0 z 4"):
        with pytest.raises(ValueError):
            list(masks.outlines_of(bad))


def test_corners_of_a_table(spark):
    rows = [("a", "m 0,0 2,0 0,2 z m 5,5 1,0 0,1 z"), ("b", None), ("c", ""), ("d", "rotate(4)"), ("a2", "M 1 1 H 3 V 3 Z")]
    got = masks.path_corners(spark.createDataFrame(rows, "name string, d string"), "name", "d").collect()
    assert sorted(map(tuple, got)) == [("a", 0, 0, 0, 0), ("a", 0, 1, 2, 0), ("a", 0, 2, 2, 2), ("a", 1, 0, 5, 5), ("a", 1, 1, 6, 5), ("a", 1, 2, 6, 6), ("a2", 0, 0, 1, 1), ("a2", 0, 1, 3, 1), ("a2", 0, 2, 3, 3)]
    with pytest.raises(Exception, match="unsupported"):
        masks.path_corners(spark.createDataFrame([("x", "m 0,0 c 1,1 2,2 3,3 Z")], "name string, d string"), "name", "d").collect()


def cells_of(runs):
    return {(x, r["y"]) for r in runs for x in range(r["x0"], r["x1"] + 1)}


def test_drawing_to_mask(spark):
    df = spark.createDataFrame([(1, SVG)], "id int, svg string")
    runs = masks.clipped(masks.filled(masks.drawing_corners(df, "id", "svg", 200, 100), ["id"]), 200, 100).collect()
    cells = cells_of(runs)
    assert (40, 60) in cells and (190, 5) not in cells and all(0 <= x < 200 and 0 <= y < 100 for x, y in cells)
    with pytest.raises(Exception, match="no width"):
        masks.drawing_corners(spark.createDataFrame([(2, "<svg/> d=\"M 0 0 1 1 2 0\"")], "id int, svg string"), "id", "svg", 9, 9).collect()


def inside(poly, x, y):
    odd = False
    for (xa, ya), (xb, yb) in zip(poly, [*poly[1:], poly[0]]):
        cross = (xb - xa) * (y - ya) - (yb - ya) * (x - xa)
        if cross == 0 and min(xa, xb) <= x <= max(xa, xb) and min(ya, yb) <= y <= max(ya, yb):
            return True
        if (ya <= y) != (yb <= y):
            odd ^= (cross > 0) == (yb > ya)
    return odd


def test_fill_against_point_in_polygon(spark):
    r = random.Random(4)
    polys = {i: [(r.randint(-5, 20), r.randint(-5, 20)) for _ in range(r.randint(3, 9))] for i in range(60)}
    polys |= {100: [(0, 0), (5, 0), (2, 0)], 101: [(3, 3), (3, 3), (3, 3)], 102: [(0, 0), (4, 4), (0, 0), (4, 0)]}
    df = spark.createDataFrame([(i, 0, k, x, y) for i, p in polys.items() for k, (x, y) in enumerate(p)], "m int, outline int, corner int, x int, y int").repartition(4)
    got = {}
    for row in masks.filled(df, ["m"]).collect():
        got.setdefault(row["m"], []).append(row)
    for i, p in polys.items():
        want = {(x, y) for x in range(-6, 22) for y in range(-6, 22) if inside(p, x, y)}
        assert cells_of(got[i]) == want, p
        assert len(cells_of(got[i])) == sum(r["x1"] - r["x0"] + 1 for r in got[i])


def blob(r, n):
    """A connected set of cells without holes."""
    cells = {(10, 10)}
    while len(cells) < n:
        x, y = r.choice(sorted(cells))
        dx, dy = r.choice(masks.AROUND)
        cells.add((x + dx, y + dy))
    box = [(x, y) for x in range(-40, 70) for y in range(-40, 70)]
    free, todo = {(-41, -41)}, [(-41, -41)]
    room = {(x, y) for x in range(-41, 71) for y in range(-41, 71)} - cells
    while todo:
        x, y = todo.pop()
        for nxt in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if nxt in room and nxt not in free:
                free.add(nxt)
                todo.append(nxt)
    return {c for c in box if c not in free}


def test_outlines_fill_back(spark):
    r = random.Random(9)
    shapes = {i: blob(r, r.choice((1, 2, 3, 10, 40, 150))) for i in range(40)}
    shapes[100] = blob(r, 60) | {(x + 60, y) for x, y in blob(r, 50)}
    df = spark.createDataFrame([(i, x, y) for i, s in shapes.items() for x, y in s], "m int, x int, y int").repartition(4)
    runs = masks.runs_of_cells(df, ["m"])
    back = {}
    for row in masks.filled(masks.outlines(runs, "m", 0.0, 0.0), ["m"]).collect():
        back.setdefault(row["m"], []).append(row)
    assert {i: cells_of(v) for i, v in back.items()} == shapes


def test_outlines_are_simplified(spark):
    box = [(1, x, y) for x in range(10, 60) for y in range(20, 40)] + [(1, x, 41) for x in range(100, 103)] + [(1, 59, y) for y in range(40, 42)]
    runs = masks.runs_of_cells(spark.createDataFrame(box, "m int, x int, y int"), ["m"])
    got = masks.outlines(runs, "m", 4.0, 64.0).orderBy("outline", "corner").collect()
    assert {(r["outline"]) for r in got} == {0} and 4 <= len(got) <= 5
    assert {(10, 20), (59, 20), (10, 39)} <= {(r["x"], r["y"]) for r in got}
    none = masks.runs_of_cells(spark.createDataFrame([], "m int, x int, y int"), ["m"])
    assert masks.outlines(none, "m").count() == 0 and masks.filled(masks.outlines(none, "m"), ["m"]).count() == 0


def test_growth_union_and_lines(spark):
    r = random.Random(1)
    cells = {(r.randint(0, 30), r.randint(0, 30)) for _ in range(25)}
    runs = masks.runs_of_cells(spark.createDataFrame([(1, x, y) for x, y in cells], "m int, x int, y int"), ["m"])
    for radius in (0, 1, 3):
        want = {(x + dx, y + dy) for x, y in cells for dy in range(-radius, radius + 1) for w in [round((radius**2 - dy**2) ** 0.5)] for dx in range(-w, w + 1)}
        got = masks.grown(runs, ["m"], radius)
        assert cells_of(got.collect()) == want
        assert cells_of(masks.clipped(got, 20, 25).collect()) == {(x, y) for x, y in want if 0 <= x < 20 and 0 <= y < 25}
    points = spark.createDataFrame([(m, x, y) for m in (1, 2) for x in range(31) for y in range(31)], "m int, px int, py int")
    hit = masks.on_mask(points, runs, ["m"], "px", "py").where("masked").collect()
    assert {(p["m"], p["px"], p["py"]) for p in hit} == {(1, x, y) for x, y in cells}
    both = masks.merged(runs.unionByName(runs.withColumns({"x0": F.col("x0") + 1, "x1": F.col("x1") + 1})), ["m"])
    assert cells_of(both.collect()) == cells | {(x + 1, y) for x, y in cells}
    assert np.array_equal(masks.regions(np.array([[0, 0, 1], [0, 5, 6], [1, 2, 4], [3, 0, 9]])), [0, 0, 0, 3])
