"""Queries over masks: outlines from path text, fill, union and growth, lines on a mask, outlines of regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import masks
from trackloom.plans.views import table

#: Frame that masks are clipped to, and by how much they grow.
WIDTH, HEIGHT, RADIUS = 40, 30, 2
#: Corners of the outline that a part draws: x and y by p_partkey (k) and p_size (s).
CORNERS = (("k % 17", "k % 11"), ("k % 17 + 5 + s % 13", "k % 11"), ("k % 17 + 5 + s % 13", "k % 11 + 4 + k % 9"), ("k % 17 + 5 + s % 13 - k % 7", "k % 11 + 7 + k % 9 + k % 5"), ("k % 17 - 2", "k % 11 + 1"))


def _paths(spark, sf_dir):
    """An outline per part, as path text with relative, level, upright and absolute segments."""
    d = "concat('m ', k % 17, ',', k % 11, ' h ', 5 + s % 13, ' v ', 4 + k % 9, ' l ', -(k % 7), ',', 3 + k % 5, ' L ', k % 17 - 2, ' ', k % 11 + 1, ' z')"
    return table(spark, sf_dir, "part").selectExpr("p_partkey as k", "p_size as s", "p_brand as brand").selectExpr("k", "brand", f"{d} as d")


def _drawn(spark, sf_dir):
    corners = masks.path_corners(_paths(spark, sf_dir), "k", "d")
    return masks.filled(corners, ["k"])


def q_path_corners(spark, sf_dir):
    """Corners of all outlines."""
    c = masks.path_corners(_paths(spark, sf_dir), "k", "d")
    return c.select(F.col("k").alias("p_partkey"), "outline", "corner", "x", "y")


def q_mask_fill(spark, sf_dir):
    """Runs of the cells in every outline or on it."""
    return masks.clipped(_drawn(spark, sf_dir), WIDTH, HEIGHT).select(F.col("k").alias("p_partkey"), "y", "x0", "x1")


def _brands(spark, sf_dir):
    # a part's brand names its mask: every eighth part draws on it
    some = _paths(spark, sf_dir).where("k % 8 = 0").select("k", "brand")
    return masks.merged(_drawn(spark, sf_dir).join(some, "k").select("brand", "y", "x0", "x1"), ["brand"])


def q_mask_union(spark, sf_dir):
    """Cells and runs per brand of the union of its parts' outlines, before and after they grow."""
    one = _brands(spark, sf_dir)
    rows = [masks.clipped(m, WIDTH, HEIGHT).groupBy("brand").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("cells"), F.count(F.lit(1)).alias("runs")).withColumn("grown", F.lit(g)) for g, m in ((0, one), (RADIUS, masks.grown(one, ["brand"], RADIUS)))]
    return rows[0].unionByName(rows[1])


def q_line_on_mask(spark, sf_dir):
    """Share of nine points of each event's line that lie on the mask of its brand."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Brand#"), F.col("event_id") % 5 + 1, (F.col("event_id") / 5).cast("long") % 5 + 1).alias("brand"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i"))
    at = e.select("event_id", "brand", F.floor((F.col("event_id") % 37) + F.col("i") * (F.col("event_id") % 7 - 3) / 8).alias("px"), F.floor((F.col("event_id") % 23) + F.col("i") * (F.col("event_id") % 11 - 5) / 8).alias("py"))
    hit = masks.on_mask(at, _brands(spark, sf_dir), ["brand"], "px", "py")
    return hit.groupBy("event_id").agg(F.round(F.count_if("masked") / 9.0, 6).alias("masked"))


def q_mask_outlines(spark, sf_dir):
    """Regions of every brand's mask whose outlines, filled again, give back all of the mask's cells and more only in holes."""
    one = masks.clipped(_brands(spark, sf_dir), WIDTH, HEIGHT)
    lines = masks.outlines(one, "brand", 0.0, 0.0)
    back = masks.filled(lines, ["brand"]).groupBy("brand").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("cells"))
    return lines.groupBy("brand").agg(F.count_distinct("outline").alias("regions")).join(back, "brand")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__name__", "").startswith("q_")}

_CO = "co AS (SELECT k, brand, c.corner, c.x, c.y FROM (SELECT p_partkey AS k, p_size AS s, p_brand AS brand FROM part) p, LATERAL (VALUES " + ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(CORNERS)) + ") c(corner, x, y))"
_ED = f"{_CO}, ed AS (SELECT a.k, a.brand, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM co a JOIN co b ON b.k = a.k AND b.corner = (a.corner + 1) % 5)"
_CROSS = "(xb - xa) * (y - ya) - (yb - ya) * (x - xa)"
_IN = f"""bool_or({_CROSS} = 0 AND x BETWEEN least(xa, xb) AND greatest(xa, xb) AND y BETWEEN least(ya, yb) AND greatest(ya, yb))
    OR sum(CASE WHEN (ya <= y) <> (yb <= y) AND (({_CROSS} > 0) = (yb > ya)) THEN 1 ELSE 0 END) % 2 = 1"""


def _cells(where: str = "") -> str:
    """Cells of the frame, with a margin that growth may reach in from, by point in polygon."""
    return f"""{_ED}, bx AS (SELECT k, min(xa) AS x0, max(xa) AS x1, min(ya) AS y0, max(ya) AS y1 FROM ed {where} GROUP BY k),
        gx AS (SELECT k, y0, y1, unnest(range(x0, x1 + 1)) AS x FROM bx), g AS (SELECT k, x, unnest(range(y0, y1 + 1)) AS y FROM gx),
        cells AS (SELECT ed.k, brand, x, y FROM g JOIN ed ON ed.k = g.k GROUP BY ed.k, brand, x, y HAVING {_IN})"""


_FRAME = f"x BETWEEN 0 AND {WIDTH - 1} AND y BETWEEN 0 AND {HEIGHT - 1}"
_BRAND = f"{_cells('WHERE k % 8 = 0')}, b AS (SELECT DISTINCT brand, x, y FROM cells WHERE k % 8 = 0)"


def _runs(name: str, keys: str, source: str) -> str:
    return f"{name} AS (SELECT {keys}, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY {keys}, y ORDER BY x) AS island FROM {source} WHERE {_FRAME}) GROUP BY {keys}, y, island)"


ORACLES = {
    "q_path_corners": f"WITH {_CO} SELECT k AS p_partkey, 0 AS outline, corner, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM co",
    "q_mask_fill": f"WITH {_cells()}, {_runs('r', 'k', 'cells')} SELECT k AS p_partkey, CAST(y AS BIGINT) AS y, CAST(x0 AS BIGINT) AS x0, CAST(x1 AS BIGINT) AS x1 FROM r",
    "q_mask_union": f"""WITH {_BRAND}, d AS (SELECT range AS dy, CAST(round(sqrt({RADIUS * RADIUS} - range * range)) AS BIGINT) AS w FROM range(-{RADIUS}, {RADIUS + 1})),
        m AS (SELECT DISTINCT brand, x + dx AS x, y + dy AS y FROM (SELECT brand, x, y, dy, unnest(range(-w, w + 1)) AS dx FROM b, d)),
        {_runs('r0', 'brand', 'b')}, {_runs('r1', 'brand', 'm')}
        SELECT brand, CAST(sum(x1 - x0 + 1) AS BIGINT) AS cells, count(*) AS runs, 0 AS grown FROM r0 GROUP BY brand UNION ALL SELECT brand, CAST(sum(x1 - x0 + 1) AS BIGINT), count(*), {RADIUS} FROM r1 GROUP BY brand""",
    "q_line_on_mask": f"""WITH {_BRAND}, e AS (SELECT event_id, 'Brand#' || (event_id % 5 + 1) || (event_id // 5 % 5 + 1) AS brand, unnest(range(0, 9)) AS i FROM events),
        p AS (SELECT event_id, brand, floor(event_id % 37 + i * (event_id % 7 - 3) / 8e0) AS x, floor(event_id % 23 + i * (event_id % 11 - 5) / 8e0) AS y FROM e)
        SELECT event_id, round(count(b.x) / 9e0, 6) AS masked FROM p LEFT JOIN b ON b.brand = p.brand AND b.x = p.x AND b.y = p.y GROUP BY event_id""",
    "q_mask_outlines": f"""WITH RECURSIVE {_BRAND}, f AS (SELECT brand, x, y, x * {HEIGHT} + y AS id FROM b WHERE {_FRAME}),
        reach AS (SELECT brand, x, y, id FROM f UNION SELECT f.brand, f.x, f.y, reach.id FROM reach JOIN f ON f.brand = reach.brand AND abs(f.x - reach.x) <= 1 AND abs(f.y - reach.y) <= 1 WHERE reach.id <= f.id),
        least AS (SELECT brand, x, y, min(id) AS region FROM reach GROUP BY brand, x, y),
        grid AS (SELECT brand, x, y FROM (SELECT DISTINCT brand FROM f), (SELECT range AS x FROM range(-1, {WIDTH + 1})), (SELECT range AS y FROM range(-1, {HEIGHT + 1}))),
        free AS (SELECT g.* FROM grid g LEFT JOIN f ON f.brand = g.brand AND f.x = g.x AND f.y = g.y WHERE f.x IS NULL),
        outside AS (SELECT brand, x, y FROM free WHERE x = -1 AND y = -1 UNION SELECT q.brand, q.x, q.y FROM outside o JOIN free q ON q.brand = o.brand AND abs(q.x - o.x) + abs(q.y - o.y) = 1)
        SELECT brand, regions, CAST(n - coalesce(o, 0) AS BIGINT) AS cells FROM (SELECT brand, count(DISTINCT region) AS regions FROM least GROUP BY brand) r
        JOIN (SELECT brand, count(*) AS n FROM grid GROUP BY brand) USING (brand) LEFT JOIN (SELECT brand, count(*) AS o FROM outside GROUP BY brand) USING (brand)""",
}
