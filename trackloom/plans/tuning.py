"""Queries over parameter grids: evaluation per combination, ranking, hold-out verdicts, score functions, region sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.core import nan_last
from trackloom.operators import metrics
from trackloom.operators.selection import percentiles
from trackloom.plans.views import SCORED, scored

THRESHOLDS = (0.2, 0.35, 0.5, 0.65, 0.8)
GRID = [(i, g, w) for i, (g, w) in enumerate((g, w) for g in (0.5, 1.0, 2.0) for w in (0.0, 0.1, 0.2))]
#: The combination and threshold in production.
DEFAULT, DEFAULT_AT = 4, 0.5
#: The region's size, the least length of a line, and the score functions over a number of lines n and a length px.
ALONG, CROSS, LONG = 500.0, 100.0, 40.0
DIAGONAL = (ALONG**2 + CROSS**2) ** 0.5
SCORE_FUNCTIONS = {
    "baseline_norm6": "least(1e0, n / 6e0)",
    "norm10": "least(1e0, n / 10e0)",
    "norm12": "least(1e0, n / 12e0)",
    "sigmoid_k4": "CASE WHEN n <= 0 THEN 0e0 ELSE 1 - exp(-n / 4e0) END",
    "length_over_diag": f"least(1e0, px / {DIAGONAL!r}e0)",
    "length_over_along": f"least(1e0, px / {ALONG}e0)",
    "length_over_diag_scaled0.7": f"least(1e0, px / ({DIAGONAL!r}e0 * 0.7e0))",
    "length_over_6xlong_min": f"least(1e0, px / ({LONG}e0 * 6))",
    "combined_count_length": f"0.5e0 * least(1e0, n / 10e0) + 0.5e0 * least(1e0, px / {DIAGONAL!r}e0)",
}


def _grid(spark) -> DataFrame:
    return spark.createDataFrame(GRID, "combo int, gamma double, bonus double")


def peaks(spark, sf_dir) -> DataFrame:
    """Largest score of each document's two frames per combination: one row per combination and document, made in the row."""
    rows = scored(spark, sf_dir).crossJoin(F.broadcast(_grid(spark)))
    s = lambda part: F.least(F.lit(1.0), F.pow(F.col("score") * part, F.col("gamma")) + F.col("bonus") * (F.col("n_chars") % 10) / 10.0)
    return rows.select("day", "combo", "doc_id", "pos", F.greatest(F.round(s(1.0), 6), F.round(s(0.8), 6)).alias("peak"))


def evaluated(rows: DataFrame) -> DataFrame:
    """combo, auc and points (threshold, tp, fp, fn, tn, recall, fpr, j): counted in one pass, not once per threshold."""
    hits = [(f"{k}{i}", F.count_if((F.col("pos") if k == "tp" else ~F.col("pos")) & (F.col("peak") >= t))) for i, t in enumerate(THRESHOLDS) for k in ("tp", "fp")]
    counts = rows.groupBy("combo").agg(F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("n"), *[c.alias(k) for k, c in hits])

    def point(i: int, t: float) -> Column:
        tp, fp = F.col(f"tp{i}"), F.col(f"fp{i}")
        recall, fpr = metrics.rate(tp, F.col("p")), metrics.rate(fp, F.col("n"))
        return F.struct(F.lit(t).alias("threshold"), tp.alias("tp"), fp.alias("fp"), (F.col("p") - tp).alias("fn"), (F.col("n") - fp).alias("tn"), recall.alias("recall"), fpr.alias("fpr"), F.round(recall - fpr, 9).alias("j"))

    points = counts.select("combo", F.array(*[point(i, t) for i, t in enumerate(THRESHOLDS)]).alias("points"))
    return points.join(metrics.auc(rows, ["combo"], F.col("pos"), "peak").select("combo", F.round("auc", 9).alias("auc")), "combo")


def ranked(rows: DataFrame) -> DataFrame:
    """The best threshold of each combination, and the combinations by J, then area, then false positives; NaN comes last."""
    best = F.reduce("points", F.get("points", F.lit(0)), lambda a, x: F.when((x["j"] > a["j"]) & ~F.isnan(x["j"]), x).otherwise(a))
    top = evaluated(rows).select("combo", "auc", best.alias("b")).select("combo", "auc", F.col("b.threshold").alias("threshold"), "b.j", "b.tp", "b.fp")
    # one row per combination of the grid
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(nan_last("j"), nan_last("auc"), "fp", "combo")))


def q_combo_rank(spark, sf_dir):
    """Combinations of the grid, each at its best threshold, ranked."""
    return ranked(peaks(spark, sf_dir))


def _card(e: DataFrame, suffix: str = "") -> DataFrame:
    p = e.select("combo", "auc", F.inline("points"))
    return p.select("combo", "threshold", *[F.round(c, 9).alias(f"{c}{suffix}") for c in ("recall", "fpr", "auc")])


def q_holdout(spark, sf_dir):
    """The combination that wins on two days, unchanged on the others, against production there: recall and area decide.

    The winner's row of the other sweep is found by its parameters, equal within 1e-6.
    """
    tune = F.col("day").isin("en", "de")
    rows = peaks(spark, sf_dir)
    grid = _grid(spark)
    best = ranked(rows.where(tune)).where("rank = 1").join(grid, "combo").select("threshold", F.col("gamma").alias("g"), F.col("bonus").alias("w"))
    held = _card(evaluated(rows.where(~tune)))
    near = grid.crossJoin(F.broadcast(best)).where("abs(gamma - g) < 1e-6 and abs(bonus - w) < 1e-6").select("combo", "threshold")
    tuned = held.join(F.broadcast(near), ["combo", "threshold"])
    base = held.where((F.col("combo") == DEFAULT) & (F.col("threshold") == DEFAULT_AT)).select(*[F.col(c).alias(f"{c}0") for c in ("recall", "fpr", "auc")])
    d_recall, d_auc = F.col("recall") - F.col("recall0"), F.col("auc") - F.col("auc0")
    # NaN is larger than any number here, and must not pass
    sure = ~F.isnan(d_recall) & ~F.isnan(d_auc)
    ok = (sure & (d_recall >= 0) & (d_auc >= -0.02)) | (~F.isnan(d_auc) & (d_auc > 0.02))
    return tuned.crossJoin(F.broadcast(base)).withColumn("verdict", F.when(ok, "generalizes").otherwise("keep production"))


def q_score_comparison(spark, sf_dir):
    """Nine score functions: area, best J, 90th percentile and saturated share."""
    d = scored(spark, sf_dir).select("pos", (F.col("n_chars") % 17).alias("n"), (F.col("score") * 600).alias("px"))
    pairs = ", ".join(f"'{k}', round({v}, 9)" for k, v in SCORE_FUNCTIONS.items())
    rows = d.select("pos", F.expr(f"stack({len(SCORE_FUNCTIONS)}, {pairs}) as (name, s)"))
    about = rows.groupBy("name").agg(F.round(F.avg((F.col("s") >= 1).cast("double")), 6).alias("full"))
    about = about.join(percentiles(rows, ["name"], "s", {"p90": 0.9}).select("name", F.round("p90", 6).alias("p90")), "name")
    area = metrics.auc(rows, ["name"], F.col("pos"), "s").select("name", F.round("auc", 9).alias("auc"))
    best = metrics.youden(rows, ["name"], F.col("pos"), "s").select("name", F.round("j", 9).alias("j"))
    return about.join(area, "name").join(best, "name")


def _sizes(spark, sf_dir):
    sizes = spark.createDataFrame([(i, float(a), float(c)) for i, (a, c) in enumerate((a, c) for a in (200, 400, 800, 1200) for c in (40, 80, 160))], "combo int, along double, cross double")
    rows = scored(spark, sf_dir).crossJoin(F.broadcast(sizes))
    return sizes, rows.select("combo", "pos", F.round(F.least(F.lit(1.0), F.col("score") * 600 / F.hypot("along", "cross")), 9).alias("peak"))


def q_roi_sizes(spark, sf_dir):
    """Twelve region sizes at the production threshold: counts, area and J."""
    sizes, rows = _sizes(spark, sf_dir)
    p = evaluated(rows).select("combo", "auc", F.inline("points")).where(F.col("threshold") == DEFAULT_AT)
    return sizes.join(p, "combo").select("along", "cross", "tp", "fp", "fn", "tn", "auc", "j")


def q_roi_top(spark, sf_dir):
    """The ten best region sizes by false positives, then area, then true positives."""
    return q_roi_sizes(spark, sf_dir).orderBy("fp", nan_last("auc"), F.col("tp").desc(), "along", "cross").limit(10).select("along", "cross", "fp", "auc", "tp")


def _auc_sql(source: str, key: str, value: str, name: str) -> str:
    return f"{name} AS (SELECT p.{key}, round(sum(CASE WHEN p.{value} > n.{value} THEN 1e0 WHEN p.{value} = n.{value} THEN 0.5e0 ELSE 0e0 END) / count(*), 9) AS auc FROM {source} p JOIN {source} n ON p.{key} = n.{key} AND p.pos AND NOT n.pos GROUP BY p.{key})"


_PK = """gr AS (SELECT row_number() OVER (ORDER BY g, w) - 1 AS combo, g, w FROM (VALUES (0.5e0), (1e0), (2e0)) a(g), (VALUES (0e0), (0.1e0), (0.2e0)) b(w)),
    pk AS (SELECT day, CAST(combo AS INTEGER) AS combo, doc_id, pos, max(round(least(1e0, pow(score * f, g) + w * (n_chars % 10) / 10e0), 6)) AS peak FROM scored, gr, (VALUES (1e0), (0.8e0)) c(f) GROUP BY day, combo, doc_id, pos),
    th AS (SELECT unnest([0.2e0, 0.35e0, 0.5e0, 0.65e0, 0.8e0]) AS threshold)"""


def _points(source: str, name: str) -> str:
    return f"""{name}c AS (SELECT combo, threshold, count(*) FILTER (pos AND peak >= threshold) AS tp, count(*) FILTER (NOT pos AND peak >= threshold) AS fp, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM {source}, th GROUP BY 1, 2),
    {name} AS (SELECT *, round(tp / CAST(p AS DOUBLE), 9) AS recall, round(fp / CAST(n AS DOUBLE), 9) AS fpr, round(tp / CAST(p AS DOUBLE) - fp / CAST(n AS DOUBLE), 9) AS j FROM {name}c)"""


_SF = " UNION ALL ".join(f"SELECT pos, '{k}' AS name, round({v}, 9) AS s FROM d" for k, v in SCORE_FUNCTIONS.items())
_RS = f"""WITH {SCORED}, sz AS (SELECT row_number() OVER (ORDER BY along, cross_) AS combo, along, cross_ FROM (VALUES (200e0), (400e0), (800e0), (1200e0)) a(along), (VALUES (40e0), (80e0), (160e0)) b(cross_)),
    r AS (SELECT combo, pos, round(least(1e0, score * 600 / sqrt(along * along + cross_ * cross_)), 9) AS peak FROM scored, sz), th AS (SELECT 0.5e0 AS threshold), {_points("r", "pt")}, {_auc_sql("r", "combo", "peak", "au")},
    res AS (SELECT along, cross_ AS "cross", tp, fp, p - tp AS fn, n - fp AS tn, auc, j FROM pt JOIN au ON au.combo = pt.combo JOIN sz ON sz.combo = pt.combo)"""

QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__name__", "").startswith("q_")}
ORACLES = {
    "q_combo_rank": f"""WITH {SCORED}, {_PK}, {_points("pk", "pt")}, {_auc_sql("pk", "combo", "peak", "au")},
        b AS (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY combo ORDER BY j DESC, threshold) = 1)
        SELECT b.combo, auc, threshold, j, tp, fp, CAST(row_number() OVER (ORDER BY j DESC, auc DESC, fp, b.combo) AS INTEGER) AS rank FROM b JOIN au ON au.combo = b.combo""",
    "q_holdout": f"""WITH {SCORED}, {_PK}, tr AS (SELECT * FROM pk WHERE day IN ('en', 'de')), va AS (SELECT * FROM pk WHERE day NOT IN ('en', 'de')), {_points("tr", "pt")}, {_auc_sql("tr", "combo", "peak", "au")},
        {_points("va", "pv")}, {_auc_sql("va", "combo", "peak", "av")}, b AS (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY combo ORDER BY j DESC, threshold) = 1),
        win AS (SELECT b.combo, threshold FROM b JOIN au ON au.combo = b.combo ORDER BY j DESC, auc DESC, fp, b.combo LIMIT 1), c AS (SELECT pv.*, auc FROM pv LEFT JOIN av ON av.combo = pv.combo),
        x AS (SELECT t.combo, t.threshold, t.recall, t.fpr, t.auc, d.recall AS recall0, d.fpr AS fpr0, d.auc AS auc0 FROM c t JOIN win ON win.combo = t.combo AND win.threshold = t.threshold, c d WHERE d.combo = {DEFAULT} AND d.threshold = {DEFAULT_AT})
        SELECT *, CASE WHEN (recall - recall0 >= 0 AND auc - auc0 >= -0.02) OR auc - auc0 > 0.02 THEN 'generalizes' ELSE 'keep production' END AS verdict FROM x""",
    "q_score_comparison": f"""WITH {SCORED}, d AS (SELECT pos, n_chars % 17 AS n, score * 600 AS px FROM scored), r AS ({_SF}), {_auc_sql("r", "name", "s", "au")},
        t AS (SELECT DISTINCT name, s AS cut FROM r), jj AS (SELECT t.name, cut, count(*) FILTER (pos AND s >= cut) / CAST(count(*) FILTER (pos) AS DOUBLE) - count(*) FILTER (NOT pos AND s >= cut) / CAST(count(*) FILTER (NOT pos) AS DOUBLE) AS j FROM t JOIN r ON r.name = t.name GROUP BY 1, 2),
        a AS (SELECT name, round(quantile_cont(s, 0.9), 6) AS p90, round(avg(CASE WHEN s >= 1 THEN 1e0 ELSE 0e0 END), 6) AS "full" FROM r GROUP BY name)
        SELECT a.name, p90, "full", auc, round(greatest(0, max(j)), 9) AS j FROM a JOIN au ON au.name = a.name JOIN jj ON jj.name = a.name GROUP BY ALL""",
    "q_roi_sizes": f"{_RS} SELECT * FROM res",
    "q_roi_top": f'{_RS} SELECT along, "cross", fp, auc, tp FROM res ORDER BY fp, auc DESC, tp DESC, along, "cross" LIMIT 10',
}
