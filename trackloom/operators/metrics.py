"""Detector evaluation: confusion counts, ROC area, best thresholds, sweeps, agreement, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def rate(a: Column, b: Column) -> Column:
    """a / b, NaN over zero."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(float("nan")))


def confusion(df: DataFrame, keys: list[str], positive: Column, hit: Column) -> DataFrame:
    """tp, fp, fn, tn with tpr, fpr and precision per key."""
    count = lambda c: F.count_if(c)
    out = df.groupBy(*keys).agg(count(positive & hit).alias("tp"), count(~positive & hit).alias("fp"), count(positive & ~hit).alias("fn"), count(~positive & ~hit).alias("tn"))
    c = F.col
    return out.select("*", rate(c("tp"), c("tp") + c("fn")).alias("tpr"), rate(c("fp"), c("fp") + c("tn")).alias("fpr"), rate(c("tp"), c("tp") + c("fp")).alias("precision"))


def by_score(df: DataFrame, keys: list[str], positive: Column, score: str) -> DataFrame:
    """Counts of positives and negatives per distinct score, and of those below it."""
    counts = df.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    below = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("*", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_below") for c in ("p", "n")])


def auc(df: DataFrame, keys: list[str], positive: Column, score: str) -> DataFrame:
    """Mann-Whitney area with ties at one half, by running counts over distinct scores; NaN if a class is empty."""
    s = by_score(df, keys, positive, score)
    wins = F.sum(F.col("p") * F.col("n_below") + 0.5 * F.col("p") * F.col("n"))
    return s.groupBy(*keys).agg(rate(wins, F.sum("p") * F.sum("n")).alias("auc"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))


def youden(df: DataFrame, keys: list[str], positive: Column, score: str) -> DataFrame:
    """threshold and j: the lowest threshold with the largest tpr - fpr over midpoints and both ends; NaN if a class is empty."""
    s = by_score(df, keys, positive, score)
    every, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("score")
    s = s.select("*", F.sum("p").over(every).alias("ps"), F.sum("n").over(every).alias("ns"), F.lag("score").over(order).alias("prev"), F.max("score").over(every).alias("top"))
    cut = F.when(F.col("prev").isNull(), F.col("score") - 1e-6).otherwise((F.col("prev") + F.col("score")) / 2)
    j = rate(F.col("ps") - F.col("p_below"), F.col("ps")) - rate(F.col("ns") - F.col("n_below"), F.col("ns"))
    rows = s.select(*keys, cut.alias("threshold"), j.alias("j")).unionByName(s.where("score = top").select(*keys, (F.col("score") + 1e-6).alias("threshold"), (j * 0.0).alias("j")))
    return rows.groupBy(*keys).agg(F.min(F.struct((-F.col("j")).alias("nj"), "threshold")).alias("b")).select(*keys, F.when(F.isnan("b.nj"), float("nan")).otherwise(F.col("b.threshold")).alias("threshold"), (-F.col("b.nj")).alias("j"))


def histogram(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """Counts in half-open bins between edges; values outside are not counted, empty bins are."""
    bins = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, lo double, hi double")
    index = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value)) - 1
    counts = df.select(index.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(bins).join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rater_pairs(df: DataFrame, item: str, rater: str, label: str) -> DataFrame:
    """Pairs of labels of two raters on one item, raters in order; a rater has one row per item."""
    one = df.select(item, F.col(rater).alias("r"), F.col(label).alias("l"))
    return one.select(item, F.col("r").alias("ra"), F.col("l").alias("la")).join(one.select(item, F.col("r").alias("rb"), F.col("l").alias("lb")), item).where("ra < rb")


def kappa(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Percent agreement and Cohen's kappa per key from counts of label pairs, with one shuffle of counts."""
    cells = pairs.groupBy(*keys, "la", "lb").agg(F.count(F.lit(1)).alias("c"))
    total = cells.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("c")).otherwise(0)).alias("same"))
    ends = cells.select(*keys, F.col("la").alias("l"), F.col("c").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(cells.select(*keys, F.col("lb").alias("l"), F.lit(0).cast("long").alias("a"), F.col("c").alias("b")))
    chance = ends.groupBy(*keys, "l").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).groupBy(*keys).agg(F.sum(F.col("a") * F.col("b")).alias("x"))
    po, pe = F.col("same") / F.col("n"), F.col("x") / (F.col("n") * F.col("n"))
    k = F.when(F.col("x") == F.col("n") * F.col("n"), F.when(F.col("same") == F.col("n"), 1.0).otherwise(float("nan"))).otherwise((po - pe) / (1 - pe))
    return total.join(chance, keys).select(*keys, "n", po.alias("agreement"), k.alias("kappa"))


def at_thresholds(df: DataFrame, keys: list[str], positive: Column, score: Column, thresholds: tuple[float, ...]) -> DataFrame:
    """Confusion counts per key and threshold: one row per key is counted, not one per row and threshold."""
    hits = [c.alias(f"{k}{i}") for i, t in enumerate(thresholds) for k, c in (("tp", F.count_if(positive & (score >= t))), ("fp", F.count_if(~positive & (score >= t))))]
    counts = df.groupBy(*keys).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"), *hits)
    points = [F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), (F.col("_p") - F.col(f"tp{i}")).alias("fn"), (F.col("_n") - F.col(f"fp{i}")).alias("tn")) for i, t in enumerate(thresholds)]
    return counts.select(*keys, F.inline(F.array(*points)))


def two_best(vectors: DataFrame, bank: DataFrame, vector: str, name: str, template: str, most: int = 10_000) -> DataFrame:
    """vectors with best: the two (sim, minus name) of largest cosine, found inside the row. A bank of over `most` is refused."""
    if bank.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} templates; join them by blocks instead")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    one = bank.agg(F.collect_list(F.struct(F.col(name).alias("name"), F.col(template).alias("t"), dot(F.col(template), F.col(template)).alias("tt"))).alias("_bank"))
    rows = vectors.withColumn("_vv", dot(F.col(vector), F.col(vector))).crossJoin(F.broadcast(one))
    sims = F.transform("_bank", lambda b: F.struct(F.round(dot(F.col(vector), b["t"]) / F.sqrt(F.col("_vv") * b["tt"]), 9).alias("sim"), (-b["name"]).alias("g")))
    return rows.withColumn("best", F.slice(F.sort_array(sims, asc=False), 1, 2)).drop("_bank", "_vv")


def observed(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """df, and how many of its rows meet each condition, known once an action has read df: no second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()]), seen
