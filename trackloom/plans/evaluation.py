"""Queries over scores and labels: metrics, sweeps, agreement, consensus, upserts, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import labels as lab
from trackloom.operators import exports, metrics
from trackloom.operators.selection import percentiles
from trackloom.plans.views import DET, RATERS, SCORED, det, raters, scored, table

THRESHOLDS = (0.2, 0.35, 0.5, 0.65, 0.8)
EDGES = [0.0, 0.083, 0.167, 0.25, 0.5, 0.75, 1.001]
#: Score functions by name, over the length in pixels and a count.
SCORES = {
    "length": "least(1e0, value / 200e0)",
    "count": "least(1e0, cast(n as double) / 10e0)",
    "saturating": "1e0 - exp(-(cast(n as double)) / 4e0)",
    "product": "least(1e0, value / 200e0) * least(1e0, cast(n as double) / 10e0)",
}


def q_truth_table(spark, sf_dir):
    """Confusion counts per day and over all, by grouping sets over one scan."""
    pos, hit = F.col("pos"), F.col("score") >= 0.5
    counts = [F.count_if(c).alias(n) for n, c in (("tp", pos & hit), ("fp", ~pos & hit), ("fn", pos & ~hit), ("tn", ~pos & ~hit))]
    c = scored(spark, sf_dir).groupingSets([["day"], []], "day").agg(*counts).withColumn("day", F.coalesce("day", F.lit("OVERALL")))
    share = lambda a, b: F.round(metrics.rate(F.col(a), F.col(a) + F.col(b)), 6)
    return c.select("day", "tp", "fp", "fn", "tn", share("tp", "fn").alias("tpr"), share("fp", "tn").alias("fpr"), share("tp", "fp").alias("precision"))


def q_outcome_review(spark, sf_dir):
    """Outcome of every item with the rank of its review, worst first."""
    hit = F.col("score") >= 0.5
    outcome = F.when(F.col("pos") & hit, "HIT").when(F.col("pos"), "MISS").when(hit, "FP").otherwise("TN")
    rank = F.when(F.col("pos") & ~hit, 0).when(~F.col("pos") & hit, 1).when(F.col("pos"), 2).otherwise(3)
    return scored(spark, sf_dir).select("doc_id", outcome.alias("outcome"), rank.alias("rank"), "score")


def q_auc(spark, sf_dir):
    """ROC area per day."""
    return metrics.auc(scored(spark, sf_dir), ["day"], F.col("pos"), "score").select("day", F.round("auc", 9).alias("auc"), "n_pos", "n_neg")


def q_youden(spark, sf_dir):
    """Best threshold per day."""
    return metrics.youden(scored(spark, sf_dir), ["day"], F.col("pos"), "score").select("day", F.round("threshold", 7).alias("threshold"), F.round("j", 9).alias("j"))


def q_grid_sweep(spark, sf_dir):
    """Nine parameter combinations by five thresholds over all days: counts and Youden's J."""
    grid = spark.createDataFrame([(i, g, w) for i, (g, w) in enumerate((g, w) for g in (0.5, 1.0, 2.0) for w in (0.0, 0.1, 0.2))], "combo int, gamma double, bonus double")
    rows = scored(spark, sf_dir).crossJoin(F.broadcast(grid))
    s = F.round(F.least(F.lit(1.0), F.pow("score", F.col("gamma")) + F.col("bonus") * (F.col("n_chars") % 10) / 10.0), 6)
    c = metrics.at_thresholds(rows.withColumn("s", s), ["combo"], F.col("pos"), F.col("s"), THRESHOLDS)
    return c.withColumn("j", F.round(metrics.rate(F.col("tp"), F.col("tp") + F.col("fn")) - metrics.rate(F.col("fp"), F.col("fp") + F.col("tn")), 9))


def q_go_gate(spark, sf_dir):
    """GO, INVESTIGATE or NO-GO per day by area and J."""
    a = metrics.auc(scored(spark, sf_dir), ["day"], F.col("pos"), "score").select("day", "auc")
    y = metrics.youden(scored(spark, sf_dir), ["day"], F.col("pos"), "score").select("day", "j")
    # NaN is larger than any number, so it is asked for first
    gate = F.when(F.isnan("auc") | F.isnan("j"), "NO-GO").when((F.col("auc") >= 0.85) & (F.col("j") >= 0.6), "GO").when(F.col("auc") >= 0.75, "INVESTIGATE").otherwise("NO-GO")
    return a.join(y, "day").select("day", gate.alias("gate"))


def q_score_catalogue(spark, sf_dir):
    """Each score function's mean, 90th percentile and saturated share per event type."""
    d = det(spark, sf_dir).withColumn("n", F.col("event_id") % 17)
    pairs = ", ".join(f"'{k}', {v}" for k, v in SCORES.items())
    long = d.select("event_type", F.expr(f"stack({len(SCORES)}, {pairs}) as (name, s)"))
    about = long.groupBy("name", "event_type").agg(F.round(F.avg("s"), 6).alias("mean"), F.round(F.avg(F.when(F.col("s") >= 1, 1.0).otherwise(0.0)), 6).alias("full"))
    high = percentiles(long, ["name", "event_type"], "s", {"p90": 0.9})
    return about.join(high, ["name", "event_type"]).select("name", "event_type", "mean", F.round("p90", 6).alias("p90"), "full")


def q_score_histogram(spark, sf_dir):
    """Detections per score bin."""
    return metrics.histogram(det(spark, sf_dir), F.col("score"), EDGES)


def q_confusion(spark, sf_dir):
    """Label pairs per pair of raters, all classes in columns; an unknown label is an error."""
    pairs = metrics.rater_pairs(raters(spark, sf_dir).withColumn("label", lab.checked(F.col("label"))), "doc_id", "rater", "label")
    return pairs.groupBy("ra", "rb", "la").pivot("lb", list(lab.LABELS)).agg(F.count(F.lit(1))).fillna(0)


def q_kappa(spark, sf_dir):
    """Agreement and kappa per pair of raters."""
    k = metrics.kappa(metrics.rater_pairs(raters(spark, sf_dir), "doc_id", "rater", "label"), ["ra", "rb"])
    return k.select("ra", "rb", "n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


def q_consensus(spark, sf_dir):
    """Consensus or conflict of the definite votes per document."""
    return lab.consensus(raters(spark, sf_dir), "doc_id", "label", "rater")


def q_merge_first(spark, sf_dir):
    """First rater's label, conflicts and sources per document."""
    return lab.merge_first(raters(spark, sf_dir).where("label <> 'unsure'"), "doc_id", "label", ["rater"], "rater")


def q_overlap_items(spark, sf_dir):
    """Documents with two raters or more."""
    return raters(spark, sf_dir).groupBy("doc_id").agg(F.count_distinct("rater").alias("n")).where("n >= 2")


def q_upsert_labels(spark, sf_dir):
    """Open rows taken by the first labeler, copies for others, updates in place."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "a").alias("rater"), F.when(F.col("doc_id") % 4 == 0, "old").alias("label"), "n_chars")
    new = raters(spark, sf_dir).where("rater <> 'c'").withColumn("arrival", F.col("rater"))
    return lab.upsert(t, new, "doc_id", "rater", "label", "arrival")


def q_open_rows(spark, sf_dir):
    """Rows without a label, by SQL with a parameter."""
    return spark.sql("SELECT d.doc_id, d.lang FROM {d} d LEFT JOIN {l} l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL AND d.n_chars >= ? ORDER BY d.n_chars DESC, d.doc_id", args=[500], d=table(spark, sf_dir, "documents"), l=table(spark, sf_dir, "labels"))


def _payload():
    return """'{"schema_version": ' || CAST(1 + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS {s}) || ', "date": "2026-04-0' || CAST(8 + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS {s}) || '", "labeler_id": "ann", "more": 1, "labels": [{"episode_id": 1, "label": "' || CASE WHEN doc_id % 8 = 0 THEN 'bird' ELSE 'contrail' END || '", "persistence_rating": ' || CAST(doc_id % 7 AS {s}) || '}, {"episode_id": ' || CAST(1 + doc_id % 3 AS {s}) || ', "label": "unsure"}]}'"""


def q_validate_payload(spark, sf_dir):
    """Errors of label exports, one string per document."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.expr(_payload().replace("{s}", "string")).alias("payload"))
    return lab.validate(rows, "payload", "2026-04-08").select("doc_id", F.array_join("errors", "; ").alias("errors"))


#: Fields of the second record of an export, by doc_id % 14, and the first error that they make.
FIELDS = (
    ("", None), ("\"persistence_rating\": true", "labels[1].persistence_rating: no whole number from 1 to 5: true"), ("\"persistence_rating\": 3.0", "labels[1].persistence_rating: no whole number from 1 to 5: 3"),
    ("\"persistence_rating\": 3", None), ("\"measurement_km\": \"12\"", "labels[1].measurement_km: no number: \"12\""), ("\"measurement_km\": 12.25", None), ("\"label_timestamp\": \"2026-04-13T12:34:50\"", "labels[1].label_timestamp: no time with a zone: \"2026-04-13T12:34:50\""),
    ("\"label_timestamp\": \"2026-04-13T12:34:50Z\"", None), ("\"label_notes\": 5", "labels[1].label_notes: no text: 5"), ("\"label_notes\": \"\"", None), ("\"persistence\": \"forever\"", "labels[1].persistence: no known persistence: \"forever\""), ("\"labeler_id\": null", "labels[1].labeler_id: not the file's: null"),
    ("\"labeler_id\": \"ann\"", None), ("\"label_notes\": \"clear\"", None),
)


def q_validate_exports(spark, sf_dir):
    """Strictly typed label exports: the first error with its place, else how many labels, notes and lengths they have."""
    more = F.element_at(F.array(*[F.lit(f", {f}" if f else "") for f, _ in FIELDS]), (F.col("doc_id") % len(FIELDS) + 1).cast("int"))
    head = F.when(F.col("doc_id") % 5 == 0, "1.0").when(F.col("doc_id") % 11 == 0, "2").otherwise("1")
    second = F.when(F.col("doc_id") % 13 == 0, "1").when(F.col("doc_id") % 17 == 0, "true").otherwise("2")
    text = F.concat(F.lit('{"schema_version": '), head, F.lit(', "date": "2026-04-08", "labeler_id": "ann", "labels": [{"episode_id": 1, "label": "contrail"}, {"episode_id": '), second, F.lit(', "label": "unsure"'), more, F.when(F.col("doc_id") % 19 == 0, "}").otherwise("}]}"))
    v = exports.validated(table(spark, sf_dir, "labels").select("doc_id", text.alias("payload")), "payload", "2026-04-08")

    def count(c: str):
        return F.coalesce(F.size(F.filter("labels", lambda r: r[c].isNotNull())), F.lit(0)).cast("long")

    return v.select("doc_id", "error", count("episode_id").alias("n"), *[count(c).alias(c) for c in ("label_notes", "measurement_km", "label_timestamp")])


def q_mask_effect(spark, sf_dir):
    """False and true positives that a second, lower score loses."""
    d = scored(spark, sf_dir).withColumn("after", F.when(F.col("n_chars") % 4 == 0, F.col("score") * 0.5).otherwise(F.col("score")))
    lost = (F.col("score") >= 0.5) & (F.col("after") < 0.5)
    return d.groupBy("day").agg(F.count_if(lost & ~F.col("pos")).alias("fp_lost"), F.count_if(lost & F.col("pos")).alias("tp_lost"))


_SW = """gr AS (SELECT row_number() OVER (ORDER BY g, w) - 1 AS combo, g, w FROM (VALUES (0.5e0), (1e0), (2e0)) a(g), (VALUES (0e0), (0.1e0), (0.2e0)) b(w)),
    th AS (SELECT unnest([0.2e0, 0.35e0, 0.5e0, 0.65e0, 0.8e0]) AS threshold),
    sw AS (SELECT day, pos, combo, threshold, round(least(1e0, pow(score, g) + w * (n_chars % 10) / 10e0), 6) >= threshold AS hit FROM scored, gr, th),
    cf AS (SELECT day, combo, threshold, count(*) FILTER (pos AND hit) AS tp, count(*) FILTER (NOT pos AND hit) AS fp, count(*) FILTER (pos AND NOT hit) AS fn, count(*) FILTER (NOT pos AND NOT hit) AS tn FROM sw GROUP BY 1, 2, 3)"""
_R = "CAST({a} AS DOUBLE) / nullif({b}, 0)"
_J = f"round({_R.format(a='tp', b='tp + fn')} - {_R.format(a='fp', b='fp + tn')}, 9)"
_SUMS = "CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn"
_AUC = "au AS (SELECT p.day, (sum(CASE WHEN p.score > n.score THEN 1e0 WHEN p.score = n.score THEN 0.5e0 ELSE 0e0 END)) / count(*) AS auc FROM scored p JOIN scored n ON p.day = n.day AND p.pos AND NOT n.pos GROUP BY p.day)"
_YOU = """sc AS (SELECT DISTINCT day, score FROM scored), ct AS (SELECT day, score - 1e-6 AS t FROM sc QUALIFY row_number() OVER (PARTITION BY day ORDER BY score) = 1
    UNION ALL SELECT day, (score + lead(score) OVER (PARTITION BY day ORDER BY score)) / 2 FROM sc UNION ALL SELECT day, max(score) + 1e-6 FROM sc GROUP BY day),
    jj AS (SELECT c.day, t, count(*) FILTER (pos AND score >= t) / CAST(count(*) FILTER (pos) AS DOUBLE) - count(*) FILTER (NOT pos AND score >= t) / CAST(count(*) FILTER (NOT pos) AS DOUBLE) AS j FROM ct c JOIN scored s ON s.day = c.day WHERE t IS NOT NULL GROUP BY c.day, t),
    yo AS (SELECT day, t AS threshold, j FROM jj QUALIFY row_number() OVER (PARTITION BY day ORDER BY round(j, 12) DESC, t) = 1)"""
_PAIR = "pairs AS (SELECT a.rater AS ra, b.rater AS rb, a.label AS la, b.label AS lb FROM raters a JOIN raters b ON a.doc_id = b.doc_id AND a.rater < b.rater)"

QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__name__", "").startswith("q_")}
ORACLES = {
    "q_truth_table": f"""WITH {SCORED}, c AS (SELECT coalesce(day, 'OVERALL') AS day, count(*) FILTER (pos AND score >= 0.5) AS tp, count(*) FILTER (NOT pos AND score >= 0.5) AS fp,
        count(*) FILTER (pos AND score < 0.5) AS fn, count(*) FILTER (NOT pos AND score < 0.5) AS tn FROM scored GROUP BY GROUPING SETS ((day), ()))
        SELECT *, round({_R.format(a="tp", b="tp + fn")}, 6) AS tpr, round({_R.format(a="fp", b="fp + tn")}, 6) AS fpr, round({_R.format(a="tp", b="tp + fp")}, 6) AS precision FROM c""",
    "q_outcome_review": f"WITH {SCORED} SELECT doc_id, CASE WHEN pos AND score >= 0.5 THEN 'HIT' WHEN pos THEN 'MISS' WHEN score >= 0.5 THEN 'FP' ELSE 'TN' END AS outcome, CASE WHEN pos AND score < 0.5 THEN 0 WHEN NOT pos AND score >= 0.5 THEN 1 WHEN pos THEN 2 ELSE 3 END AS rank, score FROM scored",
    "q_auc": f"WITH {SCORED}, {_AUC} SELECT day, round(auc, 9) AS auc, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg FROM scored LEFT JOIN au USING (day) GROUP BY day, auc",
    "q_youden": f"WITH {SCORED}, {_YOU} SELECT day, CASE WHEN NOT isnan(j) THEN round(threshold, 7) END AS threshold, round(j, 9) AS j FROM yo",
    "q_grid_sweep": f"WITH {SCORED}, {_SW}, s AS (SELECT CAST(combo AS INTEGER) AS combo, threshold, {_SUMS} FROM cf GROUP BY 1, 2) SELECT *, {_J} AS j FROM s",
    "q_go_gate": f"WITH {SCORED}, {_AUC}, {_YOU} SELECT day, CASE WHEN auc >= 0.85 AND j >= 0.6 THEN 'GO' WHEN auc >= 0.75 THEN 'INVESTIGATE' ELSE 'NO-GO' END AS gate FROM (SELECT DISTINCT day FROM scored) LEFT JOIN au USING (day) LEFT JOIN yo USING (day)",
    "q_score_catalogue": f"WITH {DET}, d AS (SELECT *, event_id % 17 AS n FROM det), l AS ("
    + " UNION ALL ".join(f"SELECT event_type, '{k}' AS name, {v} AS s FROM d" for k, v in SCORES.items())
    + ") SELECT name, event_type, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.9), 6) AS p90, round(avg(CASE WHEN s >= 1 THEN 1e0 ELSE 0e0 END), 6) AS \"full\" FROM l GROUP BY 1, 2",
    "q_score_histogram": f"WITH {DET}, e AS (SELECT unnest(range(0, 6)) AS i, {EDGES}::DOUBLE[] AS x), b AS (SELECT CAST(i AS INTEGER) AS bin, x[i + 1] AS lo, x[i + 2] AS hi FROM e) SELECT bin, lo, hi, count(score) AS n FROM b LEFT JOIN det ON score >= lo AND score < hi GROUP BY bin, lo, hi",
    "q_confusion": f"WITH {RATERS}, {_PAIR} SELECT ra, rb, la, count(*) FILTER (lb = 'contrail') AS contrail, count(*) FILTER (lb = 'no_contrail') AS no_contrail, count(*) FILTER (lb = 'unsure') AS unsure FROM pairs GROUP BY ra, rb, la",
    "q_kappa": f"""WITH {RATERS}, {_PAIR}, t AS (SELECT ra, rb, count(*) AS n, count(*) FILTER (la = lb) / CAST(count(*) AS DOUBLE) AS po FROM pairs GROUP BY ra, rb),
        a AS (SELECT ra, rb, la AS l, count(*) AS c FROM pairs GROUP BY ra, rb, la), b AS (SELECT ra, rb, lb AS l, count(*) AS c FROM pairs GROUP BY ra, rb, lb),
        e AS (SELECT a.ra, a.rb, sum(a.c * b.c) AS x FROM a JOIN b ON a.ra = b.ra AND a.rb = b.rb AND a.l = b.l GROUP BY a.ra, a.rb)
        SELECT t.ra, t.rb, n, round(po, 9) AS agreement, round((po - x / CAST(n * n AS DOUBLE)) / (1 - x / CAST(n * n AS DOUBLE)), 9) AS kappa FROM t JOIN e ON e.ra = t.ra AND e.rb = t.rb""",
    "q_consensus": f"WITH {RATERS} SELECT doc_id, CASE WHEN min(label) = max(label) THEN min(label) END AS label, min(label) <> max(label) AS conflict, string_agg(DISTINCT rater, ',' ORDER BY rater) AS raters, count(*) AS votes FROM raters WHERE label <> 'unsure' GROUP BY doc_id",
    "q_merge_first": f"WITH {RATERS} SELECT doc_id, arg_min(label, rater) AS label, count(DISTINCT label) > 1 AS conflict, string_agg(rater, ',' ORDER BY rater) AS sources FROM raters WHERE label <> 'unsure' GROUP BY doc_id",
    "q_overlap_items": f"WITH {RATERS} SELECT doc_id, count(DISTINCT rater) AS n FROM raters GROUP BY doc_id HAVING count(DISTINCT rater) >= 2",
    "q_upsert_labels": f"""WITH {RATERS}, t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'a' END AS rater, CASE WHEN doc_id % 4 = 0 THEN 'old' END AS label, n_chars FROM documents), n AS (SELECT * FROM raters WHERE rater <> 'c')
        SELECT t.doc_id, t.rater, coalesce(n.label, t.label) AS label, n_chars FROM t LEFT JOIN n ON n.doc_id = t.doc_id AND n.rater = t.rater WHERE t.rater IS NOT NULL
        UNION ALL SELECT t.doc_id, n.rater, n.label, n_chars FROM t JOIN n ON n.doc_id = t.doc_id WHERE t.rater IS NULL OR t.rater <> n.rater
        UNION ALL SELECT doc_id, rater, label, n_chars FROM t WHERE rater IS NULL AND doc_id NOT IN (SELECT doc_id FROM n)""",
    "q_open_rows": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND n_chars >= 500 ORDER BY n_chars DESC, doc_id",
    "q_validate_payload": """SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 9 = 0 THEN 'schema_version' END, CASE WHEN doc_id % 10 = 0 THEN 'date' END, CASE WHEN doc_id % 3 = 0 THEN 'duplicate episode_id' END,
        CASE WHEN doc_id % 8 = 0 THEN 'label' END, CASE WHEN doc_id % 7 NOT BETWEEN 1 AND 5 THEN 'persistence_rating' END], lambda x: x IS NOT NULL), '; ') AS errors FROM labels""",
    "q_validate_exports": f"""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'not valid JSON' WHEN doc_id % 5 <> 0 AND doc_id % 11 = 0 THEN 'schema_version: not 1: 2' WHEN doc_id % 13 = 0 THEN 'labels[1].episode_id: twice in the file: 1'
            WHEN doc_id % 17 = 0 THEN 'labels[1].episode_id: no whole number: true' ELSE ([{", ".join("NULL" if e is None else "'" + e.replace("'", "''") + "'" for _, e in FIELDS)}])[doc_id % {len(FIELDS)} + 1] END AS error, doc_id % {len(FIELDS)} AS f FROM labels)
        SELECT doc_id, error, CAST(CASE WHEN error IS NULL THEN 2 ELSE 0 END AS BIGINT) AS n, CAST(CASE WHEN error IS NULL AND f = 13 THEN 1 ELSE 0 END AS BIGINT) AS label_notes,
            CAST(CASE WHEN error IS NULL AND f = 5 THEN 1 ELSE 0 END AS BIGINT) AS measurement_km, CAST(CASE WHEN error IS NULL AND f = 7 THEN 1 ELSE 0 END AS BIGINT) AS label_timestamp FROM e""",
    "q_mask_effect": f"WITH {SCORED}, a AS (SELECT *, CASE WHEN n_chars % 4 = 0 THEN score * 0.5 ELSE score END AS aft FROM scored) SELECT day, count(*) FILTER (score >= 0.5 AND aft < 0.5 AND NOT pos) AS fp_lost, count(*) FILTER (score >= 0.5 AND aft < 0.5 AND pos) AS tp_lost FROM a GROUP BY day",
}
