"""Views of the test tables that the queries work on, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.core import micros

GAP_S, THRESHOLD, WINDOW = 21_600, 0.083, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: one row per event, score saturating at 200."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "ts", "event_id", "value", "event_type", F.least(F.lit(1.0), F.col("value") / 200.0).alias("score"), micros("ts").alias("us"))


DET = "det AS (SELECT user_id, ts, event_id, value, event_type, least(CAST(1.0 AS DOUBLE), value / CAST(200.0 AS DOUBLE)) AS score, epoch_us(ts) AS us FROM events)"

_GEO = {
    "lat": "42.0e0 + (c_custkey % 401 - 200) * 0.01e0",
    "lon": "-71.0e0 + (c_custkey % 997 - 498) * 0.01e0",
    "gnss": "CASE WHEN c_custkey % 7 <> 0 THEN 9000.0e0 + c_acctbal END",
    "baro": "CASE WHEN c_custkey % 5 <> 0 THEN 9000.0e0 + c_acctbal + (c_custkey % 13) * 50.0e0 END",
}


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with two altitudes, derived from customer."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey", *[f"{x} AS {n}" for n, x in _GEO.items()])


GEO = "geo AS (SELECT c_custkey, c_nationkey, " + ", ".join(f"{x} AS {n}" for n, x in _GEO.items()) + " FROM customer)"

_RATERS = (
    "SELECT doc_id, 'a' AS rater, CASE WHEN doc_id % 11 = 0 THEN 'unsure' WHEN quality = 1 THEN 'contrail' ELSE 'no_contrail' END AS label FROM labels"
    " UNION ALL SELECT doc_id, 'b' AS rater, CASE WHEN toxic = 0 THEN 'contrail' ELSE 'no_contrail' END AS label FROM labels"
    " UNION ALL SELECT doc_id, 'c' AS rater, CASE WHEN doc_id % 13 = 0 THEN 'unsure' WHEN n_chars % 3 > 0 THEN 'contrail' ELSE 'no_contrail' END AS label FROM documents"
)


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three raters' labels per document."""
    return spark.sql(_RATERS.replace("FROM labels", "FROM {l}").replace("FROM documents", "FROM {d}"), l=table(spark, sf_dir, "labels"), d=table(spark, sf_dir, "documents"))


RATERS = f"raters AS ({_RATERS})"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score; day is one of four groups."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    score = ((F.col("n_chars") % 997) / 997.0 + F.col("quality") * 0.25) / 1.25
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("lang").alias("day"), (F.col("quality") == 1).alias("pos"), F.round(score, 2).alias("score"), "n_chars")


SCORED = "scored AS (SELECT l.doc_id, lang AS day, quality = 1 AS pos, round(((n_chars % 997) / CAST(997.0 AS DOUBLE) + quality * CAST(0.25 AS DOUBLE)) / CAST(1.25 AS DOUBLE), 2) AS score, n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"

_SM = "list_sort(list(score) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"
EPISODES = f"""{DET}, sm AS (SELECT *, {_SM} AS xs FROM det),
    kept AS (SELECT *, xs[(len(xs) + 1) // 2] AS smoothed FROM sm WHERE xs[(len(xs) + 1) // 2] >= CAST(0.083 AS DOUBLE)),
    gaps AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= {GAP_S * 1_000_000} THEN 0 ELSE 1 END AS is_new FROM kept),
    ses AS (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM gaps),
    rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY score DESC, ts, event_id) AS r, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS f FROM ses),
    ep AS (SELECT user_id, session, min(CASE WHEN f = 1 THEN event_type END) AS first_name, min(ts) AS onset, max(ts) AS "end", max(score) AS peak_score,
                  min(CASE WHEN r = 1 THEN event_id END) AS peak_id, count(*) AS frame_count FROM rk GROUP BY user_id, session),
    episodes AS (SELECT *, row_number() OVER (ORDER BY onset, user_id) AS episode_id FROM ep)"""
