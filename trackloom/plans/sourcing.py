"""Queries over sources and what comes right after them: bounds, anchors, updates, readers, daily runs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from trackloom.functions import text
from trackloom.functions.core import micros
from trackloom.operators import joins, sampling
from trackloom.plans.views import GEO, geo, table
from trackloom.sources import day_files, tracks
from trackloom.sources.shared import new_folder
from trackloom.streaming.daily import daily_actions

LAT, LON, RADIUS_KM, LEAST, MOST = 42.0, -71.0, 120.0, 20.0, 180.0
SINCE, UNTIL = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 25)
TODAY, DAYS, NOW_S, LEAST_BYTES, STABLE_S = "2001-08-01", 2_500, 16_000, 3_000, 4_000
FAR_K, CENTRE = 4, (200, 498)


def q_tracks_in_bounds(spark, sf_dir):
    """Events as positions near a site, within altitudes and [since, until); users without any have no row."""

    def source(since, until, box, least_ft):
        e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("transponder_id"), F.timestamp_micros(micros("ts")).alias("time"), ((F.col("event_id") % 401 - 200) * 0.01 + LAT).alias("lat"), ((F.col("event_id") % 997 - 498) * 0.01 + LON).alias("lon"), F.col("value").alias("alt_ft"))
        return e.withColumns({c: F.lit(None).cast("string") for c in tracks.FLIGHT if c != "transponder_id"})

    t = tracks.nested(tracks.around(source, SINCE, UNTIL, LAT, LON, RADIUS_KM, LEAST, MOST))
    at = lambda i: F.unix_micros(F.element_at("points", i)["time"])
    return t.select(F.col("transponder_id").cast("long").alias("user_id"), F.size("points").cast("long").alias("points"), at(1).alias("first_us"), at(-1).alias("last_us"), F.array_max("points.alt_ft").alias("highest"))


def q_day_files(spark, sf_dir):
    """Events as points in SQLite files of a day each, read back within bounds that the files answer."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("transponder_id"), F.timestamp_micros(micros("ts")).alias("time"), ((F.col("event_id") % 401 - 200) * 0.01 + LAT).alias("lat"), ((F.col("event_id") % 997 - 498) * 0.01 + LON).alias("lon"), F.col("value").alias("alt_ft"))
    path = new_folder(spark, "day-files")
    day_files.write_day_files(e, path)
    rows = day_files.day_files(spark, path)(SINCE, UNTIL, (41.5, 42.5, -72.0, -70.5), LEAST)
    return rows.groupBy(F.col("transponder_id").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("points"), F.min(F.unix_micros("time")).alias("first_us"), F.max(F.unix_micros("time")).alias("last_us"), F.max("alt_ft").alias("highest"))


def q_anchor(spark, sf_dir):
    """The first event's row."""
    return tracks.anchor(table(spark, sf_dir, "events"), "event_id").select("event_id", "user_id", micros("ts").alias("us"))


def q_clock_range(spark, sf_dir):
    """Events per user whose time of day as text lies from 06:30 to 18:05, ends included."""
    minute = F.floor(micros("ts") / F.lit(60_000_000)) % 1440
    clock = F.format_string("%02d:%02d", F.floor(minute / 60), minute % 60)
    return table(spark, sf_dir, "events").where(clock.between("06:30", "18:05")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def q_update_altitudes(spark, sf_dir):
    """Altitudes of every third customer come from the other source; its last row counts, also where it is null."""
    g = geo(spark, sf_dir)
    other = g.where("c_custkey % 3 = 0").select("c_custkey", F.col("baro").alias("alt"), F.lit(0).alias("n"))
    other = other.unionByName(g.where("c_custkey % 6 = 0").select("c_custkey", F.lit(None).cast("double").alias("alt"), F.lit(1).alias("n")))
    return joins.update(g.select("c_custkey", F.col("gnss").alias("alt")), other, ["c_custkey"], ["alt"], "n")


def q_near_equal(spark, sf_dir):
    """Documents and the first one of their language and length; the lengths differ by a rounding error."""
    d = table(spark, sf_dir, "documents")
    first = d.groupBy("lang", "n_chars").agg(F.min("doc_id").alias("first_id")).select("lang", (F.col("n_chars") / 7 + 2e-7).alias("v"), "first_id")
    return joins.near_equal(d.select("doc_id", "lang", (F.col("n_chars") / 7).alias("v")), first, ["lang"], "v", 1e-6).select("doc_id", "first_id")


def q_farthest(spark, sf_dir):
    """Four customers per nation that lie far apart, the first one far from the centre."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.col("c_custkey") % 401).alias("x"), (F.col("c_custkey") % 997).alias("y"))
    return sampling.farthest_points(c, "c_nationkey", "c_custkey", "x", "y", FAR_K, CENTRE)


def q_daily_actions(spark, sf_dir):
    """Order days as inputs, days with an urgent order as published ones."""
    o = table(spark, sf_dir, "orders").withColumn("date", F.col("o_orderdate").cast("date"))
    inputs = o.groupBy("date").agg((F.count(F.lit(1)) * 1000).alias("bytes"), F.max("o_orderkey").alias("modified_s"))
    published = o.where("o_orderpriority = '1-URGENT'")
    return daily_actions(inputs, published, F.lit(TODAY).cast("date"), DAYS, F.lit(NOW_S), LEAST_BYTES, STABLE_S).select(F.col("date").cast("string").alias("date"), "action")


def q_compose_reads(spark, sf_dir):
    """Two readers per document: a sure first one, else the second, else the doubtful first."""
    n = F.col("n_chars")
    r = text.composed(F.when(n % 5 > 0, F.col("doc_id")), n % 100 / 100.0, F.lit("parse_failed"), F.when(n % 3 == 0, F.col("doc_id") + 1), F.lit(0.9), 0.5)
    return table(spark, sf_dir, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.*")


def q_json_round_trip(spark, sf_dir):
    """Records as JSON text and back; a null field is left out of the text and comes back as null."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", F.nullif("lang", F.lit("en")).alias("lang"), "n_chars")).alias("j"))
    return d.select(F.from_json("j", "doc_id long, lang string, n_chars int").alias("r"), F.size(F.json_object_keys("j")).cast("long").alias("fields")).select("r.*", "fields")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__name__", "").startswith("q_")}
_KM = f"2e0 * 6371e0 * asin(sqrt(least(1e0, pow(sin(radians(lat - {LAT}e0) / 2), 2) + cos(radians({LAT}e0)) * cos(radians(lat)) * pow(sin(radians(lon - ({LON}e0)) / 2), 2))))"


def _far() -> str:
    """The rounds of the greedy choice, one step after the other."""
    d = "(p.x - {x}) * (p.x - {x}) + (p.y - {y}) * (p.y - {y})"
    ctes = ["p AS (SELECT c_nationkey, c_custkey, c_custkey % 401 AS x, c_custkey % 997 AS y FROM customer)"]
    pick = "SELECT c_nationkey, c_custkey, x, y FROM ({0}) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY d DESC, c_custkey) = 1"
    ctes.append("r1 AS (" + pick.format(f"SELECT p.*, {d.format(x=CENTRE[0], y=CENTRE[1])} AS d FROM p") + ")")
    for k in range(2, FAR_K + 1):
        ctes.append(f"c{k} AS (" + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(1, k)) + ")")
        near = f"SELECT p.c_nationkey, p.c_custkey, p.x, p.y, min({d.format(x='c.x', y='c.y')}) AS d FROM p JOIN c{k} c ON c.c_nationkey = p.c_nationkey GROUP BY ALL"
        ctes.append(f"r{k} AS (" + pick.format(f"SELECT * FROM ({near}) WHERE d > 0") + ")")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT c_nationkey, c_custkey, {i} AS rank FROM r{i}" for i in range(1, FAR_K + 1))


ORACLES = {
    "q_tracks_in_bounds": f"""WITH p AS (SELECT user_id, epoch_us(ts) AS us, (event_id % 401 - 200) * 0.01e0 + {LAT}e0 AS lat, (event_id % 997 - 498) * 0.01e0 + ({LON}e0) AS lon, value FROM events)
        SELECT user_id, count(*) AS points, min(us) AS first_us, max(us) AS last_us, max(value) AS highest FROM p
        WHERE us >= epoch_us(TIMESTAMP '{SINCE}') AND us < epoch_us(TIMESTAMP '{UNTIL}') AND value BETWEEN {LEAST}e0 AND {MOST}e0 AND {_KM} <= {RADIUS_KM}e0 GROUP BY user_id""",
    "q_day_files": f"""WITH p AS (SELECT user_id, epoch_us(ts) AS us, (event_id % 401 - 200) * 0.01e0 + {LAT}e0 AS lat, (event_id % 997 - 498) * 0.01e0 + ({LON}e0) AS lon, value FROM events)
        SELECT user_id, count(*) AS points, min(us) AS first_us, max(us) AS last_us, max(value) AS highest FROM p
        WHERE us >= epoch_us(TIMESTAMP '{SINCE}') AND us < epoch_us(TIMESTAMP '{UNTIL}') AND lat BETWEEN 41.5e0 AND 42.5e0 AND lon BETWEEN -72e0 AND -70.5e0 AND value >= {LEAST}e0 GROUP BY user_id""",
    "q_anchor": "SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_id = 0",
    "q_clock_range": "SELECT user_id, count(*) AS n FROM events WHERE strftime(ts, '%H:%M') BETWEEN '06:30' AND '18:05' GROUP BY user_id",
    "q_update_altitudes": f"WITH {GEO} SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN baro ELSE gnss END AS alt FROM geo",
    "q_near_equal": "SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, n_chars) AS first_id FROM documents",
    "q_farthest": _far(),
    "q_daily_actions": f"""WITH d AS (SELECT CAST(DATE '{TODAY}' - CAST(i AS INTEGER) AS DATE) AS date FROM range(0, {DAYS}) t(i)),
        f AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) * 1000 AS bytes, max(o_orderkey) AS m, count(*) FILTER (o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY 1)
        SELECT CAST(d.date AS VARCHAR) AS date, CASE WHEN u > 0 THEN 'published' WHEN bytes IS NULL THEN 'missing' WHEN bytes < {LEAST_BYTES} THEN 'small' WHEN {NOW_S} - m < {STABLE_S} THEN 'unstable' ELSE 'due' END AS action FROM d LEFT JOIN f ON f.date = d.date""",
    "q_compose_reads": """WITH r AS (SELECT doc_id, CASE WHEN n_chars % 5 > 0 THEN doc_id END AS a, n_chars % 100 / 100e0 AS c, CASE WHEN n_chars % 3 = 0 THEN doc_id + 1 END AS b FROM documents)
        SELECT doc_id, CASE WHEN a IS NOT NULL AND c >= 0.5e0 THEN a WHEN b IS NOT NULL THEN b ELSE a END AS parsed, CASE WHEN a IS NOT NULL AND c >= 0.5e0 THEN c WHEN b IS NOT NULL THEN 0.9e0 ELSE c END AS confidence,
        CASE WHEN NOT (a IS NOT NULL AND c >= 0.5e0) AND b IS NOT NULL THEN 'second' ELSE 'first' END AS method, CASE WHEN a IS NOT NULL AND c >= 0.5e0 OR b IS NOT NULL THEN 'ok' WHEN a IS NULL THEN 'parse_failed' ELSE 'low_confidence' END AS status FROM r""",
    "q_json_round_trip": "SELECT doc_id, nullif(lang, 'en') AS lang, n_chars, CASE WHEN coalesce(lang, 'en') = 'en' THEN 2 ELSE 3 END AS fields FROM documents",
}
