"""Queries that choose: newest complete days, crossings of the image, spread candidates, samples in half buckets, fallbacks, an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.core import half_buckets, micros, truthy
from trackloom.operators import labels, metrics, sampling, sessions, timeseries
from trackloom.plans.tracks import episodes_of
from trackloom.plans.views import DET, EPISODES, GEO, det, geo, table

HOUR = 3_600_000_000
#: Hours that a complete day has, and days that are looked back.
LEAST_H, WITHIN = 250, 20
CROSSING = (21_600, 7_200, 900.0)
EDGES = (0.0, 25.0, 50.0, 100.0, 200.0, float("inf"))


def q_newest_days(spark, sf_dir):
    """Complete days of the last weeks, newest first: those whose episodes cover 250 hours."""
    e = episodes_of(spark, sf_dir).select(F.to_date("onset").alias("day"), micros("onset").alias("lo"), micros("end").alias("hi"))
    return sampling.newest_complete(e, "day", "lo", "hi", LEAST_H * HOUR, WITHIN)


def _pixels(spark, sf_dir):
    p = det(spark, sf_dir).select("user_id", "ts", "us", "event_id", (F.col("event_id") % 4_200 - 100).cast("double").alias("x"), (F.col("value") * 12 - 50).alias("y"))
    return p.where("x >= 0 and x < 3840 and y >= 0 and y < 2160").where(F.date_format("ts", "HH:mm").between("06:00", "21:30"))


def q_crossings(spark, sf_dir):
    """Runs of points by day and inside the image that last two hours and span 900 cells."""
    gap, least, span = CROSSING
    c = sessions.crossings(_pixels(spark, sf_dir), "user_id", "ts", "event_id", "x", "y", gap, least, span)
    return c.select("user_id", "onset", "end", "n", F.round("span", 4).alias("span"))


def q_spread_candidates(spark, sf_dir):
    """Most central point of each half hour of the day, one per user, twelve evenly over the day."""
    p = _pixels(spark, sf_dir).withColumn("off", F.hypot(F.col("x") - 1_920, F.col("y") - 1_080))
    bucket = F.floor(F.pmod("us", F.lit(24 * HOUR)) / (HOUR // 2)).cast("long")
    return sampling.spread(p, "user_id", bucket, [F.col("off"), F.col("ts"), F.col("event_id")], 12).select("event_id", "user_id")


def q_half_buckets(spark, sf_dir):
    """Seven events of each user from the middle four fifths of its rows, at the middles of equal parts."""
    d = det(spark, sf_dir)
    size = d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    spots = size.select("user_id", F.explode(F.array_distinct(half_buckets(F.col("n"), 7, 0.1, 0.9))).alias("spot"))
    from trackloom.operators.joins import numbered

    return spots.join(numbered(d, "user_id", ["us", "event_id"], "spot"), ["user_id", "spot"]).select("user_id", "spot", "event_id")


def q_altitude_fallback(spark, sf_dir):
    """The barometric altitude, else the other one, else zero, where zero counts as missing."""
    a, b = F.when(F.col("c_custkey") % 4 > 0, F.col("baro")).otherwise(0.0), F.when(F.col("c_custkey") % 3 > 0, F.col("gnss")).otherwise(0.0)
    return geo(spark, sf_dir).select("c_custkey", truthy(a, b).alias("alt"))


def q_guarded_delta(spark, sf_dir):
    """Seconds since the user's read before, where both reads are good."""
    d = det(spark, sf_dir).withColumn("ok", F.col("event_id") % 6 > 0)
    return timeseries.guarded_delta(d, "user_id", ["ts", "event_id"], "us", "ok").where("delta is not null").select("event_id", "delta")


def q_open_histogram(spark, sf_dir):
    """Events per bin of value; the last bin has no upper edge."""
    h = metrics.histogram(det(spark, sf_dir), F.col("value"), list(EDGES))
    return h.select("bin", "lo", F.when(F.col("hi") < float("inf"), F.col("hi")).alias("hi"), "n")


def q_published_index(spark, sf_dir):
    """Published dates and variants of a date with their episodes; a variant has the labelers of its date."""
    e = episodes_of(spark, sf_dir).select("episode_id", F.date_format("onset", "yyyy-MM-dd").alias("day"), "peak_score")
    variant = F.when(F.col("episode_id") % 4 == 0, F.concat("day", F.lit("-tuned"))).otherwise(F.col("day"))
    dates = e.groupBy(variant.alias("date")).agg(F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("peak_score") >= 0.5).alias("detected"))
    files = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("d"), (F.col("user_id") % 3).alias("u")).distinct()
    names = labels.catalogue(files.where("u <> dayofmonth(to_date(d)) % 4").select(F.concat("d", F.lit("_u"), "u", F.lit(".json")).alias("name"), F.lit(None).cast("string").alias("known")), "name", "known")
    found = dates.withColumn("_day", F.regexp_extract("date", r"^(\d{4}-\d\d-\d\d)(?:-[a-z0-9]+)?$", 1)).join(names.select(F.col("date").alias("_day"), "labelers"), "_day", "left")
    return found.select("date", "episodes", "detected", F.coalesce("labelers", F.lit("")).alias("labelers"))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__name__", "").startswith("q_")}
_PX = f"{DET}, px AS (SELECT * FROM (SELECT user_id, ts, us, event_id, CAST(event_id % 4200 - 100 AS DOUBLE) AS x, value * 12 - 50 AS y FROM det) WHERE x >= 0 AND x < 3840 AND y >= 0 AND y < 2160 AND strftime(ts, '%H:%M') BETWEEN '06:00' AND '21:30')"
ORACLES = {
    "q_newest_days": f"""WITH {EPISODES}, c AS (SELECT CAST(onset AS DATE) AS day, CAST(sum(epoch_us("end") - epoch_us(onset)) AS BIGINT) AS covered FROM episodes GROUP BY 1)
        SELECT day, covered, CAST(row_number() OVER (ORDER BY day DESC) AS INTEGER) AS nth FROM c WHERE covered >= {LEAST_H * HOUR} AND (SELECT max(day) FROM c) - day < {WITHIN}""",
    "q_crossings": f"""WITH {_PX}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {CROSSING[0] * 1_000_000} THEN 0 ELSE 1 END AS is_new FROM px WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g),
        c AS (SELECT user_id, min(ts) AS onset, max(ts) AS "end", count(*) AS n, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS span, max(us) - min(us) AS took FROM s GROUP BY user_id, session)
        SELECT user_id, onset, "end", n, round(span, 4) AS span FROM c WHERE took >= {CROSSING[1] * 1_000_000} AND span >= {CROSSING[2]}""",
    "q_spread_candidates": f"""WITH {_PX}, b AS (SELECT *, (us % 86400000000) // 1800000000 AS bucket, sqrt(pow(x - 1920, 2) + pow(y - 1080, 2)) AS off FROM px),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY off, ts, event_id) AS r FROM b) WHERE r = 1),
        once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bucket) AS q FROM best) WHERE q = 1),
        po AS (SELECT *, row_number() OVER (ORDER BY bucket) - 1 AS spot, count(*) OVER () AS n FROM once)
        SELECT event_id, user_id FROM po WHERE n <= 12 OR spot IN (SELECT CAST(round_even(k * (n - 1) / 11e0, 0) AS BIGINT) FROM (SELECT range AS k FROM range(0, 12)))""",
    "q_half_buckets": f"""WITH {DET}, f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS spot, count(*) OVER (PARTITION BY user_id) AS n FROM det)
        SELECT user_id, CAST(spot AS BIGINT) AS spot, event_id FROM f WHERE spot IN (SELECT CAST(round_even(n * 0.1e0 + (k + 0.5e0) * (n * 0.8e0) / 7, 0) AS BIGINT) FROM (SELECT range AS k FROM range(0, 7)))""",
    "q_altitude_fallback": f"WITH {GEO} SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 4 > 0 THEN baro ELSE 0 END, 0), nullif(CASE WHEN c_custkey % 3 > 0 THEN gnss ELSE 0 END, 0), 0) AS alt FROM geo",
    "q_guarded_delta": f"""WITH {DET}, g AS (SELECT event_id, CASE WHEN event_id % 6 > 0 THEN us END AS good, lag(CASE WHEN event_id % 6 > 0 THEN us END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS past FROM det)
        SELECT event_id, good - past AS delta FROM g WHERE good IS NOT NULL AND past IS NOT NULL""",
    "q_open_histogram": f"WITH {DET}, b(bin, lo, hi) AS (VALUES " + ", ".join(f"({i}, CAST({a} AS DOUBLE), CAST({'NULL' if b == float('inf') else b} AS DOUBLE))" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:]))) + ") SELECT bin, lo, hi, count(value) AS n FROM b LEFT JOIN det ON value >= lo AND (hi IS NULL OR value < hi) GROUP BY bin, lo, hi",
    "q_published_index": f"""WITH {EPISODES}, e AS (SELECT strftime(onset, '%Y-%m-%d') AS day, strftime(onset, '%Y-%m-%d') || CASE WHEN episode_id % 4 = 0 THEN '-tuned' ELSE '' END AS date, peak_score FROM episodes),
        u AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, user_id % 3 AS u FROM events WHERE user_id % 3 <> day(ts) % 4),
        n AS (SELECT day, string_agg('u' || u, ',' ORDER BY u) AS labelers FROM u GROUP BY day)
        SELECT date, count(*) AS episodes, count(*) FILTER (peak_score >= 0.5) AS detected, coalesce(any_value(labelers), '') AS labelers FROM e LEFT JOIN n ON n.day = e.day GROUP BY date""",
}
