"""Queries over tracks and detections: episodes, passes, windows, time-aligned joins, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.core import median_high, micros, ordinals
from trackloom.operators import joins, sampling, sessions, sweeps, timeseries, tracker
from trackloom.plans.views import DET, EPISODES, GAP_S, GEO, THRESHOLD, WINDOW, det, geo, table


def episodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sessions.episodes(det(spark, sf_dir), "user_id", "ts", "event_id", "score", "event_type", WINDOW, THRESHOLD, GAP_S)
    return ordinals(e, F.to_date("onset"), [F.col("onset"), F.col("user_id")], "episode_id")


def q_episodes(spark, sf_dir):
    """Smoothed, thresholded, gap-split episodes with their peaks and ids."""
    return episodes_of(spark, sf_dir).select("episode_id", "user_id", "first_name", "onset", "end", "peak_score", "peak_id", "frame_count")


def q_rolling_median_low(spark, sf_dir):
    """Centred rolling lower median of the scores."""
    return sessions.rolling_median_low(det(spark, sf_dir), "user_id", ["ts", "event_id"], "score", WINDOW).select("event_id", "smoothed")


def q_passes(spark, sf_dir):
    """Gap-split passes with the closest approach."""
    p = sessions.passes(det(spark, sf_dir), "user_id", "ts", "event_id", GAP_S)
    return p.select("user_id", F.col("session").cast("long").alias("session"), "onset", "end", "n", "closest")


def q_flyovers(spark, sf_dir):
    """Passes of three rows and two hours at least."""
    p = sessions.passes(det(spark, sf_dir), "user_id", "ts", "event_id", GAP_S, 7_200, 3)
    return p.select("user_id", "onset", "end", "n", (F.col("farthest") - F.col("closest")).alias("span"))


def hourly(spark, sf_dir):
    e = det(spark, sf_dir).withColumn("hour", F.floor(F.col("us") / 3_600_000_000).cast("long"))
    return timeseries.keep_last(e, ["user_id", "hour"], ["ts", "event_id"])


def q_keep_last_bucket(spark, sf_dir):
    """Last event per user and hour."""
    return hourly(spark, sf_dir).select("user_id", "hour", "event_id", "value")


def q_upsample(spark, sf_dir):
    """Hourly grid per user, gaps under 24 hours filled linearly; null ends stay null inside."""
    rows = hourly(spark, sf_dir).withColumn("opt", F.when(F.col("event_id") % 3 > 0, F.col("value")))
    u = timeseries.upsample(rows, "user_id", "hour", ["value", "opt"], 24, ["event_type"])
    return u.select("user_id", "hour", F.round("value", 6).alias("value"), F.round("opt", 6).alias("opt"), "event_type", "filled")


def q_second_join(spark, sf_dir):
    """Pairs of events of one truncated hour and type whose users differ, from counts per user: no pair is built."""
    e = det(spark, sf_dir).where("user_id is not null").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    hours = e.groupBy("event_type", "hour").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    pairs = hours.withColumn("pairs", F.call_function("div", F.col("n") * F.col("n") - F.col("own"), F.lit(2).cast("long"))).where("pairs > 0")
    return pairs.groupBy("event_type").agg(F.sum("pairs").alias("pairs"), F.count_distinct("hour").alias("hours"))


def q_overlay_default(spark, sf_dir):
    """Orders with the price of their last line, 0 where there is none."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("arrival"), F.col("l_extendedprice").alias("price"))
    return joins.overlay(o, lines, ["o_orderkey"], "price", F.lit(0.0), "arrival").select("o_orderkey", "price")


def q_band_frames(spark, sf_dir):
    """Frames of each episode: all detections of its user inside it, in order."""
    spans = episodes_of(spark, sf_dir).select("episode_id", "user_id", "onset", F.col("end").alias("stop"))
    rows = joins.band(det(spark, sf_dir), spans, "user_id", "ts", "onset", "stop")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string")), ",")
    return rows.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), ids.alias("ids"))


def q_assigned_only(spark, sf_dir):
    """Episodes assigned to one labeler: semi join."""
    mine = assigned(spark, sf_dir).where("labeler = 'l1'").select("episode_id")
    return episodes_of(spark, sf_dir).join(mine, "episode_id", "left_semi").select("episode_id", "user_id", "frame_count")


def assigned(spark, sf_dir):
    e = episodes_of(spark, sf_dir).select("episode_id", (F.col("episode_id") - 1).alias("at"))
    total = e.count()
    return sampling.assign(e, "at", total, ["l0", "l1", "l2"], 0.2)


def q_assign_labelers(spark, sf_dir):
    """A fifth of the episodes goes to all labelers, the rest round robin."""
    return assigned(spark, sf_dir).select("episode_id", "labeler")


def _spans(spark, sf_dir):
    return episodes_of(spark, sf_dir).select("episode_id", "user_id", micros("onset").alias("lo"), micros("end").alias("hi"))


def q_overlap_pairs(spark, sf_dir):
    """Pairs of episodes of different users that overlap by an hour or more."""
    return joins.overlapping(_spans(spark, sf_dir), "episode_id", "user_id", "lo", "hi", 3_600_000_000, 21_600_000_000)


def q_sustained_overlap(spark, sf_dir):
    """Overlapping pairs whose tracks, interpolated at five times, are within 40 of each other by the median."""
    track = det(spark, sf_dir).select("user_id", "us", "event_id", "value")
    return sweeps.sustained(_spans(spark, sf_dir), track, "episode_id", "user_id", "lo", "hi", "us", "event_id", "value", 7_200_000_000, 21_600_000_000, 40.0, 6)


def q_asof_nearest(spark, sf_dir):
    """Nearest other-type event of the same user within three hours of each purchase-like event."""
    e = det(spark, sf_dir).select("user_id", "event_id", "us", "event_type")
    first = e.agg(F.min("event_type")).first()[0]
    left = e.where(F.col("event_type") == first).select("user_id", "event_id", "us")
    right = e.where(F.col("event_type") != first).select("user_id", F.col("event_id").alias("other_id"), F.col("us").alias("other_us"))
    out = joins.nearest(left, right, "user_id", "event_id", "us", "other_us", 10_800_000_000, "other_id")
    return out.select("event_id", "other_id", (F.col("other_us") - F.col("us")).alias("apart"))


def q_remap_two_tier(spark, sf_dir):
    """Episodes matched to a shifted copy: exactly, else within two hours."""
    e = episodes_of(spark, sf_dir).select("episode_id", "user_id", micros("onset").alias("us"))
    shifted = e.select("user_id", (F.col("us") + F.when(F.col("episode_id") % 3 == 0, 5_400_000_000).otherwise(0)).alias("us"), (F.col("episode_id") + 100_000).alias("new_id")).where("new_id % 5 > 0")
    return joins.two_tier(e, shifted, "user_id", "us", "episode_id", "new_id", 7_200_000_000)


def q_best_per_key_topn(spark, sf_dir):
    """Best event per user, then the 20 best of all."""
    best = sampling.top_per_key(det(spark, sf_dir), ["user_id"], [F.col("score").desc(), F.col("value").desc(), F.col("event_id")])
    return best.orderBy(F.col("value").desc(), "event_id").limit(20).select("user_id", "event_id", "value")


def q_topk_per_group(spark, sf_dir):
    """Three largest values per user."""
    return sampling.top_per_key(det(spark, sf_dir), ["user_id"], [F.col("value").desc(), F.col("event_id")], 3).select("user_id", "event_id", "value")


def q_near_threshold(spark, sf_dir):
    """Five strongest and five nearest to the threshold, without repeats."""
    d = det(spark, sf_dir).select("event_id", "score", "value")
    top = d.orderBy(F.col("value").desc(), "event_id").limit(5)
    near = d.join(F.broadcast(top.select("event_id")), "event_id", "left_anti").orderBy(F.abs(F.col("score") - THRESHOLD), "event_id").limit(5)
    return top.withColumn("why", F.lit("top")).unionByName(near.withColumn("why", F.lit("near"))).select("event_id", "score", "why")


def q_prefix_limit(spark, sf_dir):
    """Only frames before number 500."""
    return det(spark, sf_dir).where("event_id < 500").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


def q_even_samples(spark, sf_dir):
    """Five evenly spaced events per user."""
    return sampling.evenly_spaced(det(spark, sf_dir).select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")], 5).select("user_id", "event_id")


def q_time_buckets(spark, sf_dir):
    """Strongest event of each half hour of the day."""
    bucket = F.floor(F.pmod(F.col("us"), F.lit(86_400_000_000)) / 1_800_000_000)
    return sampling.top_per_key(det(spark, sf_dir).withColumn("bucket", bucket), ["bucket"], [F.col("value").desc(), F.col("event_id")]).select("bucket", "event_id")


def q_stratified(spark, sf_dir):
    """Quota of four per altitude stratum, best per bucket, customers used once."""
    g = geo(spark, sf_dir).withColumn("d", F.abs(F.col("lat") - 42.0) + F.abs(F.col("lon") + 71.0))
    strata = [("low", F.col("gnss") < 11_000), ("mid", F.col("gnss").between(10_000, 15_000)), ("any", F.lit(True))]
    return sampling.stratified(g, "c_custkey", strata, F.col("c_nationkey"), [F.col("d"), F.col("c_custkey")], 4).select("stratum", "c_custkey")


def q_heatmap(spark, sf_dir):
    """Episodes by ten-minute bin of the day of their middle and upper median value."""
    spans = episodes_of(spark, sf_dir).select("episode_id", "user_id", "onset", F.col("end").alias("stop"), "peak_score")
    rows = joins.band(det(spark, sf_dir), spans, "user_id", "ts", "onset", "stop")
    e = rows.groupBy("episode_id").agg(median_high(F.collect_list("value")).alias("level"), F.first("onset").alias("onset"), F.first("stop").alias("stop"), F.first("peak_score").alias("peak"))
    mid = micros("onset") + F.floor((micros("stop") - micros("onset")) / 2)
    e = e.select(F.floor(F.pmod(mid, F.lit(86_400_000_000)) / 600_000_000).alias("tbin"), F.floor(F.col("level") / 10).alias("lbin"), "peak")
    cells = e.groupBy("tbin", "lbin").agg(F.count_if(F.col("peak") >= 0.5).alias("strong"), F.count_if(F.col("peak") < 0.5).alias("weak"))
    return cells.withColumn("colour", F.when((F.col("strong") > 0) & (F.col("weak") > 0), "mixed").when(F.col("strong") > 0, "contrail").otherwise("clear"))


def q_compact(spark, sf_dir):
    """Events of each user thinned greedily to six hours."""
    e = det(spark, sf_dir).select("user_id", "us", "event_id", F.bround("value", 1).alias("v"))
    return timeseries.thin(e, "user_id", "us", 21_600_000_000, ["event_id", "v"]).select("user_id", "event_id")


def q_tracker(spark, sf_dir):
    """Clocks of a third of a day per frame, some misread: what to believe, why, the refused dates, and the day from the context."""
    d = joins.numbered(det(spark, sf_dir).where("user_id is not null").select("user_id", "event_id", "us"), "user_id", ["us", "event_id"], "frame")
    shift = F.when(F.col("event_id") % 7 == 0, 5.0 * 86_400).when(F.col("event_id") % 11 == 0, -7_200.0).when(F.col("frame") >= 40, 40_000.0).otherwise(0.0)
    reads = d.select("user_id", "frame", (F.col("frame") * 28_800.0 + shift).alias("t"), (F.col("event_id") % 13 > 0).alias("ok"))
    return tracker.dated(tracker.track(reads, "user_id", "frame", "t", "ok", 28_800.0), "user_id", "frame", 0)


def q_delta_hist(spark, sf_dir):
    """Hours since the user's event before, clipped at 24."""
    rows = timeseries.previous(det(spark, sf_dir), "user_id", ["ts", "event_id"], ["us"]).where("prev_us is not null")
    hours = F.least(F.floor((F.col("us") - F.col("prev_us")) / 3_600_000_000), F.lit(24))
    return rows.groupBy(hours.alias("hours")).agg(F.count(F.lit(1)).alias("n"))


def q_ngram(spark, sf_dir):
    """Runs of three event types in a row per user."""
    return timeseries.n_grams(det(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type", 3)


def q_previous_row(spark, sf_dir):
    """The value before, null after an event of the type `click` or first."""
    rows = timeseries.previous(det(spark, sf_dir), "user_id", ["ts", "event_id"], ["value", "event_type"])
    return rows.select("event_id", F.when(F.col("prev_event_type") != "click", F.col("prev_value")).alias("prev"))


def q_rollover(spark, sf_dir):
    """Midnights counted from the second of the day alone."""
    e = det(spark, sf_dir).withColumn("sec", F.floor(F.pmod(F.col("us"), F.lit(86_400_000_000)) / 1_000_000))
    return timeseries.rollover(e, "user_id", ["ts", "event_id"], "sec").groupBy("user_id").agg(F.max("day_offset").alias("days"))


_GAPS = f"gaps AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= {GAP_S * 1_000_000} THEN 0 ELSE 1 END AS is_new FROM det), ses AS (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM gaps)"
_HOUR = "hr AS (SELECT * FROM (SELECT *, us // 3600000000 AS hour, row_number() OVER (PARTITION BY user_id, us // 3600000000 ORDER BY ts DESC, event_id DESC) AS r FROM det) WHERE r = 1)"
_ASSIGN = """n AS (SELECT count(*) AS n, CAST(least(count(*), round_even(count(*) * 0.2, 0)) AS BIGINT) AS m FROM episodes),
    sh AS (SELECT DISTINCT (k * n) // m AS spot FROM (SELECT unnest(range(0, m)) AS k, n, m FROM n)),
    pos AS (SELECT episode_id, episode_id - 1 AS spot, sh.spot IS NOT NULL AS shared FROM episodes LEFT JOIN sh ON sh.spot = episode_id - 1),
    rr AS (SELECT *, sum(CASE WHEN shared THEN 0 ELSE 1 END) OVER (ORDER BY spot) - 1 AS turn FROM pos),
    asg AS (SELECT episode_id, unnest(CASE WHEN shared THEN ['l0', 'l1', 'l2'] ELSE ['l' || CAST(turn % 3 AS VARCHAR)] END) AS labeler FROM rr)"""
_SPANS = "sp AS (SELECT episode_id, user_id, epoch_us(onset) AS lo, epoch_us(\"end\") AS hi FROM episodes)"
_PAIRS = "pr AS (SELECT a.episode_id AS a, b.episode_id AS b, a.user_id AS ua, b.user_id AS ub, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM sp a JOIN sp b ON a.episode_id < b.episode_id AND a.user_id <> b.user_id AND least(a.hi, b.hi) - greatest(a.lo, b.lo) >= {0})"
_THIN = """WITH RECURSIVE {det}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM det),
    w AS (SELECT user_id, event_id, i, n, us AS last, true AS keep FROM r WHERE i = 1
          UNION ALL SELECT r.user_id, r.event_id, r.i, r.n, CASE WHEN r.us - w.last >= 21600000000 THEN r.us ELSE w.last END, r.us - w.last >= 21600000000
          FROM w JOIN r ON r.user_id = w.user_id AND r.i = w.i + 1)
    SELECT user_id, event_id FROM w WHERE keep OR i = n"""

QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__name__", "").startswith("q_")}
ORACLES = {
    "q_episodes": f'WITH {EPISODES} SELECT episode_id, user_id, first_name, onset, "end", peak_score, peak_id, frame_count FROM episodes',
    "q_rolling_median_low": f"WITH {EPISODES} SELECT event_id, xs[(len(xs) + 1) // 2] AS smoothed FROM sm",
    "q_passes": f'WITH {DET}, {_GAPS} SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS onset, max(ts) AS "end", count(*) AS n, min(value) AS closest FROM ses GROUP BY user_id, session',
    "q_flyovers": f'WITH {DET}, {_GAPS} SELECT user_id, min(ts) AS onset, max(ts) AS "end", count(*) AS n, max(value) - min(value) AS span FROM ses GROUP BY user_id, session HAVING count(*) >= 3 AND max(us) - min(us) >= 7200000000',
    "q_keep_last_bucket": f"WITH {DET}, {_HOUR} SELECT user_id, hour, event_id, value FROM hr",
    "q_upsample": f"""WITH {DET}, {_HOUR}, o AS (SELECT user_id, hour, value, CASE WHEN event_id % 3 > 0 THEN value END AS opt, event_type FROM hr),
        l AS (SELECT *, lead(hour) OVER w - hour AS gap, lead(value) OVER w AS nv, lead(opt) OVER w AS no FROM o WINDOW w AS (PARTITION BY user_id ORDER BY hour)),
        k AS (SELECT *, unnest(CASE WHEN gap > 1 AND gap < 24 THEN range(0, gap) ELSE [0] END) AS k FROM l)
        SELECT user_id, hour + k AS hour, round(CASE WHEN k = 0 THEN value ELSE value + k / CAST(gap AS DOUBLE) * (nv - value) END, 6) AS value,
               round(CASE WHEN k = 0 THEN opt ELSE opt + k / CAST(gap AS DOUBLE) * (no - opt) END, 6) AS opt, event_type, k > 0 AS filled FROM k""",
    "q_second_join": f"WITH {DET}, h AS (SELECT *, date_trunc('hour', ts) AS hour FROM det) SELECT a.event_type, count(*) AS pairs, count(DISTINCT a.hour) AS hours FROM h a JOIN h b ON a.hour = b.hour AND a.event_type = b.event_type AND a.user_id < b.user_id GROUP BY a.event_type",
    "q_overlay_default": "WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem WHERE l_quantity > 25) SELECT o_orderkey, coalesce(l_extendedprice, 0) AS price FROM orders LEFT JOIN l ON l_orderkey = o_orderkey AND r = 1",
    "q_band_frames": f"""WITH {EPISODES} SELECT episode_id, count(*) AS n, max(d.score) AS best, string_agg(CAST(d.event_id AS VARCHAR), ',' ORDER BY d.ts, d.event_id) AS ids
        FROM episodes e JOIN det d ON d.user_id = e.user_id AND d.ts BETWEEN e.onset AND e."end" GROUP BY episode_id""",
    "q_assign_labelers": f"WITH {EPISODES}, {_ASSIGN} SELECT episode_id, labeler FROM asg",
    "q_assigned_only": f"WITH {EPISODES}, {_ASSIGN} SELECT episode_id, user_id, frame_count FROM episodes WHERE episode_id IN (SELECT episode_id FROM asg WHERE labeler = 'l1')",
    "q_overlap_pairs": f"WITH {EPISODES}, {_SPANS}, {_PAIRS.format(3600000000)} SELECT a, b, hi - lo AS overlap FROM pr",
    "q_sustained_overlap": f"""WITH {EPISODES}, {_SPANS}, {_PAIRS.format(7200000000)},
        s AS (SELECT *, lo + ((hi - lo) * k) // 4 AS us FROM (SELECT *, unnest([0, 1, 2, 3, 4]) AS k FROM pr)),
        seg AS (SELECT user_id, us AS t0, value AS v0, lead(us) OVER w AS t1, lead(value) OVER w AS v1 FROM det WINDOW w AS (PARTITION BY user_id ORDER BY us)),
        x AS (SELECT s.a, s.b, s.k, CASE WHEN s.us = p.t0 THEN p.v0 ELSE p.v0 + (s.us - p.t0) / CAST(p.t1 - p.t0 AS DOUBLE) * (p.v1 - p.v0) END AS xa,
                     CASE WHEN s.us = q.t0 THEN q.v0 ELSE q.v0 + (s.us - q.t0) / CAST(q.t1 - q.t0 AS DOUBLE) * (q.v1 - q.v0) END AS xb
              FROM s JOIN seg p ON p.user_id = s.ua AND s.us >= p.t0 AND (s.us < p.t1 OR p.t1 IS NULL) JOIN seg q ON q.user_id = s.ub AND s.us >= q.t0 AND (s.us < q.t1 OR q.t1 IS NULL))
        SELECT a, b, round(median(abs(xa - xb)), 6) AS separation FROM x GROUP BY a, b HAVING round(median(abs(xa - xb)), 6) <= 40""",
    "q_asof_nearest": f"""WITH {DET}, f AS (SELECT min(event_type) AS t FROM det),
        j AS (SELECT a.event_id, b.event_id AS other_id, b.us - a.us AS apart, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.us - b.us), b.us, b.event_id) AS r
              FROM det a JOIN det b ON a.user_id = b.user_id AND abs(a.us - b.us) <= 10800000000 JOIN f ON a.event_type = f.t AND b.event_type <> f.t)
        SELECT event_id, other_id, apart FROM j WHERE r = 1""",
    "q_remap_two_tier": f"""WITH {EPISODES}, e AS (SELECT episode_id, user_id, epoch_us(onset) AS us FROM episodes),
        s AS (SELECT user_id, us + CASE WHEN episode_id % 3 = 0 THEN 5400000000 ELSE 0 END AS us, episode_id + 100000 AS new_id FROM e WHERE (episode_id + 100000) % 5 > 0),
        x AS (SELECT e.episode_id, min(new_id) AS new_id FROM e JOIN s ON s.user_id = e.user_id AND s.us = e.us GROUP BY e.episode_id),
        n AS (SELECT e.episode_id, new_id, row_number() OVER (PARTITION BY e.episode_id ORDER BY abs(s.us - e.us), s.us, new_id) AS r FROM e JOIN s ON s.user_id = e.user_id AND abs(s.us - e.us) <= 7200000000 WHERE e.episode_id NOT IN (SELECT episode_id FROM x))
        SELECT episode_id, new_id, 'exact' AS tier FROM x UNION ALL SELECT episode_id, new_id, 'near' FROM n WHERE r = 1""",
    "q_best_per_key_topn": f"WITH {DET}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, value DESC, event_id) AS r FROM det) SELECT user_id, event_id, value FROM r WHERE r = 1 ORDER BY value DESC, event_id LIMIT 20",
    "q_topk_per_group": f"WITH {DET}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM det) SELECT user_id, event_id, value FROM r WHERE r <= 3",
    "q_near_threshold": f"WITH {DET}, t AS (SELECT event_id, score FROM det ORDER BY value DESC, event_id LIMIT 5), n AS (SELECT event_id, score FROM det WHERE event_id NOT IN (SELECT event_id FROM t) ORDER BY abs(score - CAST(0.083 AS DOUBLE)), event_id LIMIT 5) SELECT *, 'top' AS why FROM t UNION ALL SELECT *, 'near' FROM n",
    "q_prefix_limit": "SELECT count(*) AS n, max(event_id) AS last FROM events WHERE event_id < 500",
    "q_even_samples": f"""WITH {DET}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS spot, count(*) OVER (PARTITION BY user_id) AS n FROM det)
        SELECT user_id, event_id FROM r WHERE n <= 5 OR spot IN (0, CAST(round_even((n - 1) / 4, 0) AS BIGINT), CAST(round_even(2 * (n - 1) / 4, 0) AS BIGINT), CAST(round_even(3 * (n - 1) / 4, 0) AS BIGINT), n - 1)""",
    "q_time_buckets": f"WITH {DET}, b AS (SELECT *, (us % 86400000000) // 1800000000 AS bucket FROM det), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY value DESC, event_id) AS r FROM b) SELECT bucket, event_id FROM r WHERE r = 1",
    "q_heatmap": f"""WITH {EPISODES}, f AS (SELECT episode_id, list_sort(list(d.value)) AS vs, any_value(epoch_us(onset)) AS lo, any_value(epoch_us("end")) AS hi, any_value(e.peak_score) AS peak
            FROM episodes e JOIN det d ON d.user_id = e.user_id AND d.ts BETWEEN e.onset AND e."end" GROUP BY episode_id),
        c AS (SELECT ((lo + (hi - lo) // 2) % 86400000000) // 600000000 AS tbin, CAST(floor(vs[len(vs) // 2 + 1] / 10) AS BIGINT) AS lbin, count(*) FILTER (peak >= 0.5) AS strong, count(*) FILTER (peak < 0.5) AS weak FROM f GROUP BY 1, 2)
        SELECT *, CASE WHEN strong > 0 AND weak > 0 THEN 'mixed' WHEN strong > 0 THEN 'contrail' ELSE 'clear' END AS colour FROM c""",
    "q_compact": _THIN.format(det=DET),
    "q_delta_hist": f"WITH {DET}, d AS (SELECT us - lag(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM det) SELECT least(d // 3600000000, 24) AS hours, count(*) AS n FROM d WHERE d IS NOT NULL GROUP BY 1",
    "q_ngram": f"WITH {DET}, g AS (SELECT event_type || '>' || lead(event_type) OVER w || '>' || lead(event_type, 2) OVER w AS gram FROM det WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY gram",
    "q_previous_row": f"WITH {DET} SELECT event_id, CASE WHEN lag(event_type) OVER w <> 'click' THEN lag(value) OVER w END AS prev FROM det WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "q_rollover": f"""WITH {DET}, s AS (SELECT *, (us % 86400000000) // 1000000 AS sec FROM det), f AS (SELECT *, CASE WHEN sec + 43200 < lag(sec) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS fell FROM s)
        SELECT user_id, CAST(sum(fell) AS BIGINT) AS days FROM f GROUP BY user_id""",
    "q_stratified": f"""WITH {GEO}, g AS (SELECT *, abs(lat - 42.0e0) + abs(lon + 71.0e0) AS d FROM geo),
        b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY d, c_custkey) AS r FROM g WHERE gnss < 11000) WHERE r = 1),
        e1 AS (SELECT *, row_number() OVER (ORDER BY c_nationkey) - 1 AS spot, count(*) OVER () AS n FROM b1),
        s1 AS (SELECT 'low' AS stratum, c_custkey FROM e1 WHERE n <= 4 OR spot IN (0, CAST(round_even((n - 1) / 3, 0) AS BIGINT), CAST(round_even(2 * (n - 1) / 3, 0) AS BIGINT), n - 1)),
        b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY d, c_custkey) AS r FROM g WHERE gnss BETWEEN 10000 AND 15000 AND c_custkey NOT IN (SELECT c_custkey FROM s1)) WHERE r = 1),
        e2 AS (SELECT *, row_number() OVER (ORDER BY c_nationkey) - 1 AS spot, count(*) OVER () AS n FROM b2),
        s2 AS (SELECT 'mid' AS stratum, c_custkey FROM e2 WHERE n <= 4 OR spot IN (0, CAST(round_even((n - 1) / 3, 0) AS BIGINT), CAST(round_even(2 * (n - 1) / 3, 0) AS BIGINT), n - 1)),
        b3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY d, c_custkey) AS r FROM g WHERE c_custkey NOT IN (SELECT c_custkey FROM s1 UNION ALL SELECT c_custkey FROM s2)) WHERE r = 1),
        e3 AS (SELECT *, row_number() OVER (ORDER BY c_nationkey) - 1 AS spot, count(*) OVER () AS n FROM b3),
        s3 AS (SELECT 'any' AS stratum, c_custkey FROM e3 WHERE n <= 4 OR spot IN (0, CAST(round_even((n - 1) / 3, 0) AS BIGINT), CAST(round_even(2 * (n - 1) / 3, 0) AS BIGINT), n - 1))
        SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3""",
}
