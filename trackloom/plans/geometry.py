"""Queries over positions, times as text, vectors and masks; reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import geo as g
from trackloom.functions import text as tx
from trackloom.functions.core import micros, ordinals
from trackloom.operators import metrics
from trackloom.operators.selection import percentiles
from trackloom.plans.tracks import episodes_of
from trackloom.plans.views import DET, EPISODES, GEO, det, geo, table

LAT, LON = 42.0, -71.0


def q_altitude_policy(spark, sf_dir):
    """Altitude and its source by the automatic policy."""
    a = g.altitude(F.col("gnss"), F.col("baro"), "auto", 200.0)
    return geo(spark, sf_dir).select("c_custkey", a.alias("a")).select("c_custkey", "a.alt", "a.source", F.coalesce(F.nullif("a.alt", F.lit(0.0)), F.lit(-1.0)).alias("known"))


def q_radius_filter(spark, sf_dir):
    """Customers within 150 km: box first, exact distance after."""
    d = geo(spark, sf_dir).where(g.bounding_box(F.col("lat"), F.col("lon"), LAT, LON, 150.0))
    d = d.withColumn("km", F.round(g.haversine_km(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon")), 6))
    return d.where("km <= 150").select("c_custkey", "km")


def q_project_pixels(spark, sf_dir):
    """Pixels of positions seen by an upward camera, inside the image only."""
    e, n, u = g.enu(F.col("lat"), F.col("lon"), F.coalesce("gnss", "baro"), LAT, LON, 10.0)
    x, y = g.pinhole(e, n, u, 1500.0, 1920.0, 1080.0, -0.01)
    p = geo(spark, sf_dir).select("c_custkey", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))
    return p.where("x >= 0 and x < 3840 and y >= 0 and y < 2160")


def q_path_vector(spark, sf_dir):
    """Unit vector to the next event of the user, else to the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = F.struct(F.col("us").alias("x"), F.col("value").alias("y"))
    d = det(spark, sf_dir).select("event_id", (F.col("us") / 1e9).alias("x"), "value", F.coalesce(F.lead(p).over(w), F.lag(p).over(w)).alias("o"))
    dx, dy = F.col("o.x") / 1e9 - F.col("x"), F.col("o.y") - F.col("value")
    n = F.hypot(dx, dy)
    ok = n > 0
    return d.select("event_id", F.round(F.when(ok, dx / n).otherwise(1.0), 6).alias("dx"), F.round(F.when(ok, dy / n).otherwise(0.0), 6).alias("dy"))


def q_oriented_roi(spark, sf_dir):
    """Clipped boxes around points."""
    x, y = F.col("event_id") % 3840, F.col("value") * 10
    box = g.clip_box(x - F.col("value"), y - 40, x + F.col("value"), y + 40, 3840, 2160)
    return det(spark, sf_dir).select("event_id", box.alias("b")).select("event_id", *[F.col(f"b.{c}").cast("long").alias(c) for c in "xywh"])


def q_line_angles(spark, sf_dir):
    """Angle of a line modulo 180 and its acute angle to 30 degrees."""
    a = g.angle_mod_180(F.col("value") - 50, (F.col("event_id") % 100).cast("double") - 50)
    return det(spark, sf_dir).select("event_id", F.round(a, 6).alias("angle"), F.round(g.acute(a, F.lit(30.0)), 6).alias("apart"))


def q_sun_altitude(spark, sf_dir):
    """Solar elevation at each event."""
    hour = F.pmod(F.col("us"), F.lit(86_400_000_000)) / 3.6e9
    return det(spark, sf_dir).select("event_id", F.round(g.solar_elevation(F.dayofyear("ts"), hour, LAT, LON), 4).alias("sun"))


def q_daylight(spark, sf_dir):
    """Events from 10:00:00 to 18:30:00, both included."""
    sec = F.floor(F.pmod(F.col("us"), F.lit(86_400_000_000)) / 1_000_000)
    return det(spark, sf_dir).where(sec.between(36_000, 66_600)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def q_local_day(spark, sf_dir):
    """UTC windows of local days in New York."""
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York"))
    d = det(spark, sf_dir).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    lo = F.to_utc_timestamp(F.col("day").cast("timestamp"), "America/New_York").cast("timestamp_ntz")
    hi = F.to_utc_timestamp(F.date_add("day", 1).cast("timestamp"), "America/New_York").cast("timestamp_ntz")
    return d.select("day", "n", lo.alias("lo"), hi.alias("hi"))


def q_parse_timestamps(spark, sf_dir):
    """Overlay time stamps parsed; shapes and calendars checked."""
    x = F.concat(F.date_format("ts", "MM/"), F.lpad((F.col("event_id") % 33).cast("string"), 2, "0"), F.date_format("ts", "/yyyy HH:mm:ss"))
    return det(spark, sf_dir).select("event_id", tx.parse_overlay(x).alias("at"))


def q_clean_tokens(spark, sf_dir):
    """Misread dates and times put right."""
    x = F.concat(F.date_format("ts", "M/d/yy"), F.when(F.col("event_id") % 2 == 0, " ").otherwise(""), F.translate(F.date_format("ts", "h:mm:ss a"), "0", "O"))
    found = tx.stitch(F.split(tx.clean(x), " "))
    t = F.trim(F.expr("substring(found, length(d) + 1)"))
    rows = det(spark, sf_dir).select("event_id", found.alias("found")).withColumn("d", F.regexp_extract("found", r"^(\d{1,2}/\d{1,2}/\d{2})", 1)).withColumn("t", t)
    return rows.select("event_id", tx.canonical_date(F.col("d")).alias("date"), tx.canonical_time(F.col("t")).alias("time"))


def q_read_tokens(spark, sf_dir):
    """Time stamps from tokens in any order, in pieces, or with parts missing."""
    n = F.col("event_id")
    date, time, short = F.date_format("ts", "M/d/yyyy"), F.date_format("ts", "h:mm:ss a"), F.date_format("ts", "H:mm")
    cut = F.array(F.substring_index(date, "/", 2), F.concat(F.lit("/"), F.substring_index(date, "/", -1)), F.lit("cam"), time)
    tokens = F.when(n % 5 == 0, F.array(time, F.lit("cam"), date)).when(n % 5 == 1, cut).when(n % 5 == 2, F.array(date, F.lit("25:61"))).when(n % 5 == 3, F.array(F.lit("x"), short)).otherwise(F.array(F.lit("13/45/2026"), F.lit("no")))
    return det(spark, sf_dir).select("event_id", tx.read_tokens(tokens).alias("read"))


def q_frame_index(spark, sf_dir):
    """Frame numbers of times at 2.5 seconds per frame."""
    return det(spark, sf_dir).select("event_id", tx.frame_index(F.col("us"), F.lit(1_704_067_200_000_000), 2.5).alias("frame"))


def _glyphs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def q_template_match(spark, sf_dir):
    """Nearest class centroid by cosine, with the margin to the next as confidence."""
    v = _glyphs(spark, sf_dir)
    parts = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    bank = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("t")).withColumnRenamed("label", "guess")
    top = metrics.two_best(v, bank, "v", "guess", "t")
    b, r = F.col("best")[0]["sim"], F.col("best")[1]["sim"]
    sure = F.when(b > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), b * (0.5 + 0.5 * (b - r) / b)))).otherwise(0.0)
    return top.select("vec_id", (-F.col("best")[0]["g"]).alias("guess"), F.round(sure, 6).alias("confidence"))


def _cells(spark, sf_dir):
    return _glyphs(spark, sf_dir).select("vec_id", "label", F.posexplode("v").alias("i", "x")).select("vec_id", "label", (F.col("i") % 8).alias("px"), F.floor(F.col("i") / 8).cast("int").alias("py"), (F.col("x") > 0.05).alias("edge"))


def _mask(spark, sf_dir):
    m = _cells(spark, sf_dir).groupBy("label", "px", "py").agg(F.avg(F.col("edge").cast("int")).alias("share"))
    return m.where("share >= 0.5")


def q_persistence(spark, sf_dir):
    """Cells that are edges in half the frames or more."""
    return _mask(spark, sf_dir).select("label", "px", "py", F.round("share", 6).alias("share"))


def q_dilate(spark, sf_dir):
    """The mask grown by one cell."""
    steps = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in (-1, 0, 1) for y in (-1, 0, 1)]))
    d = _mask(spark, sf_dir).select("label", "px", "py", steps.alias("s")).select("label", (F.col("px") + F.col("s.dx")).alias("px"), (F.col("py") + F.col("s.dy")).alias("py"))
    return d.where("px between 0 and 7 and py between 0 and 7").distinct()


def q_line_mask(spark, sf_dir):
    """Share of nine points on a line across the frame that lie in the mask of the frame's class."""
    p = _glyphs(spark, sf_dir).select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    p = p.select("vec_id", "label", F.floor(F.col("k") * 7 / 8).cast("int").alias("px"), F.floor((F.col("vec_id") % 8) + F.col("k") * (7 - F.col("vec_id") % 8) / 8).cast("int").alias("py"))
    m = _mask(spark, sf_dir).select("label", "px", "py", F.lit(1).alias("hit"))
    return p.join(m, ["label", "px", "py"], "left").groupBy("vec_id").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / 9.0, 6).alias("masked"))


def q_offsets(spark, sf_dir):
    """Distance from the median per user, with totals and a verdict."""
    d = det(spark, sf_dir)
    middle = lambda keys: percentiles(d, keys, "value", {"m": 0.5})
    s = d.groupBy("user_id").agg(F.max("value").alias("top"), F.count(F.lit(1)).alias("n")).join(middle(["user_id"]), "user_id")
    every = d.agg(F.max("value").alias("top"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(middle([]))).withColumn("user_id", F.lit(-1).cast("long"))
    return s.unionByName(every).select("user_id", F.round("m", 6).alias("m"), "top", "n", F.when(F.col("m") <= 40, "aligned").otherwise("off").alias("verdict"))


def q_day_report(spark, sf_dir):
    """Per day: events, users, strong users, and the day's most frequent type."""
    d = det(spark, sf_dir).withColumn("day", F.to_date("ts"))
    s = d.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("score") >= 0.5, F.col("user_id"))).alias("strong"))
    t = d.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("c")).groupBy("day").agg(F.min_by("event_type", F.struct((-F.col("c")).alias("c"), "event_type")).alias("usual"))
    return s.join(t, "day")


def q_pipeline_metrics(spark, sf_dir):
    """Counts, hit rate, mean of the hits and maximum of all detections."""
    hit = F.when(F.col("score") >= 0.083, F.col("score"))
    return det(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.round(F.count(hit) / F.count(F.lit(1)), 6).alias("rate"), F.round(F.avg(hit), 6).alias("mean"), F.max("score").alias("best"))


def q_coverage(spark, sf_dir):
    """Days whose episodes cover 100 hours or more."""
    e = episodes_of(spark, sf_dir).select(F.to_date("onset").alias("day"), (micros("end") - micros("onset")).alias("us"))
    return e.groupBy("day").agg(F.sum("us").alias("us")).where("us >= 360000000000")


def q_rare_values(spark, sf_dir):
    """Five most frequent sources outside a fixed list."""
    d = table(spark, sf_dir, "documents").where(~F.col("source").isin("src0", "src1", "src2"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "source").limit(5)


def q_before_after(spark, sf_dir):
    """Counts of two runs side by side."""
    d = table(spark, sf_dir, "documents").select("lang", "n_chars")
    both = d.withColumn("side", F.lit("before")).unionByName(d.where("n_chars % 5 > 0").withColumn("side", F.lit("after")))
    return both.groupBy("lang").pivot("side", ["before", "after"]).agg(F.count(F.lit(1)))


def q_index(spark, sf_dir):
    """Languages with the sources that label them, numbers cut off."""
    d = table(spark, sf_dir, "documents").select("lang", F.regexp_extract("source", r"^([a-z]+)", 1).alias("family"), "source")
    s = d.groupBy("lang", "family").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return d.select("lang").distinct().join(s, "lang", "left")


def q_diff_positional(spark, sf_dir):
    """Lines of each order compared by position with a perturbed copy."""
    key = ["l_orderkey", "at"]
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    a = table(spark, sf_dir, "lineitem").withColumn("at", F.row_number().over(w)).select(*key, "l_partkey", "l_quantity")
    b = a.where("l_partkey % 50 > 0").select("l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("at")).alias("at"), F.col("l_partkey").alias("p2"), F.col("l_quantity").alias("q2"))
    d = a.join(b, key, "full")
    what = F.when(F.col("p2").isNull(), "missing").when((F.col("l_partkey") != F.col("p2")) | (F.col("l_quantity") != F.col("q2")), "changed").otherwise("same")
    return d.groupBy(what.alias("what")).agg(F.count(F.lit(1)).alias("n"))


def q_candidate_batches(spark, sf_dir):
    """Two candidate batches in one, numbered through."""
    a = det(spark, sf_dir).where("value >= 300").select("event_id")
    b = det(spark, sf_dir).where("value between 250 and 260").select("event_id")
    rows = a.withColumn("batch", F.lit(0)).unionByName(b.withColumn("batch", F.lit(1)))
    return ordinals(rows, F.struct("batch", F.floor(F.col("event_id") / 65_536)), ["batch", "event_id"], "idx").select("event_id", "idx")


_MK = "gl AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), ce AS (SELECT vec_id, label, i % 8 AS px, i // 8 AS py, v[i + 1] > 0.05 AS edge FROM (SELECT *, unnest(range(0, 64)) AS i FROM gl)), mk AS (SELECT label, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, avg(CASE WHEN edge THEN 1e0 ELSE 0e0 END) AS share FROM ce GROUP BY 1, 2, 3 HAVING avg(CASE WHEN edge THEN 1e0 ELSE 0e0 END) >= 0.5)"
_KM = "2 * 6371e0 * asin(sqrt(least(1e0, pow(sin(radians(lat - 42e0) / 2), 2) + cos(radians(42e0)) * cos(radians(lat)) * pow(sin(radians(lon + 71e0) / 2), 2))))"
_E2 = "0.0066943799901413165e0"
QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__name__", "").startswith("q_")}
ORACLES = {
    "q_altitude_policy": f"""WITH {GEO}, a AS (SELECT c_custkey, CASE WHEN gnss IS NULL AND baro IS NULL THEN NULL WHEN gnss IS NULL OR abs(gnss - baro) > 200 THEN 'barometric' ELSE 'gnss' END AS source, gnss, baro FROM geo),
        b AS (SELECT c_custkey, CASE source WHEN 'gnss' THEN gnss WHEN 'barometric' THEN baro END AS alt, source FROM a) SELECT *, coalesce(nullif(alt, 0), -1) AS known FROM b""",
    "q_radius_filter": f"WITH {GEO} SELECT c_custkey, round({_KM}, 6) AS km FROM geo WHERE round({_KM}, 6) <= 150 AND abs(lat - 42) <= 150 / 111e0 AND abs(lon + 71) <= 150 / (111e0 * cos(radians(42e0)))",
    "q_path_vector": f"""WITH {DET}, o AS (SELECT event_id, us / 1e9 AS x, value AS y, coalesce(lead(us) OVER w, lag(us) OVER w) / 1e9 AS ox, coalesce(lead(value) OVER w, lag(value) OVER w) AS oy FROM det WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        d AS (SELECT event_id, ox - x AS dx, oy - y AS dy, sqrt((ox - x) * (ox - x) + (oy - y) * (oy - y)) AS n FROM o)
        SELECT event_id, round(CASE WHEN n > 0 THEN dx / n ELSE 1e0 END, 6) AS dx, round(CASE WHEN n > 0 THEN dy / n ELSE 0e0 END, 6) AS dy FROM d""",
    "q_oriented_roi": f"""WITH {DET}, b AS (SELECT event_id, greatest(floor(event_id % 3840 - value), 0) AS x, greatest(floor(value * 10 - 40), 0) AS y, least(ceil(event_id % 3840 + value), 3839) AS r, least(ceil(value * 10 + 40), 2159) AS b FROM det)
        SELECT event_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(r - x AS BIGINT) AS w, CAST(b - y AS BIGINT) AS h FROM b""",
    "q_line_angles": f"""WITH {DET}, a AS (SELECT event_id, degrees(atan2(CAST(event_id % 100 AS DOUBLE) - 50, value - 50)) AS d FROM det), m AS (SELECT event_id, ((d % 180) + 180) % 180 AS angle FROM a)
        SELECT event_id, round(angle, 6) AS angle, round(least(abs(angle - 30) % 180, 180 - abs(angle - 30) % 180), 6) AS apart FROM m""",
    "q_daylight": f"WITH {DET} SELECT event_type, count(*) AS n FROM det WHERE (us % 86400000000) // 1000000 BETWEEN 36000 AND 66600 GROUP BY event_type",
    "q_local_day": f"""WITH {DET}, d AS (SELECT CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS day, count(*) AS n FROM det GROUP BY 1)
        SELECT day, n, timezone('UTC', timezone('America/New_York', CAST(day AS TIMESTAMP))) AS lo, timezone('UTC', timezone('America/New_York', CAST(day + 1 AS TIMESTAMP))) AS hi FROM d""",
    "q_parse_timestamps": f"WITH {DET} SELECT event_id, try_strptime(strftime(ts, '%m/') || lpad(CAST(event_id % 33 AS VARCHAR), 2, '0') || strftime(ts, '/%Y %H:%M:%S'), '%m/%d/%Y %H:%M:%S') AS at FROM det",
    "q_clean_tokens": f"WITH {DET} SELECT event_id, strftime(ts, '%m/%d/%Y') AS date, strftime(ts, '%H:%M:%S') AS time FROM det",
    "q_read_tokens": f"""WITH {DET} SELECT event_id, CASE event_id % 5 WHEN 2 THEN strftime(ts, '%m/%d/%Y') WHEN 3 THEN strftime(ts, '%H:%M:00') WHEN 4 THEN 'UNREADABLE' ELSE strftime(ts, '%m/%d/%Y %H:%M:%S') END AS read FROM det""",
    "q_frame_index": f"WITH {DET} SELECT event_id, CAST(round_even((us - 1704067200000000) / 2.5e6, 0) AS BIGINT) AS frame FROM det",
    "q_template_match": """WITH gl AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT label, i, avg(v[i]) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM gl) GROUP BY label, i),
        t AS (SELECT label AS guess, list(x ORDER BY i) AS t FROM p GROUP BY label), s AS (SELECT vec_id, guess, round(list_dot_product(v, t) / sqrt(list_dot_product(v, v) * list_dot_product(t, t)), 9) AS sim FROM gl, t),
        r AS (SELECT *, row_number() OVER w AS n, lead(sim) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY sim DESC, guess))
        SELECT vec_id, guess, round(CASE WHEN sim > 0 THEN least(1e0, greatest(0e0, sim * (0.5e0 + 0.5e0 * (sim - nxt) / sim))) ELSE 0e0 END, 6) AS confidence FROM r WHERE n = 1""",
    "q_persistence": f"WITH {_MK} SELECT label, px, py, round(share, 6) AS share FROM mk",
    "q_dilate": f"WITH {_MK} SELECT DISTINCT label, CAST(px + dx AS INTEGER) AS px, CAST(py + dy AS INTEGER) AS py FROM mk, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy) WHERE px + dx BETWEEN 0 AND 7 AND py + dy BETWEEN 0 AND 7",
    "q_line_mask": f"""WITH {_MK}, p AS (SELECT vec_id, label, CAST(floor(k * 7 / 8e0) AS INTEGER) AS px, CAST(floor((vec_id % 8) + k * (7 - vec_id % 8) / 8e0) AS INTEGER) AS py FROM (SELECT *, unnest(range(0, 9)) AS k FROM gl))
        SELECT vec_id, round(count(share) / 9e0, 6) AS masked FROM p LEFT JOIN mk ON mk.label = p.label AND mk.px = p.px AND mk.py = p.py GROUP BY vec_id""",
    "q_offsets": f"WITH {DET}, s AS (SELECT coalesce(user_id, -1) AS user_id, median(value) AS m, max(value) AS top, count(*) AS n FROM det GROUP BY GROUPING SETS ((user_id), ())) SELECT user_id, round(m, 6) AS m, top, n, CASE WHEN m <= 40 THEN 'aligned' ELSE 'off' END AS verdict FROM s",
    "q_day_report": f"""WITH {DET}, t AS (SELECT CAST(ts AS DATE) AS day, event_type, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY count(*) DESC, event_type) AS r FROM det GROUP BY 1, 2)
        SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN score >= 0.5 THEN user_id END) AS strong, any_value(t.event_type) AS usual FROM det JOIN t ON t.day = CAST(ts AS DATE) AND r = 1 GROUP BY 1""",
    "q_pipeline_metrics": f"WITH {DET} SELECT count(*) AS n, round(count(*) FILTER (score >= 0.083) / CAST(count(*) AS DOUBLE), 6) AS rate, round(avg(score) FILTER (score >= 0.083), 6) AS mean, max(score) AS best FROM det",
    "q_coverage": f'WITH {EPISODES} SELECT CAST(onset AS DATE) AS day, CAST(sum(epoch_us("end") - epoch_us(onset)) AS BIGINT) AS us FROM episodes GROUP BY 1 HAVING sum(epoch_us("end") - epoch_us(onset)) >= 360000000000',
    "q_rare_values": "SELECT source, count(*) AS n FROM documents WHERE source NOT IN ('src0', 'src1', 'src2') GROUP BY source ORDER BY n DESC, source LIMIT 5",
    "q_before_after": "SELECT lang, count(*) AS before, count(*) FILTER (n_chars % 5 > 0) AS \"after\" FROM documents GROUP BY lang",
    "q_index": "SELECT lang, regexp_extract(source, '^([a-z]+)', 1) AS family, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY 1, 2",
    "q_diff_positional": """WITH a AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS at_, l_partkey AS p, l_quantity AS q FROM lineitem),
        b AS (SELECT o, row_number() OVER (PARTITION BY o ORDER BY at_) AS at_, p, q FROM a WHERE p % 50 > 0)
        SELECT CASE WHEN b.p IS NULL THEN 'missing' WHEN a.p <> b.p OR a.q <> b.q THEN 'changed' ELSE 'same' END AS what, count(*) AS n FROM a FULL JOIN b ON a.o = b.o AND a.at_ = b.at_ GROUP BY 1""",
    "q_candidate_batches": f"WITH {DET}, a AS (SELECT event_id FROM det WHERE value >= 300), b AS (SELECT event_id FROM det WHERE value BETWEEN 250 AND 260) SELECT event_id, row_number() OVER (ORDER BY event_id) AS idx FROM a UNION ALL SELECT event_id, row_number() OVER (ORDER BY event_id) + (SELECT count(*) FROM a) FROM b",
}
