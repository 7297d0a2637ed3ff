"""Queries over oriented regions, physical sizes, units and lookups of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import geo as g
from trackloom.functions.core import bound
from trackloom.plans.views import DET, GEO, det, geo, table

LAT, LON = 42.0, -71.0

SITE = 42.0, -71.0, 10.0
#: A camera that looks up: focal lengths and centre in pixels, radial distortion.
FX, FY, CX, CY, K1 = 1500.0, 1600.0, 1920.0, 1080.0, -0.01
#: Ground heights above the ellipsoid differ from those above the sea by this many metres here.
GEOID_M = -29.0


def _oriented(spark, sf_dir):
    """Centres with a unit path vector and, for two in three, sizes of their own."""
    turn = F.pmod(F.col("event_id"), F.lit(3))
    vx = F.when(turn == 0, 0.6).when(turn == 1, 1.0).otherwise(0.0)
    vy = F.when(turn == 0, 0.8).when(turn == 1, 0.0).otherwise(1.0)
    own = F.when(turn > 0, F.col("value"))
    return det(spark, sf_dir).select("event_id", (F.col("event_id") % 3840).cast("double").alias("cx"), (F.col("value") * 10).alias("cy"), vx.alias("vx"), vy.alias("vy"), own.alias("along"), (own / 4).alias("cross"))


def q_rotated_roi(spark, sf_dir):
    """Corners of the rectangle along the path; without sizes of its own, three paddings along and one across."""
    half = g.roi_halves(F.col("along"), F.col("cross"), 20.0)
    box = g.rotated_box(F.col("cx"), F.col("cy"), F.col("vx"), F.col("vy"), *half)
    rows = _oriented(spark, sf_dir).select("event_id", F.posexplode(box).alias("corner", "p"))
    return rows.select("event_id", "corner", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def q_crop_geometry(spark, sf_dir):
    """The crop's origin in the frame after clipping, and centre and first corner in the crop."""
    rows = _oriented(spark, sf_dir)
    left, top = (g.crop_origin(F.floor(F.col(c) - 60), 20) for c in ("cx", "cy"))
    rows = rows.withColumns({"left": left.cast("long"), "top": top.cast("long")})
    box = g.rotated_box(F.col("cx") - F.col("left"), F.col("cy") - F.col("top"), F.col("vx"), F.col("vy"), F.lit(50.0), F.lit(10.0))
    return rows.select("event_id", "left", "top", F.round(F.col("cx") - F.col("left"), 4).alias("x"), F.round(F.col("cy") - F.col("top"), 4).alias("y"), F.round(box[0]["x"], 4).alias("x0"), F.round(box[0]["y"], 4).alias("y0"))


def q_pixel_metres(spark, sf_dir):
    """Length in metres of a length in pixels at the slant range of each position; 0 for no length."""
    e, n, u = g.enu(F.col("lat"), F.col("lon"), F.coalesce("gnss", "baro"), *SITE)
    metres = g.pixel_metres(F.col("c_custkey").cast("double") % 200 - 20, e, n, u, FX, FY)
    return geo(spark, sf_dir).select("c_custkey", F.round(metres, 3).alias("metres"))


def q_line_span(spark, sf_dir):
    """Along-track span of the ends of all lines of a user and type."""
    rows = det(spark, sf_dir).select("user_id", "event_type", (F.col("value") * 3).alias("x1"), (F.col("event_id") % 500).cast("double").alias("y1"), F.col("value").alias("x2"), (F.col("event_id") % 211).cast("double").alias("y2"))
    return g.along_span(rows, ["user_id", "event_type"], 0.6, 0.8).select("user_id", "event_type", F.round("span", 4).alias("span"))


def q_metric_altitudes(spark, sf_dir):
    """Feet as metres, geometric heights put on the ellipsoid; nulls stay null."""
    rows = geo(spark, sf_dir).select("c_custkey", (F.col("baro") / 0.3048).alias("baro_ft"), (F.col("gnss") / 0.3048).alias("gnss_ft"))
    return rows.select("c_custkey", F.round(g.feet_to_metres(F.col("baro_ft")), 4).alias("baro_m"), F.round(g.feet_to_metres(F.col("gnss_ft"), GEOID_M), 4).alias("gnss_m"))


def q_surviving_tracks(spark, sf_dir):
    """Tracks from 10:00 to 16:30 by the clock's text, with the points that survive; tracks without any go."""
    hhmm = F.date_format("ts", "HH:mm")
    rows = det(spark, sf_dir).where(hhmm.between("10:00", "16:30") & (F.col("value") >= 100))
    point = F.struct("us", "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss+00:00").alias("iso"))
    tracks = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(point)).alias("points"))
    return tracks.select("user_id", F.size("points").cast("long").alias("n"), F.col("points")[0]["iso"].alias("first"), F.element_at("points", -1)["event_id"].alias("last_id"))


def _frames(spark, sf_dir):
    d = det(spark, sf_dir).select("user_id", "event_id", "us")
    from trackloom.operators.joins import numbered

    return numbered(d, "user_id", ["us", "event_id"], "frame")


#: A camera that looks north, five degrees above the horizon; its distortion grows with the angle, so no far ray folds back: rotation, focal lengths, centre and distortion (k1, k2, p1, p2, k3).
TILT = (0.08715574274765817, 0.9961946980917455)
CAMERA = (((1.0, 0.0, 0.0), (0.0, TILT[0], -TILT[1]), (0.0, TILT[1], TILT[0])), 1_500.0, 1_480.0, 1_920.0, 1_080.0, (-0.05, 0.01, 0.001, -0.002, 0.001))


def q_camera_model(spark, sf_dir):
    """Pixels in the image of a turned camera with all terms of distortion, and whether the ray of the pixel hits the position."""
    p = geo(spark, sf_dir).where("coalesce(gnss, baro) is not null")
    e, n, u = g.enu(F.col("lat"), F.col("lon"), F.coalesce("gnss", "baro"), LAT, LON, 10.0)

    def pixel(at):
        x, y = g.camera((at["e"], at["n"], at["u"]), *CAMERA)
        return F.struct(x.alias("x"), y.alias("y"), at.alias("at"))

    def back(s):
        at = (s["at"]["e"], s["at"]["n"], s["at"]["u"])
        return bound(F.array(*g.camera_ray(s["x"], s["y"], *CAMERA)), lambda ray: bound(g.turned(at, CAMERA[0])[2], lambda depth: F.greatest(*[F.abs(ray[i] - c / depth) for i, c in enumerate(at)]) < 1e-6))

    inside = lambda s: (s["x"] >= 0) & (s["x"] < 3840) & (s["y"] >= 0) & (s["y"] < 2160)
    seen = bound(bound(F.struct(e.alias("e"), n.alias("n"), u.alias("u")), pixel), lambda s: F.when(inside(s), F.struct(F.round(s["x"], 4).alias("x"), F.round(s["y"], 4).alias("y"), back(s).alias("back"))))
    return p.select("c_custkey", seen.alias("s")).where("s is not null").select("c_custkey", "s.*")


def q_frame_lookup(spark, sf_dir):
    """Wanted frames of each user: those past the end are left out or clamped to the last one."""
    from trackloom.operators.joins import frames_at

    frames = _frames(spark, sf_dir)
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(F.array(*[F.lit(i).cast("long") for i in (0, 5, 60, 400)])).alias("frame"))
    rows = [frames_at(frames, wanted, "user_id", "frame", clamp).select("user_id", "frame", "event_id", F.lit(name).alias("mode")) for name, clamp in (("omit", False), ("clamp", True))]
    return rows[0].unionByName(rows[1])


_F = "1 / 298.257223563e0"
_E2 = f"({_F} * (2 - {_F}))"


def _ecef(lat: str, lon: str, h: str) -> tuple[str, str, str]:
    n = f"(6378137e0 / sqrt(1 - {_E2} * pow(sin(radians({lat})), 2)))"
    return (
        f"(({n} + {h}) * cos(radians({lat})) * cos(radians({lon})))",
        f"(({n} + {h}) * cos(radians({lat})) * sin(radians({lon})))",
        f"(({n} * (1 - {_E2}) + {h}) * sin(radians({lat})))",
    )


_D = [f"({a} - {b})" for a, b in zip(_ecef("lat", "lon", "coalesce(gnss, baro)"), _ecef("42e0", "-71e0", "10e0"))]
_EC = f"ec AS (SELECT *, {', '.join(f'{d} AS {n}' for d, n in zip(_D, ('dx', 'dy', 'dz')))} FROM geo)"
_ENU = f"""{_EC}, en AS (SELECT *, -sin(radians(-71e0)) * dx + cos(radians(-71e0)) * dy AS e,
    -sin(radians(42e0)) * cos(radians(-71e0)) * dx - sin(radians(42e0)) * sin(radians(-71e0)) * dy + cos(radians(42e0)) * dz AS n,
    cos(radians(42e0)) * cos(radians(-71e0)) * dx + cos(radians(42e0)) * sin(radians(-71e0)) * dy + sin(radians(42e0)) * dz AS u FROM ec)"""
_OR = f"""{DET}, ori AS (SELECT event_id, CAST(event_id % 3840 AS DOUBLE) AS cx, value * 10 AS cy, CASE event_id % 3 WHEN 0 THEN 0.6e0 WHEN 1 THEN 1e0 ELSE 0e0 END AS vx,
    CASE event_id % 3 WHEN 0 THEN 0.8e0 WHEN 1 THEN 0e0 ELSE 1e0 END AS vy, CASE WHEN event_id % 3 > 0 THEN value END AS along FROM det)"""

QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__name__", "").startswith("q_")}
ORACLES = {
    "q_rotated_roi": f"""WITH {_OR}, h AS (SELECT *, coalesce(nullif(along, 0) / 2, 60e0) AS a, coalesce(nullif(along, 0) / 8, 20e0) AS c FROM ori),
        s(corner, sa, sc) AS (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1))
        SELECT event_id, corner, round(cx + sa * a * vx - sc * c * vy, 6) AS x, round(cy + sa * a * vy + sc * c * vx, 6) AS y FROM h, s""",
    "q_crop_geometry": f"""WITH {_OR}, t AS (SELECT *, CAST(greatest(0, floor(cx - 60) - 20) AS BIGINT) AS "left", CAST(greatest(0, floor(cy - 60) - 20) AS BIGINT) AS top FROM ori)
        SELECT event_id, "left", top, round(cx - "left", 4) AS x, round(cy - top, 4) AS y, round(cx - "left" - 50 * vx + 10 * vy, 4) AS x0, round(cy - top - 50 * vy - 10 * vx, 4) AS y0 FROM t""",
    "q_pixel_metres": f"""WITH {GEO}, {_EC} SELECT c_custkey, round(CASE WHEN c_custkey % 200 - 20 <= 0 OR dx IS NULL OR sqrt(dx * dx + dy * dy + dz * dz) < 1 THEN 0e0
        ELSE sqrt(dx * dx + dy * dy + dz * dz) * (c_custkey % 200 - 20) / sqrt(1500e0 * 1600e0) END, 3) AS metres FROM ec""",
    "q_line_span": f"""WITH {DET}, p AS (SELECT user_id, event_type, 0.6e0 * value * 3 + 0.8e0 * (event_id % 500) AS p FROM det UNION ALL SELECT user_id, event_type, 0.6e0 * value + 0.8e0 * (event_id % 211) FROM det)
        SELECT user_id, event_type, round(max(p) - min(p), 4) AS span FROM p GROUP BY 1, 2""",
    "q_metric_altitudes": f"WITH {GEO} SELECT c_custkey, round(baro, 4) AS baro_m, round(gnss - 29, 4) AS gnss_m FROM geo",
    "q_surviving_tracks": f"""WITH {DET}, k AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM det WHERE strftime(ts, '%H:%M') BETWEEN '10:00' AND '16:30' AND value >= 100)
        SELECT user_id, count(*) AS n, arg_min(iso, (us, event_id)) AS first, arg_max(event_id, (us, event_id)) AS last_id FROM k GROUP BY user_id""",
    "q_frame_lookup": f"""WITH {DET}, f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS frame FROM det), w AS (SELECT c_custkey AS user_id, unnest([0, 5, 60, 400]) AS frame FROM customer),
        m AS (SELECT user_id, max(frame) AS top FROM f GROUP BY user_id)
        SELECT w.user_id, CAST(w.frame AS BIGINT) AS frame, event_id, 'omit' AS mode FROM w JOIN f ON f.user_id = w.user_id AND f.frame = w.frame
        UNION ALL SELECT w.user_id, CAST(w.frame AS BIGINT), event_id, 'clamp' FROM w JOIN m ON m.user_id = w.user_id JOIN f ON f.user_id = w.user_id AND f.frame = least(w.frame, top)""",
    "q_camera_model": f"""WITH {GEO}, {_ENU}, c AS (SELECT c_custkey, e AS x, {TILT[0]}e0 * n - {TILT[1]}e0 * u AS y, {TILT[1]}e0 * n + {TILT[0]}e0 * u AS z FROM en WHERE coalesce(gnss, baro) IS NOT NULL),
        p AS (SELECT c_custkey, x / z AS u, y / z AS v, pow(x / z, 2) + pow(y / z, 2) AS r FROM c WHERE z > 0),
        d AS (SELECT *, 1 - 0.05e0 * r + 0.01e0 * r * r + 0.001e0 * r * r * r AS f FROM p),
        q AS (SELECT c_custkey, 1500 * (u * f + 2 * 0.001e0 * u * v - 0.002e0 * (r + 2 * u * u)) + 1920 AS x, 1480 * (v * f + 0.001e0 * (r + 2 * v * v) - 2 * 0.002e0 * u * v) + 1080 AS y FROM d)
        SELECT c_custkey, round(x, 4) AS x, round(y, 4) AS y, true AS back FROM q WHERE x >= 0 AND x < 3840 AND y >= 0 AND y < 2160""",
    "q_project_pixels": f"""WITH {GEO}, {_ENU}, p AS (SELECT c_custkey, e / u AS x, n / u AS y FROM en WHERE u > 0), q AS (SELECT c_custkey, x, y, 1 - 0.01e0 * (x * x + y * y) AS d FROM p),
        r AS (SELECT c_custkey, round(x * d * 1500 + 1920, 4) AS x, round(y * d * 1500 + 1080, 4) AS y FROM q) SELECT * FROM r WHERE x >= 0 AND x < 3840 AND y >= 0 AND y < 2160""",
    "q_sun_altitude": f"""WITH {DET}, a AS (SELECT event_id, (us % 86400000000) / 3.6e9 AS h, dayofyear(ts) AS d FROM det), b AS (SELECT *, 2 * pi() / 365 * (d - 1 + (h - 12) / 24) AS g FROM a),
        c AS (SELECT *, 229.18e0 * (0.000075e0 + 0.001868e0 * cos(g) - 0.032077e0 * sin(g) - 0.014615e0 * cos(2 * g) - 0.040849e0 * sin(2 * g)) AS eq,
            0.006918e0 - 0.399912e0 * cos(g) + 0.070257e0 * sin(g) - 0.006758e0 * cos(2 * g) + 0.000907e0 * sin(2 * g) - 0.002697e0 * cos(3 * g) + 0.00148e0 * sin(3 * g) AS de FROM b),
        e AS (SELECT *, radians((h * 60 + eq + 4 * -71e0) / 4 - 180) AS ha FROM c)
        SELECT event_id, round(90 - degrees(acos(greatest(-1e0, least(1e0, sin(radians(42e0)) * sin(de) + cos(radians(42e0)) * cos(de) * cos(ha))))), 4) AS sun FROM e""",
}
