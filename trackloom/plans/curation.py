"""Queries that keep episodes and labels in order: suppression, precedence, remapping, guards, catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.core import micros
from trackloom.operators import joins, labels, sampling
from trackloom.plans.evaluation import _payload
from trackloom.plans.tracks import episodes_of
from trackloom.plans.views import DET, EPISODES, RATERS, SCORED, det, raters, scored, table


def q_suppress(spark, sf_dir):
    """Frames whose line lies mostly on the union of two masks lose score and line; dead frames go, peaks are found anew."""
    a, b = (spark.createDataFrame([(i,) for i in cells], "cell long") for cells in ((1, 2, 3), (3, 4, 5, 6)))
    mask = a.unionByName(b).distinct()
    frames = det(spark, sf_dir).select("user_id", "us", "event_id", F.when(F.col("event_id") % 5 > 0, F.col("score")).otherwise(0.0).alias("score"), (F.col("event_id") % 3 > 0).alias("line"))
    cells = F.when(F.col("line"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (F.col("event_id") + k) % 10))
    out = labels.suppress(frames.withColumn("cells", cells), mask, "event_id", "cells", "cell", "score", "line", 0.5)
    kept = (F.col("score") > 0) | F.col("line")
    rows = out.groupBy("user_id").agg(F.count_if("suppressed").alias("suppressed"), F.count_if(kept).alias("frames"), F.max_by(F.when(kept, F.struct("score", "event_id", "line")), F.when(kept, F.struct("score", (-F.col("us")).alias("t"), (-F.col("event_id")).alias("i")))).alias("peak"))
    return rows.select("user_id", "suppressed", "frames", F.coalesce("peak.score", F.lit(0.0)).alias("peak_score"), F.when(F.col("peak.line"), F.col("peak.event_id")).alias("peak_id"))


def q_human_over_auto(spark, sf_dir):
    """A human label wins, unsure means no class, the rest goes by score."""
    human = raters(spark, sf_dir).where("rater = 'a' and doc_id % 2 = 0").select("doc_id", "label")
    auto = F.when(F.col("score") >= 0.5, "contrail").otherwise("clear")
    own = F.when(F.col("label") == "contrail", "contrail").when(F.col("label") == "no_contrail", "clear")
    return scored(spark, sf_dir).join(human, "doc_id", "left").select("doc_id", F.when(F.col("label").isNull(), auto).otherwise(own).alias("class"))


def q_remap_unique(spark, sf_dir):
    """Episodes of an older run: the same user and onset second, else the only one that overlaps in time."""
    e = episodes_of(spark, sf_dir).select("episode_id", "user_id", micros("onset").alias("lo"), micros("end").alias("hi"))
    moved = F.when(F.col("episode_id") % 3 == 0, 3_600_000_000).otherwise(0)
    old = e.select("user_id", (F.col("lo") + moved).alias("lo"), (F.col("hi") + moved * 8).alias("hi"), (F.col("episode_id") + 500_000).alias("old_id"))
    return joins.exact_or_unique_overlap(old, e, "user_id", "lo", "hi", "old_id", "episode_id", 1_000_000, 86_400_000_000)


def q_id_space_guard(spark, sf_dir):
    """Label files per rater and language: files with more than a tenth of unknown ids are skipped."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    known = d.where("doc_id % 23 > 0").select(F.col("doc_id").alias("known"))
    rows = raters(spark, sf_dir).join(d, "doc_id").withColumn("id", F.when((F.col("rater") == "b") & (F.col("lang") == "en") & (F.col("doc_id") % 4 == 0), F.col("doc_id") + 10_000_000).otherwise(F.col("doc_id")))
    return labels.id_space(rows, known, ["rater", "lang"], "id", "known", 0.1)


def q_path_specs(spark, sf_dir):
    """user@time specifications under two seconds away, first match, and ordinals; null where there is none."""
    e = episodes_of(spark, sf_dir).select("episode_id", "user_id", micros("onset").alias("us"))
    by_time = e.where("episode_id % 40 = 0").select(F.concat_ws("@", "user_id", "us").alias("spec"), "user_id", (F.col("us") + F.when(F.col("episode_id") % 80 == 0, 1_500_000).otherwise(2_000_000)).alias("at"))
    found = joins.nearby_first(by_time, e, "user_id", "at", "us", "spec", "episode_id", 2_000_000)
    by_number = spark.range(0, 100_000, 333).select(F.col("id").cast("string").alias("spec"), F.col("id").alias("nth"))
    return found.unionByName(by_number.join(e.select(F.col("episode_id").alias("nth"), "episode_id"), "nth", "left").select("spec", "episode_id"))


def q_label_gate(spark, sf_dir):
    """Label files of one batch are taken all or none: a single invalid file holds its batch back."""
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 40).alias("batch"), F.expr(_payload().replace("{s}", "string")).alias("payload"))
    checked = labels.validate(rows, "payload", "2026-04-08").withColumn("bad", F.size("errors") > 0)
    counts = checked.groupBy("batch").agg(F.count(F.lit(1)).alias("files"), F.count_if("bad").alias("bad"))
    return counts.withColumn("taken", F.when(F.col("bad") == 0, F.col("files")).otherwise(0).cast("long"))


def q_label_catalogue(spark, sf_dir):
    """Labelers per date from file names, by their metadata where there are some; odd names are passed over."""
    n = F.col("doc_id")
    name = F.when(n % 9 == 0, F.concat(F.lit("notes-"), n)).otherwise(F.concat(F.lit("2026-04-0"), 1 + n % 5, F.lit("_lab"), n % 6, F.lit(".json")))
    rows = table(spark, sf_dir, "labels").select(name.alias("name"), F.when(n % 4 == 0, F.concat(F.lit("meta"), n % 3)).alias("known"))
    return labels.catalogue(rows, "name", "known")


def q_top_above(spark, sf_dir):
    """Twenty best episodes from a score of 0.5 on."""
    return sampling.top_above(episodes_of(spark, sf_dir), F.col("peak_score"), 0.5, [F.col("peak_score").desc(), F.col("episode_id")], 20).select("episode_id", "peak_score")


def q_missing_digits(spark, sf_dir):
    """Digits that no document of a source has in its length."""
    digits = F.explode(F.split(F.col("n_chars").cast("string"), ""))
    d = table(spark, sf_dir, "documents").where("n_chars % 7 = 0").select("source", digits.alias("digit")).where("digit <> ''")
    have = d.groupBy("source").agg(F.collect_set("digit").alias("have"))
    return have.select("source", F.array_join(F.array_except(F.array(*[F.lit(str(i)) for i in range(10)]), "have"), "").alias("missing"))


def q_compact_points(spark, sf_dir):
    """Points as compact JSON objects: milliseconds, one decimal, nulls left out; here their fields and values."""
    low = F.when(F.col("event_id") % 3 > 0, F.bround("value", 1))
    obj = F.to_json(F.struct(F.floor(F.col("us") / 1000).alias("t"), low.alias("v")))
    return det(spark, sf_dir).select("event_id", F.size(F.json_object_keys(obj)).cast("long").alias("fields"), F.get_json_object(obj, "$.t").cast("long").alias("t"), F.get_json_object(obj, "$.v").cast("double").alias("v"))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__name__", "").startswith("q_")}
_EP = f"{EPISODES}, e AS (SELECT episode_id, user_id, epoch_us(onset) AS lo, epoch_us(\"end\") AS hi, epoch_us(onset) AS us FROM episodes)"
ORACLES = {
    "q_suppress": f"""WITH {DET}, f AS (SELECT user_id, us, event_id, CASE WHEN event_id % 5 > 0 THEN score ELSE 0e0 END AS score, event_id % 3 > 0 AS line,
            event_id % 3 > 0 AND len(list_filter(range(0, 4), lambda k: (event_id + k) % 10 BETWEEN 1 AND 6)) / 4e0 > 0.5e0 AS hit FROM det),
        g AS (SELECT user_id, us, event_id, hit, CASE WHEN hit THEN 0e0 ELSE score END AS score, line AND NOT hit AS line FROM f), k AS (SELECT * FROM g WHERE score > 0 OR line),
        p AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, us, event_id) = 1), c AS (SELECT user_id, count(*) AS frames FROM k GROUP BY user_id), s AS (SELECT user_id, count(*) FILTER (hit) AS suppressed FROM g GROUP BY user_id)
        SELECT s.user_id, suppressed, coalesce(frames, 0) AS frames, coalesce(p.score, 0e0) AS peak_score, CASE WHEN p.line THEN p.event_id END AS peak_id FROM s LEFT JOIN c ON c.user_id = s.user_id LEFT JOIN p ON p.user_id = s.user_id""",
    "q_human_over_auto": f"""WITH {SCORED}, {RATERS} SELECT s.doc_id, CASE WHEN label = 'unsure' THEN NULL WHEN label = 'contrail' THEN 'contrail' WHEN label = 'no_contrail' THEN 'clear' WHEN score >= 0.5 THEN 'contrail' ELSE 'clear' END AS class
        FROM scored s LEFT JOIN raters r ON r.doc_id = s.doc_id AND rater = 'a' AND r.doc_id % 2 = 0""",
    "q_remap_unique": f"""WITH {_EP}, o AS (SELECT user_id, lo + m AS lo, hi + m * 8 AS hi, episode_id + 500000 AS old_id FROM (SELECT *, CASE WHEN episode_id % 3 = 0 THEN 3600000000 ELSE 0 END AS m FROM e)),
        x AS (SELECT old_id, max(episode_id) AS episode_id FROM o JOIN e ON e.user_id = o.user_id AND e.lo // 1000000 = o.lo // 1000000 GROUP BY old_id),
        v AS (SELECT old_id, min(episode_id) AS episode_id FROM o JOIN e ON e.user_id = o.user_id AND least(e.hi, o.hi) > greatest(e.lo, o.lo) WHERE old_id NOT IN (SELECT old_id FROM x) GROUP BY old_id HAVING count(*) = 1)
        SELECT old_id, episode_id, 'exact' AS tier FROM x UNION ALL SELECT old_id, episode_id, 'overlap' FROM v""",
    "q_id_space_guard": f"""WITH {RATERS}, r AS (SELECT rater, lang, CASE WHEN rater = 'b' AND lang = 'en' AND r.doc_id % 4 = 0 THEN r.doc_id + 10000000 ELSE r.doc_id END AS id FROM raters r JOIN documents d ON d.doc_id = r.doc_id),
        c AS (SELECT rater, lang, count(*) AS labels, count(*) FILTER (id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 23 > 0)) AS unmapped FROM r GROUP BY 1, 2)
        SELECT *, round(unmapped / CAST(labels AS DOUBLE), 3) AS unmapped_fraction, CASE WHEN unmapped > 0.1 * labels THEN 'skipped' ELSE 'remapped' END AS action FROM c""",
    "q_path_specs": f"""WITH {_EP}, s AS (SELECT CAST(user_id AS VARCHAR) || '@' || us AS spec, user_id, us + CASE WHEN episode_id % 80 = 0 THEN 1500000 ELSE 2000000 END AS at_ FROM e WHERE episode_id % 40 = 0)
        SELECT spec, min(episode_id) AS episode_id FROM s LEFT JOIN e ON e.user_id = s.user_id AND abs(us - at_) < 2000000 GROUP BY spec
        UNION ALL SELECT CAST(n AS VARCHAR), episode_id FROM (SELECT unnest(range(0, 100000, 333)) AS n) LEFT JOIN e ON episode_id = n""",
    "q_label_gate": """WITH b AS (SELECT doc_id % 40 AS batch, doc_id % 9 = 0 OR doc_id % 10 = 0 OR doc_id % 3 = 0 OR doc_id % 8 = 0 OR doc_id % 7 NOT BETWEEN 1 AND 5 AS bad FROM labels),
        c AS (SELECT batch, count(*) AS files, count(*) FILTER (bad) AS bad FROM b GROUP BY batch) SELECT *, CASE WHEN bad = 0 THEN files ELSE 0 END AS taken FROM c""",
    "q_label_catalogue": """WITH n AS (SELECT 1 + doc_id % 5 AS d, CASE WHEN doc_id % 4 = 0 THEN 'meta' || doc_id % 3 ELSE 'lab' || doc_id % 6 END AS labeler FROM labels WHERE doc_id % 9 > 0)
        SELECT '2026-04-0' || d AS date, string_agg(DISTINCT labeler, ',' ORDER BY labeler) AS labelers, count(*) AS files FROM n GROUP BY d""",
    "q_top_above": f"WITH {EPISODES} SELECT episode_id, peak_score FROM episodes WHERE peak_score >= 0.5 ORDER BY peak_score DESC, episode_id LIMIT 20",
    "q_missing_digits": """WITH d AS (SELECT DISTINCT source, unnest(string_split(CAST(n_chars AS VARCHAR), '')) AS digit FROM documents WHERE n_chars % 7 = 0), s AS (SELECT source, list(digit) AS have FROM d GROUP BY source)
        SELECT source, array_to_string(list_filter(['0', '1', '2', '3', '4', '5', '6', '7', '8', '9'], lambda x: NOT list_contains(have, x)), '') AS missing FROM s""",
    "q_compact_points": f"WITH {DET} SELECT event_id, CAST(CASE WHEN event_id % 3 > 0 AND value IS NOT NULL THEN 2 ELSE 1 END AS BIGINT) AS fields, us // 1000 AS t, CASE WHEN event_id % 3 > 0 THEN round_even(value, 1) END AS v FROM det",
}
