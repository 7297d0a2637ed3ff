"""Human labels: consensus, merging, validation of exports, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.text import ISO_ZONE

LABELS = ("contrail", "no_contrail", "unsure")
PERSISTENCE = ("short", "potentially_persistent")
EXPORT = "schema_version int, date string, labeler_id string, exported_at string, labels array<struct<episode_id:int,label:string,labeler_id:string,persistence_rating:int,persistence:string,measurement_km:double,label_timestamp:string,label_notes:string>>"


def consensus(df: DataFrame, item: str, label: str, rater: str, unsure: str = "unsure") -> DataFrame:
    """One row per item with a definite vote: its label if all definite votes agree, else conflict."""
    votes = df.where(F.col(label) != unsure).groupBy(item)
    out = votes.agg(F.min(label).alias("lo"), F.max(label).alias("hi"), F.array_join(F.array_sort(F.collect_set(rater)), ",").alias("raters"), F.count(F.lit(1)).alias("votes"))
    agreed = F.col("lo") == F.col("hi")
    return out.select(item, F.when(agreed, F.col("lo")).alias("label"), (~agreed).alias("conflict"), "raters", "votes")


def merge_first(df: DataFrame, item: str, label: str, order: list[str], source: str) -> DataFrame:
    """The first label of each item by order, whether later ones differ, and all sources in order."""
    first = F.min_by(label, F.struct(*order))
    sources = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(source).alias("_source")))), lambda x: x["_source"]), ",")
    return df.groupBy(item).agg(first.alias("label"), (F.count_distinct(label) > 1).alias("conflict"), sources.alias("sources"))


def validate(df: DataFrame, payload: str, expected_date: str) -> DataFrame:
    """errors per export document; an empty list means that it may be taken. Unknown keys are ignored."""
    doc = F.from_json(F.col(payload), EXPORT, {"mode": "PERMISSIVE"})
    rows = df.withColumn("doc", doc)
    items = F.coalesce(F.col("doc.labels"), F.array().cast("array<struct<episode_id:int,label:string,labeler_id:string,persistence_rating:int,persistence:string,measurement_km:double,label_timestamp:string,label_notes:string>>"))
    ids = F.transform(items, lambda x: x["episode_id"])

    def when(bad: Column, text: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.lit(text))

    some = lambda f: F.exists(items, f)
    checks = [
        when(F.col("doc.schema_version") != 1, "schema_version"),
        when(F.col("doc.date") != expected_date, "date"),
        when(F.size(ids) != F.size(F.array_distinct(ids)), "duplicate episode_id"),
        when(some(lambda x: x["episode_id"].isNull()), "episode_id"),
        when(some(lambda x: ~F.coalesce(x["label"].isin(*LABELS), F.lit(False))), "label"),
        when(some(lambda x: F.coalesce(x["labeler_id"], F.col("doc.labeler_id")) != F.col("doc.labeler_id")), "labeler_id"),
        when(some(lambda x: ~F.coalesce(x["persistence_rating"].between(1, 5), F.lit(True))), "persistence_rating"),
        when(some(lambda x: ~F.coalesce(x["persistence"].isin(*PERSISTENCE), F.lit(True))), "persistence"),
        when(some(lambda x: ~F.coalesce(x["label_timestamp"].rlike(ISO_ZONE), F.lit(True))), "label_timestamp"),
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*checks))).drop("doc")


def upsert(table: DataFrame, labels: DataFrame, item: str, labeler: str, label: str | list[str], arrival: str, left_out: tuple[str, ...] = ()) -> DataFrame:
    """Rows after labels come in: a labeler's last label wins; the first labeler of an item takes its open row, others get copies.

    label names the columns that a label sets; a copy has nulls in those of left_out. table has one row per item and labeler,
    with a null labeler while open; items without a row take no labels. A set-based rewrite, to be written over the partition
    it was read from.
    """
    values = [label] if isinstance(label, str) else label
    last = labels.groupBy(item, labeler).agg(F.max_by(F.struct(*values), arrival).alias("_new"), F.min(arrival).alias("_first"))
    taken = table.where(F.col(labeler).isNotNull()).join(last.drop("_first"), [item, labeler], "left")
    known = taken.withColumns({v: F.when(F.col("_new").isNull(), F.col(v)).otherwise(F.col("_new")[v]) for v in values})
    fresh = last.join(table.where(F.col(labeler).isNotNull()).select(item, labeler), [item, labeler], "left_anti")
    open_ = table.where(F.col(labeler).isNull())
    rest = [c for c in table.columns if c not in (item, labeler, *values)]
    # an item's open row, else that of its first labeler
    order = F.struct(F.col(labeler).isNotNull(), F.col(labeler))
    shape = table.groupBy(item).agg(F.min_by(F.struct(*rest), order).alias("_shape"), F.bool_or(F.col(labeler).isNull()).alias("_open"))
    heir = fresh.groupBy(item).agg(F.min_by(labeler, "_first").alias("_heir"))
    added = fresh.join(shape, item).join(heir, item).withColumn("_copy", ~(F.col("_open") & (F.col(labeler) == F.col("_heir"))))
    column = lambda c: F.when(F.col("_copy"), None).otherwise(F.col("_shape")[c]) if c in left_out else F.col("_shape")[c]
    added = added.select(item, labeler, *[F.col("_new")[v].alias(v) for v in values], *[column(c).alias(c) for c in rest])
    still = open_.join(last.select(item).distinct(), item, "left_anti")
    return known.select(*table.columns).unionByName(added.select(*table.columns)).unionByName(still)


def suppress(frames: DataFrame, mask: DataFrame, frame_id: str, cells: str, cell: str, score: str, line: str, most: float) -> DataFrame:
    """frames with suppressed: a line with more than the share `most` of its cells in the mask loses its line and its score."""
    touched = frames.select(frame_id, F.size(cells).alias("_all"), F.explode(cells).alias(cell)).join(mask, cell)
    hit = touched.groupBy(frame_id).agg((F.count(F.lit(1)) / F.first("_all") > most).alias("suppressed"))
    rows = frames.join(hit, frame_id, "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))
    return rows.withColumns({score: F.when(F.col("suppressed"), 0.0).otherwise(F.col(score)), line: F.col(line) & ~F.col("suppressed")}).drop(cells)


def id_space(rows: DataFrame, known: DataFrame, file: list[str], item: str, known_id: str, most: float) -> DataFrame:
    """Per file its labels, those with unknown ids and their share; a file with more than `most` of them is skipped."""
    found = rows.join(known.select(F.col(known_id).alias(item), F.lit(1).alias("_hit")).distinct(), item, "left")
    counts = found.groupBy(*file).agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.col("_hit").isNull()).alias("unmapped"))
    share = F.col("unmapped") / F.col("labels")
    return counts.withColumns({"unmapped_fraction": F.round(share, 3), "action": F.when(share > most, "skipped").otherwise("remapped")})


def catalogue(files: DataFrame, name: str, known: str) -> DataFrame:
    """Labelers and number of files per date: the known labeler, else the one in DATE_LABELER.json; other names are left out."""
    pattern = r"^(\d{4}-\d\d-\d\d)_(.+)\.json$"
    rows = files.where(F.col(name).rlike(pattern)).select(F.regexp_extract(name, pattern, 1).alias("date"), F.coalesce(known, F.regexp_extract(name, pattern, 2)).alias("labeler"))
    return rows.groupBy("date").agg(F.array_join(F.array_sort(F.collect_set("labeler")), ",").alias("labelers"), F.count(F.lit(1)).alias("files"))


def checked(label: Column, known: tuple[str, ...] = LABELS) -> Column:
    """The label; one that is not known is an error."""
    return F.when(label.isin(*known), label).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))))
