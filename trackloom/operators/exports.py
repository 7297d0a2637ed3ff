"""Label exports: strict validation of JSON documents with the place of the first error, and their ingestion, all or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.core import ordinals
from trackloom.functions.text import ISO_ZONE
from trackloom.operators.labels import LABELS, PERSISTENCE, upsert
from trackloom.sources.shared import written

VERSION = 1
RECORD = ("episode_id", "label", "persistence_rating", "persistence", "measurement_km", "labeler_id", "label_timestamp", "label_notes")
#: Columns that a label sets, and those that the row of a further labeler lacks.
VALUES, LEFT_OUT = [c for c in RECORD if c not in ("episode_id", "labeler_id")], ("peak_contrail_length_m",)


def _at(doc: Column, name: str) -> Column:
    """A field as a variant: null if it is absent, a variant that holds null if it is null."""
    return F.try_variant_get(doc, f"$.{name}", "variant")


def _kind(v: Column) -> Column:
    """BIGINT, DOUBLE, DECIMAL(p,s), BOOLEAN, STRING, VOID, ARRAY<...> or OBJECT<...>; empty if absent."""
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _is_int(v: Column) -> Column:
    # 2.0 is a decimal; whole numbers beyond a long are none that a table can hold
    return _kind(v) == "BIGINT"


def _is_number(v: Column) -> Column:
    return _kind(v).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")


def _is_text(v: Column) -> Column:
    return _kind(v) == "STRING"


def _given(v: Column) -> Column:
    return ~_kind(v).isin("", "VOID")


def _text(v: Column) -> Column:
    return F.when(_is_text(v), F.try_variant_get(v, "$", "string"))


def _int(v: Column) -> Column:
    return F.when(_is_int(v), F.try_variant_get(v, "$", "long"))


def _moment(v: Column) -> Column:
    """A time with a zone; null for a naive, odd or impossible one."""
    x = _text(v)
    # the cast asks for seconds
    whole = F.regexp_replace(x, r"^(.{16})(Z|[+-])", "$1:00$2")
    return F.when(x.rlike(ISO_ZONE), whole.try_cast("timestamp"))


def _shown(v: Column) -> Column:
    return F.coalesce(F.to_json(v), F.lit("nothing"))


def _record_error(r: Column, i: Column, ids: Column, labeler: Column) -> Column:
    """The first error of a record, or null; a field that may be left out may also be null."""
    f = {c: _at(r, c) for c in RECORD}
    rating, length = _int(f["persistence_rating"]), f["measurement_km"]
    rules = [
        (_kind(r).startswith("OBJECT"), "", "no object"),
        (_is_int(f["episode_id"]), ".episode_id", "no whole number"),
        (F.array_position(ids, F.get(ids, i)) == i + 1, ".episode_id", "twice in the file"),
        (F.coalesce(_text(f["label"]).isin(*LABELS), F.lit(False)), ".label", "no known label"),
        ((_kind(f["labeler_id"]) == "") | F.coalesce(_text(f["labeler_id"]) == labeler, F.lit(False)), ".labeler_id", "not the file's"),
        (~_given(f["persistence_rating"]) | F.coalesce(rating.between(1, 5), F.lit(False)), ".persistence_rating", "no whole number from 1 to 5"),
        (~_given(f["persistence"]) | F.coalesce(_text(f["persistence"]).isin(*PERSISTENCE), F.lit(False)), ".persistence", "no known persistence"),
        (~_given(length) | _is_number(length), ".measurement_km", "no number"),
        (~_given(f["label_timestamp"]) | _moment(f["label_timestamp"]).isNotNull(), ".label_timestamp", "no time with a zone"),
        (~_given(f["label_notes"]) | _is_text(f["label_notes"]), ".label_notes", "no text"),
    ]
    place = F.concat(F.lit("labels["), i.cast("string"), F.lit("]"))
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.concat(place, F.lit(f"{name}: {what}: "), _shown(f.get(name[1:], r)))) for ok, name, what in rules])


def _normal(r: Column, labeler: Column) -> Column:
    notes = _text(_at(r, "label_notes"))
    return F.struct(
        _int(_at(r, "episode_id")).alias("episode_id"),
        _text(_at(r, "label")).alias("label"),
        _int(_at(r, "persistence_rating")).cast("int").alias("persistence_rating"),
        _text(_at(r, "persistence")).alias("persistence"),
        F.when(_is_number(_at(r, "measurement_km")), F.try_variant_get(_at(r, "measurement_km"), "$", "double")).alias("measurement_km"),
        labeler.alias("labeler_id"),
        _moment(_at(r, "label_timestamp")).alias("label_timestamp"),
        F.when(notes != "", notes).alias("label_notes"),
    )


def validated(exports: DataFrame, payload: str, expected_date: str) -> DataFrame:
    """exports with error, the first one with its place or null, and labels, an array of records (null if there is an error).

    Types are those of the JSON text: true is no number, 1.0 no whole number. Unknown fields are ignored, empty notes are
    null, times without a zone are refused, and a field that is null counts as left out where it may be.
    """
    df = exports.withColumn("_v", F.try_parse_json(payload))
    v = F.col("_v")
    day, labeler = _text(_at(v, "date")), _text(_at(v, "labeler_id"))
    version = _at(v, "schema_version")
    same = (_is_number(version) & (F.try_variant_get(version, "$", "double") == VERSION)) | ((_kind(version) == "BOOLEAN") & F.lit(VERSION == 1) & F.coalesce(F.try_variant_get(version, "$", "boolean"), F.lit(False)))
    records = F.when(_kind(_at(v, "labels")).startswith("ARRAY"), F.try_variant_get(v, "$.labels", "array<variant>"))
    df = df.withColumns({"_labeler": labeler, "_records": records})
    df = df.withColumn("_ids", F.transform("_records", lambda r: _int(_at(r, "episode_id"))))
    rules = [
        (v.isNotNull(), "not valid JSON"),
        (_kind(v).startswith("OBJECT"), "top level: no object"),
        (same, F.concat(F.lit("schema_version: not 1: "), _shown(version))),
        (day.rlike(r"^\d{4}-\d\d-\d\d$") & day.try_cast("date").isNotNull(), F.concat(F.lit("date: no date: "), _shown(_at(v, "date")))),
        (day == expected_date, F.concat(F.lit(f"date: not {expected_date}: "), _shown(_at(v, "date")))),
        (F.col("_labeler") != "", F.concat(F.lit("labeler_id: no text: "), _shown(_at(v, "labeler_id")))),
        (F.col("_records").isNotNull(), F.concat(F.lit("labels: no list: "), _shown(_at(v, "labels")))),
    ]
    head = [F.when(~F.coalesce(ok, F.lit(False)), what if isinstance(what, Column) else F.lit(what)) for ok, what in rules]
    wrong = F.get(F.array_compact(F.transform("_records", lambda r, i: _record_error(r, i, F.col("_ids"), F.col("_labeler")))), F.lit(0))
    df = df.withColumn("error", F.coalesce(*head, wrong))
    return df.withColumn("labels", F.when(F.col("error").isNull(), F.transform("_records", lambda r: _normal(r, F.col("_labeler"))))).drop("_v", "_labeler", "_records", "_ids")


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """(path, payload): one row per file of a folder or pattern."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def accepted(exports: DataFrame, expected_date: str, shown: int = 20) -> DataFrame:
    """The labels of all exports (path, nth, and the record's fields), or an error that names the files at fault."""
    rows = written(validated(exports, "payload", expected_date), "exports")
    bad = rows.where("error is not null").orderBy("path").limit(shown).collect()
    if bad:
        raise ValueError("; ".join(f"{r['path']}: {r['error']}" for r in bad))
    return rows.select("path", F.posexplode("labels").alias("nth", "r")).select("path", "nth", "r.*")


def ingest(spark: SparkSession, table: str, path: str, day: str) -> dict[str, int]:
    """Take the label files of a day into its partition of the episode table; labels per labeler.

    Nothing is written unless every file is valid. The day's new rows are a table of their own first, as Spark may not
    overwrite what it reads; a run that ends early leaves the old rows. Labels arrive by file name, then in their order. Rows
    that are added get the next row ids.
    """
    labels = accepted(read_exports(spark, path), day).withColumn("arrival", F.struct("path", "nth"))
    old = spark.table(table).where(F.col("date") == day)
    new = upsert(old, labels, "episode_id", "labeler_id", VALUES, "arrival", LEFT_OUT)
    schema = spark.table(table).schema
    if "row_id" in schema.names:
        last = spark.table(table).agg(F.coalesce(F.max("row_id"), F.lit(0))).first()[0]
        # a row keeps its id; copies share one, of which the first labeler's row has it
        first = F.min(F.struct("label_timestamp", "labeler_id"))
        owner = new.where("row_id is not null").groupBy("row_id").agg(first.alias("_own"))
        rows = new.join(owner, "row_id", "left").withColumn("_copy", F.col("row_id").isNull() | (F.struct("label_timestamp", "labeler_id") != F.col("_own")))
        added = ordinals(rows.where("_copy").drop("row_id"), "episode_id", ["episode_id", "labeler_id"], "row_id").withColumn("row_id", F.col("row_id") + last)
        new = rows.where("not _copy").unionByName(added).drop("_own", "_copy")
    new = written(new.select(*[F.col(f.name).cast(f.dataType) for f in schema]), "labelled-day")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        new.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    return {r["labeler_id"]: r["n"] for r in labels.groupBy("labeler_id").agg(F.count(F.lit(1)).alias("n")).collect()}
