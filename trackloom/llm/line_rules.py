"""Quality rules on text shape and on lines that many documents of a host share, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import SPACE, lookup, marked, materialize

SYMBOLS = "[#*$%&|<>]"


def _window_hashes() -> Column:
    """Sorted longs from columns words and n_words, one per 3-word window: a hash in the upper bits, its place in the lower `bits`."""
    window = "xxhash64(w, get(words, i + 1), get(words, i + 2))"
    return F.expr(f"sort_array(transform(slice(words, 1, n_words - 2), (w, i) -> shiftleft({window}, bits) | cast(i as bigint)))")


#: Whether the windows x and y have equal hashes, the place of a window, and whether the windows at two places have equal words.
_SAME = "shiftrightunsigned({y}, bits) = shiftrightunsigned(x, bits)"
_AT = "cast({x} & (shiftleft(1L, bits) - 1) as int)"
_EQUAL = "slice(words, {x} + 1, 3) = slice(words, {y} + 1, 3)"


def _repeated() -> Column:
    """Places of the windows that are found twice or more.

    Windows of equal hash are neighbours in the sorted longs; if all neighbours of equal hash have equal words, so have all
    windows of that hash. Should two hashes be equal by chance, the windows themselves are compared as strings.
    """
    after, before = _SAME.format(y="get(windows, i + 1)"), _SAME.format(y="get(windows, i - 1)")
    by_hash = f"transform(filter(windows, (x, i) -> {after} or {before}), x -> {_AT.format(x='x')})"
    equal = _EQUAL.format(x=_AT.format(x="x"), y=_AT.format(x="get(windows, i + 1)"))
    chance = f"exists(transform(windows, (x, i) -> {after} and not ({equal})), x -> x)"
    text = "concat_ws(' ', slice(words, i + 1, 3))"
    strings = f"sort_array(transform(windows, (x, i) -> named_struct('t', {text}, 'at', i)))"
    by_text = f"transform(filter(sorted, (x, i) -> coalesce(get(sorted, i + 1).t = x.t, false) or coalesce(get(sorted, i - 1).t = x.t, false)), x -> x.at)"
    return F.expr(f"case when {chance} then transform(array({strings}), sorted -> {by_text})[0] else {by_hash} end")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of docs: id, host, hash of the text, the base measures, and (hash, words) of each line with words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("host"),
        text.alias("text"),
        F.col(text_col).cast("string").alias("own"),
    )
    df = df.withColumn("lines", F.split("text", "\n"))
    df = df.withColumn("line_words", F.transform("lines", lambda x: F.array_remove(F.split(x, SPACE + "+"), "")))
    df = df.withColumn("words", F.flatten("line_words"))
    df = df.withColumn("n_words", F.size("words"))
    df = df.withColumn("bits", F.length(F.bin(F.col("n_words").cast("long"))))
    df = df.withColumn("windows", F.when(F.col("n_words") >= 4, _window_hashes())).withColumn("twice", _repeated())
    spread = F.array_distinct(F.concat("twice", F.transform("twice", lambda p: p + 1), F.transform("twice", lambda p: p + 2)))
    full = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return df.select(
        "row",
        "id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        F.xxhash64(F.col("own")).alias("mark"),
        F.col("n_words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(spread), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform(
            F.filter("line_words", lambda w: F.size(w) > 0),
            lambda w: F.struct(F.xxhash64(F.lower(F.array_join(w, " "))).alias("h"), F.size(w).alias("n")),
        ).alias("lines"),
    )


def frequent_lines(measured: DataFrame, max_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lines, frequent): the lines of all documents, and those that more than max_docs documents of a host have.

    A document is a text: exact copies count once. first is the text hash of the smallest id that has the line.
    """
    lines = materialize(
        measured.select("row", "id", "text_hash", "host", F.explode("lines").alias("line")).select(
            "row", "id", "text_hash", F.xxhash64("host", "line.h").alias("key"), F.col("line.n").alias("n")
        ),
        "lines",
    )
    per_text = lines.groupBy("key", "text_hash").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    per_line = per_text.groupBy("key").agg(
        F.count(F.lit(1)).alias("docs"),
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("first"),
        F.sum("rows").alias("rows"),
    )
    frequent = per_line.where(F.col("docs") > max_docs).select("key", F.col("first.text_hash").alias("first"), "rows")
    return lines, materialize(frequent, "frequent-lines")


def line_frequency_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = 20,
    min_share: float = 0.5,
    min_words: int = 50,
) -> DataFrame:
    """Base measures and the verdict of cross-document line frequency, one row per row of docs.

    Lines are compared in lower case with white space collapsed, by hash and host. A line that more than max_docs
    distinct texts of its host have is removed from all of them but the text of the smallest id (copies of that text
    keep it too). A document with less than min_share of its words left is rejected. base_failed rejects too: fewer than
    min_words words, or more than half of them in repeated 3-word windows.
    Null text has no words and fails; a null host is a host of its own; null ids come last; repeated rows get equal
    verdicts; no rows give no rows; other columns of docs are not read.
    """
    measured = materialize(measures(docs, id_col, text_col, host_col), "measures")
    lines, frequent = frequent_lines(measured, max_docs)
    gone = lookup(lines, frequent, "key", "rows", "inner").where(F.col("text_hash") != F.col("first"))
    gone = gone.groupBy("row").agg(F.sum("n").alias("removed_words"), F.count(F.lit(1)).alias("removed_lines"), F.collect_set("key").alias("removed_keys"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    removed = F.coalesce("removed_words", F.lit(0)).cast("long")
    df = measured.drop("lines").join(gone, "row", "left")
    df = df.withColumns({"base_failed": failed, "removed_words": removed, "removed_lines": F.coalesce("removed_lines", F.lit(0)).cast("long")})
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= (1 - min_share) * F.col("n_words")))


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **rules) -> DataFrame:
    """docs without the rejected rows and without the lines that the rules remove; n_chars, if there, follows the text.

    Rows are told apart by id, host and text, on which alone the verdicts rest, so repeated rows share theirs; all other
    columns stay as they were. Null texts are rejected; empty tables stay empty.
    """
    verdict = line_frequency_rules(docs, id_col, text_col, host_col, **rules).where("not kept or removed_lines > 0")
    # equal keys have equal verdicts; only rows that go or change are looked up
    changes = materialize(verdict.groupBy("id", "mark", "host").agg(F.first("kept").alias("kept"), F.first("removed_keys").alias("keys")), "changes")
    rows = marked(docs, id_col, text_col).withColumn("host", F.coalesce(F.concat(F.lit("="), F.col(f"row.`{host_col}`").cast("string")), F.lit("")))
    same = rows["id"].eqNullSafe(changes["id"]) & (rows["mark"] == changes["mark"]) & (rows["host"] == changes["host"])
    df = rows.join(changes, same, "left").where("kept is null or kept").select("row", rows["host"].alias("host"), "keys")
    text = F.col(f"row.`{text_col}`")

    def stays(line: Column) -> Column:
        words = F.array_remove(F.split(line, SPACE + "+"), "")
        return ~F.array_contains("keys", F.xxhash64("host", F.xxhash64(F.lower(F.array_join(words, " ")))))

    cut = F.when(F.col("keys").isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), stays), "\n"))
    df = df.withColumn("row", F.col("row").withField(f"`{text_col}`", cut))
    if "n_chars" in docs.columns:
        df = df.withColumn("row", F.col("row").withField("n_chars", F.length(F.col(f"row.`{text_col}`")).cast("long")))
    return df.select("row.*")
