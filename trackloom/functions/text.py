"""Timestamps as text: canonical parsing, cleaning of misread characters, token stitching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats that are fixed by the data: the overlay's time stamp, an ISO time stamp with a zone.
OVERLAY = r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$"
ISO_ZONE = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)$"


def parse_overlay(x: Column) -> Column:
    """MM/DD/YYYY HH:MM:SS as TIMESTAMP_NTZ; null if the shape or the calendar is wrong."""
    at = F.try_to_timestamp(x, F.lit("MM/dd/yyyy HH:mm:ss")).cast("timestamp_ntz")
    return F.when(x.rlike(OVERLAY), at)


def clean(x: Column) -> Column:
    """Letters that stand for digits are put right, blanks collapsed."""
    return F.trim(F.regexp_replace(F.translate(x, "Ol", "01"), r"\s+", " "))


def canonical_date(x: Column) -> Column:
    """M/D/YY or M/D/YYYY as MM/DD/YYYY; null outside the calendar's ranges."""
    m, d, y = (F.regexp_extract(x, r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", i) for i in (1, 2, 3))
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    fits = m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31) & year.try_cast("int").between(1900, 2100)
    return F.when(fits, F.concat_ws("/", F.lpad(m, 2, "0"), F.lpad(d, 2, "0"), year))


def canonical_time(x: Column) -> Column:
    """H:MM:SS or H:MM with an optional AM or PM as 24-hour HH:MM:SS; null outside the ranges."""
    p = r"^(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp][Mm])?$"
    h, m, s = (F.regexp_extract(x, p, i).try_cast("int") for i in (1, 2, 3))
    s = F.when(F.regexp_extract(x, p, 2) != "", F.coalesce(s, F.lit(0)))
    half = F.upper(F.regexp_extract(x, p, 4))
    hour = F.when(half == "", h).when(h.between(1, 12), F.pmod(h, F.lit(12)) + F.when(half == "PM", 12).otherwise(0))
    return F.when(hour.between(0, 23) & m.between(0, 59) & s.between(0, 59), F.format_string("%02d:%02d:%02d", hour, m, s))


def stitch(tokens: Column) -> Column:
    """The first of: tokens joined by blanks, joined tightly, each pair of neighbours, that holds a date and a time."""
    n = F.size(tokens)
    pairs = F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n - 1), lambda i: F.concat_ws(" ", F.get(tokens, i), F.get(tokens, i + 1)))
    tries = F.concat(F.array(F.array_join(tokens, " "), F.array_join(tokens, "")), pairs)
    found = F.transform(tries, lambda t: F.regexp_extract(t, r"(\d{1,2}/\d{1,2}/\d{2,4})\s*(\d{1,2}:\d{2}:\d{2}(?:\s*[AaPp][Mm])?)", 0))
    return F.get(F.filter(found, lambda t: t != ""), F.lit(0))


def read_tokens(tokens: Column) -> Column:
    """MM/DD/YYYY HH:MM:SS from tokens, or only the date or the time that is found, else UNREADABLE.

    Date and time are looked for in turn in: all tokens with blanks, all without, each one, each two neighbours without a
    blank. They need not lie in the same place; the first valid one of each counts.
    """
    n = F.size(tokens)
    pairs = F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n - 1), lambda i: F.concat(F.get(tokens, i), F.get(tokens, i + 1)))
    tries = F.concat(F.array(F.array_join(tokens, " "), F.array_join(tokens, "")), tokens, pairs)

    def first(pattern: str, canonical) -> Column:
        return F.get(F.filter(F.transform(tries, lambda t: canonical(F.regexp_extract(t, pattern, 0))), lambda x: x.isNotNull()), F.lit(0))

    date = first(r"\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})", canonical_date)
    time = first(r"(?<!\d)\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp][Mm])?", canonical_time)
    return F.coalesce(F.nullif(F.concat_ws(" ", date, time), F.lit("")), F.lit("UNREADABLE"))


def frame_index(t: Column, start: Column, seconds_per_frame: float) -> Column:
    """Frame number of a time, half to even; both in microseconds."""
    return F.bround((t - start) / (seconds_per_frame * 1e6)).cast("long")


def composed(parsed: Column, confidence: Column, status: Column, other: Column, other_confidence: Column, least: float) -> Column:
    """struct(parsed, confidence, method, status) of two readers: the first if it is sure enough, else the second if it read
    anything, else the first's doubtful read, which is called low_confidence.
    """
    parts = lambda p, c, m, s: F.struct(p.alias("parsed"), c.alias("confidence"), F.lit(m).alias("method"), s.alias("status"))
    sure = parsed.isNotNull() & (confidence >= least)
    doubt = F.when(parsed.isNull(), status).otherwise(F.lit("low_confidence"))
    ok = F.lit("ok")
    return F.when(sure, parts(parsed, confidence, "first", ok)).when(other.isNotNull(), parts(other, other_confidence, "second", ok)).otherwise(parts(parsed, confidence, "first", doubt))
