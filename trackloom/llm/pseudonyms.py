"""Format-preserving pseudonyms for numbers and dates by a keyed Feistel network, with DataFrame functions only.

Each validated value is a number in a domain of its format: the digits of a card but the issuer's two and the check digit, area, exchange and
line of a telephone number, the four bytes of an IPv4 address, the valid social security numbers, the days of a date range,
the letters of an e-mail's local part to base 26 and its digits to base 10. The number is permuted inside its domain, so
equal values stay equal, different ones stay different, and the format stays valid. Long strings are cut into limbs; each is
permuted under a tweak that names its place and the limbs before it, so the whole stays a permutation at any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Kinds in the order of their counts.
KINDS = ("email", "card", "phone", "ssn", "ip", "date")
_EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,20}[A-Za-z]{2,63}"
_IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
#: A group of digits that begins no e-mail or IP address, in a run of groups over single spaces and hyphens.
_GROUP = rf"(?!{_IP})(?!{_EMAIL})[0-9]++(?![A-Za-z])"
#: Patterns tried in this order at each place; groups are not used, so that pieces and matches alternate. A run is taken whole,
#: with the hyphens around it; cards, social security numbers and dates are looked for inside.
#: The parts of an address have the lengths that mail allows, so a long run of letters costs no more than its length.
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9]){_EMAIL}",
    "phone": r"(?<![0-9A-Za-z])\+1[ -]?\(?[2-9][0-9]{2}\)?[ -]?[2-9][0-9]{2}-[0-9]{4}(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9A-Za-z.]){_IP}",
    "run": rf"(?:-|(?<![0-9A-Za-z]))(?=[0-9](?:[ -]?[0-9]){{7}}){_GROUP}(?:[ -]{_GROUP})*+-?+",
}
EVERY = "|".join(PATTERNS.values())
#: Inside a run, from the start of a group: dates and social security numbers, and cards of issuers' first digits, with one
#: separator and usual groups or none; longer cards first.
DATE, SSN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARDS = tuple(
    "^(?=[3-6]|2[2-7])" + groups + "(?![0-9])"
    for groups in (r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}\1[0-9]{1,3}", r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}", r"[0-9]{4}([ -])[0-9]{6}\1[0-9]{4,5}", r"[0-9]{13,19}")
)
#: Dates run over 250 * 292 days from here.
FIRST_DAY, DAYS = "1900-01-01", (250, 292)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def div(x: Column, y: Column | int) -> Column:
    """The whole part of a quotient of longs, without the rounding of doubles."""
    return F.call_function("div", x, F.lit(y).cast("long") if isinstance(y, int) else y)


def feistel(x: Column, low: Column, high: Column, key: str, tweak: str | Column) -> Column:
    """x in [0, low * high) permuted by alternating rounds that add a keyed hash of one half to the other."""
    about = F.concat_ws(":", F.lit(key), F.lit(tweak) if isinstance(tweak, str) else tweak, low.cast("string"), high.cast("string"))
    start = _let(x, lambda v: F.struct((v % low).cast("long").alias("a"), div(v, low).alias("b")))

    def hashed(half: Column, i: Column, modulus: Column) -> Column:
        # 52 bits of a keyed digest
        text = F.concat_ws(":", about, i.cast("string"), half.cast("string"))
        return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long"), modulus)

    def step(s: Column, i: Column) -> Column:
        a = F.when(i % 2 == 0, F.pmod(s["a"] + hashed(s["b"], i, low), low)).otherwise(s["a"])
        b = F.when(i % 2 == 1, F.pmod(s["b"] + hashed(s["a"], i, high), high)).otherwise(s["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["b"] * low + s["a"])


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


#: Letters and digits of a limb at most.
LETTERS, DIGITS = 12, 18


def _powers(base: int, n: Column) -> tuple[Column, Column]:
    """Powers of base for the halves of n digits."""
    of = F.array(*[F.lit(base**i).cast("long") for i in range(DIGITS // 2 + 1)])
    low = F.floor(n / 2).cast("int")
    return F.element_at(of, low + 1), F.element_at(of, n.cast("int") - low + 1)


def _permute(x: Column, base: int, most: int, key: str, tweak: str) -> Column:
    """A string of the first `base` of 0-9 or a-z as another of that length, limb by limb."""
    first = ord("0" if base == 10 else "a")

    def number(limb: Column) -> Column:
        return F.aggregate(F.filter(F.split(limb, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a * base + F.ascii(c) - first)

    def text(v: Column, n: Column) -> Column:
        places = F.filter(F.sequence(F.lit(most - 1), F.lit(0)), lambda i: i < n)
        of = F.array(*[F.lit(base**i).cast("long") for i in range(most)])
        return F.array_join(F.transform(places, lambda i: F.char((div(v, F.element_at(of, i + 1)) % base + first).cast("int"))), "")

    def limb(i: Column) -> Column:
        part, n = F.substring(x, i * most + 1, F.lit(most)), F.least(F.lit(most), F.length(x) - i * most)
        low, high = _powers(base, n)
        about = F.struct(low.alias("low"), high.alias("high"), F.concat_ws(":", F.lit(tweak), F.length(x).cast("string"), F.substring(x, F.lit(1), i * most)).alias("before"))
        # bound once: lambdas evaluate what they name at each use
        return _let(about, lambda o: _let(feistel(number(part), o["low"], o["high"], key, o["before"]), lambda v: text(v, n)))

    limbs = F.sequence(F.lit(0), F.floor((F.length(x) - 1) / most).cast("int"))
    return F.when(F.length(x) == 0, F.lit("")).otherwise(F.array_join(F.transform(limbs, limb), ""))


def permute_digits(d: Column, key: str, tweak: str) -> Column:
    """A string of digits as another of that length."""
    return _permute(d, 10, DIGITS, key, tweak)


def permute_letters(x: Column, key: str, tweak: str) -> Column:
    """A string of a-z as another of that length."""
    return _permute(x, 26, LETTERS, key, tweak)


def refill(shape: Column, new: Column) -> Column:
    """shape with its digits replaced, in order, by the characters of new."""
    def put(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(acc["out"], F.when(is_digit, F.substring(new, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["at"] + F.when(is_digit, 1).otherwise(0)).alias("at"),
        )

    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), put, lambda a: a["out"])


def luhn_sum(d: Column) -> Column:
    """Luhn sum of a string of digits whose last one is the check digit."""
    def add(acc: Column, c: Column) -> Column:
        v = c.cast("int") * F.when(acc["odd"], 2).otherwise(1)
        return F.struct((acc["sum"] + F.when(v > 9, v - 9).otherwise(v)).alias("sum"), (~acc["odd"]).alias("odd"))

    return F.aggregate(F.filter(F.split(F.reverse(d), ""), lambda c: c != ""), F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), add, lambda a: a["sum"])


def _card(x: Column, key: str) -> Column:
    """The first two digits stay, so the issuer does; the check digit fits again."""
    d = digits(x)
    body = F.concat(F.substring(d, 1, 2), permute_digits(F.substring(d, F.lit(3), F.length(d) - 3), key, "card"))
    new = _let(body, lambda body: F.concat(body, F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")))
    return F.when(luhn_sum(d) % 10 == 0, _let(new, lambda new: refill(x, new)))


def _phone(x: Column, key: str) -> Column:
    """The country code stays; area and exchange stay in 200 to 999."""
    d = digits(x)
    area, rest, line = F.substring(d, 2, 3).cast("long") - 200, F.substring(d, 5, 3).cast("long") - 200, F.substring(d, 8, 4).cast("long")
    v = feistel((area * 800 + rest) * 10_000 + line, F.lit(80_000).cast("long"), F.lit(80_000).cast("long"), key, "phone")
    new = _let(v, lambda v: F.concat(F.lit("1"), (div(v, 8_000_000) + 200).cast("string"), (div(v, 10_000) % 800 + 200).cast("string"), F.lpad((v % 10_000).cast("string"), 4, "0")))
    return _let(new, lambda new: refill(x, new))


def _ip(x: Column, key: str) -> Column:
    parts = F.transform(F.split(x, r"\."), lambda p: p.cast("long"))
    v = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    n = feistel(v, F.lit(65_536).cast("long"), F.lit(65_536).cast("long"), key, "ip")
    new = _let(n, lambda n: F.array_join(F.transform(F.array(*[F.lit(1 << i).cast("long") for i in (24, 16, 8, 0)]), lambda s: (div(n, s) % 256).cast("string")), "."))
    return F.when(F.forall(parts, lambda p: p <= 255), new)


def _ssn(x: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999; others are no numbers and stay."""
    d = digits(x)
    area, group, serial = (F.substring(d, at, n).cast("long") for at, n in ((1, 3), (4, 2), (6, 4)))
    nth = area - F.when(area > 666, 2).otherwise(1)
    v = feistel((nth * 99 + group - 1) * 9_999 + serial - 1, F.lit(3 * 9_999).cast("long"), F.lit(33 * 898).cast("long"), key, "ssn")
    def number(v: Column) -> Column:
        nth = div(v, 99 * 9_999)
        return F.concat(F.lpad((nth + F.when(nth >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((div(v, 9_999) % 99 + 1).cast("string"), 2, "0"), F.lpad((v % 9_999 + 1).cast("string"), 4, "0"))

    new = _let(_let(v, number), lambda new: refill(x, new))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), new)


def _date(x: Column, key: str) -> Column:
    day = F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date")
    at = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    new = feistel(at, F.lit(DAYS[0]).cast("long"), F.lit(DAYS[1]).cast("long"), key, "date")
    return F.when((at >= 0) & (at < DAYS[0] * DAYS[1]), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), "yyyy-MM-dd"))


def _email(x: Column, key: str) -> Column:
    """Letters and digits of the local part are permuted, each among their kind and in their case; marks and the domain stay."""
    local, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    letters = permute_letters(F.lower(F.regexp_replace(local, "[^A-Za-z]", "")), key, "email")
    shape = _let(permute_digits(digits(local), key, "email"), lambda new: refill(local, new))

    def put(acc: Column, c: Column) -> Column:
        new = F.substring(acc["left"], 1, 1)
        return F.when(c.rlike("[A-Za-z]"), F.struct(F.concat(acc["out"], F.when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)).alias("out"), F.substring(acc["left"], F.lit(2), F.length(acc["left"])).alias("left"))).otherwise(
            F.struct(F.concat(acc["out"], c).alias("out"), acc["left"].alias("left"))
        )

    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    out = F.aggregate(chars, F.struct(F.lit("").alias("out"), letters.alias("left")), put, lambda a: a["out"])
    return F.concat(out, F.lit("@"), domain)


REPLACE = {"email": _email, "phone": _phone, "ip": _ip}


def _found(i: Column, old: Column, kind: str, new: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), F.size(F.split(old, "[ -]")).alias("m"), F.lit(kind).alias("kind"), new.alias("new"))


def _valid(cards: Column) -> Column:
    return F.filter(cards, lambda c: (c != "") & (luhn_sum(digits(c)) % 10 == 0))


def _run(x: Column, key: str) -> Column:
    """text and kinds of a run with the values inside replaced: from left to right, a group that begins none is passed over."""
    lead = F.when(x.startswith("-"), F.lit("-")).otherwise(F.lit(""))

    def choose(raw: Column) -> Column:
        def rest(i: Column) -> Column:
            return F.array_join(F.slice(raw, i + 1, F.lit(19)), "")

        def usual(_: Column, i: Column) -> Column:
            def at(w: Column) -> Column:
                free = F.when(i == 0, lead).otherwise(F.substring(F.get(raw, i - 1), -1, 1)) != "-"
                date, ssn = F.regexp_extract(w, DATE, 0), F.regexp_extract(w, SSN, 0)
                new = F.when(free & (date != ""), _date(date, key))
                card = F.get(_valid(F.array(*[F.regexp_extract(w, p, 0) for p in CARDS])), F.lit(0))
                number = F.when(free & (ssn != ""), _ssn(ssn, key))
                out = F.when(new.isNotNull(), _found(i, date, "date", new)).when(number.isNotNull(), _found(i, ssn, "ssn", number))
                return out.otherwise(_let(card, lambda c: F.when(c.isNotNull(), _found(i, c, "card", _card(c, key)))))

            return _let(rest(i), at)

        def take(a: Column, c: Column) -> Column:
            before = F.array_join(F.slice(raw, a["next"] + 1, c["i"] - a["next"]), "")
            after = F.regexp_extract(F.get(raw, c["i"] + c["m"] - 1), "[ -]?$", 0)
            taken = F.struct((c["i"] + c["m"]).alias("next"), F.concat(a["text"], before, c["new"], after).alias("text"), F.concat(a["done"], F.array(c["kind"])).alias("done"))
            return F.when(c["i"] >= a["next"], taken).otherwise(a)

        start = F.struct(F.lit(0).alias("next"), lead.alias("text"), F.array().cast("array<string>").alias("done"))
        left = lambda a: F.array_join(F.slice(raw, a["next"] + 1, F.size(raw)), "")
        every = F.filter(F.transform(raw, usual), lambda c: c.isNotNull())
        return F.aggregate(every, start, take, lambda a: F.struct(F.concat(a["text"], left(a)).alias("text"), a["done"].alias("done")))

    return _let(F.regexp_extract_all(x, F.lit("[0-9]+[ -]?"), F.lit(0)), choose)


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text with pseudonyms, n_<kind> of each kind and n_replaced, one row per row of docs.

    A match that fails its check (issuer, groups and Luhn sum, byte range, area and group, calendar, date range) stays as it
    is and is not counted; inside runs of digits the other kinds and lengths, and the next groups, are tried then. Equal values under one
    key get equal pseudonyms in all documents; values of one format and length never collide. Null text stays null with zero counts; long texts are read whole; repeated rows get equal results; no
    rows give no rows; other columns of docs are not read.
    """
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    df = df.withColumn("found", F.regexp_extract_all("text", F.lit(EVERY), F.lit(0)))

    def judged(x: Column) -> Column:
        out = _run(x, key)
        for name, replace in REPLACE.items():
            kinds = lambda new, name=name: F.when(new.isNotNull(), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
            one = _let(replace(x, key), lambda new: F.struct(F.coalesce(new, x).alias("text"), kinds(new).alias("done")))
            out = F.when(x.rlike(f"^(?:{PATTERNS[name]})$"), one).otherwise(out)
        return out

    df = df.withColumn("found", F.transform("found", judged))
    pieces = F.split("text", EVERY, -1)
    rebuilt = F.concat(F.array_join(F.zip_with(F.slice(pieces, 1, F.size("found")), "found", lambda p, f: F.concat(p, f["text"])), ""), F.element_at(pieces, -1))
    text = F.when(F.size("found") > 0, rebuilt).otherwise(F.col("text"))
    done = F.flatten(F.transform("found", lambda f: f["done"]))
    df = df.select("id", text.alias("text"), F.coalesce(done, F.array().cast("array<string>")).alias("done"))

    def count(name: str) -> Column:
        return F.size(F.filter("done", lambda kind: kind == name)).cast("long").alias(f"n_{name}")

    counts = [count(n) for n in KINDS]
    return df.select("id", "text", *counts, F.size("done").cast("long").alias("n_replaced"))
