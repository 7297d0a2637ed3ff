"""Decontamination, hard negatives and the prefix trie against plain versions, with nulls, ties, repeats, long and empty texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import chat, decontaminate, hard_negatives, prefix_trie, url_rules, warc_zip

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def prose(n, seed, letters="aeioublcmnrst"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contaminated(docs, items, size=10):
    """(id, n_words, n_hit, n_items, digest) by comparing all windows."""
    wins = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(UPPER))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, who = WORD.findall((text or "").translate(UPPER)), set(), set()
        for m in {len(x) for x in wins}:
            for a in range(len(w) - m + 1):
                if (found := wins.get(tuple(w[a : a + m]))) is not None:
                    hit.update(range(a, a + m))
                    who |= found
        names = sorted(str(x) for x in who if x is not None)
        out.append((i, len(w), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out


@pytest.fixture(scope="module")
def bench():
    passage = prose(30, 1)
    few = prose(60, 2, "ab")
    items = [(1, passage), (2, passage), (2, passage), (3, prose(4, 3)), (4, "the"), (5, None), (6, " ,. "), (7, few), (None, prose(12, 4)), (10, "ÀÉ straße 日本語 x9 " * 4), (11, "same " * 30)]
    docs = [
        (0, prose(50, 9) + " " + passage + " " + prose(50, 10)),
        (1, passage.upper().replace(" ", ", ")),
        (2, " ".join(passage.split()[5:15])),
        (2, " ".join(passage.split()[5:14])),
        (3, None),
        (4, ""),
        (5, "see The end"),
        (6, few + " " + few),
        (7, prose(3_000, 5, "ab")),
        (8, prose(12, 4)),
        (9, "ÀÉ straße 日本語 x9 " * 9),
        (10, "same " * 9 + "x " + "same " * 12),
        (11, prose(40_000, 6) + " " + prose(4, 3) + " " + prose(40_000, 7)),
        (None, passage),
        (0, prose(50, 9) + " " + passage + " " + prose(50, 10)),
    ]
    return docs, items


def test_decontamination(spark, bench, monkeypatch):
    docs, items = bench
    d = spark.createDataFrame([(i, t, 1, "x", 5) for i, t in docs], "doc_id long, text string, item_id int, window string, row int").repartition(3)
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    key = lambda r: tuple(map(str, r))
    want = sorted(contaminated(docs, items), key=key)
    assert sorted(map(tuple, decontaminate.contamination(d, b).collect()), key=key) == want
    assert {r[0] for r in want if r[5]} >= {0, 1, 2, 5, 6, 8, 9, 10, 11, None} and not [r for r in want if r[0] in (3, 4) and r[5]]
    # small blocks and a full filter change nothing; windows and shingles of other sizes do
    monkeypatch.setattr(decontaminate, "BLOCK", 64)
    monkeypatch.setattr(decontaminate, "MOST_BITS", decontaminate.PAGE_BITS)
    assert sorted(map(tuple, decontaminate.contamination(d, b).collect()), key=key) == want
    assert sorted(map(tuple, decontaminate.contamination(d, b, window=3, shingle=5).collect()), key=key) == sorted(contaminated(docs, items, 3), key=key)


def test_decontamination_of_nothing(spark):
    d, b = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    assert decontaminate.contamination(d, b).count() == 0
    some = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, decontaminate.contamination(some, b).collect())) == [(1, 3, 0, 0, sha(""), False), (2, 0, 0, 0, sha(""), False)]


def test_word_hashes_do_not_depend_on_place():
    texts = ["one two one", "", "two", "x" * 50 + " one"]
    w = decontaminate.Words([t.encode() for t in texts])
    assert [w.words(i, i + 1) for i in range(5)] == ["one", "two", "one", "two", "x" * 50]
    h = w.hash.tolist()
    assert h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h)) == 3
    at, tokens = w.shingles(2)
    assert at.tolist() == [0, 1, 4] and len(set(tokens.tolist())) == 3


def negatives(rows, anchors, k=5, low=80, high=100):
    """(anchor, positive, rank, negative, positive score, negative score) by comparing all rows."""
    fine = [(n, i, y, np.array([int(np.floor(256 * float(v))) for v in x], object)) for n, (i, y, x) in enumerate(rows) if None not in (i, y, x) and all(v is not None and np.isfinite(v) for v in x)]
    dot = lambda a, b: int(sum(p * q for p, q in zip(a, b)))
    out = []
    for n, i, y, a in fine:
        if not anchors(i):
            continue
        scored = sorted((-dot(a, x), j, m, z == y) for m, j, z, x in fine if m != n)
        for p, j, _, _ in [s for s in scored if s[3]][:k]:
            ok = [s for s in scored if not s[3] and low * -p <= 100 * -s[0] <= high * -p][:k]
            out += [(i, j, r, s[1], -p, -s[0]) for r, s in enumerate(ok, 1)]
    return sorted(out)


@pytest.mark.parametrize(("part_rows", "sample"), [(64, 50), (10_000, 4096)])
def test_hard_negatives(spark, monkeypatch, part_rows, sample):
    """Close groups, equal vectors, ties, zeros, odd values and repeated ids."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 12))
    rows = [(i, int(r.integers(0, 4)), [float(np.float32(v)) for v in centres[i % 6] + r.normal(size=12) / 4]) for i in range(500)]
    rows += [(1_000 + i, i % 4, rows[0][2]) for i in range(300)]
    nan, inf = float("nan"), float("inf")
    rows += [(None, 1, rows[1][2]), (2_000, None, rows[1][2]), (2_010, 1, None), (2_020, 1, [nan] * 12), (2_030, 2, [inf] + [0.0] * 11), (2_040, 2, [None] + [0.0] * 11)]
    rows += [(2_050, 1, [0.0] * 12), (2_060, 2, []), (2_070, 3, [1.0, 2.0]), rows[0], rows[7], (2_080, 99, rows[3][2])]
    df = spark.createDataFrame([(*x, 0, "x") for x in rows], "vec_id long, label int, embedding array<float>, cell int, row string").repartition(4)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 30)
    monkeypatch.setattr(hard_negatives, "MOST_LABELS", 2 if sample == 50 else 256)
    got = hard_negatives.hard_negatives(df, anchor=F.col("vec_id") % 10 == 0, part_rows=part_rows, sample=sample)
    assert sorted(map(tuple, got.collect())) == negatives(rows, lambda i: i % 10 == 0)
    few = hard_negatives.hard_negatives(df, anchor=F.col("vec_id") % 50 == 0, k=2, low=90, high=99, part_rows=part_rows, sample=sample)
    assert sorted(map(tuple, few.collect())) == negatives(rows, lambda i: i % 50 == 0, 2, 90, 99)


def test_hard_negatives_of_little(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.hard_negatives(none).count() == 0
    one = spark.createDataFrame([(1, 1, [1.0]), (2, 1, [1.0]), (3, 1, [-1.0])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.hard_negatives(one).count() == 0
    big = spark.createDataFrame([(1, 1, [1e30, 1.0]), (2, 1, [2e5, 1.0]), (3, 1, [2e5, 1.0]), (4, 2, [199_999.0, 1.0])], "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, hard_negatives.hard_negatives(big).collect())) == negatives([(2, 1, [2e5, 1.0]), (3, 1, [2e5, 1.0]), (4, 2, [199_999.0, 1.0])], lambda i: True)


def test_large_scores_stay_exact(spark):
    """Scores beyond 2**53 that differ by one are told apart."""
    x = [(i, i % 2, [300_000.0, i / 256]) for i in range(40)]
    df = spark.createDataFrame(x, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, hard_negatives.hard_negatives(df, part_rows=8).collect())) == negatives(x, lambda i: True)


def trie(rows):
    """Node rows by building every prefix of every rebuilt conversation."""
    by = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in by.items()}
    full = {}
    for c in own:
        h, b = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        full[c] = tuple(own.get(b, [])[:h] + own[c][h:])
    nodes = {}
    for c, s in full.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    out = []
    for s, who in nodes.items():
        below = [x for x in nodes if x[: len(s)] == s]
        kids = lambda x: [y for y in nodes if len(y) == len(x) + 1 and y[: len(x)] == x]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in who if len(full[c]) == len(s))))
        out.append((min(who), len(s), min(nodes[s[:-1]]) if s else None, len(who), len(kids(s)), sum(not kids(x) for x in below), saved, sha(ends)))
    return sorted(out)


def talk(seed):
    """Conversations that branch early and late, copies, long shared parts, turns without number, role or text."""
    r = random.Random(seed)
    rows = []
    for c in range(60):
        rows += [(c, t, ("user", "assistant")[t % 2], r.choice("ab") + "é" * r.randint(0, 1)) for t in range(r.randint(1, 12))]
    for c in range(100, 140):
        rows += [(c, t, "user", "same") for t in range(20)]
    rows += [(c, t, "user", f"turn {t}" if t < 33 or c % 2 else "other") for c in (200, 201, 202, 203) for t in range(40)]
    rows += [(300, None, None, None), (300, None, "user", None), (300, 3, None, "x"), (300, 3, None, "x"), (300, 3, None, "w"), (None, 1, "user", "lost"), (-7, 0, "user", "minus"), (-5, 0, "user", "minus"), (404, 0, "user", "alone")]
    return rows


@pytest.mark.parametrize(("stride", "most"), [(8, 4096), (1, 4)])
def test_prefix_trie(spark, monkeypatch, stride, most):
    monkeypatch.setattr(prefix_trie, "MOST_STRIDE", most)
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = talk(5)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, c int, digest string").repartition(4)
    assert sorted(map(tuple, prefix_trie.conversation_trie(df, stride=stride).collect())) == trie(rows)


@pytest.mark.parametrize("rows", [[], [(3, 0, "user", "a")], [(5, 0, "user", "a"), (5, 1, "user", "b")], [(None, 0, "user", "a")], [(1, 0, "u", "a"), (2, 0, "u", "a")]])
def test_small_tries(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, prefix_trie.conversation_trie(df).collect())) == trie(rows)


def test_a_long_conversation_lies_in_many_tasks(spark):
    """Turns of one conversation are numbered over tasks, none of which holds it all."""
    df = spark.range(4_000).select(F.lit(7).alias("conv_id"), (3_999 - F.col("id")).alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = prefix_trie.ordered_turns(df)
        got = turns.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted(r["pos"] for r in got) == list(range(1, 4_001))
    text = {hashlib.sha256(f"4:user{i}".encode()).digest(): i for i in range(4_000)}
    assert all(text[bytes(r["digest"])] == 4_000 - r["pos"] for r in got)


def test_archives_of_odd_urls_and_ids(spark, tmp_path):
    """Braces, quotes, blanks and line feeds in urls; equal payloads of rows without an id, of one id and of several."""
    long, other, third = ("".join(random.Random(i).choices("abc é", k=1_500)) for i in range(3))
    urls = ["http://a.com/{id}", 'http://a.com/{"id": 1}', "http://a.com/x y\nz\r\t", "http://é.com/日本", "", None, "{", "}{"]
    rows = [(i, u, long) for i, u in enumerate(urls)] + [(None, "http://n/", long), (None, "http://n/", other), (None, None, other), (50, "x", third), (50, "y", third), (49, "z", third), (60, "t", None), (61, "t", ""), (62, "t", "short"), (63, "t", "short")]
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, id int").repartition(3)
    got = warc_zip.round_trip(spark, df).collect()
    assert len(got) == len(rows)
    best = {}
    for i, _, body in rows:
        if len((body or "").encode()) >= 1_000 and i is not None:
            best[body] = max(best.get(body, i), i)
    want = []
    for i, _, body in rows:
        refers = best.get(body) if best.get(body) != i else None
        raw = (body or "").encode()
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["id"], r["payload_bytes"], r["digest"], r["type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)


def test_equal_and_empty_urls_are_dealt_over_tasks(spark, monkeypatch):
    """A url that half of the rows repeat and urls without a host fill several ranges each, and rules still reach them."""
    rows = [(i, ("http://hot.com/", "http://hot.com/a/b", None, f"http://h{i % 97}.org/x{i}")[i % 4]) for i in range(4_000)] + [(7, "http://hot.com/")] * 3
    rules = spark.createDataFrame([("hot.com", "/a", "block"), ("com", None, "block"), ("hot.com", "/", "allow"), ("org", "/x1", "block")], "host string, path string, verdict string")
    urls = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    got = url_rules.judge_urls(urls, rules, range_rows=100)
    tasks = {}
    seen = []
    for r in got.withColumn("task", F.spark_partition_id()).collect():
        tasks.setdefault((r["host"], r["path"]) if r["host"] in ("", "hot.com") else "other", set()).add(r["task"])
        seen.append((r["id"], r["host"], r["path"], r["rule"], r["verdict"]))
    assert all(len(t) >= 5 for t in tasks.values())
    want = []
    for i, u in rows:
        host, _, path = (u or "http://").removeprefix("http://").partition("/")
        path = "/" + path if host else ""
        if path.startswith("/a"):
            found = ("hot.com/a", "block")
        elif host == "hot.com":
            found = ("hot.com/", "allow")
        elif path.startswith("/x1"):
            found = ("org/x1", "block")
        else:
            found = (None, "allow")
        want.append((i, host, path, *found))
    key = lambda r: tuple(map(str, r))
    assert sorted(seen, key=key) == sorted(want, key=key)


def test_words_that_look_like_another_roles_mark_stay(spark):
    turns = [(c, t, ("user", "assistant")[t % 2], (prose(6, 10 * c + t) + "?" if t % 2 == 0 else prose(90, 10 * c + t))) for c in range(200) for t in range(4)]
    model = chat.fit(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert chat.unmarked("user", "User: hello") == "hello" and chat.unmarked("user", "Answer: 5") == "Answer: 5"
    assert chat.render("assistant", "Question: why") == "<|assistant|>\nQuestion: why\n<|end|>\n"
    # marks are fitted with the prior: a table whose users often begin with "Answer:" makes that mark say less
    odd = [(c, t, r, "Answer: " + x if t % 2 == 0 and c < 190 else x) for c, t, r, x in turns]
    fitted = chat.fit(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))
    user, assistant = chat.ROLES.index("user"), chat.ROLES.index("assistant")
    mark = 1 + assistant
    assert model.seen[0][assistant, mark] - model.seen[0][user, mark] > 2 > 0 > fitted.seen[0][assistant, mark] - fitted.seen[0][user, mark]
