"""Each operator against a plain version, and with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import io
import itertools
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import chat, common, exact_dedup, jaccard_join, line_rules, mixing, packing, pseudonyms, secrets, url_rules, warc_zip
from trackloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, digest string, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioublcmnrst") for _ in range(r.randint(2, 7))) for _ in range(n))


def texts():
    base = prose(120, 1)
    near = base.replace(base.split()[50], "changed")
    common = "this line is on every page of the host and means nothing"
    out = [base, base.replace(" ", "\n"), near, near, None, "", " \n ", "one two", prose(9_000, 2), base + " ", "αβγ δε <|endoftext|>  x\n\ny"]
    out += [prose(60, 100 + i) + "\n" + common for i in range(30)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 0 else f"src{i % 2}", len(t or ""), 1, "x", "y") for i, t in enumerate(texts())]
    rows += [rows[0], (None, "null id here", "en", "src1", 12, 1, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, none):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (
        exact_dedup.exact_dedup(none), line_rules.line_frequency_rules(none), jaccard_join.jaccard_components(none), mixing.taken_words(*mixing.mix(none)),
        packing.pack(none, tokenizer_path()), secrets.find_secrets(none), pseudonyms.pseudonymize(none, "k"), url_rules.judge_urls(pages, rules),
        warc_zip.round_trip(spark, pages), chat.recover_roles(turns, chat.fit(turns)), exact_dedup.drop_copies(none), jaccard_join.drop_near_copies(none), line_rules.clean_documents(none), mixing.mixed_documents(none),
    ):
        assert df.count() == 0


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda n: F.substring(F.sha2(n, 256), 1, 1)])
def test_exact_dedup(docs, digest):
    """A digest of one character collides everywhere: byte verification must still tell the texts apart."""
    groups = {}
    for r in docs.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), []).append((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
    got = exact_dedup.exact_dedup(docs, digest=digest).collect()
    assert len(got) == docs.count()
    assert sorted((r["keep_id"], r["group_size"]) for r in got if r["kept"] and r["keep_id"] is not None) == sorted((min(g)[2], len(g)) for g in groups.values() if not min(g)[1])
    assert exact_dedup.drop_copies(docs).count() == len(groups)


def test_line_rules(docs):
    got = {r["id"]: r for r in line_rules.line_frequency_rules(docs, max_docs=10).collect()}
    for i, t in enumerate(texts()):
        w = WORD.findall(t or "")
        at = {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        repeat = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeat)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))
    removed = [i for i, r in got.items() if r["removed_lines"]]
    hosts = {i: None if i % 7 == 0 else i % 2 for i in range(11, 41)}
    frequent = [h for h in set(hosts.values()) if list(hosts.values()).count(h) > 10]
    first = {h: min(i for i in hosts if hosts[i] == h) for h in frequent}
    assert sorted(removed) == sorted(i for i in hosts if hosts[i] in frequent and i not in first.values())
    kept = line_rules.clean_documents(docs, max_docs=10)
    assert kept.columns == docs.columns
    assert all(("means nothing" in r["text"]) == (r["doc_id"] in first.values() or hosts[r["doc_id"]] not in frequent) for r in kept.collect() if r["doc_id"] in hosts)


def test_depleted_document_is_rejected(spark):
    shared = "\n".join(prose(20, s) for s in range(4))
    rows = [(i, shared + "\n" + prose(10, 50 + i), "h") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["id"]: r["kept"] for r in line_rules.line_frequency_rules(df, max_docs=5).collect()}
    assert got == {i: i == 0 for i in range(12)}


def components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def near_groups():
    """Texts with near copies at many sizes, passages that many share, and odd ones."""
    r = random.Random(5)
    rows = []
    for g in range(12):
        words = prose(r.choice([3, 8, 30, 100, 300]), g).split()
        for _ in range(7):
            w = list(words)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"x{r.random()}"
            rows.append(" ".join(w).upper() if r.random() < 0.3 else " ".join(w))
    passage = prose(60, 77)
    for i in range(40):
        rows.append(f"{prose(r.choice([8, 15, 40]), 900 + i)} {passage} {prose(10, 950 + i)}")
    chain = prose(80, 78).split()
    for i in range(12):
        rows.append(" ".join(chain[2 * i : 2 * i + 50]))
    return rows + [None, "", " ", "a", "A"]


def shingle_sets(rows):
    sets = {}
    for i, t in enumerate(rows):
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return sets


@pytest.mark.parametrize("rounds, cell, hot", [(1, 20_000, 10_000), (0, 3, 2), (2, 5, 10_000)])
def test_jaccard_components(spark, monkeypatch, rounds, cell, hot):
    """Also with cells and hot blocks so small that the large ones of a cluster are met."""
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    monkeypatch.setattr(jaccard_join, "HOT_BLOCK", hot)
    rows = near_groups()
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(rows)] + [(0, rows[0], "c", 1), (None, "null id", "c", 1)], "doc_id long, text string, cls string, mark int").repartition(4)
    sets = shingle_sets(rows)
    want = components(sets)
    got = jaccard_join.jaccard_components(df).collect()
    assert len(got) == len(rows) + 2
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got if r["id"] is not None} == {i: (len(sets[i]), want[i]) for i in sets}
    kept = jaccard_join.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values()))


def test_near_copies_with_repeated_ids(spark):
    p, q = prose(100, 1), prose(100, 2)
    near = p.replace(p.split()[50], "changed")
    rows = [(3, p, 1), (5, near, 2), (5, q, 3), (7, q, 4), (3, p, 5), (9, None, 6), (9, None, 7), (None, prose(50, 3), 8), (None, prose(50, 3), 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int")
    got = jaccard_join.drop_near_copies(df)
    assert got.columns == df.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(3, p), (5, q), (9, None), (9, None), (None, prose(50, 3))], key=str)


def test_sketch_bounds_difference():
    r = np.random.default_rng(2)
    for n in (3, 40, 700):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[n // 10 :], r.integers(0, 2**63, n // 8).astype(np.uint64))))
        both = jaccard_join.Sets(np.concatenate((a, b)), np.array([len(a), len(b)]))
        x, y = (np.frombuffer(s, np.uint8) for s in jaccard_join.sketches(both, 1024))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
        assert np.packbits(np.bincount(((jaccard_join.mix(a ^ jaccard_join._M1) >> np.uint64(32)) & np.uint64(1023)).astype(int), minlength=1024) & 1).tobytes() == x.tobytes()


def test_similar_sets_share_a_block():
    """The pigeonhole principle, at the largest difference that is allowed and with shingles that count as common."""
    r = np.random.default_rng(3)
    heavy = np.where(r.random(1 << 20) < 0.3, 50, 0)
    for _ in range(300):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        grow = int(r.integers(0, n // 3 + 1))
        b = np.unique(np.concatenate((a, r.integers(0, 2**64, grow, dtype=np.uint64))))
        while True:
            c = np.delete(b, r.integers(0, len(b))) if len(b) > 1 else b
            if c is b or 4 * len(np.intersect1d(a, c)) < 3 * len(np.union1d(a, c)):
                break
            b = c
        sets = jaccard_join.Sets(np.concatenate((a, b)), np.array([len(a), len(b)]))
        sent = [set(), set()]
        for band, of in jaccard_join.bands(sets.sizes, 75, 100):
            keys, at, _ = jaccard_join.block_keys(sets.pick(of), band, heavy)
            for k, i in zip(keys.tolist(), np.flatnonzero(of)[at].tolist()):
                sent[i].add(k)
        assert 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b)) and sent[0] & sent[1]


def test_shingles_of_many_texts_at_once():
    rows = [t.encode() if t is not None else None for t in near_groups()]
    sets = jaccard_join.shingles(rows)
    for i, t in enumerate(rows):
        assert sets.one(i).tolist() == jaccard_join.shingles([t]).flat.tolist()
    assert sets.sizes.tolist() == [len(s) for s in shingle_sets([t and t.decode() for t in rows]).values()]
    assert len(jaccard_join.shingles([])) == 0 and jaccard_join.shingles([None, b""]).sizes.tolist() == [0, 0]


def check_pieces(rows, want):
    by = {}
    for r in rows:
        by.setdefault(r["doc_row"], []).append(r)
    assert len(by) == len(want)
    for parts in by.values():
        parts.sort(key=lambda r: r["start"])
        ids = want[parts[0]["doc_id"]]
        at = 0
        for p in parts:
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert zlib.crc32(ids[at : at + p["length"]].tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    return len(sequences)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(tokenizer_path())
    df = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = {r["doc_id"]: np.array(bpe.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4") for r in df.collect()}
    check_pieces(packing.pack(df, tokenizer_path()).collect(), want)
    many = df.where("doc_id > 10").repartition(130)
    assert check_pieces(packing.pack(many, tokenizer_path(), n_open=2).collect(), {k: v for k, v in want.items() if k > 10}) <= 8
    assert packing.pack(docs, tokenizer_path()).select("doc_row").distinct().count() == docs.count()


def test_chunks_are_cut_where_the_tokenizer_cuts():
    words = packing.tokenizer(tokenizer_path())
    r = random.Random(9)
    for _ in range(400):
        t = "".join(r.choice(["a", "Bé", " ", "  ", "\n", "\n\n", "\t", "1", ".", "'s", " ", "\x1c", "　", "ﬁ", "²", "🙂", "don't "]) for _ in range(r.randint(0, 25)))
        assert words.ids(t).tolist() == np.frombuffer(words.whole(t), "<u4").tolist(), repr(t)


def test_texts_that_share_chunks_get_the_tokens_of_each_alone(monkeypatch):
    """Neighbours in a batch, empty texts, special tokens, a slice, few kept chunks, and far fewer calls than chunks."""
    import pyarrow as pa

    words = packing.Words(tokenizer_path())
    monkeypatch.setattr(packing, "CACHE", 20)
    monkeypatch.setattr(packing, "AT_ONCE", 7)
    r = random.Random(4)
    some = ["a", "Bé", "ﬁ", " ", "  ", "\n", "\n ", "\t", "12", ".", "×,", "ö;!", "don't", "'s", "\u00a0", "\u3000", "\u2003", "“q”", "日本", "🙂", "\x1c", "<|endoftext|>", "\0", " the,", " word" * 9]
    for nth in range(150):
        texts = ["".join(r.choice(some) for _ in range(r.choice([0, 0, 1, 3, 20]))) for _ in range(30)]
        got = words.many(pa.array(["x", *texts, "y"]).slice(1, 30))
        for t, ids in zip(texts, got):
            assert ids.dtype == np.dtype("<u4") and ids.tolist() == words.bpe.encode(t, add_special_tokens=False).ids, repr(t)
        assert len(words.chunks) == len(words.lists) == len(set(words.chunks.to_pylist())) <= 20
    plain = " ".join(f"word{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}, néw{chr(97 + i % 26)}" for i in range(5_000))
    calls = []
    monkeypatch.setattr(packing, "AT_ONCE", 10_000)
    monkeypatch.setattr(words, "whole", lambda text: calls.append(text) or packing.Words.whole(words, text))
    assert words.ids(plain).tolist() == words.bpe.encode(plain, add_special_tokens=False).ids and not calls
    assert [len(x) for x in packing.stretches(pa.array(["a" * packing.STRETCH, "b", "", "c" * packing.STRETCH]))] == [1, 2, 1]


def test_a_worker_gives_memory_back_and_settings_end(spark, tmp_path):
    """A reused Python worker holds no freed memory after a task; Spark's batches are small only while pieces are written."""
    import pyarrow as pa

    def run(batches):
        for _ in batches:
            kept = [pa.array([f"{i:060d}" for i in range(400_000)]) for _ in range(3)]
            kept = [bytes(300) for _ in range(400_000)]
            last = bytes(600)
            del kept
            yield last

    def resident():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("Anonymous")) // 1024

    list(run(iter([1])))
    held = resident()
    list(common.freed(run)(iter([1])))
    assert held - resident() > 15
    key = next(iter(packing.BATCH))
    unset = spark.conf.get(key)
    seen = common.materialize(spark.range(5).mapInArrow(common.freed(lambda b: b), "id long"), "settings", packing.BATCH)
    assert seen.count() == 5 and spark.conf.get(key) == unset


def test_mixing(docs):
    rows, plan, pieces = mixing.mix(docs, block_words=64)
    got = mixing.taken_words(rows, plan, pieces).collect()
    assert len(got) == docs.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    per = {r["source"]: r for r in plan.collect()}
    assert sum(r["target"] for r in per.values()) == pytest.approx(1.5 * total)
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    free = [s for s in order if per[s]["target"] < 2 * per[s]["source_size"] - 1e-6]
    assert len({round(per[s]["target"] / weight[s], 6) for s in free}) <= 1
    for s in order:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - per[s]["target"]) <= 1
    again = mixing.taken_words(*mixing.mix(docs.repartition(5), block_words=64))
    assert sorted((r["id"] or -1, r["taken"]) for r in again.collect())[3:] == sorted((r["id"] or -1, r["taken"]) for r in got)[3:]
    mixed = mixing.mixed_documents(docs.dropDuplicates(["doc_id"]), block_words=64)
    assert mixed.columns == docs.columns and mixed.count() > 0


def test_schedule_gives_small_sources_their_slots(spark):
    """Sources of 1 to 3 blocks between large ones, at many places of the unit interval."""
    need = {f"={i:03d}": 1 + i % 3 if i % 4 else 5_000 for i in range(80)}
    assert sum(need.values()) > 100_000
    plan = spark.createDataFrame([(k, 64 * n, 64.0 * n, n) for k, n in need.items()], "key string, source_size long, target double, need long")
    got = mixing.schedule(spark, plan, 64).collect()
    assert len({r["slot"] for r in got}) == len(got)
    blocks = {}
    for r in got:
        blocks.setdefault(r["key"], []).append(r["block"])
    assert {k: sorted(v) for k, v in blocks.items()} == {k: list(range(n)) for k, n in need.items()}


def spans(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark):
    r = random.Random(4)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    keys = ["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(60)]
    rows = [f"é token = \"{h}\" and {k} password=ab token:abcdef12 {prose(10, i)}" for i, (h, k) in enumerate(zip(hexes, keys))]
    rows += [f"{prose(8, 500 + i)} item-number-{i}-of-the-list-2024" for i in range(60)]
    rows += [None, "", "PASSWORD: token=secret1", "x" * 30_000 + hexes[0][:23] + " " + hexes[1], "ASIA" + keys[0][4:]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, row long")
    got = {r["id"]: r for r in secrets.find_secrets(df).collect()}
    for i, t in enumerate(rows):
        want = spans(t or "")
        listed = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [got[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == j for _, k, _ in want) for j in range(3)]
    assert not any(got[i]["n_grammar"] for i in range(60, 120))


def test_grammar_on_held_out_values():
    r = random.Random(8)
    make = lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    plain = lambda: "-".join(prose(1, r.random()) for _ in range(5)) + str(r.randint(1, 99))
    scorer = secrets.Scorer([("access", make()) for _ in range(200)] + [("", plain()) for _ in range(200)])
    assert np.mean([scorer.is_secret(make()) for _ in range(200)]) > 0.95
    assert np.mean([scorer.is_secret(plain()) for _ in range(200)]) < 0.05


def test_credential_behind_an_ordinary_head():
    r = random.Random(8)
    make = lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    plain = lambda n: "/".join(prose(1, r.random()) for _ in range(n)) + str(r.randint(1, 99))
    scorer = secrets.Scorer([("access", make()) for _ in range(200)] + [("", plain(5)) for _ in range(200)])
    for n in (10, 30, 3_000):
        head, key = plain(n), "ASIA" + make()[4:]
        assert scorer.secrets(head + "/") == []
        (start, end), *more = scorer.secrets(head + "/" + key + "/" + plain(5))
        assert not more and abs(start - len(head) - 1) <= 6 and abs(end - len(head) - 21) <= 6
    assert scorer.is_secret(make()) and not scorer.is_secret(make() + plain(40))


def test_every_run_is_scored(spark):
    """Short runs, runs without digits and runs that extend past a base span."""
    r = random.Random(3)
    make = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))
    rows = [f"{prose(30, i)} item-{i}-of-2024 token={make(12)}" for i in range(80)]
    hexes = "0123456789abcdef01234567"
    rows += [f"{prose(5, 900)} {make(12)} {prose(5, 901)}", f"see {hexes}{make(12)} there", f"see {make(12)}token=abcdef12 there"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["id"]: r for r in secrets.find_secrets(df).collect()}
    assert not any(got[i]["n_grammar"] for i in range(80))
    at = rows[80].index(next(w for w in rows[80].split() if w.isupper()))
    assert got[80]["spans"] == f"grammar:{at}:{at + 12}"
    assert got[81]["spans"] in ("hex:4:28,grammar:4:40", "hex:4:28,grammar:28:40")
    assert got[82]["spans"] in ("grammar:4:30,assign:16:30", "grammar:4:16,assign:16:30")


def plain_finder(text):
    """(kind, value) of the numbers and dates inside runs of digits, by rule and from left to right."""
    import datetime

    def luhn(d):
        return sum((v * (1 + i % 2) - 9 * (v * (1 + i % 2) > 9)) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0

    def date(v):
        try:
            return 0 <= (datetime.date.fromisoformat(v) - datetime.date(1900, 1, 1)).days < 73_000
        except ValueError:
            return False

    usual = ((4, 4, 4, 4, 3), (4, 4, 4, 4, 2), (4, 4, 4, 4, 1), (4, 4, 4, 4), (4, 4, 4, 3), (4, 4, 4, 2), (4, 4, 4, 1), (4, 6, 5), (4, 6, 4))
    out = []
    for m in re.finditer(r"(?:-|(?<![0-9A-Za-z]))[0-9]+(?:[ -][0-9]+)*-*", text):
        run, groups, i = m[0], list(re.finditer("[0-9]+", m[0])), 0
        sep = lambda k: run[groups[k].end() : groups[k].end() + 1] if k < len(groups) else ""  # noqa: B023, E731
        while i < len(groups):
            free = run[groups[i].start() - 1 : groups[i].start()] != "-"
            part = lambda n: run[groups[i].start() : groups[i + n - 1].end()] if i + n <= len(groups) else ""  # noqa: B023, E731
            three, took = part(3), 0
            if free and re.fullmatch(r"\d{4}-\d\d-\d\d", three) and sep(i + 2) != "-" and date(three):
                took, kind = 3, "date"
            elif free and re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", three) and sep(i + 2) != "-":
                took, kind = 3, "ssn"
            else:
                for shape in (*usual, (1,)):
                    v, n = part(len(shape)), len(shape)
                    d = re.sub("[^0-9]", "", v)
                    seps = set(re.findall("[ -]", v))
                    fits = v and tuple(map(len, re.split("[ -]", v))) == shape and len(seps) == 1 if n > 1 else v and 13 <= len(v) <= 19
                    if fits and 13 <= len(d) <= 19 and re.match("[3-6]|2[2-7]", d) and luhn(d):
                        took, kind = n, "card"
                        break
            if took:
                out.append((kind, part(took)))
            i += took or 1
    return out


def test_numbers_against_a_plain_finder(spark):
    """Runs of valid and invalid neighbours: what is found is what the rules say, and the rest of the text stays."""
    r = random.Random(11)
    pool = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "3782 822463 10005", "378282246310005", "9111 1111 1111 1110", "4111 1111-1111 1111", "000-00-0000", "078-05-1120", "2020-02-30", "1984-02-29", "12", "2024", "5105105105105100", "30569309025904", "1", "666-12-1234"]
    texts = ["4111 1111 1111 1111 000-00-0000 2020-02-30"] + [" ".join(r.choice(pool) for _ in range(r.randint(1, 5))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for row in pseudonyms.pseudonymize(df, "k").collect():
        text, want = texts[row["id"]], plain_finder(texts[row["id"]])
        assert {k: row[f"n_{k}"] for k in ("card", "ssn", "date")} == {k: sum(x == k for x, _ in want) for k in ("card", "ssn", "date")}, text
        shape = lambda t: re.sub("[0-9]", "0", t)
        assert shape(row["text"]) == shape(text)
        rest, new, at = text, row["text"], 0
        for _, v in want:
            at = rest.index(v, at)
            assert new[at : at + 2] == v[:2] or _ != "card"
            rest, new = rest[:at] + "#" * len(v) + rest[at + len(v) :], new[:at] + "#" * len(v) + new[at + len(v) :]
        assert rest == new


def test_pseudonyms(spark):
    rows = ["card 4111 1111 1111 1111, again 4111 1111 1111 1111", "4111111111111112 fails", "call +1 (415) 555-2671 or 10.0.0.1", "born 1984-02-29, not 1985-02-29", "a.b9@mail.example.com", None, "", "x" * 20_000 + " 078-05-1120"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["id"]: r for r in pseudonyms.pseudonymize(df, "k").collect()}
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}", got[0]["text"])
    assert len(set(cards)) == 1 and cards[0] != "4111 1111 1111 1111" and got[0]["n_card"] == 2
    assert got[1]["text"] == rows[1] and got[2]["n_phone"] == got[2]["n_ip"] == 1 and "415" not in got[2]["text"]
    assert got[3]["n_date"] == 1 and "1985-02-29" in got[3]["text"] and got[5]["text"] is None and got[6]["text"] == ""
    assert got[4]["text"].endswith("@mail.example.com") and got[4]["text"] != rows[4]
    assert got[7]["n_ssn"] == 1 and len(got[7]["text"]) == len(rows[7])
    digits = spark.range(1000).select(pseudonyms.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("p"))
    assert digits.distinct().count() == 1000


def test_pseudonyms_beside_other_digits(spark):
    dates, ssn, card = ["2020-01-01", "2020-03-15"], "078-05-1120", "4111 1111 1111 1111"
    rows = [f"{card} 12", "4111111111111111 123", " ".join(dates), f"{ssn} {dates[1]}", f"12 {dates[0]} 10.0.0.1", f"{dates[0]} 5a@b.com", f"x-{ssn}-", f"on {dates[0]}, {dates[1]}; {ssn}"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["id"]: r for r in pseudonyms.pseudonymize(df, "k").collect()}
    kinds = [{"card": 1}, {"card": 1}, {"date": 2}, {"ssn": 1, "date": 1}, {"date": 1, "ip": 1}, {"date": 1, "email": 1}, {}, {"date": 2, "ssn": 1}]
    for i, want in enumerate(kinds):
        assert {k: got[i][f"n_{k}"] for k in pseudonyms.KINDS if got[i][f"n_{k}"]} == want, rows[i]
    new = re.findall(r"[0-9-]+", got[7]["text"])
    assert got[2]["text"] == f"{new[0]} {new[1]}" and got[3]["text"] == f"{new[2]} {new[1]}" and got[6]["text"] == rows[6]
    assert got[0]["text"].endswith(" 12") and not got[0]["text"].startswith(card) and got[1]["text"].endswith(" 123")


def test_chat_roles(spark):
    r = random.Random(6)

    def turn(c, i):
        role = "user" if i % 2 == 0 else "assistant"
        n = r.randint(3, 9) if role == "user" else r.randint(60, 120)
        mark = ("User: " if role == "user" else "Assistant: ") if r.random() < 0.4 else ""
        return c, i, role, mark + prose(n, r.random()) + ("?" if role == "user" else ".")

    rows = [turn(c, i) for c in range(60) for i in range(r.randint(1, 8))]
    train = spark.createDataFrame([x for x in rows if x[0] < 40], "conv_id long, turn long, role string, text string")
    test = spark.createDataFrame([x for x in rows if x[0] >= 40] + [(99, 0, None, None), (None, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    got = chat.recover_roles(test, chat.fit(train)).collect()
    assert len(got) == test.count()
    assert np.mean([x["given"] == x["role"] for x in got if x["given"]]) > 0.95
    assert all("User:" not in x["rendered"] for x in got)
    parsed = chat.parse_transcript("User: hi there\nAssistant: " + prose(80, 1) + "\n\nand more " + prose(60, 2), chat.fit(train))
    assert [x for x, _ in parsed] == ["user", "assistant"]


def test_viterbi_against_all_paths(spark):
    """Short talks: the decoded roles have the likelihood of the best of all paths."""
    r = np.random.default_rng(1)
    rows = [(c, t, ("system", "user", "assistant")[int(r.integers(0, 3))], prose(int(r.integers(1, 40)), int(r.integers(0, 10**6)))) for c in range(80) for t in range(5)]
    model = chat.fit(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for c in range(40):
        texts = [x[3] for x in rows if x[0] == c]
        emit = [model.emit(t) for t in texts]
        score = lambda p: model.start[p[0]] + emit[0][p[0]] + sum(model.step[a, b] + e[b] for a, b, e in zip(p, p[1:], emit[1:]))  # noqa: B023,E731
        decoder = chat.Decoder(model)
        for t in texts:
            decoder.add(t)
        assert score([chat.ROLES.index(x) for x in decoder.roles()]) == pytest.approx(max(map(score, itertools.product(range(3), repeat=len(texts)))))


def test_marked_lines_inside_a_turn(spark):
    rows = [(1, 0, "user", "User: hi\nand more\nAssistant: " + prose(80, 1), "k"), (1, 1, None, None, "k"), (None, 0, "user", "a", "k"), (None, 0, "user", "a", "k"), (2, 0, "user", prose(30_000, 2), "k")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    got = chat.recover_roles(turns, chat.fit(turns)).collect()
    assert sorted((r["conv_id"] or 0, r["turn"], r["part"]) for r in got) == [(0, 0, 0), (0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 0), (2, 0, 0)]
    first = {r["part"]: r for r in got if (r["conv_id"], r["turn"]) == (1, 0)}
    assert first[0]["role"] == "user" and first[0]["rendered"] == "<|user|>\nhi\nand more\n<|end|>\n" and first[1]["role"] == "assistant"


def plain_feistel(x, low, high, key, tweak):
    a, b = x % low, x // low
    for i in range(8):
        half, m = (b, low) if i % 2 == 0 else (a, high)
        h = int(hashlib.sha256(f"{key}:{tweak}:{low}:{high}:{i}:{half}".encode()).hexdigest()[:13], 16) % m
        a, b = ((a + h) % low, b) if i % 2 == 0 else (a, (b + h) % high)
    return b * low + a


def plain_permute(x, base, most, key, tweak):
    alphabet, out = "0123456789" if base == 10 else "abcdefghijklmnopqrstuvwxyz", ""
    for at in range(0, len(x), most):
        limb = x[at : at + most]
        n, v = len(limb), 0
        for c in limb:
            v = v * base + alphabet.index(c)
        v = plain_feistel(v, base ** (n // 2), base ** (n - n // 2), key, f"{tweak}:{len(x)}:{x[:at]}")
        out += "".join(alphabet[v // base**i % base] for i in reversed(range(n)))
    return out


def test_permutations_against_a_plain_feistel_network(spark):
    r = random.Random(2)
    digits = ["".join(r.choice("0123456789") for _ in range(r.choice([0, 1, 2, 9, 17, 18, 19, 40]))) for _ in range(150)] + ["9" * 18, "0" * 18, "9" * 37]
    letters = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.choice([0, 1, 2, 11, 12, 13, 30]))) for _ in range(150)] + ["z" * 12]
    df = spark.createDataFrame(list(zip(digits, letters)), "d string, l string")
    for row in df.select("d", "l", pseudonyms.permute_digits(F.col("d"), "k", "t").alias("p"), pseudonyms.permute_letters(F.col("l"), "k", "t").alias("q")).collect():
        assert row["p"] == plain_permute(row["d"], 10, 18, "k", "t") and row["q"] == plain_permute(row["l"], 26, 12, "k", "t")


def test_pseudonyms_never_collide(spark):
    mails = [f"{c}@x.com" for c in "abcdefghijklmnopqrstuvwxyzABC"] + ["u1234567890123456789@x.com", "u1234567890123456780@x.com", "aB.c-1@x.com", "aB.c-2@x.com"]
    numbers = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899) for g in (1, 99) for s in (1, 9999)]
    odd = ["000-12-1234", "666-12-1234", "900-12-1234", "123-00-1234", "123-12-0000"]
    rows = mails + numbers + odd
    df = spark.createDataFrame([(i, t, "d", 0) for i, t in enumerate(rows)] + [(0, rows[0], "d", 0)], "doc_id long, text string, done string, row int")
    got = {r["id"]: r for r in pseudonyms.pseudonymize(df, "k").collect()}
    new = [got[i]["text"] for i in range(len(mails))]
    assert len(set(new)) == len(mails) and all(re.sub("[a-z]", "x", re.sub("[A-Z]", "X", re.sub("[0-9]", "0", x))) == re.sub("[a-z]", "x", re.sub("[A-Z]", "X", re.sub("[0-9]", "0", y))) for x, y in zip(new, mails))
    assert "1234567890123456789" not in new[29]
    valid = [got[len(mails) + i] for i in range(len(numbers))]
    assert len({r["text"] for r in valid}) == len(numbers) and all(r["n_ssn"] == 1 and re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", r["text"]) for r in valid)
    assert all(got[len(mails) + len(numbers) + i]["text"] == t and not got[len(mails) + len(numbers) + i]["n_replaced"] for i, t in enumerate(odd))


def test_automaton_bits_against_plain_walk():
    """bits() follows the tables, and the states' next symbols and ends are probabilities but for the smoothing."""
    r = random.Random(3)
    words = ["".join(r.choice("Ud") for _ in range(r.randint(1, 3))) for _ in range(300)]
    a = secrets.Automaton(words)
    for n in range(5):
        for w in map("".join, itertools.product("Udx", repeat=n)):
            at, total = 0, 0.0
            for c in map(secrets.SYMBOLS.index, w):
                total, at = total + a.step[at, c], a.to[at, c]
            assert a.bits(w) == pytest.approx((total + a.end[at]) / (n + 1))
    assert a.step.shape == a.to.shape == (len(a.end), len(secrets.SYMBOLS))
    assert all((2.0 ** a.step[i]).sum() + 2.0 ** a.end[i] < 1.02 for i in range(len(a.end)))
    assert a.bits("Ud") > a.bits("xx")


@pytest.mark.parametrize("n", [40, 24])
def test_automata_keep_the_length(n):
    """A format of one length has a state per place; shorter and longer values are refused, whatever they are made of."""
    r = random.Random(n)
    make = lambda m: "".join(r.choice("0123456789abcdef") for _ in range(m))
    plain = lambda: prose(1, r.random()) + str(r.randint(1, 99))
    scorer = secrets.Scorer([("hex", make(n)) for _ in range(120)] + [("", plain()) for _ in range(120)])
    assert len(scorer.formats["hex"].end) == n + 2
    assert all(scorer.is_secret(make(n)) for _ in range(100))
    assert not any(scorer.is_secret(make(m)) for m in (6, 10, n - 1, n + 1, 2 * n) for _ in range(50))
    # glued to other characters it is found at its length
    for _ in range(20):
        head, key = prose(1, r.random()) + "_", make(n)
        assert scorer.secrets(head + key + "/zz") == [(len(head), len(head) + n)]


def test_few_labels_make_a_format():
    r = random.Random(5)
    make = lambda: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(20))
    scorer = secrets.Scorer([("access", make()) for _ in range(3)] + [("word", prose(1, i)) for i in range(100)])
    assert scorer.is_secret(make()) and not any(scorer.is_secret(prose(1, 500 + i)) for i in range(100))


def test_hidden_labels_of_the_given_tables(spark):
    """Automata fitted on half of the labelled values accept the other half, and next to nothing of ordinary tokens."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labelled = secrets.labelled_values(rows, 100_000)
    half = lambda v, k: zlib.crc32(v.encode()) % 2 == k
    scorer = secrets.Scorer([x for x in labelled if half(x[1], 0) and x[0] not in ("", "word")] + [x for x in labelled if half(x[1], 0) and x[0] in ("", "word")][:800])
    assert set(scorer.formats) == {"assign", "hex"}
    for kind in scorer.formats:
        assert len(scorer.formats[kind].end) > 20
        hidden = [v for k, v in labelled if k == kind and half(v, 1)]
        assert hidden and np.mean([scorer.is_secret(v) for v in hidden]) >= 0.9
    plain = [v for k, v in labelled if k in ("", "word") and half(v, 1)]
    assert sum(bool(scorer.secrets(v)) for v in plain) <= len(plain) / 1_000


def test_equal_hashes_of_windows_are_compared_by_words(spark, monkeypatch):
    monkeypatch.setattr(line_rules, "_window_hashes", lambda: F.expr("transform(slice(words, 1, n_words - 2), (w, i) -> cast(i as bigint))"))
    rows = ["a b c d a b c", "a b c d e f g h", "x y z q x y z x y z", "a a a a a"]
    got = line_rules.measures(spark.createDataFrame([(i, t, "h") for i, t in enumerate(rows)], "doc_id long, text string, source string")).collect()
    assert {r["id"]: r["n_repeat_words"] for r in got} == {0: 6, 1: 0, 2: 9, 3: 5}


CLASHING = "doc_id long, text string, source string, n_chars long, id long, mark string, row int, host string, keys string, kept string, slot int, part int, _id int"


def test_rows_are_told_apart(spark):
    """Equal ids with other texts, repeated rows, and columns named like the operators' own."""
    p, q = prose(100, 1), prose(100, 2)
    line = "a line that is everywhere"
    rows = [(3, p, "s"), (3, q, "s"), (4, q, "s"), (3, p, "s"), (None, p + " ", None), (5, None, "s"), (6, "", "s"), (7, prose(80, 9) + "\n" + line, "s"), (7, prose(80, 10) + "\n" + line, "s"), (7, prose(80, 11) + "\n" + line, "t")]
    data = [(i, t, s, len(t or ""), 1, "m", n, "h", "k", "y", 0, 0, n) for n, (i, t, s) in enumerate(rows)]
    df = spark.createDataFrame(data, CLASHING).repartition(3)
    single = exact_dedup.drop_copies(df)
    assert single.columns == df.columns
    got = sorted((r["doc_id"] or 0, (r["text"] or "")[:20], r["_id"]) for r in single.collect())
    assert got == sorted((rows[n][0] or 0, (rows[n][1] or "")[:20], n) for n in (1, 4, 5, 7, 8, 9))
    clean = line_rules.clean_documents(df, max_docs=1)
    assert clean.columns == df.columns
    got = {r["_id"]: r for r in clean.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 7, 8, 9] and [n for n in got if line in got[n]["text"]] in ([7, 9], [9, 7], [8, 9], [9, 8])
    assert all(r["n_chars"] == len(r["text"]) and r["host"] == "h" for r in got.values())
    mixed = mixing.mixed_documents(df, block_words=16)
    assert mixed.columns == df.columns
    per = Counter(r["_id"] for r in mixed.collect())
    assert set(per) <= set(range(5)) | {7, 8, 9} and max(per.values()) <= 2 and {0, 3} <= set(per)
    none = df.limit(0)
    assert exact_dedup.drop_copies(none).count() == line_rules.clean_documents(none).count() == mixing.mixed_documents(none).count() == 0


def test_mixed_documents_keep_the_order_of_slots(spark):
    """Sources alternate along the output as their weights ask; a filter over the bound gives way to a shuffle."""
    rows = [(i, prose(40, i), ("a", "b")[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = [r["source"] for r in mixing.mixed_documents(df, block_words=40, total_share=0.5, weights=(3.0, 1.0)).collect()]
    for at in range(0, len(seen) - 40, 40):
        assert 22 <= seen[at : at + 40].count("a") <= 38


def test_filter_of_the_index(spark, monkeypatch):
    rows = [(i, prose(30, i % 150)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wal = exact_dedup.log(df, "doc_id", "text", exact_dedup.sha256)
    index = exact_dedup.compact(exact_dedup.flush(wal, 10))
    hits = {r["digest"] for r in index.collect()}
    assert len(hits) == 50
    found = {r["digest"] for r in exact_dedup.asked(wal, index, 50).collect()}
    assert hits <= found and len(found) < 75
    monkeypatch.setattr(exact_dedup, "SENT_BYTES", 0)
    assert exact_dedup.asked(wal, index, 50).count() == 200


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("b.example.net", "", "block"), ("net", "", "block")]


def test_urls(spark):
    r = random.Random(3)
    urls = [f"http://{r.choice(['', 'a.', 'x.y.'])}{r.choice(['Example.com', 'example.net', 'b.example.net', 'notexample.net', 'com', 'org'])}{r.choice(['', '/', '/en/', '/en/71', '/de/8?q', '/de/9#x', '/en', '?/en/'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "http:///en/"]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, key string").repartition(5)
    rules = spark.createDataFrame(RULES + RULES[:1], "host string, path string, verdict string")
    for most in (10_000, 7):
        got = url_rules.judge_urls(pages, rules, range_rows=most).collect()
        assert len(got) == len(urls)
        for row in got:
            m = re.search(r"://([^/?#]*)([^?#]*)", urls[row["id"]] or "")
            host, path = (m[1].lower(), m[2]) if m else ("", "")
            fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
            best = max(fits) if fits else (0, None, "allow")
            assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, *best[1:])


def test_warc(spark, tmp_path):
    big = "é" * 700
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://a b/4", "x"), (5, "u", "x"), (6, "u", None), (7, "u", ""), (8, "u", prose(5_000, 1))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    archives = warc_zip.write_archives(pages, str(tmp_path / "w"), archive_bytes=2_000)
    got = {r["id"]: r for r in warc_zip.read_archives(archives).collect()}
    for i, _, body in rows:
        raw = (body or "").encode()
        assert (got[i]["payload_bytes"], got[i]["digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert got[i]["type"] == ("revisit" if i < 3 else "response") and got[i]["refers_to"] == (3 if i < 3 else None)
        assert i < 3 or got[i]["payload"] == raw
    names = zipfile.ZipFile(archives.first()["archive"]).namelist()
    assert names == [warc_zip.DATA, warc_zip.INDEX]


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directories(wide):
    data = warc_zip.zip_bytes([("a", b"123"), ("b/c", b"x" * 999)], zip64=wide)
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    f = io.BytesIO(data)
    members = warc_zip.directory(f)
    assert [(m.name, m.size) for m in members] == [("a", 3), ("b/c", 999)]
    assert data[warc_zip.begins(f, members[1]) :][:999] == b"x" * 999
    with pytest.raises(ValueError):
        warc_zip.directory(io.BytesIO(b"no archive"))


@pytest.mark.parametrize("edges_per_task", [10_000, 300])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, edges_per_task):
    monkeypatch.setattr(common, "FOREST_EDGES", edges_per_task)
    r = random.Random(3)
    links = [(i, i + 1) for i in range(400)] + [(10_000 + r.randrange(900), 10_000 + r.randrange(900)) for _ in range(600)] + [(20_000, i) for i in range(20_001, 20_500)] + [(5, 5), (1, 0)]
    root = {x: x for pair in links for x in pair}
    changed = True
    while changed:
        changed = False
        for x, y in links:
            if root[x] != root[y]:
                root[x] = root[y] = min(root[x], root[y])
                changed = True
    got = common.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted((x, y) for x, y in root.items() if any(x in p and p[0] != p[1] for p in links))
