"""The registered queries against SQL, and the pipeline stage by stage."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from trackloom.llm import queries
from trackloom.llm.common import materialize

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioublcmnrst") for _ in range(r.randint(2, 7))) for _ in range(n))


def components(sets):
    """Least id that each id reaches over links of similarity 0.75, by comparing all pairs and spreading the least."""
    near = {a: [b for b in sets if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])] for a in sets}
    root = {a: a for a in sets}
    while (new := {a: min(root[b] for b in near[a]) for a in sets}) != root:
        root = new
    return root


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = c.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.select(*cols).collect()), key=key) == sorted(want, key=key)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        docs = out
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    pieces = corpus_pipeline.run(spark, DATA)
    assert pieces.count() > 0


def test_tables_of_a_step_go_when_its_result_is_written(spark, tmp_path):
    import pathlib

    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {p.name for p in shared.iterdir()}
    own = lambda: {p.name for p in shared.iterdir()} - before
    first = corpus_pipeline.quality_rules(spark, docs, DATA)
    steps = own()
    # not yet written: the next stage leaves what it still reads
    assert corpus_pipeline.exact_dedup(spark, first, DATA).count() > 0 and steps and steps <= own()
    first = corpus_pipeline.quality_rules(spark, docs, DATA)
    mine = own() - steps
    first.write.parquet(str(tmp_path / "first"))
    second = corpus_pipeline.exact_dedup(spark, spark.read.parquet(str(tmp_path / "first")), DATA)
    assert not (mine - {n for n in mine if n.startswith("lsm")}) & own() and second.count() > 0


def test_pipeline_of_nothing(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def plain_stages(rows):
    """Documents (doc_id, text, source) after each of the first three stages, by plain loops."""
    words = lambda t: WORD.findall(t or "")
    norm = lambda line: " ".join(words(line)).lower()
    has = {}
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            if words(line):
                has.setdefault((s, norm(line)), {}).setdefault(t, i)
    first = {k: min(v, key=v.get) for k, v in has.items() if len(v) > 20}
    clean = []
    for i, t, s in rows:
        w, at = words(t), {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        repeat = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
        lines = (t or "").split("\n")
        gone = [x for x in lines if first.get((s, norm(x)), t) != t]
        if len(w) >= 50 and 100 * len(repeat) <= 50 * len(w) and 2 * sum(len(words(x)) for x in gone) <= len(w):
            clean.append((i, "\n".join(x for x in lines if x not in gone), s))
    best = {}
    for i, t, s in clean:
        best.setdefault("".join(words(t)), []).append((-len(t), i, t, s))
    single = [(i, t, s) for _, i, t, s in map(min, best.values())]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t, _ in single if (w := words(t.lower()))}
    root = components(sets)
    return clean, single, [x for x in single if root[x[0]] == x[0]]


def test_pipeline_equals_plain_version(spark, tmp_path):
    """Stages 1 to 3 give the rows of plain loops; mixing meets its targets; the pieces rebuild the tokens of every mixed row."""
    from tokenizers import Tokenizer

    common = "this line is on every page of the host and means nothing"
    rows = [(i, prose(60 + i, 100 + i) + "\n" + common, ("a", None)[i % 2]) for i in range(50)]
    base = prose(200, 7)
    more = [base, base.replace(base.split()[90], "changed"), base.replace(" ", "\n"), base + "  ", None, "", "too short", "again and again " * 40, prose(5_000, 8), prose(70, 9), prose(70, 9)]
    rows += [(100 + i, t, "b") for i, t in enumerate(more)]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, n = spark.read.parquet(str(tmp_path / "documents.parquet")), len(rows)
    key = lambda r: (r[0], str(r[1]))
    for (_, stage), want in zip(corpus_pipeline.STAGES, plain_stages(rows)):
        docs = materialize(stage(spark, docs, str(tmp_path)), "test-stage")
        assert sorted(map(tuple, docs.select("doc_id", "text", "source").collect()), key=key) == sorted(want, key=key)
        assert len(want) < n
        n = len(want)
    size = {}
    for i, t, s in want:
        size[s] = size.get(s, 0) + len(WORD.findall(t))
    mixed = materialize(corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)), "test-stage")
    text = {i: t for i, t, _ in want}
    got = mixed.select("doc_id", "text", "source").collect()
    assert all("".join(WORD.findall(text[r["doc_id"]])).startswith("".join(WORD.findall(r["text"]))) for r in got)
    assert max(sum(r["doc_id"] == i for r in got) for i in text) <= 2
    total = sum(len(WORD.findall(r["text"])) for r in got)
    assert total >= 1.45 * sum(size.values())
    bpe = Tokenizer.from_file(queries.tokenizer_path())
    tokens = sorted((r["doc_id"], tuple(bpe.encode(r["text"], add_special_tokens=False).ids) + (1,)) for r in got)
    by = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        by.setdefault((r["doc_id"], r["doc_row"]), []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert len(by) == len(tokens)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    left = list(tokens)
    for (i, _), pieces in sorted(by.items()):
        pieces.sort()
        assert [p[0] for p in pieces] == [sum(p[1] for p in pieces[:k]) for k in range(len(pieces))]
        left.remove(next(x for x in left if x[0] == i and len(x[1]) == pieces[0][3] and all(crc(x[1][a : a + n]) == c for a, n, c, _ in pieces)))
    assert not left
