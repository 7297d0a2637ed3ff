"""The registered queries of this package, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import chat, decontaminate, exact_dedup, hard_negatives, jaccard_join, line_rules, mixing, packing, prefix_trie, pseudonyms, secrets, url_rules, warc_zip

Query = Callable[[SparkSession, str], DataFrame]

#: Rules of op9: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Key of op5. A deployment passes its own secret.
PSEUDONYM_KEY = "trackloom-demo-key"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record into ZIP-packaged archives and read back by range."""
    r = warc_zip.round_trip(spark, _read(spark, sf_dir, "pages"))
    return r.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and line-frequency verdicts of all documents."""
    r = line_rules.line_frequency_rules(_read(spark, sf_dir, "documents"))
    return r.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_lines", "removed_words"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    r = packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())
    return r.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents: fixed patterns, and candidates that the inferred grammars accept."""
    r = secrets.find_secrets(_read(spark, sf_dir, "documents"))
    return r.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_grammar")


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for validated numbers and dates."""
    r = pseudonyms.pseudonymize(_read(spark, sf_dir, "documents"), PSEUDONYM_KEY)
    return r.withColumnRenamed("id", "doc_id")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at similarity 0.75 over five-word shingles."""
    r = jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"))
    return r.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op7_chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of all conversation turns by the hidden Markov model, with canonical turns."""
    turns = _read(spark, sf_dir, "conversations")
    return chat.recover_roles(turns, chat.fit(turns))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    r = mixing.taken_words(*mixing.mix(_read(spark, sf_dir, "documents")))
    return r.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(_read(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents, and the row of each that stays."""
    r = exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))
    return r.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in windows of benchmark items."""
    r = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return r.withColumnRenamed("id", "doc_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all vectors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_read(spark, sf_dir, "embeddings"), anchor=F.col("vec_id") % 100 == 0, label=label)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, once heads are shared."""
    return prefix_trie.conversation_trie(_read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_warc_zip,
        op2_line_frequency,
        op3_packing,
        op4_secret_scan,
        op5_pseudonyms,
        op6_jaccard_join,
        op7_chat_roles,
        op8_mixing,
        op9_url_rules,
        op10_exact_dedup,
        op11_decontamination,
        op12_hard_negatives,
        op13_prefix_trie,
    )
}

_SPACE = r"[\x20\x09-\x0D]"

ORACLES: dict[str, str] = {
    "op1_warc_zip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, lower(sha1(body)) AS payload_digest FROM p),
        b AS (SELECT payload_digest, max(page_id) AS best FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN b.best <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN b.best <> d.page_id THEN b.best END AS refers_to
        FROM d LEFT JOIN b ON b.payload_digest = d.payload_digest AND d.payload_bytes >= 1000""",
    "op2_line_frequency": rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS host FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
        win AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w),
        g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM win),
        dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
        ln AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM t),
        l AS (SELECT doc_id, host, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
                     lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS norm FROM ln),
        dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE n > 0 GROUP BY doc_id),
        f AS (SELECT host, norm, arg_min(text, doc_id) AS first FROM l WHERE n > 0 GROUP BY host, norm HAVING count(DISTINCT text) > 20),
        r AS (SELECT l.doc_id, sum(l.n) AS words, count(*) AS lines FROM l JOIN f ON f.host = l.host AND f.norm = l.norm AND f.first <> l.text GROUP BY l.doc_id),
        m AS (SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(length(array_to_string(w.words, '')) AS BIGINT) AS word_chars,
                     CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
                     CAST(coalesce(r.lines, 0) AS BIGINT) AS removed_lines, CAST(coalesce(r.words, 0) AS BIGINT) AS removed_words
              FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN r USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * removed_words <= n_words AS kept,
               removed_lines, removed_words FROM m""",
    "op6_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS i FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_have >= 75 * (a.n + b.n - both_have)),
        e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id""",
    "op9_url_rules": r"""
        WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r(r_host, r_path, r_verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        f AS (SELECT page_id, r_host || r_path AS rule, r_verdict,
                     row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC) AS nth
              FROM h JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
        SELECT h.page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
        FROM h LEFT JOIN (SELECT * FROM f WHERE nth = 1) g ON g.page_id = h.page_id""",
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT doc_id, text_sha256, CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
                     first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op11_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bi AS (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS i FROM b),
        bw AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM bi),
        sizes AS (SELECT DISTINCT m FROM bw),
        di AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes),
        dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM di),
        hit AS (SELECT doc_id, i, m, item FROM dw JOIN bw USING (m, g)),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
        t AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item)), ',')) AS items_sha256 FROM hit GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
        p AS (SELECT anchor, id AS positive, score AS p FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS nth FROM s WHERE same) WHERE nth <= 5),
        n AS (SELECT p.anchor, positive, p, s.id, score, row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, s.id) AS nth
              FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND 80 * p <= 100 * score AND 100 * score <= 100 * p)
        SELECT anchor AS anchor_id, positive AS positive_id, CAST(nth AS INTEGER) AS rank, id AS negative_id, p AS positive_score, score AS negative_score FROM n WHERE nth <= 5""",
    "op13_prefix_trie": """
        WITH RECURSIVE t AS (SELECT conv_id AS c, turn, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
                   FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS pos, digest, strlen(text) AS bytes FROM t),
        ids AS (SELECT c, max(pos) AS own FROM o GROUP BY c),
        bits(c, s, i, x) AS (SELECT c, CAST(c AS VARCHAR), 0, 4294967295 FROM ids UNION ALL
                   SELECT c, s, i + 1, CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END
                   FROM (SELECT c, s, i, CASE WHEN i % 8 = 0 THEN xor(x, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE x END AS y FROM bits WHERE i < 8 * length(s))),
        h AS (SELECT c, CAST(xor(x, 4294967295) % 9 AS BIGINT) AS h, c - c % 5 AS b FROM bits WHERE i = 8 * length(s)),
        g AS (SELECT h.c, h.h, h.b, least(h.h, coalesce(ids.own, 0)) AS head FROM h LEFT JOIN ids ON ids.c = h.b),
        r AS (SELECT g.c, pos AS d, digest, bytes FROM g JOIN o ON o.c = g.b AND pos <= head UNION ALL
              SELECT g.c, pos - h + head, digest, bytes FROM g JOIN o ON o.c = g.c AND pos > h),
        m AS (SELECT c, d, string_agg(digest, '') OVER (PARTITION BY c ORDER BY d) AS key, bytes FROM r UNION ALL SELECT c, 0, '', 0 FROM ids),
        l AS (SELECT c, max(d) AS len FROM m GROUP BY c),
        n AS (SELECT key, d, min(c) AS conv, count(*) AS n, any_value(bytes) AS bytes, max(len) = d AS leaf FROM m JOIN l USING (c) GROUP BY key, d),
        u AS (SELECT n.key, n.d, p.conv AS parent, p.key AS up FROM n JOIN m ON m.c = n.conv AND m.d = n.d - 1 JOIN n p ON p.key = m.key AND p.d = m.d),
        k AS (SELECT up AS key, d - 1 AS d, count(*) AS kids FROM u GROUP BY up, d - 1),
        s AS (SELECT m.key, m.d, sum(CASE WHEN leaf THEN 1 ELSE 0 END) AS leaves, sum((n.n - 1) * n.bytes) AS saved FROM n JOIN m ON m.c = n.conv AND m.d <= n.d GROUP BY m.key, m.d),
        e AS (SELECT key, d, sha256(string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c)) AS ends FROM m JOIN l ON l.c = m.c AND l.len = m.d GROUP BY key, d)
        SELECT n.conv AS conv_id, CAST(n.d AS BIGINT) AS depth, parent AS parent_conv_id, n.n AS n_convs, CAST(coalesce(kids, 0) AS BIGINT) AS n_children,
               CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
        FROM n JOIN s USING (key, d) LEFT JOIN u USING (key, d) LEFT JOIN k USING (key, d) LEFT JOIN e USING (key, d)""",
}
