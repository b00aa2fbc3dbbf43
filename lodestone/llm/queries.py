"""The queries of this subpackage and, where SQL can state one, its DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, mixing, multi_index, near_dedup, prefix_trie, quality, quality_rules, secrets, substring_dedup, token_shards, unigram, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_starts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(_table(spark, sf_dir, "embeddings"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.tokenize(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = warc.capture_history(_table(spark, sf_dir, "pages"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_soft_mixing": op1_soft_mixing,
    "op2_quality": op2_quality,
    "op3_token_shards": op3_token_shards,
    "op4_multi_index": op4_multi_index,
    "op5_secret_scan": op5_secret_scan,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_warc": op9_warc,
    "op10_minhash": op10_minhash,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_quality_rules": op12_quality_rules,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM d),
        v AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS h FROM s),
        r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM v),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE k > 1),
        t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d),
        k AS (SELECT t.doc_id, string_agg(t.w[t.j], ' ' ORDER BY t.j) FILTER (WHERE g.j IS NULL) AS kept, count(g.j) AS n_removed
              FROM t LEFT JOIN g ON t.doc_id = g.doc_id AND t.j = g.j GROUP BY t.doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        b AS (SELECT page_id, payload, octet_length(encode(payload)) AS payload_bytes FROM p),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS top FROM b)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM r
    """,
    "op10_minhash": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM i),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
        l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        c(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, c.root FROM c JOIN l ON c.doc_id = l.a)
        SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(c.root) AS component_id, min(c.root) = d.doc_id AS kept
        FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
    """,
    "op11_prefix_trie": """
        WITH bits AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab
                      FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
        t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos
              FROM conversations WHERE conv_id IS NOT NULL),
        cs AS (SELECT c, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                         lambda a, b: xor(a >> 8, tab[xor(a, b) % 256 + 1])), 4294967295) % 6 AS h
               FROM (SELECT DISTINCT c FROM t), bits),
        r AS (SELECT cs.c, 0 AS own, t.pos, t.role, t.text FROM cs JOIN t ON t.c = cs.c - cs.c % 100 AND t.pos < cs.h
              UNION ALL SELECT t.c, 1, t.pos, t.role, t.text FROM t JOIN cs ON t.c = cs.c AND t.pos >= cs.h),
        p AS (SELECT c, row_number() OVER w AS depth, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS k, length(text) AS points, count(*) OVER (PARTITION BY c) AS n
              FROM r WINDOW w AS (PARTITION BY c ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
        m AS (SELECT c, depth, k, points, n FROM p UNION ALL SELECT c, 0, '', 0, coalesce((SELECT max(p.n) FROM p WHERE p.c = cs.c), 0) FROM cs),
        nodes AS (SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, min(points) AS points, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = depth), '')) AS ends_sha256
                  FROM m GROUP BY depth, k),
        kids AS (SELECT left(k, CAST(64 * (depth - 1) AS BIGINT)) AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
        own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON nodes.k = kids.k),
        up AS (SELECT left(k, CAST(64 * a AS BIGINT)) AS k, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * points) AS saved_tokens
               FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM own) GROUP BY 1)
        SELECT own.conv_id, CAST(own.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, own.n_convs, own.n_children, CAST(up.n_leaves AS BIGINT) AS n_leaves,
               CAST(up.saved_tokens AS BIGINT) AS saved_tokens, own.ends_sha256
        FROM own JOIN up ON up.k = own.k LEFT JOIN nodes q ON own.depth > 0 AND q.k = left(own.k, CAST(64 * (own.depth - 1) AS BIGINT))
    """,
}
