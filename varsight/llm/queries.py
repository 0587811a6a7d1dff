"""The registered queries of the text operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, divergence, fingerprints, langid, licenses, ngram_join, packing, prefix_trie, quality, secrets, topk, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archive_pages(table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (
        op1_ngram_jaccard_join, op2_secret_scan, op3_toxicity, op4_quality_rules, op5_bpe_round_trip, op6_document_fingerprints, op7_warc_index, op8_license_scan, op9_language_id, op10_best_fit_packing,
        op11_prefix_trie, op12_exact_topk, op13_source_divergence,
    )
    return {f.__name__: f for f in found}


# Words of a text and the shingles of a document, as the join takes them.
_SHINGLES = r"""w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN words ELSE words[i:i + 4] END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n_shingles FROM g GROUP BY doc_id)"""

_OP1 = f"""WITH RECURSIVE {_SHINGLES},
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT p.a, p.b FROM pairs p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.shared >= 75 * (x.n_shingles + y.n_shingles - p.shared)),
reach AS (SELECT doc_id, doc_id AS least FROM documents UNION SELECT links.b, reach.least FROM reach JOIN links ON links.a = reach.doc_id WHERE reach.least < links.b)
SELECT w.doc_id, coalesce(n.n_shingles, 0)::BIGINT AS n_shingles, min(reach.least) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY w.doc_id, n.n_shingles"""

# Base 32 of the digest: four letters for every five hexadecimal digits.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(f"substr('{_LETTERS}', ((('0x' || substr(digest, {1 + 5 * (k // 4)}, 5))::INT >> {15 - 5 * (k % 4)}) & 31) + 1, 1)" for k in range(32))

_OP7 = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p)
SELECT page_id, size::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f"""


# crc32 bit by bit; nodes as lists of turns; subtrees as pairs of a list and its prefixes.
_OP11 = """WITH t AS (SELECT conv_id::BIGINT AS c, {'role': coalesce(role, ''), 'body': coalesce("text", '')} AS turn, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce("text", ''))) AS k FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(turn ORDER BY k) AS turns FROM t GROUP BY c),
crc AS (SELECT c, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda e, i: xor(e >> 1, 3988292384 * (e & 1)))), 4294967295) % 6 AS h FROM own),
rebuilt AS (SELECT x.c, list_concat(coalesce(b.turns[1:x.h], []), x.turns[x.h + 1:]) AS turns FROM crc x LEFT JOIN own b ON b.c = x.c - x.c % 100),
m AS (SELECT c, d, turns[1:d] AS prefix, len(turns) = d AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
n AS (SELECT prefix, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ended,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(prefix[d].body) END AS saved FROM m GROUP BY prefix, d),
ch AS (SELECT prefix[1:d - 1] AS prefix, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(ch.n_children, 0) AS n_children FROM n LEFT JOIN ch USING (prefix)),
up AS (SELECT prefix[1:a] AS prefix, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY 1)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, up.n_leaves::BIGINT AS n_leaves,
  up.saved_tokens::BIGINT AS saved_tokens, sha256(f.ended) AS ends_sha256
FROM f JOIN up USING (prefix) LEFT JOIN n p ON f.d > 0 AND p.d = f.d - 1 AND p.prefix = f.prefix[1:f.d - 1]"""

_OP12 = """WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row <> c.row)
SELECT query_id, (row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20"""

_OP13 = r"""WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT d.lang, coalesce(any_value(k.v), 0) AS v, coalesce(any_value(k.n), 0) AS n FROM d LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang) k USING (lang) GROUP BY d.lang),
g AS (SELECT x.lang, x.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c USING (lang, source) GROUP BY x.lang, x.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.n + 5 * l.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 5) // (l.n + 5 * l.v) AS q
  FROM g JOIN kept k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (FROM pair UNION ALL FROM term))
SELECT * FROM r WHERE part = 'pair' OR rank <= 50"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries whose rows SQL can express."""
    return {"op1_ngram_jaccard_join": _OP1, "op7_warc_index": _OP7, "op11_prefix_trie": _OP11, "op12_exact_topk": _OP12, "op13_source_divergence": _OP13}
