"""The registered queries of this package, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from minuteworks.llm.byte_bpe import byte_digests
from minuteworks.llm.common import table
from minuteworks.llm.embedding_dedup import near_vectors
from minuteworks.llm.exact_dedup import exact_dedup
from minuteworks.llm.filter_audit import filter_audit
from minuteworks.llm.language import identify_language
from minuteworks.llm.minhash import minhash_components
from minuteworks.llm.packing import pack_documents
from minuteworks.llm.pieces import piece_digests
from minuteworks.llm.prefix_trie import conversation_trie
from minuteworks.llm.quality import quality_scores
from minuteworks.llm.secrets import scan_secrets
from minuteworks.llm.simple8b import token_files
from minuteworks.llm.warc import warc_round_trip


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"), width=2)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_digests(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS kept,
       sha256(n) AS text_sha256
FROM d
"""

OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), tests AS (
  SELECT d.doc_id, part,
         len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         d.doc_id > min(d.doc_id) OVER (PARTITION BY t) AS e,
         coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM words d LEFT JOIN labels l ON l.doc_id = d.doc_id
), fails AS (
  SELECT part, good, toxic, f.letter, f.bad, a::INT + b::INT + c::INT + d::INT + e::INT AS n_bad,
         concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
                CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS mask
  FROM tests, LATERAL (VALUES ('A', a), ('B', b), ('C', c), ('D', d), ('E', e)) f(letter, bad)
), masks AS (
  SELECT part, mask, letter, bad, n_bad, count(*) AS docs, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM fails GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
  SELECT m.part, o.filter_order, k.step,
         sum(docs) FILTER (WHERE NOT gone AND NOT bad) AS kept, sum(docs) FILTER (WHERE NOT gone AND bad) AS removed,
         sum(docs) FILTER (WHERE gone AND bad) AS redundant, sum(docs) FILTER (WHERE bad AND n_bad = 1) AS unique_fails,
         sum(good) FILTER (WHERE NOT gone AND bad) AS good_lost, sum(toxic) FILTER (WHERE NOT gone AND bad) AS toxic_lost
  FROM orders o, (SELECT unnest(range(1, 6)) AS step) k,
       LATERAL (SELECT *, len(mask) > 0 AND len(replace(translate(mask, left(o.filter_order, (k.step - 1)::INT), ''), ' ', '')) < len(mask) AS gone
                FROM masks WHERE letter = substr(o.filter_order, k.step, 1)) m
  GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)), 0)::BIGINT AS shapley
FROM steps
"""

OP13_SQL = r"""
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT *, conv_id - conv_id % 100 AS base,
         (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::UBIGINT)),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)),
          4294967295::UBIGINT) % 6)::INT AS h
  FROM own
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM heads c LEFT JOIN own b ON b.conv_id = c.base
), begun AS (
  SELECT conv_id, d, turns[1:d] AS p, len(turns) AS n FROM rebuilt, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)
), nodes AS (
  SELECT p, d, min(conv_id) AS conv, count(*) AS n_convs, coalesce(length(any_value(p[d].text)), 0) AS size,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends
  FROM begun GROUP BY p, d
), above AS (SELECT b.conv_id, b.d, n.conv FROM begun b JOIN nodes n ON n.p = b.p AND n.d = b.d),
linked AS (SELECT n.*, a.conv AS parent FROM nodes n LEFT JOIN above a ON a.conv_id = n.conv AND a.d = n.d - 1),
children AS (SELECT parent AS conv, d - 1 AS d, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c ON c.conv = l.conv AND c.d = l.d),
sums AS (
  SELECT a.conv, a.d, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.size) AS saved
  FROM full_nodes f JOIN above a ON a.conv_id = f.conv AND a.d <= f.d GROUP BY a.conv, a.d
)
SELECT f.conv AS conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN sums s ON s.conv = f.conv AND s.d = f.d
"""

QUERIES = {
    "op1_packing": op1_packing,
    "op2_minhash": op2_minhash,
    "op3_token_files": op3_token_files,
    "op4_pieces": op4_pieces,
    "op5_near_vectors": op5_near_vectors,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_secrets": op9_secrets,
    "op10_warc": op10_warc,
    "op11_filter_audit": op11_filter_audit,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {"op8_exact_dedup": OP8_SQL, "op11_filter_audit": OP11_SQL, "op13_prefix_trie": OP13_SQL}
