"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_extract

    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring

    return substring.digests(table(spark, sf_dir, "documents"))


def op4_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.top_products(table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokenstore

    return tokenstore.store_and_check(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embdedup

    return embdedup.links(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {"op1_minhash": op1_minhash, "op2_main_text": op2_main_text, "op3_substring_dedup": op3_substring_dedup, "op4_top_products": op4_top_products, "op5_warc": op5_warc, "op6_language": op6_language, "op10_vector_dedup": op10_vector_dedup, "op7_token_store": op7_token_store, "op8_bpe": op8_bpe, "op9_mixing": op9_mixing}

_OP2 = """
WITH a AS (SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, string_split_regex(regexp_replace(body, '<br>|</?b>', ' ', 'g'), '</?(?:h1|p)>') AS parts FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(
  replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'),
  '\\\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM c
"""

_OP3 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
g AS (SELECT DISTINCT h.doc_id, unnest(range(i, i + 50)) AS j FROM h JOIN m ON h.h = m.h WHERE m.least < h.doc_id),
r AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, k: NOT list_contains(coalesce(gone, []), k)), ' ')) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""

_OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP5 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM o
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS most,
  ([3.0, 1.0, 2.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
p AS (SELECT *, (0.75::DOUBLE * sum(most) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, weight * coalesce((SELECT arg_min(level, most / weight) FROM p WHERE most > weight * level), 0)) AS target FROM s),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
r AS (SELECT *, target - copies * source_size AS spare FROM b),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (SELECT g.source, h, words, sum(words) OVER (PARTITION BY g.source ORDER BY h) AS upto, spare FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source),
e AS (SELECT source, min(h) FILTER (upto > spare) AS edge, arg_min(words, h) FILTER (upto > spare) AS words,
  any_value(spare) - coalesce(max(upto) FILTER (upto <= spare), 0) AS rest FROM c GROUP BY source)
SELECT doc_id, size, source_size, target,
  (copies + CASE WHEN edge IS NULL OR h < edge OR (h = edge AND words - rest < rest) THEN 1 ELSE 0 END)::BIGINT * size AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""

_OP10 = """
WITH RECURSIVE n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS id, vec_id AS root FROM n UNION SELECT l.v, reach.root FROM reach JOIN l ON l.u = reach.id),
c AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
k AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT n.vec_id, coalesce(k.n_links, 0)::BIGINT AS n_links, c.component_id, n.vec_id = c.component_id AS kept
FROM n JOIN c ON c.id = n.vec_id LEFT JOIN k ON k.u = n.vec_id
"""

ORACLE: dict[str, str] = {"op2_main_text": _OP2, "op3_substring_dedup": _OP3, "op4_top_products": _OP4, "op5_warc": _OP5, "op9_mixing": _OP9, "op10_vector_dedup": _OP10}
