"""Queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datalotus.llm import bpe_codec, exact_dedup, language_id, mixing, near_dedup, pii, quality, token_counts, topk, warc
from datalotus.llm.common import read

TOKENIZER = "byte_bpe_50k.json"
#: The session's setting for the secret of surrogates; synthetic documents need none.
PII_KEY, OPEN_KEY = "spark.datalotus.pii.key", "synthetic documents"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def capture_log(pages: DataFrame) -> DataFrame:
    """A crawl's records made from every page: its full response, and a later
    not-modified visit of the same URL whose validators agree, disagree or lack."""
    kept = F.col("page_id").isNotNull()
    tag, base = F.md5(F.col("html").cast("binary")), F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.col("page_id") * 7919, F.lit(86_400)))
    since = F.lit("Tue, 14 Nov 2023 22:13:20 GMT")
    kind7 = F.pmod("page_id", F.lit(7))
    # tag and digest first, without the text, so that pages are read into few bytes
    slim = pages.where(kept).select("page_id", "url", tag.alias("tag"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    full = slim.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("uri"), base.alias("date"),
        F.when(F.pmod("page_id", F.lit(5)) != 4, F.concat(F.lit('"'), "tag", F.lit('"'))).alias("etag"), since.alias("last_modified"), "digest",
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("server"), F.lit("a")).alias("headers"),
    )
    again = slim.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.col("url").alias("uri"), (base + F.make_dt_interval(mins=F.pmod("page_id", F.lit(97)).cast("int") - 3)).alias("date"),
        F.when(kind7 == 1, F.lit('"other"')).when(kind7 != 2, F.concat(F.lit('W/"'), "tag", F.lit('"'))).alias("etag"),
        F.when(kind7 == 3, F.lit("Wed, 15 Nov 2023 22:13:20 GMT")).when(kind7 != 2, since).alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("cache-control"), F.lit("max-age=90"), F.lit("server"), F.lit("b")).alias("headers"),
    )
    return full.unionByName(again)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.resolve_revisits(capture_log(read(spark, sf_dir, "pages")))
    return done.select("record_id", "canonical", "refers_to", "status", "digest", F.element_at("headers", F.lit("cache-control")).alias("cache_control"), F.element_at("headers", F.lit("server")).alias("server"), F.element_at("headers", F.lit("content-type")).alias("content_type"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(read(spark, sf_dir, "documents")).drop("text_hash")


def op5_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assign(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digest(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantise(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(50)) == 0), 5)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents"), spark.conf.get(PII_KEY, OPEN_KEY)).select("doc_id", "text", "n_entities")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_quality_classifier, op3_warc_revisits, op4_minhash_near_dedup, op5_curriculum_mixing, op6_bpe_codec, op7_exact_top_k, op8_language_id, op9_pii_surrogates, op10_token_counts)}

SQL: dict[str, str] = {}

SQL["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

SQL["op3_warc_revisits"] = r"""
WITH b AS (SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
c AS (SELECT page_id, md5(html) AS tag, sha256(html) AS digest,
  lower(regexp_replace(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?@]*@)?([^/?]*)', 1), ':(80|443)$', '')) AS host,
  regexp_replace(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)', 1), '/+$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
    lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(sid|sessionid|phpsessid|jsessionid|utm_[a-z]+|ref)='))), '&') AS q FROM b),
k AS (SELECT page_id, tag, digest, host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical,
  1700000000 + page_id * 7919 % 86400 AS t FROM c),
r AS (
  SELECT page_id * 2 AS record_id, true AS is_full, canonical, t, CASE WHEN page_id % 5 <> 4 THEN '"' || tag || '"' END AS etag, 'a' AS lm, digest FROM k
  UNION ALL
  SELECT page_id * 2 + 1, false, canonical, t + (page_id % 97 - 3) * 60, CASE WHEN page_id % 7 = 1 THEN '"other"' WHEN page_id % 7 <> 2 THEN 'W/"' || tag || '"' END,
    CASE WHEN page_id % 7 = 3 THEN 'b' WHEN page_id % 7 <> 2 THEN 'a' END, NULL FROM k),
f AS (SELECT *, last_value(CASE WHEN is_full THEN record_id END IGNORE NULLS) OVER (PARTITION BY canonical ORDER BY t, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS refers_to FROM r),
j AS (SELECT f.record_id, f.canonical, f.refers_to, g.digest,
  CASE WHEN f.refers_to IS NULL THEN 'no_response'
    WHEN regexp_replace(f.etag, '^W/', '') <> g.etag THEN 'etag_mismatch'
    WHEN (f.etag IS NULL OR g.etag IS NULL) AND f.lm <> g.lm THEN 'modified_mismatch'
    WHEN (f.etag IS NULL OR g.etag IS NULL) AND f.lm IS NULL THEN 'no_validator' ELSE 'resolved' END AS status
  FROM f LEFT JOIN r g ON g.record_id = f.refers_to WHERE NOT f.is_full)
SELECT record_id, canonical, refers_to, status, CASE WHEN status = 'resolved' THEN digest END AS digest,
  CASE WHEN status = 'resolved' THEN 'max-age=90' END AS cache_control, CASE WHEN status = 'resolved' THEN 'a' END AS server,
  CASE WHEN status = 'resolved' THEN 'text/html' END AS content_type
FROM j"""

SQL["op4_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w),
n AS (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e2.b, reach.root FROM reach JOIN e2 ON e2.a = reach.id)
SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id, n.doc_id = min(root) AS kept FROM n JOIN reach ON reach.id = n.doc_id GROUP BY n.doc_id, n.n"""

SQL["op5_curriculum_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
t AS (SELECT *, (i % 3 + 1)::DOUBLE AS w, (i % 3 - 1) * 0.5::DOUBLE AS ramp, 3.0::DOUBLE * source_size AS most, (sum(source_size) OVER ())::DOUBLE AS total, sum(i % 3 + 1) OVER () AS all_w FROM s),
u AS (SELECT *, most < w * (total - coalesce(sum(most) OVER b, 0)) / (all_w - coalesce(sum(w) OVER b, 0)) AS capped FROM t WINDOW b AS (ORDER BY most / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CASE WHEN capped THEN most ELSE least(most, w * (total - sum(CASE WHEN capped THEN most ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()) END AS target FROM u),
x AS (SELECT d.*, v.source_size, v.target, v.ramp, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source),
y AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM x),
z AS (SELECT *, CASE WHEN source_size > 0 THEN least(epochs + CASE WHEN target - epochs * source_size > 0 AND 2 * start + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END, 3) ELSE 0 END AS copies FROM y),
q AS (SELECT *, CASE WHEN copies > 0 THEN least(greatest((2 * start + size) / (2.0::DOUBLE * target), 0), 1) END AS u FROM z)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, 2.0::DOUBLE * u / ((1 - ramp) + sqrt((1 - ramp) * (1 - ramp) + 4.0::DOUBLE * ramp * u)) AS position FROM q"""

SQL["op7_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
