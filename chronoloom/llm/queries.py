"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced, bpe, jaccard, langid, lm, packing, pfp_dedup, quality, secrets, toxicity
from .common import read

PACKING_TOKENIZER = "byte_bpe_50k.json"
ENCODING_RANKS = "byte_bpe_multi_50k.tiktoken"


def _crc(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = F.coalesce(_crc() % 4 == 2, F.lit(False))
    return langid.identify(docs, langid.fit(docs, ~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path(ENCODING_RANKS), public_tokenizers.PATTERN)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = F.coalesce(_crc() % 3 == 1, F.lit(False))
    labels = read(spark, sf_dir, "labels").where(~out)
    return toxicity.tag(docs, toxicity.fit(docs, labels)).select("doc_id", out.alias("held_out"), "score", "predicted")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return pfp_dedup.remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length("kept") + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_secret_scans, op3_language_id, op4_packing, op5_bpe, op6_toxicity, op7_topk, op8_suffix_dedup, op9_jaccard_join, op10_quality)}


#: Queries that SQL can express; the others are held against brute force, round trips and held-out rows in tests/llm.
ORACLE = {
    "op7_topk": """
WITH v AS (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS r, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.r <> a.r
), o AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5
""",
    # windows of 100 bytes as 200 hexadecimal digits; the first of equal ones in order of (doc_id, start) stays
    "op8_suffix_dedup": """
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS m
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS n FROM w) WHERE n > 1
), marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM later
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g
), cut AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM runs
), gone AS (
  SELECT c.doc_id, sum(c.b - c.a) AS removed, count(*) AS spans, max(c.b) AS last, string_agg(substr(d.h, CAST(2 * c.p + 1 AS BIGINT), CAST(2 * (c.a - c.p) AS BIGINT)), '' ORDER BY c.a) AS head
  FROM cut c JOIN d USING (doc_id) GROUP BY c.doc_id
)
SELECT d.doc_id AS doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(g.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(g.spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN g.doc_id IS NULL THEN d.h ELSE g.head || substr(d.h, CAST(2 * g.last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN gone g USING (doc_id)
""",
    "op9_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT r, doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0 AND doc_id IS NOT NULL
), n AS (
  SELECT r, doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS k FROM s
), x AS (
  SELECT r, unnest(s) AS g FROM s
), p AS (
  SELECT a.r AS a, b.r AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r
), links AS (
  SELECT p.a, p.b FROM p JOIN n a ON a.r = p.a JOIN n b ON b.r = p.b WHERE 5 * p.i >= 4 * (a.n + b.n - p.i)
), reach(a, b) AS (
  SELECT a, b FROM links
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), head AS (
  SELECT reach.a AS r, min(n.doc_id) AS head FROM reach JOIN n ON n.r = reach.b GROUP BY reach.a
), same AS (
  SELECT k, n, min(doc_id) AS text_class FROM n GROUP BY k, n
)
SELECT w.doc_id AS doc_id, CASE WHEN n.r IS NULL THEN w.doc_id ELSE least(n.doc_id, coalesce(h.head, n.doc_id)) END AS class_id, coalesce(same.text_class, w.doc_id) AS text_class,
       CAST((SELECT count(*) FROM links WHERE links.a = w.r) AS BIGINT) AS n_links
FROM w LEFT JOIN n ON n.r = w.r LEFT JOIN head h ON h.r = w.r LEFT JOIN same ON same.k = n.k AND same.n = n.n
""",
}
