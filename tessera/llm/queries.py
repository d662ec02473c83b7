"""Registered queries of the corpus operators (``opN_<name>``) and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, html, langid, media, pii, ppm, quality, simhash, substrings
from tessera.llm.common import fold, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    counts = [pii.count(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    digest = F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256")
    keys = F.size("secrets").cast("long").alias("n_secret")
    return found.select("doc_id", *counts, digest, pii.listed(F.col("spans")).alias("spans"), keys, pii.listed(F.col("secrets")).alias("secrets"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) != 0)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = fold(F.col("doc_id"), 4)
    model = langid.train(docs.where(part != 2), "text", "lang")
    out = langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (part == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3)
    model = quality.train(docs, table(spark, sf_dir, "labels").where(part != 1))
    out = quality.score(docs, model)
    return out.select("doc_id", (part == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeated(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("items", F.array_join("items", ","))


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store(table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op10_query(spark, sf_dir)


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell about op1_pii: the base spans' numbers."""
    return op1_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in pii.KINDS))


def lm_unigram_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell about op2_ppm: all but the model's score."""
    out = op2_ppm(spark, sf_dir)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_ppm": op2_ppm,
    "op3_langid": op3_langid,
    "op5_quality": op5_quality,
    "op4_substrings": op4_substrings,
    "op6_simhash": op6_simhash,
    "op7_decontaminate": op7_decontaminate,
    "op8_ogg_media": op8_ogg_media,
    "op9_html": op9_html,
    "op10_bpe": op10_bpe,
    "pii_base_counts": pii_base_counts,
    "lm_unigram_base": lm_unigram_base,
}

#: crc32 of an id as text, byte by byte and bit by bit.
_CRC = (
    "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
    "lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"
)

ORACLE: dict[str, str] = {
    "op4_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
r AS (SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k,
      count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n FROM p),
f AS (SELECT k, min(doc_id) AS m FROM r WHERE n = 13 GROUP BY k),
b AS (SELECT r.doc_id, r.i FROM r JOIN f USING (k) WHERE r.n = 13 AND f.m < r.doc_id),
c AS (SELECT DISTINCT doc_id, i + d AS i FROM b, (SELECT unnest(range(0, 13)) AS d)),
g AS (SELECT p.doc_id, count(c.i) AS gone, string_agg(CASE WHEN c.i IS NULL THEN p.word END, ' ' ORDER BY p.i) AS kept FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON w.doc_id = g.doc_id
""",
    "pii_base_counts": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS i,
      list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS c,
      list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS p FROM d)
SELECT doc_id, CAST(len(e) AS BIGINT) AS n_email,
  CAST(len(list_filter(i, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: CAST(y AS HUGEINT))) <= 255)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(c, lambda x: len(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(len(x)), lambda k: CASE WHEN k % 2 = 0 THEN CAST(x[len(x) - k] AS INT)
    ELSE 2 * CAST(x[len(x) - k] AS INT) - CASE WHEN CAST(x[len(x) - k] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(p, lambda x: len(x) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone FROM m
""",
    "lm_unigram_base": rf"""
WITH d AS (SELECT doc_id, {_CRC} % 10 = 0 AS held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, held_out, unnest(list_append(ws, '')) AS w FROM d),
c AS (SELECT w, count(*) AS n FROM t WHERE NOT held_out GROUP BY w),
s AS (SELECT coalesce(sum(n), 0) AS total, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(n) AS n_known, CAST(max(total) AS BIGINT) AS train_tokens,
  round(sum(log10((coalesce(n, 0) + 0.1) / (total + 0.1 * (v + 1)))), 6) AS base_score FROM t LEFT JOIN c USING (w), s GROUP BY doc_id, held_out
""",
}
