"""A training-data pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and gives a table that is written as
Parquet and read again as the next one's documents.  All but the last return
the columns of documents.  Rows with a null id pass the stages that decide by
id, as they can't be told apart; empty tables pass as empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, langid, pii, simhash
from tessera.llm.common import ensure_checkpoint_dir, fold, table
from tessera.sources import files

#: A language with a lower score isn't clear.
SURE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or of no clear language; a missing language is filled in."""
    model = langid.train(docs.where(fold(F.col("doc_id"), 4) != 2), "text", "lang")
    told = langid.identify(docs.select(*COLUMNS), model)
    sure = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE)
    return told.where(sure).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id, once."""
    groups = simhash.near_duplicates(docs, width=5, similarity=0.8)
    # a few long rows for each id: what goes, and ids that occur more than once
    ids = groups.groupBy("doc_id").agg(F.min("component_id").alias("root"), F.count("*").alias("n"))
    kept = docs.select(*COLUMNS).join(ids.where("doc_id > root").select("doc_id"), "doc_id", "left_anti")
    repeated = ids.where("n > 1 and doc_id = root").select("doc_id")
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that have a benchmark question, in its own words or with other names and numbers."""
    hits = decontaminate.matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(*COLUMNS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars is the length of what is left."""
    out = pii.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and the length of the text they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    both = bpe.bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), path, keep=["doc_id", "lang", "source"])
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.length("decoded").cast("long").alias("n_decoded"))


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("pii", redacted),
    ("bpe", tokenised),
]

#: SQL has neither the classifier nor the fingerprints' groups.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what lies between them goes to the shared checkpoint folder, and goes away once the next stage is written."""
    ensure_checkpoint_dir(spark)
    folder, before = files.scratch(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            files.delete(spark, before)
        before = path
    return docs
