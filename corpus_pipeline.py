"""Corpus pipeline: language, near duplicates, benchmark items, secrets, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its rows are
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruptura.llm import bpe, decontaminate, langid, secrets, simhash
from ruptura.llm.common import fresh_name, table
from ruptura.runtime import ensure_checkpoint_dir

#: Texts whose best language holds a smaller share of their n-grams are rejected.
LEAST_SCORE = 0.25
#: Words of a shingle, and the percentage of common shingles that makes two texts near duplicates.
SHINGLE, SIMILARITY = 5, 80


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and texts that resemble no learned language.

    The filter learns from the labelled rows of ``docs``; without any, nothing can be
    judged and all texts with letters stay. Other rows are returned unchanged.
    """
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    guess = fresh_name(docs, "guess")
    judged = docs.withColumn(guess, langid.predict(model, F.col("text")))
    known = (F.col(f"{guess}.lang") != langid.UNKNOWN) & (F.col(f"{guess}.score") >= LEAST_SCORE)
    return judged.where(known).drop(guess)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates.

    Texts are linked by fingerprints of their five-word shingles, and where four fifths of
    all shingles of two texts are common to both. Rows without id stay. Rows that repeat an id and its text are one document: one stays;
    other texts under its id stay with it.
    """
    groups = simhash.near_duplicates(docs.select("doc_id", "text"), size=SHINGLE, similarity=SIMILARITY)
    gone = groups.where("component_id is not null and doc_id <> component_id").select("doc_id").distinct()
    again = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    rows = docs.join(gone, "doc_id", "left_anti")
    if again.isEmpty():
        return rows.select(docs.columns)
    once = rows.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rows.join(again, "doc_id", "left_anti").unionByName(once).select(docs.columns)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; rows without id stay."""
    pairs = decontaminate.contained_items(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark and count the characters again; all rows stay."""
    model = secrets.fit(docs)
    clean = docs.withColumn("text", secrets.redact(F.col("text"), model))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every remaining text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language identification", keep_known_languages),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_items),
    ("secret scan", redact_secrets),
    ("byte-level BPE", encode),
]

#: Texts that travel to Python at a time: a worker holds several copies of them, which by default are 10,000.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000

#: SimHash, the random field and BPE merges are beyond SQL; tests/llm compares the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table, each written to the shared checkpoint folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    usual = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    finally:
        spark.conf.set(BATCH_SETTING, usual)
    return STAGES[-1][1](spark, docs, sf_dir)
