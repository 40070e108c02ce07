"""Corpus pipeline over `documents`: five stages, each written as Parquet and reread by the next.

Every stage works on all rows its predecessor kept. Models are fitted on the stage's own input. Null and empty
texts have no letter, so the first stage rejects them; rows without doc_id take part like others. Repeated rows are
copies, of which the second stage keeps one. Very long texts go through every stage whole; from an empty table every
stage makes an empty one. Columns besides those of documents are kept up to the last stage, whatever their names.

Each stage begins with asking the executors to return memory of the one before: its Python workers stand beside the
JVM's heap, which otherwise stays as large as it ever was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import byte_bpe, decontaminate, language, near_dup, pii
from strata.llm.common import give_back, prefix, shared_dir, table

#: A document whose best label has less than this pooled probability is rejected (as is one without any letter).
LEAST_SCORE = 0.3


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language; lang becomes the recognised one where it was null."""
    give_back(spark)
    guess = language.predict(language.fit(docs), F.col("text").cast("string"))
    own = prefix(docs)
    kept = docs.withColumn(own, guess).where((F.col(f"{own}.lang") != language.UND) & (F.col(f"{own}.score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce(F.col("lang"), F.col(f"{own}.lang"))).select(docs.columns)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: the one with the smallest doc_id."""
    give_back(spark)
    return near_dup.deduplicate(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    give_back(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents").select(docs.columns)


def _personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts kinds in angle brackets in the place of personal data; n_chars follows the text."""
    give_back(spark)
    masked = docs.withColumn("text", pii.redact(pii.fit(docs), F.col("text").cast("string")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian uint32) and the digest of the decoded bytes."""
    give_back(spark)
    path = byte_bpe.default_path()
    out = byte_bpe.decode(byte_bpe.encode(docs, path, keys=("doc_id", "lang", "source")), path)
    return out.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", _language),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontaminate),
    ("personal_data", _personal_data),
    ("byte_bpe", _encode),
]

#: Trained models and byte-level BPE have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
