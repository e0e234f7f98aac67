"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, then packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of `documents`, and any further ones whatever their names; n_chars follows a changed
text. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm import decontamination, packing, secrets, simhash, toxicity
from locusflow.llm.session import shared_folder


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go.

    A null, empty or wordless text scores 0 and stays; equal texts score alike and go or stay together,
    whatever their keys; without labels of both kinds, or without rows, nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents similar in 0.8 of their five-word shingles or more, the smallest doc_id stays.

    Fingerprints within a loose bound come from the Gray-order index, and their shingle sets are compared whole.
    Links reach over others: a group is a component. Null and empty texts are one group, so the
    smallest of them stays; rows of equal doc_id and text stay or go together; a row without a doc_id
    stays where no row with one is like it.
    """
    return simhash.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items leave the texts; documents that hold nothing else go.

    Null and empty texts hold no passage and stay; a passage leaves each text that holds it, copies
    alike; items without words, or no items, change nothing.
    """
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _recounted(decontamination.remove_spans(docs, bench))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays. Null and empty texts stay as they are."""
    return _recounted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece.

    A null or empty text is one piece, its closing id; repeated rows are packed once each.
    """
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Models, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    """Removes a stage's folder from whatever store holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over `documents`, each written as Parquet to the shared folder and read again.

    A stage's folder goes once its successor is written; the last one's holds the result.
    """
    base = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            _remove(spark, before)
        before = f"{base}/{name}"
    return docs
