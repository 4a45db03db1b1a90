"""The corpus pipeline: documents in, token rows of the chosen mixture out."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontamination, mixing, queries, shingles, toxicity
from riskloom.session import shared_folder

# Every chosen document is used once, so the texts of the result stay free of copies.
EPOCHS, FRACTION, SEED = 1, (3, 4), "pipeline"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents predicted to be toxic."""
    labels = queries.read(spark, sf_dir, "labels")
    return toxicity.without_toxic(docs, labels, labelled_id="doc_id", **queries.DOCUMENT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 of their five-word shingles), that with the smallest id."""
    return shingles.keep_one_per_group(docs, **queries.DOCUMENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold too much of the benchmark."""
    return decontamination.without_contaminated(docs, queries.read(spark, sf_dir, "benchmark"), complaint_id="item_id",
                                                description="text", **queries.DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three quarters of the tokens, dealt to domains, languages and sources by weight."""
    chosen = mixing.mix_transcripts(docs, queries.mix_weights(spark), fraction=FRACTION, epochs=EPOCHS, seed=SEED, **queries.mix_columns())
    mixed = mixing.take_chosen(docs, chosen, **queries.mix_columns())
    return mixed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents left, read back: one row per document."""
    return queries.token_rows(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("mixing", mix_sources), ("token_files", write_tokens)]

# Learned scores, fingerprints and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    folder = os.path.join(shared_folder(spark), "riskloom", f"pipeline-{uuid.uuid4().hex}")
    docs = queries.read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = os.path.join(folder, f"{number}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
