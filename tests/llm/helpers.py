"""Odd transcripts that every operator of this package has to take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

CLASHING = ("word", "n", "fingerprint", "part", "tokens", "a", "b", "toxic", "score", "k", "t", "at", "start", "items", "budget", "h", "copy", "number",
            "taken", "key0", "key1", "other_id", "toxic_id", "bad_id", "bad_key", "_copy", "_number", "_taken", "_tokens", "_key", "_key0", "_bad", "_toxic",
            "_rejected", "_repeated", "key", "text_key", "size", "bands", "root", "component_id", "epoch", "row", "drawn", "value", "path", "content", "predicted",
            "contaminated", "h1", "h2", "words", "n_words", "piece", "file")


def with_clashes(df: DataFrame) -> DataFrame:
    """The table with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


def transcripts(spark: SparkSession, rows, extra: bool = True) -> DataFrame:
    """(transcript_id, full_text) rows, spread over several partitions."""
    df = spark.createDataFrame([tuple(r) for r in rows], "transcript_id bigint, full_text string").repartition(3)
    return with_clashes(df) if extra else df


def odd_rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = [a + b for a in ("la", "te", "mor", "Si", "cu", "ña") for b in ("ra", "No", "ple", "ti", "xu")]
    long_text = " ".join(rng.choice(words) for _ in range(30_000))
    return [(1, None), (2, ""), (3, " \t\n\r "), (4, "uno"), (5, "uno dos\tTRES"), (6, long_text), (7, long_text + " fin"), (8, "Hola señor 5555 @ a@b.co \U0001F600 fin"),
            (9, "uno dos tres cuatro cinco"), (9, "uno dos tres cuatro cinco"), (None, "sin clave"), (10, "x" * 200_000)]


def empty(spark: SparkSession) -> DataFrame:
    return with_clashes(spark.createDataFrame([], "transcript_id bigint, full_text string"))
