"""Complaints of an evaluation set found inside call transcripts, by a prefix-filtered set join.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.texts import free_names, only
from riskloom.session import materialize, materialize_counted
from riskloom.operators.scaling import small_side

WINDOW = 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: everything between words; ASCII letters, digits and all of U+0080 and above are words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z only; `lower` does the same for texts without other letters and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Words with their case; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda w: w != "")


def item_windows(complaints: DataFrame, complaint_id: str, description: str) -> DataFrame:
    """(complaint_id, window): every run of WINDOW words of an item, or all its words if it has fewer."""
    words = F.transform(words_of(F.col("description")), lower_ascii)
    rows = only(complaints, complaint_id=complaint_id, description=description).select("complaint_id", words.alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))
    return (rows.filter(F.size("w") > 0).select("complaint_id", "w", F.explode(starts).alias("s"))
                .select("complaint_id", F.slice("w", F.col("s"), F.lit(WINDOW)).alias("window")).distinct())


BLOCK = 64
NOTHING = ""            # stands for a transcript itself among its words


def _blocks(texts: DataFrame) -> DataFrame:
    """The words of each transcript in blocks with the words around them (so that what a row carries
    has a fixed size): `first` is the place of the block, `low` that of its array's first word."""
    first = lambda b: b * BLOCK                                                          # noqa: E731
    low = lambda b: F.greatest(first(b) - (WINDOW - 1), F.lit(0))                        # noqa: E731
    own = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("words") / BLOCK).cast("int"), F.lit(1)) - 1), lambda b: F.struct(
        first(b).alias("first"), low(b).alias("low"),
        F.concat(F.slice("words", low(b) + 1, first(b) - low(b) + BLOCK + WINDOW - 1),
                 F.when(b == 0, F.array(F.lit(NOTHING))).otherwise(F.array().cast("array<string>"))).alias("near")))
    return texts.select("transcript_id", "text_key", F.size("words").alias("n_words"), F.inline(own))


def _stream(blocks: DataFrame) -> DataFrame:
    """One row per word (word, at), and one row with NOTHING per transcript."""
    rows = blocks.select("*", F.posexplode("near").alias("place", "raw"))
    rows = rows.withColumns({"word": lower_ascii(F.col("raw")), "at": F.col("low") + F.col("place")})
    return rows.filter((F.col("raw") == NOTHING) | ((F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + BLOCK))).drop("raw", "place")


def contamination(transcripts: DataFrame, complaints: DataFrame, transcript_id: str = "transcript_id",
                  full_text: str = "full_text", complaint_id: str = "complaint_id", description: str = "description"
                  ) -> DataFrame:
    """One row per transcript: transcript_id, text_key, n_words, n_hit, items (sorted ids as text), contaminated.

    A word is hit when it lies inside an occurrence of a window of an item; contaminated means
    n_hit > 0 and 20 * n_hit >= n_words.

    The tokens of each window are ordered by their frequency in all transcripts. Containment needs
    all of them, so the necessary prefix is the rarest token: only where a transcript has it can the
    window occur. Its place in the window fixes the one possible start; bounds on start and length
    are checked before the words themselves are compared. Nothing is shuffled but the occurrences.

    Null and blank texts have no words; items without words are ignored; equal items count each;
    repeated transcripts are repeated in the result. Other columns are ignored; an empty table of
    items leaves every transcript without hits.
    """
    items = materialize(item_windows(complaints, complaint_id, description), "item-windows")
    words, n_words = materialize_counted(items.select(F.explode("window").alias("word")).distinct(), "item-words")
    texts = only(transcripts, transcript_id=transcript_id, full_text=full_text).select(
        "transcript_id", F.xxhash64("full_text").alias("text_key"), words_of(F.col("full_text")).alias("words"))

    blocks = _blocks(texts)
    seen = _stream(blocks).join(small_side(words, n_words), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarity = words.join(seen, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    windows = items.groupBy("window").agg(F.array_sort(F.collect_set(F.col("complaint_id").cast("string"))).alias("items"))
    placed = windows.select("window", "items", F.posexplode("window").alias("offset", "word")).join(rarity, "word")
    prefix = placed.groupBy("window").agg(F.min(F.struct("n", "word", "offset")).alias("rarest"), F.first("items").alias("items"))
    prefix = prefix.select(F.col("rarest.word").alias("word"), F.col("rarest.offset").alias("offset"), "window", "items")
    own = transcripts.sparkSession.range(1).select(
        F.lit(NOTHING).alias("word"), F.lit(0).alias("offset"), F.lit(None).cast("array<string>").alias("window"), F.lit(None).cast("array<string>").alias("items"))
    prefix, n_prefix = materialize_counted(prefix.unionByName(own), "prefix")

    size = F.size("window")
    start = F.col("at") - F.col("offset")
    met = _stream(blocks).join(small_side(prefix, n_prefix), "word")
    fits = (start >= 0) & (start + size <= F.col("n_words")) & (
        F.transform(F.slice("near", F.greatest(start - F.col("low"), F.lit(0)) + 1, size), lower_ascii) == F.col("window"))
    found = met.filter((F.col("word") == NOTHING) | fits).select(
        "transcript_id", "text_key", "n_words", (F.col("word") == NOTHING).alias("own"),
        F.when(F.col("word") != NOTHING, F.struct(start.alias("from"), (start + size).alias("to"))).alias("span"), "items")
    grouped = found.groupBy("transcript_id", "text_key", "n_words").agg(
        F.count_if("own").alias("copies"), F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["to"] - F.greatest(s["from"], a["end"]), F.lit(0))).cast("bigint").alias("n"),
                              F.greatest(a["end"], s["to"]).alias("end")))["n"]
    result = grouped.withColumn("n_hit", covered).select(
        "transcript_id", "text_key", F.col("n_words").cast("bigint").alias("n_words"), "n_hit", "items",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "copies")
    return result.select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy", "copies")


def without_contaminated(transcripts: DataFrame, complaints: DataFrame, transcript_id: str = "transcript_id",
                         full_text: str = "full_text", complaint_id: str = "complaint_id", description: str = "description"
                         ) -> DataFrame:
    """The transcripts that are not contaminated, with all their columns; rows with a null id are judged alike."""
    judged = contamination(transcripts, complaints, transcript_id, full_text, complaint_id, description)
    own_id, own_key = free_names(transcripts, "bad_id", "bad_key")
    bad = judged.filter("contaminated").select(F.col("transcript_id").alias(own_id), F.col("text_key").alias(own_key)).distinct()
    same = F.col(f"`{transcript_id}`").eqNullSafe(F.col(f"`{own_id}`")) & (F.xxhash64(F.col(f"`{full_text}`")) == F.col(f"`{own_key}`"))
    return transcripts.join(bad, same, "left_anti")
