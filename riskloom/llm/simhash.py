"""Near-duplicate call transcripts by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.graph import components
from riskloom.llm.texts import arrow_rows, free_names, lowered_words, only
from riskloom.session import materialize

BITS = 64
SEED = 42
# Members compared at once in one bucket; larger buckets are compared block against block.
BLOCK = 1024


def fingerprint(text: str | None, words: int = 4) -> int:
    """64 majority bits over the XXH64 of all word shingles, repeats included; 0 without words."""
    ones, total, carry = np.zeros(BITS, np.int64), 0, []
    for run in lowered_words(text):
        run = carry + run
        for at in range(0, max(0, len(run) - words + 1), 1 << 16):
            part = run[at:at + (1 << 16) + words - 1]
            shingles = map(b" ".join, zip(*[part[i:] for i in range(words)]))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(hashes)
        carry = run[-(words - 1):] if total else run
    if not total and carry:
        total, value = 1, xxhash.xxh64_intdigest(b" ".join(carry), SEED)
        ones = np.array([(value >> i) & 1 for i in range(BITS)])
    return sum(1 << i for i in range(BITS) if 2 * int(ones[i]) > total)


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprints(transcripts: DataFrame, transcript_id: str = "transcript_id", full_text: str = "full_text",
                 words: int = 4) -> DataFrame:
    """(transcript_id, fingerprint as a signed 64-bit number), one row per row of the input."""
    rows = only(transcripts, transcript_id=transcript_id, full_text=full_text)
    kind = rows.schema["transcript_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(text, words)) for (text,) in arrow_rows(batch, "full_text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())],
                                             ["transcript_id", "fingerprint"])

    return rows.mapInArrow(run, f"transcript_id {kind}, fingerprint bigint")


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1)-1 bit masks of which, for any `radius` positions, at least one avoids them all.

    Position i gets a non-zero vector of radius+1 bits; mask v selects the positions whose vector
    has an odd product with v. `radius` vectors cannot span radius+1 dimensions, so some v is
    orthogonal to all of them: two values that differ in these positions agree under that mask.
    """
    size = (1 << (radius + 1)) - 1
    vectors = [i % size + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if bin(vectors[i] & v).count("1") & 1) for v in range(1, size + 1)]


def _spanning(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs within the radius: as many components, no more links."""
    left, found = np.arange(len(values)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= radius
            found += [(_signed(int(values[at])), _signed(int(values[x]))) for x in left[near]]
            front += list(left[near])
            left = left[~near]
    return found


def links(prints: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different fingerprints whose components are those of all pairs within the radius.

    Each fingerprint goes to one bucket per covering mask. Buckets of one are left out; buckets of
    more than `block` members are compared block against block, each pair of blocks a unit of its
    own, so no task ever holds a whole large bucket and no pair is missed.
    """
    masks = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("k"))
                      for t, m in enumerate(covering_masks(radius))])
    keyed = prints.select("fingerprint").distinct().select("fingerprint", F.inline(masks))
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    # Spark takes `keyed` to be as large as the fingerprints, which it holds once per mask, and would send it to the driver.
    placed = keyed.join(sizes.hint("merge"), ["t", "k"]).withColumn("parts", parts)
    placed = placed.withColumn("own", F.pmod(F.xxhash64("fingerprint", "t"), F.col("parts")).cast("int"))
    placed = placed.select("t", "k", "fingerprint", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    units = placed.groupBy("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list("fingerprint").alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {pair for (members,) in arrow_rows(batch, "members")
                     for pair in _spanning(np.array(members, np.int64).view(np.uint64), radius)}
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return units.select("members").mapInArrow(run, "a bigint, b bigint")


def near_duplicate_transcripts(transcripts: DataFrame, transcript_id: str = "transcript_id",
                               full_text: str = "full_text", radius: int = 4, words: int = 4) -> DataFrame:
    """(transcript_id, fingerprint, component_id): component_id is the smallest transcript_id that can be
    reached over links of at most `radius` differing bits, the transcript itself included.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Repeated rows give
    repeated rows. A null id takes part but is never a component_id unless its group has no other.
    Other columns of the input are ignored. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(transcripts, transcript_id, full_text, words), "fingerprints")
    owners = prints.groupBy("fingerprint").agg(F.min("transcript_id").alias("least_id"))
    roots = components(links(prints, radius))
    rooted = owners.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = rooted.join(named, "root").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select("transcript_id", "fingerprint", "component_id")


def keep_one_per_group(transcripts: DataFrame, transcript_id: str = "transcript_id", full_text: str = "full_text",
                       radius: int = 4, words: int = 4) -> DataFrame:
    """The transcripts without those that have a near duplicate with a smaller id; all columns stay.

    Rows that share an id are one document and stay together unless they are equal rows, of which
    one stays. Rows with a null id are kept.
    """
    return keep_least(transcripts, near_duplicate_transcripts(transcripts, transcript_id, full_text, radius, words), transcript_id)


def keep_least(transcripts: DataFrame, groups: DataFrame, transcript_id: str) -> DataFrame:
    """The transcripts whose component_id in `groups` (transcript_id, component_id) is their own id."""
    groups = materialize(groups.groupBy("transcript_id").agg(
        F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "groups")
    key, (other,) = F.col(f"`{transcript_id}`"), free_names(transcripts, "other_id")
    rejected = groups.filter("component_id < transcript_id").select(F.col("transcript_id").alias(other))
    kept = transcripts.join(rejected, key == F.col(f"`{other}`"), "left_anti")
    repeated = groups.filter("n > 1 AND transcript_id IS NOT NULL").select(F.col("transcript_id").alias(other))
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, key == F.col(f"`{other}`"), "left_anti")
    return once.unionByName(kept.join(repeated, key == F.col(f"`{other}`"), "left_semi").distinct())
