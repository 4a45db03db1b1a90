"""Near-duplicate call transcripts by the shares of their five-word shingles.

Two texts are linked when at least 0.8 of all their different shingles are in both. Candidates are
found twice. First come the texts whose SimHash fingerprints are linked (`simhash.links`, covering masks), which
are nearly all copies and join most of each group at little cost. Then come all texts that agree in one of
BANDS bands of ROWS minima of mixed shingle hashes, where a bucket still holds texts that are not joined: a pair at 0.8
misses all bands in one of twenty million cases, a more similar one yet less. Both kinds of candidates
are compared shingle by shingle.

Buckets hold keys only. The words of a text are fetched for the comparison, once for each unit it takes part in,
and shingles are never written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.graph import components
from riskloom.llm import simhash
from riskloom.llm.texts import arrow_rows, lowered_words, only
from riskloom.session import materialize

WORDS, SIMILARITY = 5, (4, 5)
BANDS, ROWS = 32, 4
# Members and bytes compared at once in one bucket; larger buckets are compared block against block.
BLOCK, BYTES = 512, 16 << 20
COLUMNS = 4096          # shingles of one matrix product
_rng = np.random.default_rng(42)
_ADD, _TIMES = (_rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the different shingles; a shorter text is one shingle of all its words."""
    parts, carry, seen = [], [], False
    for run in lowered_words(text):
        run = carry + run
        for at in range(0, max(0, len(run) - WORDS + 1), 1 << 16):
            part = run[at:at + (1 << 16) + WORDS - 1]
            parts.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*[part[i:] for i in range(WORDS)]))), np.uint64)))
            seen = True
        carry = run[-(WORDS - 1):] if seen else run
    return np.unique(np.concatenate(parts)) if seen else np.array([xxhash.xxh64_intdigest(b" ".join(carry))], np.uint64)


def bands_of(shingles: np.ndarray) -> list[int]:
    """One hash per band of the minima over the shingles."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 1 << 12):
        mixed = (shingles[at:at + (1 << 12), None] ^ _ADD) * _TIMES
        mixed = (mixed ^ mixed >> np.uint64(32)) * _TIMES
        low = np.minimum(low, mixed.min(axis=0))
    return [xxhash.xxh64_intdigest(b.tobytes()) - (1 << 63) for b in low.reshape(BANDS, ROWS)]


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share: products of 0-1 matrices, over shingles that occur twice at least."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    repeated = times[place] > 1
    owner, (_, place) = owner[repeated], np.unique(place[repeated], return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((len(sets), len(sets)))
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        low, high = np.searchsorted(place, [start, start + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[low:high], place[low:high] - start] = 1
        total += held @ held.T
    return total.astype(np.int64)


def similar_pairs(sets: list[np.ndarray]) -> np.ndarray:
    """Which two of the sets have at least SIMILARITY of their different shingles in both."""
    up, down = SIMILARITY
    both, sizes = common_counts(sets), np.array([len(x) for x in sets])
    return both * down >= up * (sizes[:, None] + sizes - both)


def majority(shingles: np.ndarray) -> int:
    """The SimHash fingerprint of the different shingles, as a signed number."""
    ones = np.zeros(simhash.BITS, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        bits = np.unpackbits(shingles[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.int64)[0])


def spanning(keys: list[int], roots: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between similar members that join all groups that similarity joins, no more than are needed.
    Members of one root are joined already."""
    near, own, left, found = similar_pairs(sets), np.array(roots, np.int64), np.ones(len(keys), bool), []
    while left.any():
        front = np.flatnonzero(left & (own == own[left.argmax()])).tolist()
        left[front] = False
        while front and left.any():
            at = front.pop()
            while (met := np.flatnonzero(near[at] & left)).size:
                found.append((keys[at], keys[met[0]]))
                joined = np.flatnonzero(left & (own == own[met[0]]))
                left[joined] = False
                front += joined.tolist()
    return found


def _compared(members: DataFrame, texts: DataFrame, every_pair: bool) -> DataFrame:
    """Links (a, b) between similar keys of one bucket, from members (t, k, key, root, size) and texts (key, words).

    Buckets of one root are left out, as are those with the same members as another one. Large buckets are cut into
    blocks by count and bytes. With `every_pair` each block meets every other one; otherwise each block is compared
    within itself and with the smallest key of the bucket.
    """
    sizes = members.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("key").alias("least"),
                                          F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("same"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    buckets = sizes.filter("r0 != r1").groupBy("n", "bytes", "least", "same").agg(F.min(F.struct("t", "k")).alias("b")).select(
        "b.t", "b.k", "least", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BYTES)).cast("int").alias("parts"))
    # Members and units repeat keys and roots, so their files are far smaller than their rows: Spark is not to send them by that size.
    placed = members.join(buckets.hint("merge"), ["t", "k"]).withColumn("own", F.pmod(F.xxhash64("key", "t"), F.col("parts")).cast("int"))
    blocks = F.sequence(F.lit(0), F.col("parts") - 1)
    met = blocks if every_pair else F.when(F.col("key") == F.col("least"), blocks).otherwise(F.array("own"))
    units = placed.select("t", "k", "key", "root", "own", F.explode(met).alias("other"))
    i, j = (F.least("own", "other"), F.greatest("own", "other")) if every_pair else (F.col("other"), F.lit(0))
    units = materialize(units.select("t", "k", i.alias("i"), j.alias("j"), "key", "root"), "shingle-units")
    wanted = texts.join(units.select("key").distinct(), "key", "left_semi")
    grouped = units.join(wanted.hint("merge"), "key").groupBy("t", "k", "i", "j").agg(F.collect_list(F.struct("key", "root", "words")).alias("members"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (own,), = arrow_rows(batch.slice(at, 1), "members")
                pairs = spanning([m["key"] for m in own], [m["root"] for m in own], [shingle_set(m["words"]) for m in own])
                a, b = zip(*pairs) if pairs else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return materialize(grouped.select("members").mapInArrow(compare, "a bigint, b bigint").distinct(), "shingle-links")


def near_copies(transcripts: DataFrame, transcript_id: str = "transcript_id", full_text: str = "full_text") -> DataFrame:
    """(transcript_id, component_id), one row per row of the input: the smallest id of those linked to it.

    Null, empty and blank texts are equal to each other. A null id takes part but is never a
    component_id unless its group has no other.
    """
    rows = only(transcripts, transcript_id=transcript_id, full_text=full_text).withColumn("text_key", F.xxhash64("full_text"))
    kind = rows.schema["transcript_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints, bands, sizes = [], [], [], []
            for (text,) in arrow_rows(batch, "full_text"):
                shingles = shingle_set(text)
                keys.append(xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63))
                prints.append(majority(shingles))
                bands.append(bands_of(shingles))
                sizes.append(8 * len(shingles) + len(text or ""))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in ("transcript_id", "text_key")], pa.array(keys, pa.int64()),
                 pa.array(prints, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64())],
                ["transcript_id", "text_key", "key", "fingerprint", "bands", "size"])

    found = materialize(rows.mapInArrow(run, f"transcript_id {kind}, text_key bigint, key bigint, fingerprint bigint, bands array<bigint>, size bigint"),
                        "shingle-keys")
    owners = materialize(found.groupBy("key").agg(*[f(c).alias(n) for f, c, n in (
        (F.min, "transcript_id", "least_id"), (F.min, "text_key", "text_key"), (F.first, "fingerprint", "fingerprint"), (F.first, "bands", "bands"),
        (F.max, "size", "size"))]), "shingle-owners")
    texts = rows.select("text_key", "full_text").join(owners.select("key", "text_key"), "text_key").groupBy("key").agg(F.first("full_text").alias("words"))

    # A bucket for every fingerprint: the keys that have it and those it is linked to.
    own = owners.select(F.col("fingerprint").alias("k"), "key", "size")
    linked = simhash.links(owners.select("fingerprint")).join(owners, F.col("b") == F.col("fingerprint")).select(F.col("a").alias("k"), "key", "size")
    first = _compared(own.unionByName(linked).select(F.lit(-1).alias("t"), "k", "key", F.col("key").alias("root"), "size"), texts, False)
    joined = components(first)
    keyed = owners.join(joined, F.col("key") == F.col("node"), "left").select("key", "size", F.coalesce("root", "key").alias("root"), "bands")
    keyed = materialize(keyed.select("key", "size", "root", F.posexplode("bands").alias("t", "k")), "shingle-buckets")
    stars = joined.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(stars.unionByName(_compared(keyed, texts, True)))

    rooted = owners.join(roots, F.col("key") == F.col("node"), "left").select("key", "least_id", F.coalesce("root", "key").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return found.select("transcript_id", "key").join(rooted.join(named, "root").select("key", "component_id"), "key").select(
        "transcript_id", "component_id")


def keep_one_per_group(transcripts: DataFrame, transcript_id: str = "transcript_id", full_text: str = "full_text") -> DataFrame:
    """The transcripts without those that have a near copy with a smaller id, as `simhash.keep_one_per_group`."""
    return simhash.keep_least(transcripts, near_copies(transcripts, transcript_id, full_text), transcript_id)
