"""Content hashes of tables that can be added up.

A row is hashed by SHA-256 and the digest taken as eight numbers of 32 bits; the sums of these numbers over all rows,
with the number of rows, stand for the rows as a multiset. So partitions and parts of a table can be summed
apart, rows can be added to a table or taken away without reading it again, and the order never matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 8
SUMS = ["rows", *[f"lane{i}" for i in range(LANES)]]


def row_text(df: DataFrame) -> Column:
    """A text that determines the row: each value in the order of the column names, with its length in front."""
    parts = []
    for c in sorted(df.columns):
        value = F.col(f"`{c}`").cast("string")
        parts.append(F.coalesce(F.concat(F.char_length(value).cast("string"), F.lit(":"), value), F.lit("~")))
    return F.concat(*parts)


def content_sums(df: DataFrame) -> DataFrame:
    """One row: the number of rows and the sums of the eight parts of their digests."""
    digest = df.select(F.sha2(row_text(df).cast("binary"), 256).alias("d"))
    lane = [F.sum(F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")) for i in range(LANES)]
    zero = F.lit(0).cast("decimal(38,0)")
    return digest.agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("rows"),
                      *[F.coalesce(s.cast("decimal(38,0)"), zero).alias(f"lane{i}") for i, s in enumerate(lane)])


def combined(*sums: DataFrame) -> DataFrame:
    """The sums of the union of several tables."""
    rows = sums[0]
    for other in sums[1:]:
        rows = rows.unionByName(other)
    return rows.agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in SUMS])


def without(sums: DataFrame, removed: DataFrame) -> DataFrame:
    """The sums of a table after rows of it, given by their own sums, are taken away."""
    return combined(sums, removed.select(*[(-F.col(c)).cast("decimal(38,0)").alias(c) for c in SUMS]))


def fingerprint_of(sums: DataFrame) -> DataFrame:
    """One row `fingerprint`: 16 hexadecimal digits of the sums."""
    joined = F.concat_ws("#", *[F.col(c).cast("string") for c in SUMS])
    return sums.select(F.left(F.sha2(joined.cast("binary"), 256), F.lit(16)).alias("fingerprint"))


def fingerprint(df: DataFrame) -> DataFrame:
    return fingerprint_of(content_sums(df))
