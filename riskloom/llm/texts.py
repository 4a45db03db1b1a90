"""Words of very long texts in bounded pieces, shared by the operators of this package."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = re.compile(r"[\x20\x09-\x0D]")
PIECE = 1 << 20

# The characters of a word, as a Java and DuckDB class.
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Consecutive parts of a text, cut before a blank; their concatenation is the text."""
    start = 0
    while len(text) - start > size:
        cut = BLANK.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def lowered_words(text: str | None) -> Iterator[list[bytes]]:
    """UTF-8 words between ASCII blanks with A-Z lower-cased, piece by piece; a null has none."""
    for piece in pieces(text or ""):
        yield piece.encode("utf-8", "replace").lower().split()


def arrow_rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names])


def remainder(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names, whatever else the table holds."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes to differ from all columns of the table."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return found
