"""Fill-in-the-middle training texts from call transcripts, cut at lines by SWAR words.

A line of a transcript is a turn of speech. The UTF-8 bytes of many texts are viewed together as
64-bit words. Arithmetic on a word marks the high bit of each byte that ends a line; the marks are
counted per word and the counts summed up, so that the k-th end is found by a binary search for its word
and then by its place among the (at most eight) marks of that word. Code points are counted in the
same way from marks at the bytes that begin one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.texts import arrow_rows, only

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = ("plain", "psm", "spm")
HELD = 1 << 23          # bytes of texts that are viewed at once; a longer text is alone

_LOW7, _HIGH1 = (np.uint64(0x0101010101010101 * b) for b in (0x7F, 0x80))
# Place of the k-th marked byte among the eight of a word, by the marks as a number of eight bits.
_SELECT = np.array([[([i for i in range(8) if m >> i & 1] + [8] * 8)[k] for k in range(8)] for m in range(256)], np.uint8)


class Marks:
    """Marked bytes of a buffer, one bit each, with the number of marks before each word."""

    def __init__(self, marks: np.ndarray):
        self.marks = np.append(marks, np.uint64(0))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before byte `at`."""
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << np.uint64(8) * inside) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Place of the marked byte with k marked bytes before it."""
        word = np.searchsorted(self.before, k, "right") - 1
        # The marks stand eight bits apart; the product brings them together in the highest byte.
        together = (self.marks[word] >> np.uint64(7)) * np.uint64(0x0102040810204080) >> np.uint64(56)
        return 8 * word + _SELECT[together.astype(np.int64), k - self.before[word]]


def as_words(data: bytes) -> np.ndarray:
    """The bytes as little-endian 64-bit words, filled up with zeros."""
    return np.frombuffer(data + bytes(-len(data) % 8), "<u8")


def line_ends(words: np.ndarray, end: bytes = b"\n") -> Marks:
    """Marks of the bytes equal to `end`: the bytes that are zero after an exclusive or. Adding 0x7F to the
    lower seven bits cannot carry into the next byte, so no byte is marked by its neighbour."""
    x = words ^ np.uint64(0x0101010101010101 * end[0])
    return Marks(~(((x & _LOW7) + _LOW7) | x | _LOW7))


def code_points(words: np.ndarray) -> Marks:
    """Marks of the bytes that begin a code point: those that are not 10xxxxxx."""
    return Marks((~words | words << np.uint64(1)) & _HIGH1)


def cut_points(texts: list[bytes], draws: list[tuple[int, int]], end: bytes = b"\n"
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lines, bytes before the middle, bytes before the suffix, code points before each of them) per text.

    The cuts stand after draw % (lines + 1) lines each, the smaller first. An `end` byte closes a line; what
    follows the last of them is a line too.
    """
    data = b"".join(texts)
    stop = np.cumsum([len(t) for t in texts], dtype=np.int64)
    start = stop - np.array([len(t) for t in texts], np.int64)
    if not data:
        zero = np.zeros(len(texts), np.int64)
        return zero, zero, zero, np.zeros((2, len(texts)), np.int64)
    words = as_words(data)
    ends = line_ends(words, end)
    first = ends.rank(start)
    closed = ends.rank(stop) - first
    lines = closed + ((stop > start) & (np.frombuffer(data, np.uint8)[np.maximum(stop, 1) - 1] != end[0]))
    a, b = (np.array([d[i] for d in draws], np.int64) % (lines + 1) for i in (0, 1))
    places = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        # The end of line k is a mark, unless it is the last line and not closed, or there is none.
        marked = (k > 0) & (k <= closed)
        at = np.where(k > 0, stop, start)
        at[marked] = ends.select((first + k - 1)[marked]) + 1
        places.append(at)
    begins = code_points(words)
    before = begins.rank(start)
    return lines, places[0] - start, places[1] - start, np.stack([begins.rank(p) - before for p in places])


def rearranged(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if form == "psm":
        return p + prefix + s + suffix + m + middle
    return s + suffix + p + prefix + m + middle


def restored(output: str | None, form: str | None) -> str | None:
    """The text that an output was made from. No part of it holds a sign, so the first of each is the sign."""
    if output is None or form not in ("psm", "spm"):
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(second, len(first))
    last = output.index(MIDDLE, at)
    one, two, middle = output[len(first):at], output[at + len(second):last], output[last + len(MIDDLE):]
    return one + middle + two if form == "psm" else two + middle + one


def draws(transcript_id: Column, seed: str) -> list[Column]:
    """Four numbers of 32 bits from the id and the seed: two cuts, the choice of a form, its order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(transcript_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(transcripts: DataFrame, transcript_id: str = "transcript_id", full_text: str = "full_text", seed: str = "7",
                   rate: int = 100, spm_rate: int = 50, line_end: str = "\n") -> DataFrame:
    """One row per transcript: transcript_id, n_lines, form, prefix_chars, middle_chars, output.

    `rate` percent of the transcripts are rearranged, `spm_rate` percent of these with the suffix first (spm),
    the others with the prefix first (psm). All choices follow from the seed and the id, so rows that share
    an id are cut by the same draws, and a null id draws as the empty text. form is plain, output the text
    itself and both counts null for the remaining ones, for empty texts and for texts that hold one of the
    three signs. A null text is empty. Texts are cut behind `line_end` (one ASCII character). Repeated rows
    give repeated rows, other columns are ignored, an empty table gives an empty result.
    """
    rows = only(transcripts, transcript_id=transcript_id, full_text=full_text)
    kind = rows.schema["transcript_id"].dataType.simpleString()
    end = line_end.encode("ascii")
    if len(end) != 1:
        raise ValueError("line_end is one ASCII character")
    signs = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]

    def make(texts: list[bytes], drawn: list[tuple[int, int, int, int]]) -> Iterator[tuple]:
        lines, low, high, chars = cut_points(texts, [d[:2] for d in drawn], end)
        for i, (text, (_, _, h3, h4)) in enumerate(zip(texts, drawn)):
            if not text or h3 % 100 >= rate or any(s in text for s in signs):
                yield int(lines[i]), "plain", None, None, text
                continue
            form = "spm" if h4 % 100 < spm_rate else "psm"
            output = rearranged(form, text[:low[i]], text[low[i]:high[i]], text[high[i]:])
            yield int(lines[i]), form, int(chars[0, i]), int(chars[1, i] - chars[0, i]), output

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            texts, drawn, size = [], [], 0
            for text, *own in arrow_rows(b, "full_text", "h1", "h2", "h3", "h4"):
                raw = (text or "").encode("utf-8")
                if texts and size + len(raw) > HELD:
                    out += make(texts, drawn)
                    texts, drawn, size = [], [], 0
                texts.append(raw)
                drawn.append(tuple(own))
                size += len(raw)
            out += make(texts, drawn)
            lines, form, prefix, middle, output = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lines, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                 pa.array(output, pa.binary()).cast(pa.string())], ["transcript_id", "n_lines", "form", "prefix_chars", "middle_chars", "output"])

    return rows.select("*", *draws(F.col("transcript_id"), seed)).mapInArrow(
        run, f"transcript_id {kind}, n_lines bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore_transcripts(infills: DataFrame, output: str = "output", form: str = "form", full_text: str = "full_text") -> DataFrame:
    """The table with a further column: the text rebuilt from output and form alone. A null output stays null.

    A column of that name is replaced. Other columns stay, repeated rows too.
    """
    held = [c for c in infills.columns if c != full_text]
    schema = infills.select(*[F.col(f"`{c}`") for c in held]).schema.add(full_text, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [restored(o, f) for o, f in arrow_rows(b, output, form)]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in held], pa.array(texts, pa.string())], [*held, full_text])

    return infills.mapInArrow(run, schema)
