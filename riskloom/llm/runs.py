"""Periodic runs in call transcripts, found with string synchronising sets.

A transcription model that gets stuck repeats words, turns or whole passages. A run is a stretch of
consecutive words of `full_text` that is as long as EXPONENT smallest periods at least and that no
neighbouring word extends.

For a scale T (a power of two) a position is highly periodic when the T words from it have a period of
T/4 at most. Every other position has a hash of its T words, and a position belongs to the
synchronising set when the least hash over it and the T positions after it is its own or that of the
last of them. Membership depends on the 2T words from a position (the context) alone, and any T
consecutive positions hold a member unless the 3T-1 words from the first are highly periodic.

So a run with a period p, T <= p < 2T, has a member among its first T positions, whose context comes
again p words later and not in between: neighbours of equal context propose every such period. The
highly periodic positions left out belong to runs of smaller periods, which smaller scales found
before; the smallest periods come from comparing the text with itself moved by 1 to SMALL - 1 words.
A proposal is only a hint: the stretch is found by comparing words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.texts import arrow_rows, only

EXPONENT = 4
SHORTEST = 6            # words of a run, at least
SMALL = 8               # periods below are found directly; the first scale, a power of two
TOGETHER = 1 << 17      # words of texts that are worked on at once; a longer text is alone
STEP = 1 << 20
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_HIGH = np.uint64(np.iinfo(np.uint64).max)


# ---------------------------------------------------------------- hashes of stretches

def _scattered(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def _doubled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of stretches of 2*size words from those of `size` words."""
    return _scattered(h[:len(h) - size] * np.uint64(0x2545F4914F6CDD1D) + h[size:])


def _least(h: np.ndarray, size: int) -> np.ndarray:
    """The least of h[i] .. h[i + size], for a power of two."""
    low, width = h, 1
    while width < size:
        low = np.minimum(low[:len(low) - width], low[width:])
        width *= 2
    return np.minimum(low[:len(h) - size], h[size:])


# ---------------------------------------------------------------- stretches with a period

def _stretch(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch around `at` in which words `period` apart are the same."""
    start, width = at, 64
    while start > 0:
        low = max(0, start - width)
        other = np.flatnonzero(words[low:start] != words[low + period:start + period])
        if len(other):
            start = low + int(other[-1]) + 1
            break
        start, width = low, min(2 * width, STEP)
    end, width = at, 64
    while end + period < len(words):
        high = min(len(words) - period, end + width)
        other = np.flatnonzero(words[end:high] != words[end + period:high + period])
        if len(other):
            end += int(other[0])
            break
        end, width = high, min(2 * width, STEP)
    return start, end + period


def _small_periods(words: np.ndarray, found: dict[tuple[int, int], int]) -> None:
    for period in range(1, min(SMALL, len(words))):
        same = np.concatenate([[False], words[period:] == words[:-period], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        starts, ends = edges[::2], edges[1::2]
        for i in np.flatnonzero(ends - starts >= (EXPONENT - 1) * period):
            found.setdefault((int(starts[i]), int(ends[i]) + period), period)


def synchronising_set(hashes: np.ndarray, scale: int, periodic: np.ndarray) -> np.ndarray:
    """Members in order, given the hashes of `scale` words and which positions are highly periodic."""
    own = np.where(periodic[:len(hashes)], _HIGH, hashes)
    least = _least(own, scale)
    return np.flatnonzero((least < _HIGH) & ((least == own[:len(least)]) | (least == own[scale:])))


def runs_of(words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of a sequence of numbers, by start and period.

    `longest` bounds the length of a run where it is known, as with several texts put together.
    """
    longest = len(words) if longest is None else longest
    found: dict[tuple[int, int], int] = {}
    _small_periods(words, found)
    hashes, scale = _scattered(words.astype(np.uint64)), 1
    while scale < SMALL and len(hashes) > scale:
        hashes, scale = _doubled(hashes, scale), 2 * scale
    while EXPONENT * scale <= longest and len(hashes) > scale:
        border = np.zeros(len(words) + 1, np.int32)
        for (start, end), period in found.items():
            if EXPONENT * period <= scale <= end - start:
                border[start] += 1
                border[end - scale + 1] -= 1
        members = synchronising_set(hashes, scale, np.cumsum(border)[:-1] > 0)
        hashes = _doubled(hashes, scale)
        members = members[members < len(hashes)]
        order = np.argsort(hashes[members], kind="stable")
        placed, context = members[order], hashes[members][order]
        apart = np.diff(placed)
        hits = np.flatnonzero((context[1:] == context[:-1]) & (apart >= scale) & (apart < 2 * scale))
        # Proposals of one period lie in the order of their places: one inside the last stretch is known.
        period_before, end_before = -1, -1
        for period, at in sorted(zip(apart[hits].tolist(), placed[:-1][hits].tolist())):
            if period != period_before or at + period > end_before:
                start, end = _stretch(words, at, period)
                if end - start >= EXPONENT * period:
                    found.setdefault((start, end), period)
                period_before, end_before = period, end
        scale *= 2
    return sorted((start, end, period) for (start, end), period in found.items() if end - start >= max(SHORTEST, EXPONENT * period))


# ---------------------------------------------------------------- texts

def _numbered(texts: list[str]) -> Iterator[tuple[list[list[str]], np.ndarray]]:
    """Texts as lists of words, several at a time, and all their words as numbers: equal numbers for equal
    words, and after each text a number that occurs nowhere else, which no run can hold."""
    lists: list[list[str]] = []
    size, known = 0, {}
    numbers: list[np.ndarray] = []
    for text in texts:
        words = WORDS.findall(text or "")
        if lists and size + len(words) > TOGETHER:
            yield lists, np.concatenate(numbers)
            lists, size, known, numbers = [], 0, {}, []
        for word in words:
            known.setdefault(word, len(known))
        numbers.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        numbers.append(np.array([-1 - len(lists)]))
        lists.append(words)
        size += len(words)
    if lists:
        yield lists, np.concatenate(numbers)


def runs_of_texts(texts: list[str]) -> Iterator[tuple[list[str], list[tuple[int, int, int]]]]:
    """(words, runs as (start, length, period)) of each text."""
    for lists, numbers in _numbered(texts):
        sizes = np.array([len(words) for words in lists])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        own: list[list[tuple[int, int, int]]] = [[] for _ in lists]
        if int(sizes.max()) >= SHORTEST:
            found = runs_of(numbers, int(sizes.max()))
            for (start, end, period), text in zip(found, np.searchsorted(starts, [f[0] for f in found], "right") - 1):
                own[text].append((start - int(starts[text]), end - start, period))
        yield from zip(lists, own)


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    border = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        border[start + period] += 1
        border[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(border)[:-1] == 0)]


SCHEMA = ("n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed_text string")
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def transcript_runs(transcripts: DataFrame, transcript_id: str = "transcript_id", full_text: str = "full_text") -> DataFrame:
    """One row per transcript: transcript_id, n_words, runs, collapsed_text.

    `runs` are (start, length, period) in words, by start, then period: the stretches of max(SHORTEST,
    EXPONENT * period) words at least in which words `period` apart, and no fewer, are the same, taken as
    far as they go. `collapsed_text` has the words joined by one space, without those that a run holds after
    its first period. Words stand between ASCII blanks and are compared as they are.

    Null, empty and blank texts have no words and no runs and collapse to the empty text. Repeated rows
    give repeated rows, null ids stay, other columns are ignored, an empty table gives an empty result.
    Each text is worked on by itself: nothing is shuffled, and a task holds TOGETHER words or one text.
    """
    rows = only(transcripts, transcript_id=transcript_id, full_text=full_text)
    kind = rows.schema["transcript_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, runs, texts = [], [], []
            for words, found in runs_of_texts([text for (text,) in arrow_rows(b, "full_text")]):
                n.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(" ".join(collapsed(words, found)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.string())],
                                             ["transcript_id", "n_words", "runs", "collapsed_text"])

    return rows.mapInArrow(run, f"transcript_id {kind}, {SCHEMA}")


def longest_run(runs: str = "runs") -> Column:
    """The run with the greatest length, then the smallest start and period; null where there is none."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["l"]).alias("length"), best["period"].alias("period")))


def runs_digest(runs: str = "runs") -> Column:
    """sha256 of the `start,length,period` lines of all runs."""
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "").cast("binary"), 256)

