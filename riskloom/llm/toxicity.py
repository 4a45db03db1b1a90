"""Toxic call transcripts: a learned lexicon matched with Levenshtein automata over a trie.

The lexicon is learned from labelled transcripts: words, and beginnings of words shared by many
inflected forms, that are significantly more frequent in toxic ones. A word of a text matches a term
exactly, by its beginning, or with one error in the word or in its beginning; a digit or sign may be the
error. With terms of less than MIN_FUZZY letters an error counts beside another match only. Each match is
weighed by the window around it: inside quotation marks or beside a reporting word it counts as
quotation, otherwise as abuse. A logistic regression turns both sums into a score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.texts import arrow_rows, free_names, lowered_words, only, pieces, remainder
from riskloom.session import materialize

MIN_WORD, MIN_FUZZY = 3, 5
STEMS = range(4, 9)             # lengths of beginnings that may become terms
SKETCH = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)      # odd numbers
SAMPLE_TOXIC, SAMPLE_CLEAN = 8_000, 16_000      # labelled transcripts learned from, at most
WINDOW = 6                      # words on either side that can mark a quotation
THRESHOLD = 0.3
KNOWN = 250_000                 # words whose match a worker keeps

LETTERS = re.compile(r"[^\W\d_]+")
RUNS = re.compile(r"([^\W\d_]+)")
# Fixed value: signs that stand for a letter at the start or end of a word.
LIKE_LETTERS = frozenset("0123456789$@€")
# Quotation marks, and words that report what somebody else said.
QUOTES = frozenset("\"“”„«»‹›")
REPORTING = frozenset((
    "said says say told wrote writes written called calls quoted quote quotes quoting reported reports alleged "
    "dijo dice dicho escribió llamó citó cita según "
    "dit disait écrit appelé citation selon "
    "sagte sagt schrieb nannte zitat zitiert laut").split())


# ---------------------------------------------------------------- automaton and trie

class Trie:
    """Terms as a tree of letters; `ends` at a node has the terms that end there."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.depth = [0]
        for number, term in enumerate(terms):
            at = 0
            for letter in term:
                if letter not in self.children[at]:
                    self.children[at][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.depth.append(self.depth[at] + 1)
                at = self.children[at][letter]
            self.ends[at] = number


class LevenshteinAutomaton:
    """Accepts what lies within `errors` edits of a word. A state is the tuple of (position, errors so
    far) of its nondeterministic form, without those that another one covers."""

    def __init__(self, word: str, errors: int):
        self.word, self.errors = word, errors

    def start(self) -> tuple[tuple[int, int], ...]:
        return ((0, 0),)

    def step(self, state: tuple[tuple[int, int], ...], letter: str) -> tuple[tuple[int, int], ...]:
        word, found = self.word, {}

        def add(position: int, spent: int) -> None:
            if spent <= self.errors and spent < found.get(position, self.errors + 1):
                found[position] = spent

        for position, spent in state:
            add(position, spent + 1)                                # the letter is extra
            add(position + 1, spent + 1) if position < len(word) else None      # or stands for another
            for skipped in range(min(self.errors - spent, len(word) - position - 1) + 1):
                if word[position + skipped:position + skipped + 1] == letter:    # or comes after missing ones
                    add(position + skipped + 1, spent + skipped)
                    break
        return tuple(sorted((p, e) for p, e in found.items()
                            if not any(q != p and f + abs(p - q) <= e and f < e for q, f in found.items())))

    def distance(self, state: tuple[tuple[int, int], ...]) -> int | None:
        left = [e + len(self.word) - p for p, e in state if e + len(self.word) - p <= self.errors]
        return min(left, default=None)


def intersect(trie: Trie, word: str, errors: int, beginning: bool = False) -> list[tuple[int, int]]:
    """(term, distance) of every term within the errors of the word, or else of the nearest of its
    beginnings: automaton and trie are walked together."""
    automaton, found = LevenshteinAutomaton(word, errors), []
    stack = [(0, automaton.start())]
    while stack:
        node, state = stack.pop()
        term = trie.ends[node]
        d = None if term is None else min(e for _, e in state) if beginning else automaton.distance(state)
        if d is not None:
            found.append((term, d))
        for letter, child in trie.children[node].items():
            after = automaton.step(state, letter)
            if after:
                stack.append((child, after))
    return found


def shortened(word: str) -> list[str]:
    """The word and its forms with one letter less."""
    return [word, *[word[:i] + word[i + 1:] for i in range(len(word))]]


class Lexicon:
    """Weighted words, beginnings (ending in *) and misspellings (ending in ~, weighted on their own)."""

    def __init__(self, weights: dict[str, float]):
        self.words = {t: w for t, w in weights.items() if t[-1] not in "*~"}
        self.stems = {t[:-1]: w for t, w in weights.items() if t[-1] == "*"}
        self.near = {t[:-1]: w for t, w in weights.items() if t[-1] == "~"}
        self.lengths = sorted({len(s) for s in self.stems})
        self.terms, self.beginnings = sorted(self.words), sorted(self.stems)
        self.trie, self.stem_trie = Trie(self.terms), Trie(self.beginnings)
        self.longest = max(map(len, self.terms), default=0)
        self.around = {v for t in self.terms for v in shortened(t)}
        self.stems_around = {v for t in self.beginnings for v in shortened(t)}
        self.known: dict[str, tuple[str, float] | None] = {}
        self.matching: set[str] = set()
        # One error leaves one half of a term as it is: the first at its place, the second at the end of the
        # word, or, of a beginning, at most one letter from its place.
        self.heads = {n: {t[:n] for t in (*self.terms, *self.beginnings) if len(t) // 2 == n} for n in {len(t) // 2 for t in (*self.terms, *self.beginnings)}}
        self.tails = {n: {t[-n:] for t in self.terms if len(t) - len(t) // 2 == n} for n in {len(t) - len(t) // 2 for t in self.terms}}
        self.inner: dict[tuple[int, int], set[str]] = {}
        for t in self.beginnings:
            for at in range(len(t) // 2 - 1, len(t) // 2 + 2):
                self.inner.setdefault((at, at + len(t) - len(t) // 2), set()).add(t[len(t) // 2:])
        self.halves = [*self.heads.items()], [*self.tails.items()], [*self.inner.items()]

    def may_be_misspelt(self, word: str) -> bool:
        """False where no half of a term is in its place."""
        heads, tails, inner = self.halves
        return any([word[:n] in known for n, known in heads]) or any([word[-n:] in known for n, known in tails]) or any(
            [word[a:b] in known for (a, b), known in inner])

    def starts(self, word: str) -> list[str]:
        """The beginnings that the word has, exactly."""
        return [word[:n] for n in self.lengths if n < len(word) and word[:n] in self.stems]

    def misspelt(self, word: str) -> str | None:
        """The term that the word, or else the beginning that its own beginning, misspells by one error.
        Two words within one error share a form with at most one letter less, which is looked up first."""
        if word in self.words or self.starts(word) or not self.may_be_misspelt(word):
            return None
        found = []
        if len(word) <= self.longest + 1 and not self.around.isdisjoint(shortened(word)):
            found = [self.terms[t] for t, d in intersect(self.trie, word, 1) if d == 1]
        if not found and any(not self.stems_around.isdisjoint(shortened(word[:n]))
                             for n in {m for length in self.lengths for m in (length - 1, length, length + 1)} if n <= len(word)):
            found = [self.beginnings[t] + "*" for t, d in intersect(self.stem_trie, word, 1, beginning=True) if d == 1]
        return min(found, default=None)

    def match(self, word: str) -> tuple[str, float] | None:
        """The heaviest entry that the word matches."""
        if word in self.known:
            return self.known[word]
        found = [(word, self.words[word])] if word in self.words else []
        found += [(start + "*", self.stems[start]) for start in self.starts(word)]
        if not found and (term := self.misspelt(word)) is not None:
            found.append((term + "~", self.near.get(term, 0.5 * (self.stems[term[:-1]] if term[-1] == "*" else self.words[term]))))
        best = max(found, key=lambda x: (x[1], x[0]), default=None)
        self.known[word] = best = best if best and best[1] > 0 else None
        if best:
            self.matching.add(word)
        return best

    def look_up(self, words: set[str]) -> bool:
        """Match all words that were not met before; whether any of the words matches."""
        if len(self.known) > KNOWN:
            self.known.clear()
            self.matching.clear()
        for word in words.difference(self.known):
            self.match(word)
        return not self.matching.isdisjoint(words)


@lru_cache(maxsize=4)
def _lexicon(items: tuple[tuple[str, float], ...]) -> Lexicon:
    """One per Python worker and lexicon."""
    return Lexicon(dict(items))


# ---------------------------------------------------------------- features

def word_set(text: str | None) -> set[str]:
    found: set[str] = set()
    for piece in pieces(text or ""):
        found.update(LETTERS.findall(piece.lower()))
    return {w for w in found if len(w) >= MIN_WORD}


def term_set(text: str | None) -> set[str]:
    """The different words of a text and their beginnings."""
    words = word_set(text)
    return words | {w[:n] + "*" for w in words for n in STEMS if n < len(w)}


def hits(low: str, lexicon: Lexicon) -> list[tuple[int, int, str, float]]:
    """(start, end, entry, weight) of every match in a lower-case text.

    A run of letters is looked up alone; where neither it nor its neighbour across a single digit or
    sign is a term, it is looked up with that sign, so that the sign can be the error. An error in a
    term of less than MIN_FUZZY letters counts only within WINDOW words of another match. A long text is
    read in pieces, which are cut at blanks; runs are counted on, so a border makes no difference.
    """
    found: list[tuple[int, int, int, str, float]] = []
    base = before = 0
    for piece in pieces(low):
        parts = RUNS.split(piece)
        found += [(before + i, base + a, base + b, entry, weight) for i, a, b, entry, weight in _piece_hits(parts, lexicon)]
        before += len(parts) // 2
        base += len(piece)
    firm = [i for i, _, _, entry, _ in found if not _weak(entry)]
    return [hit[1:] for hit in found if not _weak(hit[3]) or any(abs(i - hit[0]) <= WINDOW for i in firm[max(0, bisect_left(firm, hit[0]) - 1):][:2])]


def _may_err(gap: str) -> bool:
    """Whether what stands between two runs may be an error of a word: a sign alone, or one that stands for a letter."""
    return len(gap) == 1 and not gap.isspace() or gap[:1] in LIKE_LETTERS or gap[-1:] in LIKE_LETTERS


def _piece_hits(parts: list[str], lexicon: Lexicon) -> list[tuple[int, int, int, str, float]]:
    """(number of the run, start, end, entry, weight) of the matches in one piece, given as gaps and runs in turn.
    Only runs that match alone or stand beside a sign are looked at."""
    runs, gaps = parts[1::2], parts[::2]
    met = lexicon.look_up({w for w in set(runs) if len(w) >= MIN_WORD - 1})
    signs = {g for g in set(gaps) if g and _may_err(g)}
    if not met and not signs:
        return []
    matching, known = lexicon.matching, lexicon.known
    wanted = {i for i, w in enumerate(runs) if w in matching} if met else set()
    if signs:
        wanted.update(j for i, g in enumerate(gaps) if g in signs for j in (i - 1, i) if 0 <= j < len(runs))
    ends = list(accumulate(map(len, parts)))
    exact = {w for w in map(runs.__getitem__, wanted) if w in matching and known[w][0][-1] != "~"}
    found: list[tuple[int, int, int, str, float]] = []
    used = -1
    for i in sorted(wanted):
        word, start, end = runs[i], ends[2 * i], ends[2 * i + 1]
        if word not in exact:
            before, after = gaps[i], gaps[i + 1]
            joined = i + 1 < len(runs) and len(after) == 1 and not after.isspace() and runs[i + 1] not in exact
            ways = [(word + after + runs[i + 1], start, ends[2 * i + 3], i + 1)] if joined else []
            if before[-1:] in LIKE_LETTERS:
                ways.append((before[-1] + word, start - 1, end, i))
            if after[:1] in LIKE_LETTERS:
                ways.append((word + after[0], start, end + 1, i))
            signed = [(a, b, last, m) for text, a, b, last in ways if (m := lexicon.match(text)) is not None]
            if signed and i > used:
                a, b, used, m = max(signed, key=lambda x: x[3][1])
                found.append((i, a, b, *m))
                continue
        if i > used and word in matching:
            found.append((i, start, end, *known[word]))
    return found


def _weak(entry: str) -> bool:
    return entry[-1] == "~" and len(entry.rstrip("*~")) < MIN_FUZZY


def evidence(text: str | None, lexicon: Lexicon) -> tuple[float, float, float, float]:
    """Largest and summed weight of the matches that are abuse, then of those that are quotation."""
    best, total, low = [0.0, 0.0], [0.0, 0.0], (text or "").lower()
    for start, end, _, weight in hits(low, lexicon):
        quoted = is_quoted(low, start, end)
        best[quoted] = max(best[quoted], weight)
        total[quoted] += weight
    return best[0], math.log1p(total[0]), best[1], math.log1p(total[1])


def is_quoted(text: str, start: int, end: int) -> bool:
    """Quotation marks on both sides, or a reporting word before, within the window of words."""
    before, after = text[max(0, start - 16 * WINDOW):start], text[end:end + 16 * WINDOW]
    words_before = LETTERS.findall(before)[-WINDOW:]
    if REPORTING.intersection(words_before):
        return True
    left = re.split(r"\s+", before)[-WINDOW - 1:]
    right = re.split(r"\s+", after)[:WINDOW + 1]
    return any(QUOTES.intersection(w) for w in left) and any(QUOTES.intersection(w) for w in right)


# ---------------------------------------------------------------- learning

def _per_text(rows: DataFrame, extra: str, schema: str, function) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [function(text) for (text,) in arrow_rows(b, "full_text")]
            columns = list(zip(*values)) if values else [()] * 4
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in extra.split()],
                                              *[pa.array(c, pa.float64()) for c in columns]], [*extra.split(), "x0", "x1", "x2", "x3"])
    return rows.mapInArrow(run, schema)


def learn_lexicon(sample: DataFrame, weights: dict[int, float]) -> dict[str, float]:
    """Weights of the terms that are significantly more frequent in toxic transcripts of the sample.

    A term is significant when twice its log likelihood ratio exceeds what the best of so many terms
    reaches by chance, and kept when at least two in three of the transcripts that have it are toxic. Of a
    beginning and the words under it the one with the stronger case is kept.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for b in batches:
            for text, label in arrow_rows(b, "full_text", "toxic"):
                (toxic if label else clean).update(term_set(text))
        terms = list(toxic.keys() | clean.keys())
        for at in range(0, len(terms), 1 << 16):
            part = terms[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[t] for t in part], pa.int64()),
                                              pa.array([clean[t] for t in part], pa.int64())], ["term", "t", "c"])

    sizes = sample.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    n_toxic, n_clean = sizes
    if not n_toxic or not n_clean:
        return {}
    counts = materialize(sample.select("full_text", "toxic").mapInArrow(count, "term string, t bigint, c bigint").groupBy("term").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c")), "term-counts")
    total, both = counts.count(), n_toxic + n_clean

    def part(seen: Column, of: Column, size: int) -> Column:
        return F.when(seen > 0, seen * F.log(seen * both / (of * size))).otherwise(0.0)

    seen = F.col("t") + F.col("c")
    unseen = F.lit(both) - seen
    gain = 2 * (part(F.col("t"), seen, n_toxic) + part(F.col("c"), seen, n_clean)
                + part(n_toxic - F.col("t"), F.greatest(unseen, F.lit(1)), n_toxic) + part(n_clean - F.col("c"), F.greatest(unseen, F.lit(1)), n_clean))
    weight = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    strong = counts.withColumns({"gain": gain, "weight": weight}).filter(
        (F.col("gain") > 2 * math.log(max(total, 2)) + 6) & (F.col("t") * weights[1] >= 2 * F.col("c") * weights[0]))
    base = F.regexp_replace("term", r"\*$", "")
    kept = strong.withColumn("head", F.substring(base, 1, STEMS[0])).groupBy("head").applyInPandas(
        _without_covered, "term string, t bigint, gain double, weight double")
    # As many terms as the bounded sample shows to be significant.
    return {r["term"]: r["weight"] for r in kept.select("term", "weight").orderBy("term").collect()}


def _without_covered(terms: pd.DataFrame) -> pd.DataFrame:
    """Of the significant terms with one head, those that no stronger one stands for. Beginnings are at
    least as long as a head, so only terms with the same head can cover each other."""
    terms = terms.assign(size=terms["term"].str.rstrip("*").str.len()).sort_values(["gain", "size", "term"], ascending=[False, False, True])
    kept: dict[str, int] = {}
    for term, toxic in zip(terms["term"], terms["t"]):
        base = term.rstrip("*")
        if any(k[-1] == "*" and base.startswith(k[:-1]) for k in kept):
            continue
        if term[-1] == "*" and any(k.startswith(base) and n >= 0.8 * toxic for k, n in kept.items()):
            continue
        kept[term] = toxic
    return terms[terms["term"].isin(list(kept))][["term", "t", "gain", "weight"]]


def sketch(text: str | None) -> list[int]:
    """Smallest values of SKETCH mixings of the hashes of all three-word shingles; near copies share most."""
    low = [np.iinfo(np.uint64).max] * len(SKETCH)
    for words in lowered_words(text):
        shingles = map(b" ".join, zip(words, words[1:] or words, words[2:] or words))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64)
        if len(hashes):
            low = [min(x, int((hashes * np.uint64(m)).min())) for x, m in zip(low, SKETCH)]
    return [x - (1 << 63) for x in low]


def without_copies(sample: DataFrame) -> DataFrame:
    """The sample with one of each group of near copies, whose common words would look significant.

    A text goes if another one with a smaller hash shares a value of its sketch; of a group the
    smallest stays in any case.
    """
    names = [f"m{i}" for i in range(len(SKETCH))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sketch(text) for (text,) in arrow_rows(b, "full_text")] or []
            columns = list(zip(*found)) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array(c, pa.int64()) for c in columns]],
                                             ["text_key", "full_text", "toxic", *names])

    keyed = materialize(sample.select(F.xxhash64("full_text").alias("text_key"), "full_text", "toxic").mapInArrow(
        run, "text_key bigint, full_text string, toxic int, " + ", ".join(f"{n} bigint" for n in names)), "sketches")
    kept = keyed
    for name in names:
        first = keyed.groupBy(name).agg(F.min("text_key").alias("first"))
        kept = kept.join(first, name).filter("text_key = first").drop("first")
    return materialize(kept.select("full_text", "toxic"), "distinct-texts")


def learn_misspellings(sample: DataFrame, lexicon: dict[str, float]) -> dict[str, float]:
    """Weights of what lies one error from a term, from how often that is toxic in the sample: 0 and
    less where such words are harmless."""
    fixed = tuple(sorted(lexicon.items()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            own = _lexicon(fixed)
            for text, label in arrow_rows(b, "full_text", "toxic"):
                near = {entry[:-1] for _, _, entry, _ in hits((text or "").lower(), own) if entry[-1] == "~"}
                found.update((t, bool(label)) for t in near)
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
                                          pa.array([found[k] for k in keys], pa.int64())], ["term", "toxic", "n"])

    n_toxic, n_clean = sample.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    seen: dict[str, list[int]] = {}
    for r in sample.select("full_text", "toxic").mapInArrow(count, "term string, toxic boolean, n bigint").groupBy("term", "toxic").agg(
            F.sum("n").alias("n")).collect():                        # two rows per term of the lexicon at most
        seen.setdefault(r["term"], [0, 0])[bool(r["toxic"])] = r["n"]
    return {t + "~": min(0.7 * lexicon[t], math.log((b + 0.5) / (n_toxic + 1)) - math.log((a + 0.5) / (n_clean + 1)))
            for t, (a, b) in seen.items()}


PRIOR = np.array([-3.0, 0.5, 1.0, 0.1, 0.3])      # constant, abuse (largest, sum), quotation (largest, sum)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression drawn towards PRIOR, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    b = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * (b - PRIOR)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(curve, slope)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return b


def training_sample(transcripts: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """Labelled transcripts that are not held out (the first of each class by a hash of the id), and how
    many of its class each stands for. The chosen labels are bounded, so they are broadcast and the
    texts are not shuffled."""
    open_to_learn = labels.filter("toxic IN (0, 1) AND transcript_id IS NOT NULL").filter(remainder(F.col("transcript_id"), 4) != 2).groupBy(
        "transcript_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen, weights = None, {}
    open_to_learn = materialize(open_to_learn, "labels")
    for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        own = open_to_learn.filter(F.col("toxic") == label)
        n = own.count()
        weights[label] = max(1.0, n / most)
        part = own.orderBy(F.xxhash64("transcript_id"), "transcript_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # A text that was labelled several times counts once.
    sample = transcripts.join(F.broadcast(chosen), "transcript_id").groupBy("full_text").agg(F.max("toxic").alias("toxic"))
    return materialize(sample, "labelled"), weights


def score_transcripts(transcripts: DataFrame, labels: DataFrame, transcript_id: str = "transcript_id", full_text: str = "full_text",
                      labelled_id: str = "transcript_id", toxic: str = "toxic") -> DataFrame:
    """(transcript_id, held_out, score, predicted) for every transcript.

    Learned from rows of `labels` (id, toxic 0 or 1) whose crc32(id as text) mod 4 is not 2; transcripts
    with that remainder are held out. Only texts are inputs of a score. Null, empty and blank texts get
    the score of a text without any match. Null labels and labels without a transcript are ignored, an
    id labelled twice is toxic if either label is; without labels of both classes nothing is learned and
    every score is that of no match. Repeated rows give repeated rows, other columns are ignored, an
    empty table gives an empty result.
    """
    rows = only(transcripts, transcript_id=transcript_id, full_text=full_text)
    kind = rows.schema["transcript_id"].dataType.simpleString()
    sample, weights = training_sample(rows, only(labels, transcript_id=labelled_id, toxic=toxic))
    apart = without_copies(sample)
    lexicon = learn_lexicon(apart, weights)
    if lexicon:
        lexicon |= learn_misspellings(apart, lexicon)
    fixed = tuple(sorted(lexicon.items()))
    coefficients = PRIOR
    if lexicon:
        seen = _per_text(sample.select("toxic", "full_text"), "toxic", "toxic int, x0 double, x1 double, x2 double, x3 double",
                         lambda text: evidence(text, _lexicon(fixed))).toPandas()      # SAMPLE_TOXIC + SAMPLE_CLEAN rows at most
        y = seen["toxic"].to_numpy(float)
        coefficients = fit_logistic(seen[["x0", "x1", "x2", "x3"]].to_numpy(), y, np.where(y == 1, weights[1], weights[0]))
    found = _per_text(rows, "transcript_id", f"transcript_id {kind}, x0 double, x1 double, x2 double, x3 double",
                      lambda text: evidence(text, _lexicon(fixed)))
    total = sum((F.col(f"x{i}") * float(c) for i, c in enumerate(coefficients[1:])), F.lit(float(coefficients[0])))
    score = 1 / (1 + F.exp(-total))
    return found.select("transcript_id", (remainder(F.col("transcript_id"), 4) == 2).alias("held_out"), score.alias("score"),
                        (score >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(transcripts: DataFrame, labels: DataFrame, transcript_id: str = "transcript_id", full_text: str = "full_text",
                  labelled_id: str = "transcript_id", toxic: str = "toxic") -> DataFrame:
    """The transcripts that are not predicted to be toxic, with all their columns.

    Rows that share an id go if one of them is toxic; rows with a null id are kept.
    """
    scored = score_transcripts(transcripts, labels, transcript_id, full_text, labelled_id, toxic)
    (name,) = free_names(transcripts, "toxic_id")
    bad = materialize(scored.filter("predicted = 1").select(F.col("transcript_id").alias(name)).distinct(), "toxic")
    return transcripts.join(bad, F.col(f"`{transcript_id}`") == F.col(f"`{name}`"), "left_anti")
