"""Personal data in call transcripts by weak supervision.

Base spans come from fixed rules. Wide generators add candidates: every longer number and every pair of words around
an at sign in any spelling. Labelers judge base spans and candidates: rules about their form, lists of names, issuers and
codes, cue words around them, and signs that speak against them. No truth is given: for each kind of data
expectation-maximisation estimates how reliable each labeler is from how they agree, and the resulting probabilities
train a logistic classifier over the votes and the form of a span, which decides on each candidate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.texts import arrow_rows, only
from riskloom.session import materialize

KINDS = ("email", "ip", "card", "phone")

# The shapes of the base spans.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NON_DIGIT = re.compile(r"[^0-9]")

# Shapes of further candidates: any number of seven to nineteen digits, whatever stands between them; four small
# numbers with dots in any spelling; words around an @ or a spelt one.
SPELT_DOT = r" ?(?:\.|[(\[{] ?(?:\.|dot|punto|point|punkt) ?[)\]}]) ?| (?:dot|punto) "
NUMBER = re.compile(r"(?<![\w.+-])\+?\(?[0-9](?:[ ()./_\u00a0-]{0,3}[0-9]){6,18}(?!\w)")
NUMBERS = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:(?:{SPELT_DOT})[0-9]{{1,3}}){{3}}(?![\w.])")
SPELT_AT = re.compile(r" ?@ ?| ?[(\[{] ?(?:at|arroba|arobase) ?[)\]}] ?| (?:at|arroba) (?=[A-Za-z0-9-]+ (?:dot|punto) )", re.IGNORECASE)
SPELT_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:(?:{SPELT_DOT})[A-Za-z0-9-]+)*", re.IGNORECASE)

# Cue words around a span; parts of provider names and ends of domains; first digits of card issuers; calling
# codes; words and signs of amounts and references.
CUES = {"email": ("mail", "correo", "courriel", "contact", "kontakt", "escriba", "write"), "ip": ("ip", "host", "server", "address", "servidor", "serveur"),
        "card": ("card", "tarjeta", "carte", "karte", "visa", "mastercard", "amex"),
        "phone": ("phone", "tel", "call", "mobile", "teléfono", "téléphone", "telefon", "whatsapp", "llame", "móvil", "celular")}
PROVIDERS = ("example", "gmail", "mail", "hotmail", "outlook", "yahoo", "proton")
DOMAIN_ENDS = ("com", "org", "net", "co", "es", "mx", "ar", "br", "fr", "de", "uk", "io", "edu", "gov", "info", "eu")
ISSUERS = re.compile(r"4|5[1-5]|3[47]|3[068]|6011|65|35|2(?:2[2-9]|[3-6]|7[01]|720)")
CALLING_CODES = re.compile(r"1|2[0-9]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]")
AMOUNTS = re.compile(r"[€$£¥%]|\b(?:usd|eur|cop|mxn|kg|km|importe|total|precio|price|prix|preis|order|pedido|factura|invoice|rechnung|ref|referencia|version|versión)\b")
AREA = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address rule, found from their @ instead of from every letter."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, sorted."""
    found = [(s, 0, e) for s, e in _emails(text)]
    if any(d in text for d in "0123456789"):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m.groups())]
        for m in CARD.finditer(text):
            digits = NON_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(NON_DIGIT.sub("", m.group())) <= 15]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of further candidates that touch neither a base span nor an earlier candidate."""
    found = []
    if any(d in text for d in "0123456789"):
        found += [(m.start(), 1, m.end()) for m in NUMBERS.finditer(text)]
        for m in NUMBER.finditer(text):
            digits = NON_DIGIT.sub("", m.group())
            found.append((m.start(), 3 if m.group()[0] in "+(" or len(digits) < 12 else 2, m.end()))
    for sign in SPELT_AT.finditer(text):
        start = sign.start()
        while start and LOCAL.match(text, start - 1):
            start -= 1
        domain = SPELT_DOMAIN.match(text, sign.end())
        if domain and start < sign.start():
            found.append((start, 0, domain.end()))
    kept, end = [], 0
    for c in sorted(found):
        if c[0] >= end and not any(s < c[2] and c[0] < e for s, _, e in taken):
            kept.append(c)
            end = c[2]
    return kept


def _form(kind: int, inside: str, digits: str) -> int:
    """Whether a span has the form of its kind."""
    if kind == 0:
        parts = [p for p in re.split(r"[^A-Za-z0-9]+", re.split(r"@|\b(?:at|arroba|arobase)\b", inside, maxsplit=1, flags=re.IGNORECASE)[-1])
                 if p and p.lower() not in ("dot", "punto", "point", "punkt")]
        return int(len(parts) > 1 and parts[-1].isalpha() and len(parts[-1]) > 1)
    if kind == 1:
        return int(all(int(p) <= 255 for p in re.findall("[0-9]+", inside)))
    if kind == 2:
        return int(12 <= len(digits) <= 19 and luhn(digits))
    gaps = len(re.findall(r"[0-9][^0-9]+(?=[0-9])", inside))
    return int(9 <= len(digits) <= 15 or len(digits) > 6 and gaps > 0) if inside[0] in "+(" or gaps > 1 else 0


def _listed(kind: int, inside: str, digits: str) -> int:
    """Whether a list knows a part of the span: providers and ends of domains, issuers, calling codes, usable addresses."""
    low = inside.lower()
    if kind == 0:
        return int(any(p in low for p in PROVIDERS) or re.split(r"[^a-z0-9]+", low)[-1] in DOMAIN_ENDS)
    if kind == 1:
        first, *rest = [int(p) for p in re.findall("[0-9]+", inside)]
        return int(0 < first < 224 and first != 127 and max(first, *rest) > 9)
    if kind == 2:
        return int(bool(ISSUERS.match(digits)))
    return int(bool(CALLING_CODES.match(digits))) if inside[0] == "+" else -1


def votes(text: str, span: tuple[int, int, int]) -> tuple[list[int], list[float]]:
    """The labelers' votes (1 yes, 0 no, -1 silent) on a span, and features of its form.

    In order: the form, the lists, cue words of the kind, cue words of other kinds only, a table of numbers around,
    signs and words of amounts and references beside, digits without variety.
    """
    start, kind, end = span
    inside, around = text[start:end], (text[max(0, start - AREA):start] + " " + text[end:end + AREA]).lower()
    digits = NON_DIGIT.sub("", inside)
    words = set(re.findall(r"\w+", around))
    cue = 1 if words.intersection(CUES[KINDS[kind]]) else -1
    other = 0 if cue < 0 and any(words.intersection(c) for k, c in CUES.items() if k != KINDS[kind]) else -1
    crowd = 0 if kind and sum(c.isdigit() for c in around) > 24 else -1
    amount = 0 if kind and AMOUNTS.search((text[max(0, start - 14):start] + " # " + text[end:end + 6]).lower()) else -1
    dull = 0 if kind > 1 and len(set(digits)) < 3 else -1
    return [_form(kind, inside, digits), _listed(kind, inside, digits), cue, other, crowd, amount, dull], [
        1.0, len(digits) / 10.0, float(inside.count(" ")) / 3, *[float(kind == k) for k in range(3)]]


LABELERS, FORMS = 7, 6
ROUNDS = 30


# What labelers are taken to do before they are heard (no, yes, silent), on false and on true spans, and its weight.
HABIT, HABIT_WEIGHT = np.array([[0.40, 0.15, 0.45], [0.05, 0.50, 0.45]]), 5.0


def reliabilities(patterns: dict[tuple[int, ...], int]) -> tuple[float, np.ndarray]:
    """Share of true spans, and the chances of a no, a yes and of silence of each labeler on false and on true spans,
    by expectation-maximisation over counted vote patterns. Silence counts: a labeler that only ever says no tells
    something by not saying it. HABIT keeps an unheard labeler where it was."""
    seen = np.array(list(patterns), np.int64)
    n = np.array(list(patterns.values()), float)
    share, rates = 0.5, np.tile(HABIT, (seen.shape[1], 1, 1))
    for _ in range(ROUNDS):
        true = truth(seen, share, rates)
        share = (n @ true + 1) / (n.sum() + 2)
        for j in range(seen.shape[1]):
            for side, p in ((0, 1 - true), (1, true)):
                mass = np.array([n * p @ (seen[:, j] == vote) for vote in (0, 1, -1)]) + HABIT_WEIGHT * HABIT[side]
                rates[j, side] = mass / mass.sum()
    return share, rates


def truth(seen: np.ndarray, share: float, rates: np.ndarray) -> np.ndarray:
    """Probability that a span is true, given its votes."""
    odds = np.full(len(seen), np.log(share / (1 - share)))
    for j in range(seen.shape[1]):
        odds += np.log(rates[j, 1] / rates[j, 0])[seen[:, j]]           # no is 0, yes 1, and silence, -1, the last
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _row(votes_: list[int], form: list[float]) -> list[float]:
    return [*form, *[float(v == 1) for v in votes_], *[float(v == 0) for v in votes_]]


def train_classifier(counted: dict[tuple, int]) -> np.ndarray | None:
    """Logistic regression on the probabilities of the labelers' model, over counted (votes, form) rows."""
    if not counted:
        return None
    x = np.array([_row(list(v), list(f)) for v, f in counted])
    n = np.array(list(counted.values()), float)
    goal, kinds = np.zeros(len(n)), np.array([f[3:] for _, f in counted])
    for kind in np.unique(kinds, axis=0):                  # a labeler is as reliable as it is for this kind
        own = np.flatnonzero((kinds == kind).all(axis=1))
        patterns: dict[tuple[int, ...], int] = {}
        keys = list(counted)
        for i in own:
            patterns[keys[i][0]] = patterns.get(keys[i][0], 0) + int(n[i])
        share, rates = reliabilities(patterns)
        goal[own] = truth(np.array([keys[i][0] for i in own], np.int64), share, rates)
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(b))
        step = np.linalg.solve(curve, x.T @ (n * (goal - p)) - b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return b


def find_personal_data(transcripts: DataFrame, transcript_id: str = "transcript_id", full_text: str = "full_text",
                       threshold: float = 0.5) -> DataFrame:
    """One row per transcript: transcript_id, n_email, n_ip, n_card, n_phone, base_spans, spans.

    The counts are of base spans. base_spans and spans are kind:start:end (code points, end exclusive)
    ordered by start and kind, joined by commas; spans also has the accepted candidates. Null and empty
    texts have none; repeated rows give repeated rows; other columns are ignored; an empty table gives
    an empty result. Texts are taken whole.
    """
    rows = only(transcripts, transcript_id=transcript_id, full_text=full_text)
    kind = rows.schema["transcript_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, more, ballots, known = [], [], [], []
            for (text,) in arrow_rows(b, "full_text"):
                own = base_spans(text) if text else []
                extra = candidates(text, own) if text else []
                base.append([x for s in own for x in s])
                more.append([x for s in extra for x in s])
                for spans, cast in ((extra, ballots), (own, known)):
                    cast.append([float(x) for s in spans for x in chain(*votes(text, s))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.list_(pa.int64())), pa.array(more, pa.list_(pa.int64())),
                                              pa.array(ballots, pa.list_(pa.float64())), pa.array(known, pa.list_(pa.float64()))],
                                             ["transcript_id", "base", "more", "ballots", "known"])

    scanned = materialize(rows.mapInArrow(scan, f"transcript_id {kind}, base array<bigint>, more array<bigint>, ballots array<double>, known array<double>"), "spans")
    width = LABELERS + FORMS

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, int] = {}
        for b in batches:
            for flats in arrow_rows(b, "ballots", "known"):
                for flat in flats:
                    for at in range(0, len(flat), width):
                        key = tuple(flat[at:at + width])
                        found[key] = found.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in found], pa.list_(pa.float64())), pa.array(list(found.values()), pa.int64())],
                                         ["ballot", "n"])

    # Base spans vote and train too; they stay in the result whatever the verdict. Votes, a digit count, a count of blanks
    # and the kind: a few thousand different rows at most.
    counted = scanned.filter("size(ballots) + size(known) > 0").select("ballots", "known").mapInArrow(tally, "ballot array<double>, n bigint").groupBy("ballot").agg(
        F.sum("n").alias("n")).collect()
    classifier = train_classifier({(tuple(int(x) for x in r["ballot"][:LABELERS]), tuple(r["ballot"][LABELERS:])): r["n"] for r in counted})

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for base, more, ballots in arrow_rows(b, "base", "more", "ballots"):
                own = [tuple(base[i:i + 3]) for i in range(0, len(base), 3)]
                extra = []
                for i in range(0, len(more), 3):
                    ballot = ballots[i // 3 * width:(i // 3 + 1) * width]
                    x = np.array(_row([int(v) for v in ballot[:LABELERS]], ballot[LABELERS:]))
                    if classifier is not None and 1 / (1 + np.exp(-x @ classifier)) >= threshold:
                        extra.append(tuple(more[i:i + 3]))
                for k in range(4):
                    out[k].append(sum(s[1] == k for s in own))
                for place, spans in ((4, own), (5, sorted(own + extra))):
                    out[place].append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(out[k], pa.int64()) for k in range(4)], *[pa.array(out[k], pa.string()) for k in (4, 5)]],
                                             ["transcript_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"])

    return scanned.mapInArrow(decide, f"transcript_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_spans string, spans string")
