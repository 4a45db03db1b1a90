import random
import re

import pytest

from riskloom.llm import pii
from tests.llm.helpers import empty, odd_rows, transcripts

RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def slow(text):
    found = []
    for kind, (name, rule) in enumerate(RULES):
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0
            if {"email": True, "ip": name == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn,
                    "phone": 9 <= len(digits) <= 15}[name]:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_are_those_of_the_rules():
    rng = random.Random(3)
    parts = ["a", ".", "@", "-", "b.co", "@x.y", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.255", "1.2.3.256", "0000000001.2.3.4", "+34 (600) 12-34.56", "+", "9",
             " ", "12", "(", ")", "é", "\U0001F600", "_%", "@@", "..", "1.2.3.4.5.6.7.8"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == slow(text), repr(text)


def rows_of(spark, rows):
    return {r.transcript_id: r for r in pii.find_personal_data(transcripts(spark, rows)).collect()}


def test_base_spans_stay_and_odd_rows_pass(spark):
    rows = odd_rows()
    found = pii.find_personal_data(transcripts(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = [t for k, t in rows if k == r.transcript_id][0]
        expected = slow(text)
        assert r.base_spans == ",".join(f"{RULES[k][0]}:{s}:{e}" for s, k, e in expected)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in expected) for k in range(4))
        assert set(r.base_spans.split(",")) <= set(r.spans.split(","))
    assert pii.find_personal_data(empty(spark)).count() == 0


def card_number(rng, first="4", good=True):
    digits = first + "".join(str(rng.randrange(10)) for _ in range(15 - len(first)))
    last = next(d for d in "0123456789" if pii.luhn(digits + d))
    return digits + (last if good else str((int(last) + rng.randrange(1, 10)) % 10))


def planted(seed=5, n=60):
    """(text, place of a true span that the rules miss or None) of many shapes, and numbers and words that look alike."""
    rng, rows = random.Random(seed), []

    def digits(k):
        return str(rng.randrange(1, 10)) + "".join(str(rng.randrange(10)) for _ in range(k - 1))

    def add(before, span, after, true, kind):
        rows.append((f"{before}{span}{after}", (kind, len(before), len(before) + len(span)) if true else None))

    for i in range(n):
        card = card_number(rng, rng.choice(["4", "51", "37"]))
        add("mi tarjeta es la ", "/".join(card[k:k + 4] for k in range(0, 16, 4)), " gracias", True, "card")
        add("pago con visa ", ".".join(card[k:k + 4] for k in range(0, 16, 4)), ", ya", True, "card")
        add("mi teléfono es ", f"({rng.randrange(200, 999)}) {digits(3)}-{digits(4)}", " gracias", True, "phone")
        add("llame al móvil ", f"{digits(3)}.{digits(3)}.{digits(4)}", " hoy", True, "phone")
        add("escriba a ", f"ana{i} (at) example (dot) com", " por correo", True, "email")
        add("my mail is ", f"joe{i} at mail{i % 9} dot example dot org", " thanks", True, "email")
        add("correo: ", f"eva{i} @ gmail.com", " por favor", True, "email")
        add("el servidor ", f"{rng.randrange(11, 220)}[.]{rng.randrange(99)}[.]{rng.randrange(99)}[.]{rng.randrange(99)}", " no responde", True, "ip")
        add("importe ", f"{digits(3)} {digits(3)} {digits(4)}", " en la tabla " + " ".join(digits(3) for _ in range(12)), False, "phone")
        add("pedido ", digits(9), " enviado", False, "phone")
        add("un número ", card_number(rng, "9", good=False), " cualquiera", False, "card")
        add("la factura ", card_number(rng, "8", good=False), " vencida", False, "card")
        add("total ", f"{digits(3)}.{digits(3)}.{digits(3)} €", " pagado", False, "phone")
        add("nos vemos ", f"hoy @ casa{i}", " a las ocho", False, "email")
        add("versión ", f"{i % 9}.{i % 5}.{i % 7}[.]{300 + i}", " instalada", False, "ip")
    return rows


def test_precision_and_recall_of_the_added_spans(spark):
    rows = planted()
    rng = random.Random(1)
    base = [(f"base {i}: {rng.choice(['mail', 'x'])} p{i}@mail.example.com, tarjeta {card_number(rng)}, +34 600 {100 + i} 222, 10.1.2.{i}", None) for i in range(60)]
    found = rows_of(spark, [(i, text) for i, (text, _) in enumerate(rows + base)])
    hit = wrong = missed = 0
    for i, (_, truth) in enumerate(rows):
        r = found[i]
        added = {tuple(s.split(":")) for s in r.spans.split(",") if s} - {tuple(s.split(":")) for s in r.base_spans.split(",") if s}
        expected = {(truth[0], str(truth[1]), str(truth[2]))} if truth else set()
        hit += len(added & expected)
        wrong += len(added - expected)
        missed += len(expected - added)
    assert hit / (hit + missed) >= 0.9 and hit / (hit + wrong) >= 0.9, (hit, wrong, missed)
    assert all(found[len(rows) + i].base_spans == ",".join(f"{RULES[k][0]}:{s}:{e}" for s, k, e in slow(text)) for i, (text, _) in enumerate(base))


def test_labelers_say_no():
    text = "importe 123 456 7890 €"
    assert pii.votes(text, (8, 3, 20))[0] == [1, -1, -1, -1, -1, 0, -1]
    assert pii.votes("a @ casa", (0, 0, 8))[0][:2] == [0, 0]
    assert pii.votes("card 9999 9999 9999 9999", (5, 2, 24))[0][1] == 0 and pii.votes("card 9999 9999 9999 9999", (5, 2, 24))[0][6] == 0


def test_reliable_labelers_are_recognised():
    rng = random.Random(9)
    patterns = {}
    for _ in range(5000):
        true = rng.random() < 0.3
        votes = tuple(-1 if rng.random() < 0.2 else int(true if rng.random() < right else not true) for right in (0.95, 0.9, 0.85, 0.6, 0.55))
        patterns[votes] = patterns.get(votes, 0) + 1
    share, rates = pii.reliabilities(patterns)
    yes = rates[:, :, 1] / (rates[:, :, 0] + rates[:, :, 1])
    assert share == pytest.approx(0.3, abs=0.05)
    assert yes[0, 1] > 0.9 and yes[0, 0] < 0.1 and yes[3, 1] < 0.75 and yes[4, 0] > 0.3
