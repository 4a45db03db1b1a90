import datetime as dt
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from riskloom.functions import numbers as N
from riskloom.functions import text as X


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", build(F.col("v")).alias("r")).orderBy("i").collect()]


def test_normalize_key(spark):
    values = ["México", "Mexico ", " MEXICO", "Ñandú", "ĀČĘ", "é", " Perú\n", None, "日本x"]
    expected = [None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode().strip().lower()
                for v in values]
    assert column(spark, values, X.normalize_key) == expected


def test_normalize_key_of_long_texts(spark):
    """Four million characters with accents, ligatures, other scripts and marks, in far less than a minute."""
    odd = [*"éñÉøß日本жﬁ½Ⅷ", "e\u0301", "\U0001d400", "\u2028", *"".join(X.SEVERAL.values())[::97], *X.ACCENTED[::97]]
    values = [(f"Texto {i} " + odd[i % len(odd)] + " palabras sin más ") * 800 for i in range(180)]
    expected = [unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode().strip().lower() for v in values]
    started = time.monotonic()
    assert column(spark, values, X.normalize_key) == expected
    assert time.monotonic() - started < 45


@pytest.mark.parametrize("build, cases", [
    (X.mask_email, {"ana@x.co": "a***@x.co", "sin": "sin", "": "", "@x": "***@x", "a@b@c": "a***@b@c", None: None}),
    (X.mask_phone, {"+57 300 1234": "***1234", "12": "***", "": "", None: None}),
    (X.normalize_phone, {"whatsapp:+57 300 111": "+57300111", "300-111": "300111", None: "", " +1 2": "+12"}),
    (X.valid_email, {"a@b.co": True, "a@b": False, "a b@c.d": False, "x.y@z": False, None: False, "a@b@c.d": True}),
    (X.valid_phone, {"+573001234567": True, "573001234567": False, "+1234567": False, "whatsapp:+57 3001234": True, None: False}),
    (X.mask_cards, {"tarjeta 4111 1111 1111 1234.": "tarjeta •••• 1234.", "411111111111": "411111111111",
                    "4111-1111-1111-1": "•••• 1111", None: None}),
])
def test_contact_columns(spark, build, cases):
    assert column(spark, list(cases), build) == list(cases.values())


def test_windows():
    baseline, recent = N.recent_and_baseline("2026-06-17")
    assert recent == N.DayWindow(dt.date(2026, 5, 19), dt.date(2026, 6, 18)) and recent.days == 30
    assert baseline.end == recent.start and baseline.start == dt.date(2025, 5, 19)
    assert N.history_window("2026-06-17") == N.DayWindow(dt.date(2025, 6, 18), dt.date(2026, 6, 18))
    assert N.minus_months(dt.date(2024, 3, 31), 1) == dt.date(2024, 2, 29)
    assert N.DayWindow(dt.date(2025, 5, 19), dt.date(2026, 5, 19)).months_touched == 13


def test_age(spark):
    days = [dt.date(1990, 6, 17), dt.date(1990, 6, 18), None]
    assert column(spark, days, lambda c: N.age_at(c, "2026-06-17"), "date") == [36, 35, None]
    assert column(spark, [dt.date(1990, 12, 31)], lambda c: N.age_at(c, "2026-01-01"), "date") == [35]
    assert column(spark, [dt.date(2000, 2, 29)], lambda c: N.age_at(c, "2025-02-28"), "date") == [24]


def test_micros_do_not_depend_on_the_zone(spark):
    moment = dt.datetime(2024, 3, 31, 2, 30, 1, 5)
    expected = int((moment - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    assert column(spark, [moment], N.micros, "timestamp_ntz") == [expected]


def test_haversine(spark):
    km = spark.range(1).select(N.haversine_km(F.lit(4.6), F.lit(-74.1), F.lit(6.25), F.lit(-75.56))).first()[0]
    assert 230 < km < 260
