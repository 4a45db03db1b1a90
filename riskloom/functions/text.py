"""Text, contact and card columns."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c"


def _plain_letters() -> dict[str, str]:
    """Every character that is not ASCII and whose compatibility decomposition has ASCII characters."""
    table = {}
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x110000)]:
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if plain:
            table[chr(code)] = plain
    return table


_LETTERS = _plain_letters()
_SINGLE = {letter: plain for letter, plain in _LETTERS.items() if len(plain) == 1}
ACCENTED, PLAIN = "".join(_SINGLE), "".join(_SINGLE.values())
# Ligatures, fractions, roman numerals and the like, by what they stand for.
SEVERAL: dict[str, str] = {}
for _letter, _plain in _LETTERS.items():
    if len(_plain) > 1:
        SEVERAL[_plain] = SEVERAL.get(_plain, "") + _letter


def _as_ranges(letters: str) -> str:
    """The letters as ranges for a regular expression: its class is searched range by range."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, letters)):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\x{{{first:x}}}-\\x{{{last:x}}}" for first, last in ranges)


_NEITHER = r"[^\x00-\x7F" + _as_ranges("".join(SEVERAL.values())) + "]"

# 13 to 19 digits with single blanks or hyphens between them.
CARD_NUMBER = r"\b(?:\d[ -]?){9,15}(\d)[ -]?(\d)[ -]?(\d)[ -]?(\d)\b"
CARD_MASK = "•••• $1$2$3$4"


def _several() -> Column:
    return F.from_json(F.lit(json.dumps({c: plain for plain, letters in SEVERAL.items() for c in letters})), "map<string,string>")


def _is_ascii(text: Column) -> Column:
    """As many bytes as characters."""
    return F.octet_length(text) == F.char_length(text)


def strip_accents(text: Column) -> Column:
    """Plain letters for accented ones, several where one letter stands for several; what still is not
    ASCII (combining marks) is removed. Each step only sees the texts, and the last one the letters, that the
    steps before have left."""
    single = F.translate(text, ACCENTED, PLAIN)
    pieces = F.regexp_extract_all(F.regexp_replace(single, _NEITHER, ""), F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))
    spelt = F.array_join(F.transform(pieces, lambda c: F.when(_is_ascii(c), c).otherwise(F.try_element_at(_several(), c))), "")
    return F.when(_is_ascii(text), text).otherwise(F.when(_is_ascii(single), single).otherwise(spelt))


def normalize_key(text: Column) -> Column:
    """'México', 'Mexico ' and 'MEXICO' give the same key; null stays null."""
    return F.lower(F.btrim(strip_accents(text), F.lit(WHITESPACE)))


def normalize_or_empty(text: Column) -> Column:
    return F.coalesce(normalize_key(text), F.lit(""))


def present(text: Column) -> Column:
    """True for a text that is neither null nor empty."""
    return F.coalesce(text != "", F.lit(False))


def mask_email(email: Column) -> Column:
    """First letter and domain; a text without @ is left as it is."""
    return F.regexp_replace(email, r"(?s)^([^@]?)[^@]*@(.*)$", "$1***@$2")


def mask_phone(phone: Column) -> Column:
    """Last four digits; null and empty are left as they are."""
    digits = F.regexp_replace(phone, r"\D", "")
    masked = F.when(F.length(digits) >= 4, F.concat(F.lit("***"), F.right(digits, F.lit(4))))
    return F.when(phone == "", phone).when(phone.isNotNull(), F.coalesce(masked, F.lit("***")))


def valid_email(email: Column) -> Column:
    """Has an @, a dot after the last @, and no blank."""
    return F.coalesce(email.rlike(r"^[^ ]*@[^@ ]*\.[^@ ]*$"), F.lit(False))


def valid_phone(phone: Column) -> Column:
    """International form: + and 8 to 15 digits; blanks and a channel prefix do not matter."""
    digits = F.replace(F.replace(phone, F.lit("whatsapp:"), F.lit("")), F.lit(" "), F.lit(""))
    return F.coalesce(digits.rlike(r"^\+[0-9]{8,15}$"), F.lit(False))


def normalize_phone(phone: Column) -> Column:
    """Digits only, keeping a leading +; null gives an empty text."""
    bare = F.replace(phone, F.lit("whatsapp:"), F.lit(""))
    digits = F.regexp_replace(bare, r"\D", "")
    signed = F.when(F.trim(bare).startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)
    return F.coalesce(signed, F.lit(""))


def mask_cards(text: Column) -> Column:
    """Card numbers keep only their last four digits."""
    return F.regexp_replace(text, CARD_NUMBER, CARD_MASK)


def as_truth(value: Column, true_values: tuple[str, ...]) -> Column:
    """Text truth: one of the listed words after trimming and lower-casing; null is false."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*true_values), F.lit(False))
