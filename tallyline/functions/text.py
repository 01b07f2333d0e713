"""Names and case identifiers: normal forms as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline import constants as K


def clean(text: Column) -> Column:
    """text with no-break spaces as blanks, trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, "[\\u00A0\\uFEFF\\s]+", " ")), F.lit(""))


@cache
def _unaccented() -> tuple[str, str]:
    """Letters whose decomposition is an ASCII letter and combining marks, and those ASCII letters."""
    pairs = [(chr(c), d) for c in range(0xC0, 0x2000) if len(d := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not "̀" <= x <= "ͯ")) == 1 and d.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def upper_plain(text: Column) -> Column:
    """Upper case without accents, with straight quotes; null becomes empty."""
    src, dst = _unaccented()
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), src, dst), "[\\u0300-\\u036f]", "")
    return F.translate(F.upper(plain), "‘’`", "'''")


def letters(text: Column) -> Column:
    """The A-Z of a text: what identifies a person on a roster."""
    return F.regexp_replace(upper_plain(text), "[^A-Z]", "")


def alphanumerics(text: Column) -> Column:
    return F.regexp_replace(upper_plain(text), "[^A-Z0-9]", "")


def plain_words(text: Column) -> Column:
    """Upper-case words of letters and digits, one blank apart."""
    return F.trim(F.regexp_replace(upper_plain(text), "[^A-Z0-9]+", " "))


def _blanked(text: Column, words: list[str]) -> Column:
    return F.regexp_replace(text, rf"\b({'|'.join(words)})\b", " ")


def _split(text: Column) -> Column:
    """struct(initials, core) of an upper-case text."""
    for words in (K.TITLES, K.ROLES, K.PARTY_SEPARATORS):
        text = _blanked(text, words)
    text = F.regexp_replace(text, r"\b[RDP]-?\d+\b", " ")
    tokens = F.filter(F.split(F.regexp_replace(text, "[^A-Z. ]", " "), r"[.\s]+"), lambda t: t != "")
    return F.struct(F.filter(tokens, lambda t: F.length(t) == 1).alias("initials"), F.filter(tokens, lambda t: F.length(t) > 1).alias("core"))


def name_parts(name: Column) -> Column:
    """struct(initials, core) of a printed name: single letters, and longer words without titles, roles and markers."""
    return _split(F.regexp_replace(upper_plain(name), r"^M/S\.?\s*", ""))


def name_readings(name: Column) -> Column:
    """All ways to read a name: as printed, and with an opening MR., DR. and the like as initials."""
    text = F.trim(F.regexp_replace(upper_plain(name), r"^M/S\.?\s*", ""))
    opener = rf"^({'|'.join(K.OPENERS)})[.\s]+(?=[A-Z])"
    dotted = F.regexp_replace(F.regexp_extract(text, opener, 1), "(.)(?=.)", "$1.")
    other = _split(F.concat(dotted, F.lit("."), F.regexp_replace(text, opener, "")))
    both = F.when(text.rlike(opener) & (F.size(other["core"]) > 0), F.array(name_parts(name), other))
    return F.coalesce(both, F.array(name_parts(name)))


def skeleton(text: Column) -> Column:
    """The consonants that survive transliteration."""
    folded = reduce(lambda t, rule: F.replace(t, F.lit(rule[0]), F.lit(rule[1])), K.SKELETON_RULES, letters(text))
    return F.regexp_replace(F.regexp_replace(folded, r"(.)\1+", "$1"), "[AEIOU]", "")


def case_key(raw: Column, ocr: bool = False) -> Column:
    """TYPE/number/year of one case number, or the cleaned text if it holds none.

    ocr: misread characters are folded, letters in the type and digits in the number and year.
    """
    text = F.replace(upper_plain(raw), F.lit("."), F.lit(""))
    text = _blanked(text, ["OF", "NO", "NOS", "SL", "CASE", "YEAR"])
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"NO(?=\d)", " "), "[^A-Z0-9]+", " "))
    text = F.regexp_replace(text, r"\b([A-Z]{1,8})(\d+)\b", "$1 $2")
    pattern = r"([A-Z0-9]{1,8})\s*([0-9OILSBGZQD]+)\s*([0-9OILSBGZQD]{4})"
    kind, number, year = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    if ocr:
        digits, alphas = ("".join(K.OCR_DIGITS), "".join(K.OCR_DIGITS.values())), ("".join(K.OCR_LETTERS), "".join(K.OCR_LETTERS.values()))
        kind, number, year = F.translate(kind, *alphas), F.translate(number, *digits), F.translate(year, *digits)
    leading = F.regexp_replace(F.regexp_extract(number, r"^\d+", 0), r"^0+(?=\d)", "")  # as far as it is a number
    return F.when(text.rlike(pattern), F.concat_ws("/", kind, F.coalesce(F.nullif(leading, F.lit("")), number), year)).otherwise(text)


def case_key_from_parts(kind: Column, number: Column, year: Column) -> Column:
    return case_key(F.concat_ws("/", *(F.coalesce(c, F.lit("")) for c in (kind, number, year))))


def case_mentions(text: Column) -> Column:
    """All that look like case numbers in a text, as printed."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(K.CASE_IN_TEXT), F.lit(0)), lambda m: F.trim(m))


def dates_iso(text: Column) -> Column:
    """yyyy-MM-dd of the first d.m.yyyy in a text, as printed, not validated; null if there is none."""
    d, m, y = (F.regexp_extract(text, K.REPOST_DATE, k) for k in (1, 2, 3))
    return F.when(text.rlike(K.REPOST_DATE), F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def is_noise(line: Column) -> Column:
    """Lines of a name column that hold no name."""
    words = rf"\b({'|'.join(K.NOISE_WORDS)})\b"
    text = F.trim(F.coalesce(line, F.lit("")))
    return (text == "") | text.rlike("^-+$") | text.rlike(r"\d{4,}") | F.upper(text).rlike(words) | (F.length(text) > K.NAME_MAX_CHARS)


def highlight_spans(text: Column, needle: Column) -> Column:
    """array(struct(start, end)) of the places of needle in text that do not overlap, from 0."""
    pieces = F.split(text, F.concat(F.lit(r"\Q"), needle, F.lit(r"\E")), -1)
    at = F.aggregate(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans")),
        lambda s, p: F.struct((s["at"] + F.length(p) + F.length(needle)).alias("at"), F.array_append(s["spans"], F.struct((s["at"] + F.length(p)).alias("start"), (s["at"] + F.length(p) + F.length(needle)).alias("end"))).alias("spans")),
        lambda s: s["spans"],
    )
    return F.when(F.coalesce(needle, F.lit("")) != "", at).otherwise(F.expr("cast(array() as array<struct<start: int, end: int>>)"))
