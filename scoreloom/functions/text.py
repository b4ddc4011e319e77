"""Text canonicalisation and comparison as column expressions. Rules run in order; the order is part of CANON_VERSION."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CANON_VERSION = "1"

# fixed values: code points and spellings that the rules are about
ARABIC_INDIC, EXTENDED_INDIC, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"
SEPARATORS_FROM, SEPARATORS_TO = "٫٬٪", ".,%"
INVISIBLE = "[\\u200B-\\u200F\\u202A-\\u202E\\u2066-\\u2069\\uFEFF]"
DIACRITICS = "[\\u064B-\\u065F\\u0670\\u06D6-\\u06DC\\u06DF-\\u06E4\\u06E7\\u06E8\\u06EA-\\u06ED\\u0640]"
LETTERS_FROM, LETTERS_TO = "أإآٱىة", "اااايه"
CLOSING = "[,،.؛;:!؟?%)\\]]"
MOJIBAKE = "[ÃÂØÙ][\\u0080-\\u00BF]"
NULL_FORMS = ("", "-", "—", "–", "null", "none", "n/a")


def nfkc(c: Column) -> Column:
    """Unicode NFKC, which Spark lacks."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return run(c)


def nfc(c: Column) -> Column:
    """Unicode NFC."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return run(c)


def strip_invisibles(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, DIACRITICS, "")


def fold_numerals(c: Column) -> Column:
    return F.translate(c, ARABIC_INDIC + EXTENDED_INDIC + SEPARATORS_FROM, ASCII_DIGITS * 2 + SEPARATORS_TO)


def fold_paren_negatives(c: Column) -> Column:
    """(1,000) is -1,000."""
    return F.regexp_replace(c, r"(?U)\(\s*(\d[\d,.]*)\s*\)", "-$1")


def fold_letters(c: Column) -> Column:
    return F.translate(c, LETTERS_FROM, LETTERS_TO)


def era_spacing(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(\d)\s+([مه])(?!\w)", "$1$2")


def spacing(c: Column) -> Column:
    """White space collapses; none stays before closing punctuation (of either script), after an opening bracket, or at the ends."""
    one = F.regexp_replace(c, r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(one, f" ({CLOSING})", "$1"), r"([(\[]) ", "$1"))


def rules(letters: bool = False, unicode: bool = True) -> list[tuple[str, object]]:
    """The active rules, in order; letters are folded after negatives and before spacing."""
    first = [("text/nfkc", nfkc)] if unicode else []
    first += [("text/strip_invisibles", strip_invisibles), ("text/strip_diacritics", strip_diacritics), ("text/fold_numerals", fold_numerals), ("text/fold_paren_negatives", fold_paren_negatives)]
    last = [("text/normalize_spacing", spacing), ("text/era_marker_spacing", era_spacing)]
    return first + ([("text/fold_letter_variants", fold_letters)] if letters else []) + last


def canonical(c: Column, letters: bool = False, unicode: bool = True) -> Column:
    for _, rule in rules(letters, unicode):
        c = rule(c)
    return c


def traced(c: Column, letters: bool = False, unicode: bool = True) -> tuple[Column, Column]:
    """(canonical text, names of the rules that changed it)."""
    fired = []
    for name, rule in rules(letters, unicode):
        after = rule(c)
        fired.append(F.when(~after.eqNullSafe(c), F.lit(name)))
        c = after
    return c, F.filter(F.array(*fired), lambda x: x.isNotNull())


def mojibake_pairs(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(MOJIBAKE)), F.lit(0))


def is_null_form(c: Column) -> Column:
    """A blank or one of the written forms of nothing; 0 is a value."""
    return c.isNull() | F.lower(F.trim(c)).isin(*NULL_FORMS)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0))


def script_of_run(run: Column) -> Column:
    western, arabic = run.rlike("[0-9]"), run.rlike(f"[{ARABIC_INDIC}{EXTENDED_INDIC}]")
    return F.when(western & arabic, "mixed").when(arabic, "arabic-indic").otherwise("western")


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " "), r"\s+", " "))


def cell_text(c: Column) -> Column:
    """Typographic variants of a cell to plain ones: quotes, dashes, dot leaders, sup and sub digits, emphasis."""
    c = F.regexp_replace(c, r"(?i)</?(b|i|u|em|strong|sup|sub)>", "")
    c = F.translate(c, "“”‘’‐‑‒–—−²³¹⁰", "\"\"''------2310")
    c = F.regexp_replace(F.regexp_replace(c, r"\*\*|__", ""), r"\.{3,}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s*-+\s*$", "-"), r"\s+", " "))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / the longer length; both empty is 1."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)
