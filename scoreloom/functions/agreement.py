"""Whether two values agree, for kernels: (passed, score, mode) by the first of a list of tests that decides.

Each list is in the order that gives a pair its mode; a test returns None where it does not decide.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher
from typing import NamedTuple

from . import prose, readings

STRING, EXACT = 0.9, 0.999


class Agreement(NamedTuple):
    passed: bool
    score: float
    mode: str


def yes(mode: str, score: float = 1.0) -> Agreement:
    return Agreement(True, score, mode)


def no(mode: str, score: float = 0.0) -> Agreement:
    return Agreement(False, score, mode)


def judged(ok: bool, mode: str) -> Agreement:
    return Agreement(bool(ok), float(bool(ok)), mode)


def first(tests) -> Agreement:
    return next(a for a in tests if a is not None)


# --- field values ---------------------------------------------------------------------------------------------------------------


def field_value(true, got) -> Agreement:
    """By the type of the true value: null, truth, integer, number, date, or a text by Jaro-Winkler."""
    if true is None:
        return judged(readings.plain(got) == "", "null")
    if isinstance(true, bool):
        return judged(readings.truth(got) is true, "boolean")
    if isinstance(true, (int, float)):
        n = readings.field_number(got)
        if isinstance(true, int):
            return judged(n is not None and math.isclose(n, round(n), abs_tol=1e-6) and round(n) == true, "integer")
        return judged(n is not None and math.isclose(true, n, rel_tol=1e-6, abs_tol=1e-6), "number")
    a, b = readings.field_date(true), readings.field_date(got)
    if a and b:
        return judged(a == b, "date")
    score = prose.jaro_winkler(readings.plain(true), readings.plain(got))
    return Agreement(score >= STRING, score, "jaro_winkler")


# --- values as text within a box ----------------------------------------------------------------------------------------------------

# fixed values: signs that PDF text layers give for others, letters that OCR confuses, words at the foot of pages
GLYPHS = {"µ": "u", "μ": "u", "Μ": "M", "×": "x", "÷": "/", "—": "-", "–": "-", "−": "-", "‐": "-", "‑": "-", "‒": "-", "“": '"', "”": '"', "„": '"', "‟": '"', "‘": "'", "’": "'"}
OCR_LETTERS = str.maketrans("þÞðÐáÁéÉíÍóÓúÚýÝöÖæÆ", "bPdDaAeEiIoOuUyYoOaA")
BOX_TRUE = ("true", "yes", "y", "1", "x", "✓", "✗", "✘", "☒", "[x]", "checked")
BOX_FALSE = ("false", "no", "n", "0", "", "[ ]", "☐", "unchecked")
_TAIL = re.compile(r"[.,;:!?*†‡§°™®©•·\]\|/]+\s*$")
_FOOT = re.compile(r"(?i)\s*(?:Monthly|Weekly|Annual|Quarterly|Daily|Bi-?Weekly|Semi-?Monthly|Hourly)\s*$")
_NUMBER = re.compile(r"^[\s$€£¥]*([-+]?)[\s$€£¥]*(\(?)\s*(\d{1,3}(?:[, ]\d{3})*(?:\.\d+)?|\.\d+|\d+(?:\.\d+)?)\s*(\)?)\s*[$€£¥%]*\s*$")


def untailed(s: str) -> str:
    return _TAIL.sub("", s).rstrip()


def glyphs(s: str) -> str:
    return "".join(GLYPHS.get(ch, ch) for ch in unicodedata.normalize("NFKC", s))


def box_number(s: str) -> float | None:
    """A number with currency, sign or brackets; or digit groups of which the last, of two digits, is cents."""
    s = untailed(s)
    if m := _NUMBER.match(s):
        v = float(re.sub("[, ]", "", m[3]))
        return -v if m[1] == "-" or m[2] and m[4] else v
    groups = s.strip().replace(",", "").split()
    if len(groups) > 1 and all(g.isdigit() for g in groups) and len(groups[-1]) == 2:
        return float("".join(groups[:-1]) + "." + groups[-1])
    return None


def _alnum(s: str) -> str:
    return re.sub("[^a-zA-Z0-9]+", "", s).casefold()


def _likeness(a: str, b: str) -> float:
    return prose.jaro_winkler(a.casefold(), b.casefold())


def box_text(true, kind: str, text: str | None, source: str = "native") -> Agreement:
    """Whether the text in a box is a value of a kind (string, number, boolean, date, null); ``source``: native or ocr.

    Modes annotation_truncated and ocr_noise_prefix say that the text holds more than the value.
    """
    b = " ".join((text or "").split())
    blank = lambda s: not re.sub(r"[\s—–−\-]", "", s)
    if true is None:
        return judged(blank(b), "null_empty") if blank(b) else no("none")
    a = " ".join(str(true).split())
    same = lambda f: f(a) != "" and f(a).casefold() == f(b).casefold()
    changed = lambda f: f(a) != a or f(b) != b
    none = no("none", _likeness(a, b) if kind == "string" and a else 0.0)
    if blank(a) and blank(b):
        return yes("null_empty")
    if a == b:
        return yes("identity")
    if kind == "string":
        folded = lambda s: untailed(glyphs(s))
        footless = lambda s: _FOOT.sub("", s).rstrip()
        for mode, ok in (("case_insensitive", same(str)), ("trailing_punct_fold", same(untailed)), ("unicode_compat_fold", same(folded) and changed(folded)), ("footer_text_trim", same(footless) and changed(footless))):
            if ok:
                return yes(mode)
    if kind == "number" or isinstance(true, (int, float)) and not isinstance(true, bool):
        x = float(true) if isinstance(true, (int, float)) and not isinstance(true, bool) else box_number(a) if isinstance(true, str) else None
        y = box_number(b)
        if x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6):
            return yes("numeric")
        bare = lambda s: re.sub(r"[\s,$€£¥%()]+", "", s)
        return no("none", _likeness(bare(a), bare(b)) if kind == "number" else none.score)
    if kind in ("string", "date") and re.match(r"^\d{4}-\d{2}-\d{2}$", a):
        days = {readings.parsed(b, dayfirst=d) for d in (False, True)} if b else set()
        return yes("date") if readings.parsed(a) in days - {None} else none
    if kind == "boolean":
        wanted = true if isinstance(true, bool) else a.lower() in BOX_TRUE if a.lower() in BOX_TRUE + BOX_FALSE else None
        bare = re.sub(r"[^\w]", "", b).casefold()
        got = True if bare in BOX_TRUE or b in BOX_TRUE else False if bare in BOX_FALSE or b in BOX_FALSE or len(b) <= 4 else None
        return yes("boolean") if wanted is not None and wanted == got else no("none")
    if kind == "string":
        x, y = _alnum(a), _alnum(b)
        tests = (
            ("ocr_punctuation_fold", source == "ocr" and x and x == y),
            ("alnum_text_fold", len(x) >= 8 and sum(map(str.isdigit, x)) >= 4 and x == y),
            ("icelandic_diacritic_fold", source == "ocr" and same(lambda s: s.translate(OCR_LETTERS))),
            ("annotation_truncated", len(x) >= 10 and len(y) > len(x) and y.startswith(x)),
            ("ocr_noise_prefix", len(x) >= 10 and 1 <= len(y) - len(x) <= 2 and y.endswith(x)),
        )
        for mode, ok in tests:
            if ok:
                return yes(mode)
    return none


def attributed(true, text, kind: str | None = None, source: str = "native", diagnostic: bool = False) -> Agreement:
    """``box_text``, but texts that are alike by Jaro-Winkler pass, and texts that hold more than the value only with ``diagnostic``."""
    kind = kind or readings.value_type(true)
    got = box_text(true, kind, "" if text is None else str(text), "ocr" if source == "ocr" else "native")
    more = got.mode in ("annotation_truncated", "ocr_noise_prefix") and not diagnostic
    if got.passed and not more:
        return yes(got.mode)
    score = 0.0 if got.passed else got.score
    if kind in ("string", "date") and score >= STRING:
        return yes("jaro_winkler", score)
    return no(got.mode if got.mode != "none" else "strict", score)


# --- extracted values --------------------------------------------------------------------------------------------------------------------

# fixed values: letters that have no decomposition
LETTERS = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ð": "d", "þ": "th", "đ": "d", "ł": "l", "ħ": "h", "ı": "i"})


def unaccented(s: str) -> str:
    s = s.translate(LETTERS)
    return s if s.isascii() else "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch))


def canonical(v) -> str:
    """A value as compared text: no case, accents, protocol, bullets or markup."""
    if v is None:
        return ""
    s = re.sub(r"\bhttps?://", "", unaccented(str(v).casefold())).replace("–", "-").replace("—", "-")
    return re.sub(r"\s+", " ", re.sub("[_`#]", " ", re.sub("[*•·]", " ", s))).strip(" ;,:\n\t")


def tokens(v) -> set[str]:
    return set(re.findall("[a-z0-9]+", canonical(v)))


def numerals(v) -> set[str]:
    return set(re.findall(r"\d+(?:\.\d+)?", re.sub(r"(?<=\d),(?=\d)", "", canonical(v))))


def contained(a, b) -> float:
    """The share of a's tokens that b has."""
    x, y = tokens(a), tokens(b)
    return len(x & y) / len(x) if x and y else 0.0


def supported(v, cited: str | None) -> bool:
    """A value stands in a cited text, or nearly all of its tokens do."""
    a, b = canonical(v), canonical(cited)
    if len(a) < 3 or not b:
        return False
    return a in b or contained(a, b) >= 0.85


def url(v) -> str:
    return re.sub(r"^www\.", "", re.sub("^https?://", "", str(v or "").strip().casefold())).rstrip("/")


def separatorless(v) -> str:
    return re.sub(r"[-\s/().,]", "", unaccented(v.casefold())) if isinstance(v, str) else ""


def _equal(a: float, b: float) -> bool:
    return abs(a - b) <= max(1e-9, 1e-9 * max(abs(a), abs(b)))


def _nothing(true, got, array: bool) -> Agreement | None:
    if got is None and true == [] and array:
        return yes("null_empty_list_equivalent")
    if got == true:
        return yes("identity")
    if true is None and isinstance(got, str) and got.strip().casefold() in ("present", "current"):
        return yes("present_null_current_equivalent")
    if readings.effectively_null(true) and readings.effectively_null(got):
        return yes("null_equivalent_empty")
    return no("null_vs_value") if got is None else None


def _numeric(true, got) -> Agreement | None:
    a, b = readings.single_number(true), readings.single_number(got)
    if a is not None and b is not None:
        if not _equal(a, b):
            return no("numeric_value_mismatch")
        if isinstance(true, str) and isinstance(got, str):
            x, y = (re.sub("[^0-9]", "", s) for s in (true, got))
            if x != y and "0" in (x[:1], y[:1]):
                return no("leading_zero_code_mismatch")
        return yes("numeric_equal")
    u, v = readings.number_with_unit(true), readings.number_with_unit(got)
    a, b = (x if x is not None else w for x, w in ((a, u), (b, v)))
    if (u is not None or v is not None) and a is not None and b is not None:
        return yes("numeric_equal_unit_suffix") if _equal(a, b) else no("numeric_value_mismatch")
    return None


def _same_text(true: str, got: str) -> Agreement | None:
    if url(true) and url(true) == url(got):
        return yes("url_protocol_equivalent" if "/" in true or true.strip().casefold().startswith(("http", "www.")) else "casefold_equivalent")
    key = separatorless(true)
    if key and key == separatorless(got) and (any(map(str.isalpha, key)) or sum(map(str.isdigit, key)) >= 7):
        return yes("separator_insensitive_equivalent")
    if re.sub(r"\s*\([^)]*\)\s*$", "", true).strip().casefold() == got.strip().casefold():
        return yes("parenthetical_detail_omitted")
    return None


def _days(true: str, got: str, dated: bool) -> Agreement | None:
    a, b, month = readings.iso_day(true), readings.iso_day(got), readings.year_month(true)
    if month and month == readings.year_month(got) and (a is None or b is None):
        return yes("year_month_equivalent")
    if a and b and a != b:
        return no("date_mismatch")
    if a and b is None and len(days := readings.embedded_dates(got)) == 1:
        return yes("date_equivalent_embedded") if a in days else no("date_mismatch")
    if a and dated and a[1:] == readings.month_day(got):
        return yes("month_day_without_year_equivalent")
    return None


def _contents(true: str, got: str) -> Agreement | None:
    n, m = numerals(true), numerals(got)
    if not readings.looks_temporal(true) and not readings.looks_temporal(got):
        share, back = contained(true, got), contained(got, true)
        a, b = canonical(true), canonical(got)
        if share >= 0.95 and len(tokens(true)) >= 3 and n == m:
            return yes("token_containment", share)
        if len(b) >= 30 and len(tokens(b)) >= 5 and b in a:
            return yes("long_exact_substring")
        if back >= 0.95 and len(tokens(got)) >= 4 and len(b) >= 18 and m <= n:
            return yes("concise_string_contained_in_expected", back)
    return no("numeric_mismatch") if n and m and n != m else None


def _typed(true, got, kind: str | None) -> Agreement:
    got_ = attributed(true, got, kind, "structured")
    if not got_.passed:
        longer = len(canonical(got)) - len(canonical(true)) <= 3
        if got_.mode == "ocr_noise_prefix" or got_.mode == "annotation_truncated" and longer:
            return yes(got_.mode, max(got_.score, 0.99))
        return got_
    if got_.mode == "jaro_winkler":
        x, y = tokens(true) - tokens(got), tokens(got) - tokens(true)
        if len(x) >= 2 and len(y) >= 2:
            return no("jaro_winkler_token_divergence", got_.score)
        if bool(x) != bool(y):
            return no("jaro_winkler_token_drop", got_.score)
        if x and (min(map(len, x | y)) <= 3 or max(SequenceMatcher(None, p, q).ratio() for p in x for q in y) < 0.7):
            return no("jaro_winkler_token_divergence", got_.score)
    return got_


def values(true, got, kind: str | None = None, array: bool = False, dated: bool = False) -> Agreement:
    """An extracted value against the true one. ``kind``: the schema's type; ``array``: the schema has an array here; ``dated``: the path names a date."""
    text = isinstance(true, str) and isinstance(got, str)
    tests = (
        lambda: _nothing(true, got, array), lambda: _numeric(true, got), lambda: _same_text(true, got) if text else None,
        lambda: _days(true, got, dated) if text else None, lambda: _contents(true, got) if text else None, lambda: _typed(true, got, kind),
    )
    return first(t() for t in tests)


# --- evidence ------------------------------------------------------------------------------------------------------------------------------


def _letters(v) -> str:
    s = unicodedata.normalize("NFKC", "" if v is None else str(v))
    return " ".join(re.sub(r"[^\w\s]", " ", s).casefold().split())


def _some_number(v) -> float | None:
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float)):
        return float(v)
    m = re.search(r"[-+]?\d[\d,]*(?:\.\d+)?", str(v))
    if not m:
        return None
    n = float(m[0].replace(",", ""))
    return -abs(n) if re.search(r"\([^)]*\)", str(v)) else n


def _evidence_truth(v) -> bool | None:
    if isinstance(v, bool):
        return v
    s = _letters(v)
    return True if s in ("true", "yes", "y", "1", "checked", "x") else False if s in ("false", "no", "n", "0", "unchecked", "") else None


def _by_number(a, b, mode: str) -> Agreement:
    x, y = _some_number(a), _some_number(b)
    return judged(x is not None and y is not None and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6), mode)


def _by_truth(a, b) -> Agreement:
    x, y = _evidence_truth(a), _evidence_truth(b)
    return judged(x is not None and x == y, "boolean")


def evidence(true, got, comparator: str | dict | None = None) -> Agreement:
    """A value of evidence by a named comparator, or an object by one for each of its keys."""
    spec = comparator or "case_insensitive"
    if isinstance(spec, dict):
        if not isinstance(true, dict) or not isinstance(got, dict):
            return no("object")
        scores = []
        for k, c in spec.items():
            if k in true:
                a = evidence(true[k], got[k], c) if k in got else no("object")
                if not a.passed:
                    return no(f"object.{c}" if k in got else "object", a.score)
                scores.append(a.score)
        return yes("object", sum(scores) / len(scores) if scores else 1.0)
    name = spec.casefold().strip()
    if true is None:
        return judged(_letters(got) == "", "null")
    if name in ("exact", "identity"):
        text = isinstance(true, str) or isinstance(got, str)
        return judged(" ".join(str(true).split()) == " ".join(("" if got is None else str(got)).split()) if text else true == got, "exact")
    if name in ("case_insensitive", "enum", "name", "address"):
        if isinstance(true, bool):
            return _by_truth(true, got)
        if isinstance(true, (int, float)):
            return _by_number(true, got, "number")
        score = prose.jaro_winkler(_letters(true), _letters(got))
        return Agreement(score >= STRING, score, name)
    if name in ("string_substring", "substring", "contains"):
        a, b = _letters(true), _letters(got)
        ok = bool(a) and (a in b or b in a)
        return Agreement(ok, 1.0 if ok else prose.jaro_winkler(a, b), "string_substring")
    if name in ("number", "number_with_unit", "currency"):
        return _by_number(true, got, name)
    if name == "date":
        a, b = (None if v is None else readings.parsed(str(v), fuzzy=True) for v in (true, got))
        return judged(a is not None and a == b, "date")
    if name == "phone":
        a, b = (re.sub(r"\D+", "", "" if v is None else str(v)) for v in (true, got))
        return judged(a[-10:] == b[-10:] if min(len(a), len(b)) >= 10 else a == b and bool(a), "phone")
    return _by_truth(true, got) if name == "boolean" else no(name or "unknown")


def stable(v) -> str:
    """A value as a key: case, punctuation and the order of an object's keys dropped."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{stable(v[k])}" for k in sorted(v)) + "}"
    return "[" + ",".join(map(stable, v)) + "]" if isinstance(v, list) else _letters(v)


def evidence_array(true: list, got, comparator=None, structural: str | None = None, exhaustive: bool | None = None, least: int | None = None) -> Agreement:
    """Arrays in order, as sets, as multisets, or by the keys that ``match_by:a,b`` names; ``exhaustive`` (the default) allows nothing beyond."""
    mode, whole = structural or "ordered", exhaustive is None or exhaustive
    name = mode.partition(":")[0]
    if not isinstance(got, list):
        return no(structural or "array")
    if len(true) < (len(true) if least is None else least):
        return no(structural or "array")
    if name not in ("set", "multiset", "match_by"):
        if len(got) < len(true) or whole and len(got) != len(true):
            return no("ordered")
        each = [evidence(a, b, comparator) for a, b in zip(true, got, strict=False)]
        bad = next((a for a in each if not a.passed), None)
        return no("ordered", bad.score) if bad else yes("ordered", sum(a.score for a in each) / len(each) if each else 1.0)
    if name == "multiset" and not comparator:
        a, b = Counter(map(stable, true)), Counter(map(stable, got))
        return judged(a == b if whole else a <= b, "multiset")
    keys = [k.strip() for k in mode.partition(":")[2].split(",") if k.strip()]
    if name == "match_by" and (not keys or any(not isinstance(x, dict) or k not in x for x in true for k in keys)):
        return no("match_by")

    def best(row) -> float | None:
        if name != "match_by":
            found = [evidence(x, row, comparator) for x in true]
        elif not isinstance(row, dict):
            return None
        else:
            of = lambda k: comparator.get(k) if isinstance(comparator, dict) else None
            mine = [x for x in true if all(evidence(x[k], row.get(k), of(k)).passed for k in keys)]
            found = [evidence({k: v for k, v in x.items() if v is not None}, row, comparator) for x in mine]
        return max((a.score for a in found if a.passed), default=None)

    scores = [best(row) for row in got]
    matched = [s for s in scores if s is not None]
    needed = least if least is not None else len({tuple(stable(x[k]) for k in keys) if keys else stable(x) for x in true})
    ok = len(matched) >= needed and not (whole and len(matched) < len(got))
    return Agreement(ok, sum(matched) / len(matched) if matched else 0.0, name)


# --- table cells --------------------------------------------------------------------------------------------------------------------------


def cell_equal(true, got, field: str, fuzzy: dict[str, float] | None = None) -> bool:
    """Cells of records: texts once white space is one space, others as they are; texts of a field with a threshold by likeness of their words."""
    if isinstance(true, str) and isinstance(got, str):
        if fuzzy and field in fuzzy:
            a, b = (" ".join(re.sub(r"[^\w\s]", " ", s).split()).lower() for s in (true, got))
            return a == b or bool(a and b) and prose.ratio(a, b) >= fuzzy[field]
        return " ".join(true.split()) == " ".join(got.split())
    return bool(true == got)


def configured(true, got, field: str, fuzzy: dict[str, float] | None = None, normalizers: tuple[str, ...] = ()) -> bool:
    """``cell_equal``, or equal under one of the field's normalisers, which can only mend a mismatch."""
    if cell_equal(true, got, field, fuzzy):
        return True
    if "null_equals_false" in normalizers and all(v is None or v is False for v in (true, got)):
        return True
    if not isinstance(true, str) or not isinstance(got, str):
        return False
    ends = [re.sub(r"\s*[.,;:]\s*$", "", s.strip()) for s in (true, got)]
    tight = [re.sub(r"\s*([,.;:])\s*", r"\1", s) for s in (true, got)]
    digits = [re.sub(r"\D", "", s) for s in (true, got)]
    phones = digits[0][-10:] == digits[1][-10:] if min(map(len, digits)) >= 10 else bool(digits[0]) and digits[0] == digits[1]
    tests = {
        "optional_terminal_punctuation": all(ends) and cell_equal(*ends, field, fuzzy), "punctuation_spacing": cell_equal(*tight, field, fuzzy),
        "case_insensitive": " ".join(true.split()).casefold() == " ".join(got.split()).casefold(), "phone_digits": phones,
        "lenient_date": bool(readings.lenient_dates(true) & readings.lenient_dates(got)),
    }
    return any(tests.get(n, False) for n in normalizers)


def parsed_json(s: str | None):
    """JSON, or the text itself where it is none."""
    try:
        return json.loads(s) if s is not None else None
    except ValueError:
        return s
