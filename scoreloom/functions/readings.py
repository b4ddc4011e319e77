"""Numbers, dates and truth values as written: the readings that kernels compare."""

from __future__ import annotations

import math
import re
import unicodedata
from datetime import date, datetime

from dateutil import parser as dates

# fixed values: scale words and letters, months, and the shapes that count as dates
SCALES = (
    (r"(trillion|trill|trn)$", 1e12), (r"(billion|bill|bln)$", 1e9), (r"(million|mill|mln)$", 1e6),
    (r"t$", 1e12), (r"g$", 1e9), (r"b$", 1e9), (r"m$", 1e6), (r"k$", 1e3),
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
WHOLE_DATES = (
    r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}/\d{1,2}/\d{4}", r"\d{1,2}/\d{1,2}/\d{2}\b", r"\d{1,2}-\d{1,2}-\d{4}", r"\d{1,2}-\d{1,2}-\d{2}\b",
    r"[A-Za-z]+ \d{1,2},? \d{4}", r"[A-Za-z]+\.? [A-Za-z]+\.? \d{1,2},? \d{4}", r"\d{1,2} [A-Za-z]+ \d{4}",
)
FIELD_DATES = (
    r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}/\d{1,2}/\d{2,4}", r"\d{1,2}-\d{1,2}-\d{2,4}",
    r"(?:[A-Za-z]{3,9}\.?\s+)?[A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{4}", r"\d{1,2}\s+[A-Za-z]{3,9}\.?\s+\d{4}",
)
TRUE, FALSE = ("true", "yes", "y", "1", "checked"), ("false", "no", "n", "0", "unchecked")
UNSEEN = "­​⁠﻿"


def month_number(name: str) -> int:
    return next(i for i, m in enumerate(MONTHS, 1) if m.startswith(name.lower()[:3]))


# --- numbers of charts --------------------------------------------------------------------------------------------------------


def number(s: str | None) -> float | None:
    """A number with its currency sign, thousands separators, percent sign and scale word or letter taken into account."""
    s = re.sub(r"\s*[$€£¥]$", "", re.sub(r"^[$€£¥]\s*", "", (s or "").strip()))
    s = re.sub(r"^[~≈]\s*", "", s).rstrip("%").replace(",", "").replace(" ", "")
    scale = 1.0
    for pattern, by in SCALES:
        if re.search(rf"(?i){pattern}", s):
            s, scale = re.sub(rf"(?i)\s*{pattern}", "", s), by
            break
    try:
        return float(s) * scale
    except ValueError:
        return None


def numbers(s: str | None) -> list[float]:
    """The readings of a number: with commas between thousands, and as decimal commas."""
    readings = [number(s), number((s or "").replace(",", ".")) if "," in (s or "") else None]
    return list(dict.fromkeys(x for x in readings if x is not None))


def numbers_match(a: str, b: str, tolerance: float = 0.01) -> bool:
    """Some readings differ by no more than a share of the larger; beside a zero, by less than the tolerance itself."""
    for x in numbers(a):
        for y in numbers(b):
            if x == y == 0 or (abs(x - y) < tolerance if 0 in (x, y) else abs(x - y) / max(abs(x), abs(y)) <= tolerance):
                return True
    return False


def numeric_similarity(true: str, got: str) -> float | None:
    """1 - relative error at the best readings; None where a side is no number."""
    scores = [float(abs(y) < 0.001) if x == 0 else max(0.0, 1 - abs(x - y) / abs(x)) for x in numbers(true) for y in numbers(got)]
    return max(scores, default=None)


def date_forms(s: str) -> set[str]:
    """The coarse dates a label may stand for: year, month-year and quarter."""
    low = s.strip().lower()
    m = re.match(r"^(\d{4})-(\d{2})-\d{2}\s+\d{2}:\d{2}:\d{2}$", low)
    year, month = (m[1], m[2]) if m else (None, None)
    if not m and (m := re.match(r"^(\d{1,2})-(\d{4})$", low)):
        year, month = m[2], m[1].zfill(2)
    if year:
        quarter = {"01": 1, "04": 2, "07": 3, "10": 4}.get(month)
        return {year, f"{month}-{year}"} | ({f"q{quarter}-{year}"} if quarter else set())
    return {low} if re.match(r"^(q\d-)?\d{4}$", low) else set()


def dates_match(a: str, b: str) -> bool:
    return bool(date_forms(a) & date_forms(b))


# --- numbers and dates of fields ---------------------------------------------------------------------------------------------------


def single_number(v) -> float | None:
    """A value that is one signed number, with brackets as minus; no percentage, fraction or truth value."""
    if isinstance(v, bool) or not isinstance(v, (int, float, str)):
        return None
    if not isinstance(v, str):
        return float(v) if math.isfinite(v) else None
    s, minus = v.strip(), False
    if not s or "%" in s or "/" in s:
        return None
    if s.startswith("(") and s.endswith(")"):
        s, minus = s[1:-1].strip(), True
    if s[:1] in ("+", "-"):
        s, minus = s[1:].strip(), minus or s[0] == "-"
    s = s.lstrip("$").strip()
    if not re.match(r"^\d[\d,]*(?:\.\d+)?$", s):
        return None
    return float(s.replace(",", "")) * (-1 if minus else 1)


def number_with_unit(v) -> float | None:
    m = re.match(r"^([$\-(]?[\d,]+(?:\.\d+)?\)?)\s*([A-Za-z%]{1,5})\.?$", v.strip()) if isinstance(v, str) else None
    return single_number(m[1]) if m else None


def year_month(v) -> str | None:
    """The month of a value; a time in the last two hours of a day from the 28th on counts for the month that follows."""
    s = "" if v is None else str(v).strip()
    if m := re.match(r"^(\d{4})-(\d{2})-(\d{2})(?:T.*)?$", s):
        year, month, day = map(int, m.groups())
        hour = re.search(r"T(\d{2}):", s)
        if hour and day >= 28 and int(hour[1]) >= 22:
            year, month = (year + 1, 1) if month == 12 else (year, month + 1)
        return f"{year:04d}-{month:02d}"
    if m := re.match(r"^(\d{4})-(\d{2})", s):
        return f"{m[1]}-{m[2]}"
    m = re.match(rf"^{MONTH}\s+(\d{{4}})$", s.casefold())
    return f"{m[2]}-{month_number(m[1]):02d}" if m else None


def month_day(v) -> tuple[int, int] | None:
    m = re.match(r"^(\d{1,2})[/-](\d{1,2})$", "" if v is None else str(v).strip())
    out = (int(m[1]), int(m[2])) if m else None
    return out if out and 1 <= out[0] <= 12 and 1 <= out[1] <= 31 else None


def iso_day(v) -> tuple[int, int, int] | None:
    m = re.match(r"^(\d{4})-(\d{2})-(\d{2})(?:T.*)?$", "" if v is None else str(v).strip())
    return tuple(map(int, m.groups())) if m else None


def embedded_dates(v) -> set[tuple[int, int, int]]:
    """All dates in prose: ISO, month/day/year, and month by name."""
    if not isinstance(v, str):
        return set()
    out = {tuple(map(int, m)) for m in re.findall(r"\b(\d{4})-(\d{2})-(\d{2})\b", v)}
    out |= {(int(y), int(m), int(d)) for m, d, y in re.findall(r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", v)}
    return out | {(int(y), month_number(m), int(d)) for m, d, y in re.findall(rf"(?i)\b{MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", v)}


def looks_temporal(v) -> bool:
    if v is None or isinstance(v, (int, float)):
        return False
    return bool(re.match(r"^\d{1,2}:\d{2}(?::\d{2})?$", str(v).strip())) or any(f(v) is not None for f in (iso_day, month_day, year_month))


def parsed(s: str, **how) -> date | None:
    try:
        got = dates.parse(s, **how)
    except (ValueError, OverflowError, TypeError):
        return None
    return got.date() if isinstance(got, datetime) else None


def whole_date(v):
    """A text that is a date as a whole, in ISO form; anything else as it is. Years from 1900 to 2100."""
    if not isinstance(v, str) or not 4 <= len(v) <= 50 or v.isdigit() or re.search(r"\d{10,}", v):
        return v
    s = re.sub(r"\s*,\s*", ", ", v)
    day = parsed(s) if any(re.search(p, s) for p in WHOLE_DATES) else None
    return day.isoformat() if day and 1900 <= day.year <= 2100 else v


def lenient_dates(v: str) -> set[str]:
    """The dates that a form's entry may stand for: with a year that a space splits, or of two digits in either century; each needs a day before it."""
    out, more = {whole_date(v)}, []
    split = r"\b(19|20)\s+(\d{2})\b"
    if (m := re.search(split, v)) and re.search(r"\d", v[: m.start()]):
        more.append(re.sub(split, r"\1\2", v))
    for s in (v, *more[:1]):
        m = re.match(r"^(.*[ ,/\-])(\d{2})\s*$", s)
        if m and re.search(r"\d", m[1]):
            more += [f"{m[1]}19{m[2]}", f"{m[1]}20{m[2]}"]
    return out | {d for d in map(whole_date, more) if re.match(r"^\d{4}-\d{2}-\d{2}$", d)}


def plain(v) -> str:
    """NFKC, no invisible or control signs, single spaces, no case."""
    s = unicodedata.normalize("NFKC", "" if v is None else str(v))
    s = "".join(" " if ch.isspace() else "" if ch in UNSEEN or unicodedata.category(ch) == "Cc" else ch for ch in s)
    return " ".join(s.split()).casefold().strip()


def field_number(v) -> float | None:
    if v is None or isinstance(v, bool):
        return None
    if isinstance(v, (int, float)):
        return float(v)
    s, minus = plain(v), False
    if s.startswith("(") and s.endswith(")"):
        s, minus = s[1:-1].strip(), True
    s = re.sub(r"^[$€£¥₹]\s*", "", re.sub("^[~≈]", "", s).strip())
    s = re.sub(r"\s*[$€£¥₹]$", "", s).rstrip("%").replace(",", "").replace(" ", "")
    try:
        return float(s) * (-1 if minus else 1)
    except ValueError:
        return None


def field_date(v) -> date | None:
    if isinstance(v, datetime):
        return v.date()
    if isinstance(v, date):
        return v
    s = plain(v)
    return parsed(s) if s and any(re.search(p, s) for p in FIELD_DATES) else None


def truth(v) -> bool | None:
    s = plain(v)
    return True if s in TRUE else False if s in FALSE else None


def effectively_null(v) -> bool:
    """Null, blank, or made of such alone."""
    if isinstance(v, dict):
        return all(map(effectively_null, v.values()))
    if isinstance(v, list):
        return all(map(effectively_null, v))
    return v is None or isinstance(v, str) and not v.strip()


def value_type(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "date" if isinstance(v, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", v.strip()) else "string"
