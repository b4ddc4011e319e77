"""Evidence: typed comparison of an expected and a given value, sets of them, charts, formatting and schemas."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, numbers

# fixed values: written forms of truth
TRUE, FALSE = ("true", "yes", "y", "1", "checked", "x"), ("false", "no", "n", "0", "unchecked", "")


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def compare(comparator: str, expected: Column, given: Column) -> Column:
    """Whether two written values agree; nothing is expected if and only if nothing is given."""
    a, b = _flat(expected), _flat(given)
    number = lambda c: numbers.normal_number(c)
    digits = lambda c: F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(10))
    truth = lambda c: F.when(c.isin(*TRUE), True).when(c.isin(*FALSE), False)
    agree = {
        "exact": expected == given,
        "case_insensitive": a == b,
        "substring": F.contains(a, b) | F.contains(b, a),
        "number": F.abs(number(expected) - number(given)) <= 1e-6 * F.greatest(F.abs(number(expected)), F.abs(number(given)), F.lit(1.0)),
        "date": numbers.iso_date(expected) == numbers.iso_date(given),
        "phone": (digits(expected) == digits(given)) & (F.length(digits(expected)) >= 7),
        "boolean": truth(a) == truth(b),
    }[comparator]
    return F.when(blank(expected) | blank(given), blank(expected) & blank(given)).otherwise(F.coalesce(agree, F.lit(False)))


def covered(expected: Column, given: Column, exhaustive: bool = False, least: int | None = None) -> Column:
    """Sets: the given items that are expected must be ``least`` or as many as are expected, with none beyond them if exhaustive."""
    e, g = F.array_distinct(expected), F.array_distinct(given)
    enough = F.size(F.array_intersect(e, g)) >= (F.lit(least) if least is not None else F.size(e))
    return enough & (F.size(F.array_except(g, e)) == 0) if exhaustive else enough


def multiset_equal(expected: Column, given: Column) -> Column:
    return F.sort_array(expected) == F.sort_array(given)


def chart_number(expected: Column, given: Column) -> Column:
    """Graded agreement of two chart values: empty matches empty or 0; a value that is off by a thousand, a million and so on is rescued."""
    e, g = numbers.normal_number(expected), numbers.normal_number(given)
    plain = numbers.numeric_similarity(e, g)
    scaled = [numbers.numeric_similarity(e, g * f) for p in (3, 6, 9, 12) for f in (10.0**p, 10.0**-p)]
    score = F.when(plain >= 0.8, plain).otherwise(F.greatest(plain, *scaled))
    return F.when(blank(expected), (blank(given) | (g == 0)).cast("double")).when(blank(given), 0.0).otherwise(F.coalesce(score, (F.trim(expected) == F.trim(given)).cast("double")))


def is_formatted(markdown: Column, phrase: str, kind: str) -> Column:
    """Whether a phrase stands bold, italic, as heading, superscript or subscript in a markdown text; a heading counts as bold."""
    p = r"\s+".join(re.escape(w) for w in phrase.split())
    heading = rf"(?m)^\s*#{{1,6}}\s[^\n]*{p}|<h[1-6][^>]*>[^<]*{p}"
    patterns = {
        "bold": rf"\*\*[^*\n]*{p}[^*\n]*\*\*|__[^_\n]*{p}[^_\n]*__|<(b|strong)>[^<]*{p}|{heading}",
        "italic": rf"(?<!\*)\*(?!\*)[^*\n]*{p}[^*\n]*\*(?!\*)|(?<!_)_(?!_)[^_\n]*{p}[^_\n]*_(?!_)|<(i|em)>[^<]*{p}",
        "heading": heading, "superscript": rf"<sup>[^<]*{p}", "subscript": rf"<sub>[^<]*{p}",
    }
    return F.coalesce(markdown, F.lit("")).rlike(patterns[kind])


def name_matches(expected: str, given: str, least: float = 0.9) -> Column:
    """Jaro-Winkler of two columns at or above a threshold, on Arrow batches."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([bool(x and y and kernels.jaro_winkler(x.lower(), y.lower()) >= least) for x, y in zip(a, b, strict=True)])

    return run(F.col(expected), F.col(given))


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """What a JSON value breaks of a schema: type, required, properties, items, enum, anyOf, and local references."""

    def check(v, s: dict, at: str) -> list[str]:
        if "$ref" in s:
            target = schema
            for part in s["$ref"].removeprefix("#/").split("/"):
                target = target[part]
            return check(v, target, at)
        if "anyOf" in s:
            return [] if any(not check(v, one, at) for one in s["anyOf"]) else [f"{at}: none of anyOf"]
        kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}
        wanted = s.get("type")
        names = wanted if isinstance(wanted, list) else [wanted] if wanted else []
        if names and not any(isinstance(v, kinds[n]) and (n in ("boolean",) or not isinstance(v, bool)) for n in names):
            return [f"{at}: not {'/'.join(names)}"]
        out = [f"{at}: not in enum"] if "enum" in s and v not in s["enum"] else []
        if isinstance(v, dict):
            out += [f"{at}.{k}: missing" for k in s.get("required", ()) if k not in v]
            for k, x in v.items():
                if k in s.get("properties", {}):
                    out += check(x, s["properties"][k], f"{at}.{k}")
                elif s.get("additionalProperties") is False:
                    out.append(f"{at}.{k}: not allowed")
        if isinstance(v, list) and "items" in s:
            for i, x in enumerate(v):
                out += check(x, s["items"], f"{at}[{i}]")
        return out

    return check(value, schema, path)


def schema_violations(docs: DataFrame, key: str, column: str, schema: dict) -> DataFrame:
    """key, violation of every document whose JSON breaks the schema or does not parse."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            try:
                return violations(json.loads(t), schema)
            except (TypeError, ValueError):
                return ["$: no JSON"]

        return texts.map(one)

    return docs.select(key, F.explode(run(F.col(column))).alias("violation"))
