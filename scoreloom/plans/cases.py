"""Queries over stated cases: each has inputs and the outcomes that are known for them, which the SQL holds as VALUES.

They cover what the driver's tables cannot show: rules, normalisers and metrics of tables with known right answers.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import agreement, canon, grids, prose, readings
from ..functions import table_metrics as metrics
from ..functions.udfs import structured, vectorised
from ..operators import document_score, rule_engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TYPES = {"string": "varchar", "double": "double", "bigint": "bigint", "boolean": "boolean", "int": "integer"}


def literal(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    return repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def values(schema: str, rows: list[tuple]) -> str:
    """A SELECT of stated rows."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    names = ", ".join(f"c{i}" for i in range(len(fields)))
    cast = ", ".join(f"c{i}::{TYPES[t]} as {n}" for i, (n, t) in enumerate(fields))
    return f"select {cast} from (values " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") as t({names})"


def cases(schema: str, expected: list[tuple]):
    """Registers a query f(spark) -> DataFrame whose rows are ``expected``."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark)

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        ORACLES[f.__name__] = values(schema, expected)
        return f

    return add


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- text ----------------------------------------------------------------------------------------------------------------------------------------

#: (operation, text, outcome)
TEXTS = [
    ("nfkc", "ﬁ ﻻ ①", "fi لا 1"), ("strip_invisibles", "a​b﻿c‮d", "abcd"), ("strip_diacritics", "كِتَـاب", "كتاب"), ("strip_diacritics", "۝ۥ۩", "۝ۥ۩"),
    ("fold_numerals", "٢٠٢٣ ۴۵٫۶٬٧٪", "2023 45.6,7%"), ("fold_paren_negatives", "( 1,000 ) (a)", "-1,000 (a)"), ("fold_letters", "أحمد إلى آخرة", "احمد الي اخره"),
    ("spacing", " a  ( b ) ، c ؛ d ؟ e % f . ", "a (b)، c؛ d؟ e% f."), ("era_spacing", "2024 م 1445 ه 12 محمد", "2024م 1445ه 12 محمد"),
    ("canonical", "( ١٬٠٠٠ ) ريال ٢٠٢٣ م", "-1,000 ريال 2023م"), ("canonical", None, ""), ("traced", "( ١ )", "text/fold_numerals,text/fold_paren_negatives"), ("traced", "abc", ""),
    ("markup", '<td colspan="٢">٢ م</td>\n a  b ', '<td colspan="٢">2م</td>\na b'), ("markup_traced", "<b>٢</b> x", "text/fold_numerals,text/normalize_spacing"), ("compared:case_insensitive", "ABC ٢", "abc 2"),
    ("compared:phone_digits", "+1 (٢)", "12"), ("compared:lenient_date", "March 5, 2021", "2021-03-05"), ("unaccounted:phone_digits,other", "", "other"),
    ("prose", "**Bold** __x__ <b>y</b> É “q” – <sup>1</sup>2² …", 'bold x y e "q" - 2 '), ("prose", "a_b_c <user@host.tld> <http://x.y>", "abc user@host.tld http://x.y"), ("prose", "Total.......", "total"), ("prose", "が", "が"),
    ("styled", "**Bold**  É <span style='c'>x</span> – <br/>y", "**Bold** E x - y"), ("cell", " <b>A</b><sup>2</sup> **x** ● ⓧ “q” –  .... ", 'A2 x • ⊗ "q" -'), ("cell", "— –", "-"), ("cell", "H₂O x²", "H2O x2"),
    ("record_text", "$ 1,234 % ( a ) ® ", "$1234%( a)®"), ("record_text", "Income . . . . 5", "income 5"), ("record_text", "1,2,3", "12,3"), ("header_text", "<b>Net</b> Sales–É", "net sales-e"), ("match_key", "Assets — Cash", "assets cash"),
    ("words", "Élan über 検査abc結果 a 12 x_y", "Élan|über|検査|abc|結果|12|x_y"), ("sentence", "## 1. The quick <b>brown</b> fox.", "the quick brown fox"), ("sentence", "short.", ""), ("sentence", "a &lt; b and &amp;amp; more", "a < b and & more"),
    ("chunks", "Fig 1. The whole text is here! No. End of it", "Fig 1. The whole text is here|No End of it"), ("formulas", "x $$a^{2}+\\frac{b}{c}$$ y $z_1$ $5 and $6", "x  a2+bc  y z1 $5 and $6"), ("formulas", "$\\alpha$", "LATEX"),
    ("without_tables", "a<table><tr><td>1</td></tr></table>b<table>rest", "a b "), ("entities", "&amp;lt;b&amp;gt; &nbsp;x", "<b> \xa0x"), ("without_fences", "a\n```mermaid\ngraph\n```\nb", "a\n \nb"),
    ("plain", "A­B​  C\tD", "ab c d"), ("letters", "Dr. O’Neil, Jr", "dr o neil jr"), ("canonical_value", "https://Ex.com/É • a_b;", "ex.com/e a b"), ("unaccented", "Straße Øl Łódź", "Strasse Øl Łodz"), ("separatorless", "AB-12 (3).4", "ab1234"),
]

TEXT = {
    **{k.removeprefix("text/").replace("fold_letter_variants", "fold_letters").replace("normalize_spacing", "spacing").replace("era_marker_spacing", "era_spacing"): f for k, f in canon.FORMS.items()},
    "canonical": canon.canonical, "traced": lambda s: ",".join(canon.traced(s)[1]), "markup": canon.markup, "markup_traced": lambda s: ",".join(canon.markup_traced(s)[1]),
    "prose": prose.prose, "styled": prose.styled, "cell": prose.cell, "record_text": metrics.record_text, "header_text": metrics.header_text, "match_key": metrics.match_key, "words": lambda s: "|".join(prose.words(s)),
    "sentence": prose.sentence, "chunks": lambda s: "|".join(prose.chunks(s)), "formulas": prose.without_formulas, "without_tables": prose.without_tables, "entities": prose.entities, "without_fences": prose.without_fences,
    "plain": readings.plain, "letters": agreement._letters, "canonical_value": agreement.canonical, "unaccented": agreement.unaccented, "separatorless": agreement.separatorless,
}


def _text(op: str, s: str | None) -> str:
    name, _, more = op.partition(":")
    if name == "compared":
        return canon.compared(s, tuple(more.split(",")))
    if name == "unaccounted":
        return ",".join(canon.unaccounted(tuple(more.split(","))))
    return TEXT[name](s)


@cases("case_id bigint, op string, outcome string", [(i, op, out) for i, (op, _, out) in enumerate(TEXTS)])
def text_cases(spark):
    """Normalisers of text, cells and tokens."""
    t = table(spark, [(i, op, s) for i, (op, s, _) in enumerate(TEXTS)], "case_id bigint, op string, s string")
    return t.select("case_id", "op", vectorised(_text, "string")("op", "s").alias("outcome"))


# --- numbers, dates, likeness ---------------------------------------------------------------------------------------------------------------------

#: (operation, first, second, outcome as text)
VALUES = [
    ("number", "$1,234.5", None, "1234.5"), ("number", "39.2m", None, "39200000.0"), ("number", "~5%", None, "5.0"), ("number", "2 bln", None, "2000000000.0"), ("number", "abc", None, "None"), ("numbers", "2,08", None, "[208.0, 2.08]"),
    ("numbers_match", "2,08", "2.08", "True"), ("numbers_match", "100", "101", "True"), ("numbers_match", "100", "102", "False"), ("numbers_match", "0", "0.001", "True"), ("numeric_similarity", "100", "90", "0.9"), ("numeric_similarity", "0", "5", "0.0"), ("numeric_similarity", "x", "5", "None"),
    ("date_forms", "2021-04-01 00:00:00", None, "['04-2021', '2021', 'q2-2021']"), ("dates_match", "Q2-2021", "4-2021", "True"), ("dates_match", "2021", "x", "False"),
    ("single_number", "(1,234)", None, "-1234.0"), ("single_number", "12%", None, "None"), ("single_number", "- $5", None, "-5.0"), ("number_with_unit", "25 mg", None, "25.0"), ("number_with_unit", "mg", None, "None"),
    ("year_month", "2021-12-31T23:00:00", None, "2022-01"), ("year_month", "March 2021", None, "2021-03"), ("year_month", "soon", None, "None"), ("month_day", "12/25", None, "(12, 25)"), ("month_day", "13/25", None, "None"),
    ("embedded_dates", "on Jan 5th, 2020 and 3/4/2021 or 2022-01-02", None, "[(2020, 1, 5), (2021, 3, 4), (2022, 1, 2)]"), ("looks_temporal", "12:30", None, "True"), ("looks_temporal", "twelve", None, "False"),
    ("whole_date", "January 5 , 2020", None, "2020-01-05"), ("whole_date", "20200105", None, "20200105"), ("whole_date", "5/6/1850", None, "5/6/1850"), ("lenient_dates", "June 17, 43", None, "['1943-06-17', '2043-06-17', 'June 17, 43']"), ("lenient_dates", "June 17, 19 43", None, "['1943-06-17', 'June 17, 19 43']"),
    ("field_number", "≈ €1 234,5", None, "12345.0"), ("field_number", "(7%)", None, "-7.0"), ("field_date", "Mon. Jan. 02 2023", None, "2023-01-02"), ("field_date", "hello", None, "None"), ("truth", "Yes", None, "True"), ("truth", "unchecked", None, "False"), ("truth", "maybe", None, "None"),
    ("value_type", "2020-01-01", None, "date"), ("value_type", "abc", None, "string"), ("box_number", "2 671 43", None, "2671.43"), ("box_number", "-$21,948,982.12", None, "-21948982.12"), ("box_number", "(5)", None, "-5.0"), ("amount", "1,5", None, "3/2"), ("amount", "1,2345", None, "2469/2000"), ("amount", "(1,000)", None, "-1000"), ("amount", "n.a.", None, "None"),
    ("date_key", "31 ديسمبر 2023م", None, "(2023, 12, 31)"), ("date_key", "البيان", None, "None"), ("is_numeric", "-", None, "True"), ("is_numeric", "12 a", None, "False"), ("effectively_null", "  ", None, "True"),
    ("ratio", "abc", "acb", "0.6667"), ("ratio", "", "", "1.0"), ("partial_ratio", "bcd", "abcde", "1.0"), ("partial_ratio", "abxd", "zzabcdzz", "0.75"), ("near_matches", "hello", "say helo twice hallo", "2"), ("jaro_winkler", "MARTHA", "MARHTA", "0.9611"), ("edit_distance", "abc", "acb", "2"), ("block_ratio", "abcd", "bcda", "0.75"),
    ("occurrences", "cat", "cat concat cat.", "2"), ("occurrences", "検査", "検査結果検査", "2"), ("sha_key", '{"b":[1,"A."],"a":null}', None, "{a:,b:[1,a]}"), ("url", "https://www.X.com/", None, "x.com"), ("contained", "a b c", "c b z", "0.6667"), ("supported", "Acme Corp", "the ACME corp.", "True"), ("supported", "ab", "ab", "False"),
    ]


def _short(v) -> str:
    return str(round(v, 4)) if isinstance(v, float) else str(sorted(v)) if isinstance(v, set) else str(v)


def _value(op: str, a: str | None, b: str | None) -> str:
    own = {
        "box_number": agreement.box_number, "amount": canon.amount, "date_key": canon.date_key, "is_numeric": canon.is_numeric, "ratio": prose.ratio, "partial_ratio": prose.partial_ratio,
        "near_matches": lambda x, y: len(prose.near_matches(x, y, 1)), "jaro_winkler": prose.jaro_winkler, "edit_distance": prose.edit_distance, "block_ratio": metrics.kernels.block_ratio, "occurrences": prose.occurrences,
        "sha_key": lambda x: agreement.stable(json.loads(x)), "url": agreement.url, "contained": agreement.contained, "supported": agreement.supported,
    }
    f = own.get(op) or getattr(readings, op)
    two = op in ("numbers_match", "numeric_similarity", "dates_match", "ratio", "partial_ratio", "near_matches", "jaro_winkler", "edit_distance", "block_ratio", "occurrences", "contained", "supported")
    return _short(f(a, b) if two else f(a))


@cases("case_id bigint, op string, outcome string", [(i, op, out) for i, (op, _, _, out) in enumerate(VALUES)])
def value_cases(spark):
    """Readings of numbers, dates and truth values, and measures of likeness."""
    t = table(spark, [(i, op, a, b) for i, (op, a, b, _) in enumerate(VALUES)], "case_id bigint, op string, a string, b string")
    return t.select("case_id", "op", vectorised(_value, "string")("op", "a", "b").alias("outcome"))


# --- agreement of values -----------------------------------------------------------------------------------------------------------------------------

#: (comparison, true and given value as JSON, passed, score, mode)
AGREE = [
    ("field", "null", '""', True, 1.0, "null"), ("field", "true", '"Yes"', True, 1.0, "boolean"), ("field", "5", '"5.0"', True, 1.0, "integer"), ("field", "5", '"5.5"', False, 0.0, "integer"), ("field", "1.5", '"$1.50"', True, 1.0, "number"),
    ("field", '"2023-01-02"', '"Jan 02 2023"', True, 1.0, "date"), ("field", '"Acme Corp"', '"Acme Corp."', True, 0.98, "jaro_winkler"), ("field", '"abc"', '"xyz"', False, 0.0, "jaro_winkler"),
    ("box:string", "null", '" — "', True, 1.0, "null_empty"), ("box:string", '"Acme"', '"ACME"', True, 1.0, "case_insensitive"), ("box:string", '"Acme"', '"Acme.*"', True, 1.0, "trailing_punct_fold"), ("box:string", '"5 µg"', '"5 ug"', True, 1.0, "unicode_compat_fold"),
    ("box:string", '"Rent"', '"Rent Monthly"', True, 1.0, "footer_text_trim"), ("box:number", "1234.5", '"$1,234.50"', True, 1.0, "numeric"), ("box:date", '"2020-02-01"', '"02/01/2020"', True, 1.0, "date"), ("box:boolean", "true", '"[x]"', True, 1.0, "boolean"), ("box:boolean", "false", '"~"', True, 1.0, "boolean"),
    ("box:string", '"AB-1234-5678"', '"AB 1234 5678"', True, 1.0, "alnum_text_fold"), ("box:string", '"Some long name"', '"Some long names here"', True, 1.0, "annotation_truncated"), ("box:string", '"Some long name"', '"1 Some long name"', True, 1.0, "ocr_noise_prefix"),
    ("attributed:string", '"Some long name"', '"Some long names here"', False, 0.0, "annotation_truncated"), ("attributed:string", '"Jonathan Smith"', '"Jonathan Smyth"', True, 0.9714, "jaro_winkler"),
    ("values", "null", '"Present"', True, 1.0, "present_null_current_equivalent"), ("values", '{"a":""}', "[]", True, 1.0, "null_equivalent_empty"), ("values", '"x"', "null", False, 0.0, "null_vs_value"), ("values", '"1,234"', '"1234.0"', True, 1.0, "numeric_equal"), ("values", '"007"', '"7"', False, 0.0, "leading_zero_code_mismatch"),
    ("values", '"5"', '"6"', False, 0.0, "numeric_value_mismatch"), ("values", '"25 mg"', '"25"', True, 1.0, "numeric_equal_unit_suffix"), ("values", '"https://x.com/"', '"www.x.com"', True, 1.0, "url_protocol_equivalent"), ("values", '"Abc"', '"ABC"', True, 1.0, "casefold_equivalent"), ("values", '"AB-12"', '"AB 12"', True, 1.0, "separator_insensitive_equivalent"),
    ("values", '"Acme (old)"', '"acme"', True, 1.0, "parenthetical_detail_omitted"), ("values", '"2021-03"', '"March 2021"', True, 1.0, "year_month_equivalent"), ("values", '"2021-03-01"', '"2021-03-02"', False, 0.0, "date_mismatch"), ("values", '"2021-03-05"', '"signed on March 5, 2021"', True, 1.0, "date_equivalent_embedded"),
    ("values:dated", '"2021-03-05"', '"3/5"', True, 1.0, "month_day_without_year_equivalent"), ("values", '"alpha beta gamma"', '"the gamma of beta and alpha"', True, 1.0, "token_containment"), ("values", '"order 12 of wood"', '"order 13 of wood"', False, 0.0, "numeric_mismatch"), ("values", '"cat"', '"cat food tin"', False, 0.825, "strict"),
    ("evidence:exact", '"a  b"', '"a b"', True, 1.0, "exact"), ("evidence:enum", '"Full-Time"', '"full time"', True, 1.0, "enum"), ("evidence:number", '"(5 kg)"', '"-5"', True, 1.0, "number"), ("evidence:phone", '"+1 212 555 1234"', '"(212) 555-1234"', True, 1.0, "phone"), ("evidence:substring", '"Main St"', '"12 Main St."', True, 1.0, "string_substring"),
    ("evidence:date", '"5 May 2020"', '"2020-05-05"', True, 1.0, "date"), ("evidence:boolean", '"x"', "true", True, 1.0, "boolean"), ("evidence:null", "null", '"-"', True, 1.0, "null"), ("evidence:other", '"a"', '"a"', False, 0.0, "other"), ('evidence:{"a":"number"}', '{"a":1}', '{"a":"1.0"}', True, 1.0, "object"), ('evidence:{"a":"number"}', '{"a":1}', "{}", False, 0.0, "object"),
    ("array:ordered", '["a","b"]', '["a","b"]', True, 1.0, "ordered"), ("array:ordered", '["a","b"]', '["b","a"]', False, 0.0, "ordered"), ("array:set", '["a","b"]', '["b","a","a"]', True, 1.0, "set"), ("array:set", '["a","b"]', '["b","a","c"]', False, 1.0, "set"), ("array:multiset", '["a","a"]', '["a"]', False, 0.0, "multiset"), ("array:match_by:k", '[{"k":"1","v":"x"}]', '[{"k":"1","v":"x"}]', True, 1.0, "match_by"), ("array:match_by:k", '[{"v":"x"}]', "[]", False, 0.0, "match_by"),
]


def _agree(op: str, a: str, b: str) -> tuple[bool, float, str]:
    name, _, more = op.partition(":")
    x, y = json.loads(a), json.loads(b)
    if name == "field":
        got = agreement.field_value(x, y)
    elif name == "box":
        got = agreement.box_text(x, more, y)
    elif name == "attributed":
        got = agreement.attributed(x, y, more)
    elif name == "values":
        got = agreement.values(x, y, dated=more == "dated")
    elif name == "evidence":
        got = agreement.evidence(x, y, json.loads(more) if more.startswith("{") else more)
    else:
        keyed = {"k": "exact", "v": "exact"} if more.startswith("match_by") else None
        got = agreement.evidence_array(x, y, keyed if keyed else "exact" if more == "set" else None, more)
    return bool(got.passed), round(float(got.score), 4), got.mode


@cases("case_id bigint, op string, passed boolean, score double, mode string", [(i, op, p, s, m) for i, (op, _, _, p, s, m) in enumerate(AGREE)])
def agreement_cases(spark):
    """Typed comparison of values: fields, text in boxes, extracted values, evidence and arrays of it."""
    t = table(spark, [(i, op, a, b) for i, (op, a, b, *_) in enumerate(AGREE)], "case_id bigint, op string, a string, b string")
    got = structured(_agree, "passed boolean, score double, mode string")("op", "a", "b")
    return t.select("case_id", "op", got.alias("x")).select("case_id", "op", "x.passed", "x.score", "x.mode")


# --- rules ------------------------------------------------------------------------------------------------------------------------------------------

PAGE = """<page_header>Annual Report – 2023</page_header>

# Main Title

## Part one

The quick brown fox jumps over the lazy dog. Revenue grew to $5 million in 2023! It was **very good** news, <u>indeed</u>.

**Bold line**

Some *soft words* and ~~gone~~ x<sup>2</sup> <mark style="color:red">hot</mark> text.

$$E = mc^2$$

```python
print("hi")
```

| Year | Sales |
|---|---|
| 2021 | 100 |
| 2022 | 150 |

<table><tr><th rowspan="2">Item</th><th colspan="2">Amount</th></tr><tr><th>2022</th><th>2023</th></tr><tr><td>Cash</td><td>10</td><td>20</td></tr><tr><td>Stock</td><td></td><td>5</td></tr></table>

**Name:** John Doe

☑ Married ☐ Single
"""

#: (kind, payload, passed, score)
RULED = [
    ("present", {"text": "quick brown fox"}, True, 1.0), ("present", {"text": "quick braun fox", "max_diffs": 2}, True, 1.0), ("present", {"text": "purple zebra crossing"}, False, 0.0), ("present", {"text": "2023", "count": 3}, True, 1.0), ("present", {"text": "dog", "first_n": 20}, False, 0.0), ("absent", {"text": "purple zebra crossing"}, True, 1.0), ("absent", {"text": "lazy dog"}, False, 0.0),
    ("order", {"before": "Main Title", "after": "lazy dog"}, True, 1.0), ("order", {"before": "John Doe", "after": "Main Title"}, False, 0.0), ("order", {"before": "2023", "after": "quick brown fox"}, True, 1.0), ("baseline", {}, True, 1.0), ("baseline", {"max_length": 5}, False, 0.0),
    ("unexpected_sentence", {"bag_of_sentence": {"nothing of this is here": 1}}, False, 0.0), ("missing_sentence", {"bag_of_sentence": {"The quick brown fox jumps over the lazy dog": 1}}, True, 1.0), ("missing_sentence", {"bag_of_sentence": {"The quick brown fox jumps over the lazy dog": 2}}, False, 0.0),
    ("missing_sentence_percent", {"bag_of_sentence": {"The quick brown fox jumps over the lazy dog": 1, "This sentence is not there": 3}}, False, 0.25), ("too_many_sentence_occurence", {"bag_of_sentence": {"quick brown fox jumps": 0}}, False, 0.0), ("too_many_sentence_occurence_percent", {"bag_of_sentence": {"quick brown fox jumps": 0, "Bold line": 1}}, False, 0.5),
    ("missing_specific_sentence", {"sentence": "Revenue grew to $5 million"}, True, 1.0), ("missing_specific_sentence", {"sentence": "Revenue fell to nothing"}, False, 0.0), ("extra_content", {"bag_of_sentence": {"only this one is known": 1}}, False, 0.0),
    ("missing_word", {"bag_of_word": {"fox": 1, "dog": 1}}, True, 1.0), ("missing_word", {"bag_of_word": {"cat": 1}}, False, 0.0), ("missing_word_percent", {"bag_of_word": {"fox": 1, "cat": 1}}, False, 0.5), ("too_many_word_occurence", {"bag_of_word": {"fox": 1}}, True, 1.0), ("too_many_word_occurence_percent", {"bag_of_word": {"the": 1, "fox": 1}}, False, 0.6667),
    ("unexpected_word", {"bag_of_word": {"fox": 1}}, False, 0.0), ("missing_specific_word", {"word": "fox"}, True, 1.0), ("missing_specific_word", {"word": "wolf"}, False, 0.0), ("bag_of_digit_percent", {"bag_of_digit": {"9": 4, "8": 0}}, False, 0.0),
    ("table", {"cell": "150", "left": "2022", "top_heading": "Sales"}, True, 1.0), ("table", {"cell": "150", "left": "2021"}, False, 0.0), ("table", {"cell": "20", "left": "10", "left_heading": "Cash"}, True, 1.0),
    ("tables_values", {"table_variations": [{"rows": [{"cells": [{"text": "Year"}, {"text": "Sales"}]}, {"cells": [{"text": "2021"}, {"text": "100"}]}, {"cells": [{"text": "2022"}, {"text": "150"}]}]}], "table_match_threshold": 0.9, "table_values_match_threshold": 0.9}, True, 1.0),
    ("tables_num_rows", {"expected_num_rows": 4}, True, 1.0), ("tables_num_rows", {"expected_num_rows": 9}, False, 0.0), ("tables_num_cols", {"expected_num_cols": 3}, True, 1.0), ("table_colspan", {"cell": "Amount", "expected_colspan": 2}, True, 1.0), ("table_rowspan", {"cell": "Item", "expected_rowspan": 2}, True, 1.0), ("table_rowspan", {"cell": "Item", "expected_rowspan": 1}, False, 0.0),
    ("table_same_row", {"cell_a": "Cash", "cell_b": "20"}, True, 1.0), ("table_same_column", {"cell_a": "Amount", "cell_b": "20"}, True, 1.0), ("table_same_column", {"cell_a": "Item", "cell_b": "20"}, False, 0.0), ("table_header_chain", {"data_cell": "20", "column_headers": ["Amount", "2023"], "row_headers": ["Cash", "10"]}, True, 1.0), ("table_header_chain", {"data_cell": "20", "column_headers": ["Amount"]}, False, 0.0),
    ("table_adjacent_up", {"anchor_cell": "Stock", "expected_neighbor": "Cash"}, True, 1.0), ("table_adjacent_right", {"anchor_cell": "Amount", "expected_neighbor": "Amount"}, True, 1.0), ("table_adjacent_left", {"anchor_cell": "Cash", "expected_neighbor": "10"}, False, 0.0), ("table_top_header", {"data_cell": "10", "expected_header": "Amount"}, True, 1.0), ("table_left_header", {"data_cell": "20", "expected_header": "Cash"}, True, 1.0),
    ("table_no_left", {"cell": "Cash"}, True, 1.0), ("table_no_right", {"cell": "Stock"}, True, 1.0), ("table_no_right", {"cell": "Cash"}, False, 0.0), ("table_no_below", {"cell": "Stock", "table_anchor_cells": ["Item"]}, True, 1.0), ("table_no_above", {"cell": "Nowhere"}, False, 0.0),
    ("is_bold", {"text": "very good"}, True, 1.0), ("is_bold", {"text": "lazy dog"}, False, 0.0), ("is_not_bold", {"text": "lazy dog"}, True, 1.0), ("is_italic", {"text": "soft words"}, True, 1.0), ("is_underline", {"text": "indeed"}, True, 1.0), ("is_strikeout", {"text": "gone"}, True, 1.0), ("is_sup", {"text": "2"}, True, 1.0), ("is_sub", {"text": "2"}, False, 0.0), ("is_mark", {"text": "hot"}, False, 0.0),
    ("mark_color", {"text": "hot", "color": "red"}, True, 1.0), ("mark_color", {"text": "hot", "color": "blue"}, False, 0.0), ("is_latex", {"formula": "$E=mc^2$"}, True, 1.0), ("is_latex", {"formula": "a+b"}, False, 0.0), ("is_code_block", {"language": "Python", "code": 'print("hi")'}, True, 1.0), ("is_code_block", {"language": "rust", "code": "x"}, False, 0.0),
    ("is_title", {"text": "Main Title"}, True, 1.0), ("is_title", {"text": "Bold line"}, True, 1.0), ("is_title", {"text": "lazy dog"}, False, 0.0), ("title_hierarchy_percent", {"title_hierarchy": {"Main Title": {"Part one": None}}}, True, 1.0), ("title_hierarchy_percent", {"title_hierarchy": {"Part one": ["Main Title"]}}, False, 0.6667),
    ("is_header", {"text": "Annual Report - 2023"}, True, 1.0), ("is_footer", {"text": "Annual"}, False, 0.0), ("rotate_check", {"value": 90}, True, 1.0), ("rotate_check", {"value": 0}, False, 0.0),
    ("chart_data_point", {"value": "150", "labels": ["2022", "Sales"]}, True, 1.0), ("chart_data_point", {"value": "150", "labels": ["2021"]}, False, 0.0), ("chart_data_array_labels", {"data": [["Year", "Sales"]]}, True, 1.0), ("chart_data_array_data", {"data": [["Year", "Sales"], [2021, 100], [2022, 150]]}, True, 1.0), ("chart_data_array_data", {"data": [["Year", "Sales"], [2022, 150], [2021, 100]], "y_axis_shuffle": True}, True, 1.0), ("chart_data_array_data", {"data": [["Year", "Sales"], [2021, 100], [2022, 300]]}, False, 0.875),
    ("form_field", {"label": "Name", "field_type": "text", "value": "john doe"}, True, 1.0), ("form_field", {"label": "Name", "value": "Jane"}, False, 0.0), ("form_field", {"label": "Married", "field_type": "checkbox", "value": True}, True, 1.0), ("form_field", {"label": "Single", "field_type": "checkbox", "value": True}, False, 0.0), ("form_field", {"label": "Signature", "field_type": "signature", "value": False}, True, 1.0),
    ("no_such_rule", {}, None, None), ("present", {}, None, None),
]


@cases("rule bigint, kind string, passed string, score double", [(i, k, "error" if p is None else str(p).lower(), -1.0 if s is None else s) for i, (k, _, p, s) in enumerate(RULED)])
def rule_cases(spark):
    """Every kind of rule on a page, with cases that pass and cases that fail."""
    pages = table(spark, [("page", PAGE, json.dumps({"pages": [{"page_number": 1, "original_orientation_angle": 90, "page_header_markdown": "Annual Report — 2023"}]}))], "doc string, text string, meta string")
    rules = table(spark, [("page", i, k, json.dumps(p)) for i, (k, p, *_) in enumerate(RULED)], "doc string, rule bigint, kind string, payload string")
    got = rule_engine.evaluate(pages, rules, "doc").join(rules.select("rule", "kind"), "rule")
    verdict = F.coalesce(F.col("passed").cast("string"), F.lit("error"))
    return got.select("rule", "kind", verdict.alias("passed"), F.round(F.coalesce("score", F.lit(-1.0)), 4).alias("score"))


@cases("doc string, n_rules bigint, n_errors bigint, pass_rate double, score double", [("a", 4, 1, 0.5, 0.625), ("b", 1, 0, 0.0, 0.0)])
def rule_page_scores(spark):
    """Verdicts by page: a rule that could not be run fails, and so does one whose page is missing."""
    pages = table(spark, [("a", "The fox. The fox.")], "doc string, text string")
    rules = [("a", "1", "missing_word", {"bag_of_word": {"fox": 2}}), ("a", "2", "missing_word_percent", {"bag_of_word": {"fox": 2, "cat": 2}}), ("a", "3", "nothing", {}), ("a", "4", "absent", {"text": "wolf"}), ("b", "1", "present", {"text": "fox"})]
    verdicts = rule_engine.evaluate(pages, table(spark, [(d, r, k, json.dumps(p)) for d, r, k, p in rules], "doc string, rule string, kind string, payload string"), "doc")
    return rule_engine.page_scores(verdicts, "doc")


# --- tables ---------------------------------------------------------------------------------------------------------------------------------------------

HEADED = "<table><tr><th>Name</th><th>Age</th></tr><tr><td>Ann</td><td>30</td></tr><tr><td>Bob</td><td>40</td></tr></table>"
PAIRS = {
    "same": (HEADED, HEADED),
    "swapped rows": (HEADED, "<table><tr><th>Name</th><th>Age</th></tr><tr><td>Bob</td><td>40</td></tr><tr><td>Ann</td><td>30</td></tr></table>"),
    "two more columns": (HEADED, "<table><tr><th>Name</th><th>Age</th><th>City</th><th>Zip</th></tr><tr><td>Ann</td><td>30</td><td>x</td><td>1</td></tr><tr><td>Bob</td><td>40</td><td>y</td><td>2</td></tr></table>"),
    "no header marks": (HEADED, HEADED.replace("th>", "td>")),
    "none": (HEADED, "no table here"),
    "title row": ('<table><tr><th colspan="2">People</th></tr>' + HEADED.removeprefix("<table>"), HEADED),
    "one cell": ("<table><tr><td>abc</td></tr></table>", "<table><tr><td>acb</td></tr></table>"),
    "ragged": (HEADED, "<table><tr><th>Name</th><th>Age</th></tr><tr><td>Ann</td></tr></table>"),
}
#: (pair, metric, value)
TABLES = [
    *[("same", m, 1.0) for m in ("grits_con", "table_record_match", "table_record_match_perfect", "header_composite_v3", "header_perfect", "teds", "teds_struct", "teds_struct_bool", "structural_consistency", "table_composite_v3", "grits_trm_composite")],
    ("swapped rows", "table_record_match", 1.0), ("swapped rows", "teds_struct", 1.0), ("two more columns", "table_record_match", 0.5), ("two more columns", "header_cell_count", 0.5), ("two more columns", "header_content_bag", 1.0), ("two more columns", "grits_con", 0.6667),
    ("no header marks", "header_cell_count", 0.0), ("no header marks", "table_record_match", 1.0), ("no header marks", "exp_header_composite_v3_generous", 1.0), ("no header marks", "teds_struct", 0.8), ("none", "grits_con", 0.0), ("none", "table_record_match", 0.0), ("none", "header_composite_v3", 0.0), ("none", "structural_consistency", 1.0), ("none", "teds", 0.0),
    ("title row", "table_record_match", 1.0), ("title row", "multilevel_header_depth", 0.5), ("one cell", "teds", 0.7778), ("one cell", "teds_struct", 1.0), ("one cell", "teds_struct_bool", 1.0), ("one cell", "grits_con", 0.6667), ("ragged", "structural_consistency", 0.0), ("ragged", "table_record_match", 0.25),
]


@cases("pair string, metric string, value double", TABLES)
def table_metric_cases(spark):
    """Grid similarity, record match, tree edit distance, header accuracy and their composites on pairs with known scores."""
    t = table(spark, [(k, a, b) for k, (a, b) in PAIRS.items()], "pair string, a string, b string")
    all_ = vectorised(lambda a, b: json.dumps({k: round(float(v), 4) for k, v in metrics.page_scores(a, b, teds_too=True).items()}), "string")
    long = t.select("pair", F.explode(F.from_json(all_("a", "b"), "map<string,double>")).alias("metric", "value"))
    wanted = table(spark, [(p, m) for p, m, _ in TABLES], "pair string, metric string")
    return wanted.join(long, ["pair", "metric"], "left").select("pair", "metric", "value")


MERGED = "<table><tr><th>Year</th><th>Sales</th><th>Year</th><th>Sales</th></tr><tr><td>1</td><td>10</td><td>3</td><td>30</td></tr><tr><td>2</td><td>20</td><td></td><td></td></tr></table>"
SHAPES = [
    ("split", "2", 2), ("split rows", "2", 2), ("split rows 2", "2", 1), ("not split", "1", 1), ("titles", "People", 1), ("title strip rows", "", 3), ("pipe rows", "", 2), ("pipe cols", "", 2), ("spans", "", 6), ("nested", "", 1), ("headings", "", 2), ("section rows kept", "", 1), ("columns moved", "", 2),
]


@cases("op string, n bigint", [(op, n) for op, _, n in SHAPES])
def table_shape_cases(spark):
    """Reading tables, cutting merged ones, titles, sections and column order."""

    def run(op: str) -> int:
        merged = [metrics.sheet(t) for t in grids.html_tables(MERGED)]
        if op in ("split", "split rows", "split rows 2", "not split"):
            parts = metrics.split_merged(merged, 1 if op == "not split" else 2)
            return len(parts) if op in ("split", "not split") else len(parts[0 if op == "split rows" else 1].rows) - 1
        if op == "titles":
            return len(document_score.title_rows(PAIRS["title row"][0]))
        if op == "title strip rows":
            return len(metrics.untitled(metrics.sheet(grids.html_tables(PAIRS["title row"][0])[0]))[0].rows)
        if op.startswith("pipe"):
            m = grids.pipe_tables("x\n| a | b |\n|---|---|\n| 1 |\n\ny")[0].matrix()
            return len(m) if op == "pipe rows" else len(m[1])
        if op == "spans":
            return len(grids.html_tables('<table><tr><td rowspan="2">a</td><td colspan="2">b</td></tr><tr><td>c</td><td>d</td></tr></table>')[0].spread())
        if op == "nested":
            return len(grids.html_tables("<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>"))
        if op == "headings":
            return len(grids.html_tables(HEADED)[0].headings()[0])
        sections = '<table><tr><td>x</td><td>2022</td></tr><tr><td colspan="2">Part</td></tr><tr><td></td><td></td></tr><tr><td>a</td><td>1</td></tr></table>'
        if op == "section rows kept":
            return len(canon.table_structure(sections)[1].sections)
        return canon.table_structure("<table><tr><td>2023</td><td>2022</td><td>item</td></tr><tr><td>1</td><td>2</td><td>cash</td></tr></table>")[1].order[0]

    t = table(spark, [(op,) for op, _, _ in SHAPES], "op string")
    return t.select("op", vectorised(run, "bigint")("op").alias("n"))


SHEET = (
    '<table><tr><th>item</th><th>2023</th><th>2022</th></tr><tr><td colspan="3">Assets</td></tr><tr><td>cash</td><td>10</td><td>20</td></tr><tr><td>stock</td><td>-</td><td>5</td></tr><tr><td>total</td><td>10</td><td>25</td></tr></table>'
)
READ = "<table><tr><th>item</th><th>٢٠٢٣</th><th>2022</th></tr><tr><td>cash</td><td>١٠</td><td>20</td></tr><tr><td>stock</td><td></td><td>6</td></tr><tr><td>total</td><td>10</td><td>25</td></tr></table>"
#: (document, pass, metric, value)
SCORES = [
    ("read", "text", "header_perfect", 1.0), ("read", "raw", "header_perfect", 0.0), ("read", "struct", "table_record_match", 0.9167), ("read", "struct", "grits_con", 0.8333), ("read", "document", "script_fidelity", 0.7143), ("read", "document", "coverage", 0.9167), ("read", "document", "numeric_exact", 0.8571), ("read", "document", "null_accuracy", 1.0), ("read", "document", "null_judged", 1.0),
    ("read", "document", "arithmetic_declared", 2.0), ("read", "document", "arithmetic_evaluable", 2.0), ("read", "document", "arithmetic_reconciling", 1.0), ("read", "document", "arithmetic_consistency", 0.5), ("blank", "raw", "grits_con", 0.0), ("blank", "struct", "table_record_match", 0.0), ("blank", "document", "empty_prediction", 1.0), ("broken", "document", "error", -1.0),
]


def _documents(spark) -> DataFrame:
    relations = json.dumps(document_score.block_sums("total", 0, 4, [2, 3], [1, 2]))
    rows = [("read", SHEET, READ, relations), ("blank", SHEET, " ", relations), ("broken", SHEET, "ÃÂ© Ø§Ø\u0084Ø£ " + "Ã\u0083Â\u0083 " * 40, None)]
    return document_score.document_scores(table(spark, rows, "doc string, expected string, actual string, relations string"), "doc", relations="relations")


@cases("doc string, pass string, metric string, value double", SCORES)
def document_score_cases(spark):
    """Documents scored from their markup: three passes, cells, nulls, arithmetic, fidelity; a blank prediction and a broken encoding."""
    wanted = table(spark, [r[:3] for r in SCORES], "doc string, pass string, metric string")
    return wanted.join(_documents(spark), ["doc", "pass", "metric"], "left").select("doc", "pass", "metric", F.round(F.coalesce("value", F.lit(-1.0)), 4).alias("value"))


@cases("system string, doc string, status string, coverage double, arithmetic_reconciling double", [("mine", "read", "api", 0.9167, 1.0), ("mine", "blank", "failed", -1.0, -1.0)])
def stored_score_cases(spark):
    """One record a document for the score log."""
    t = document_score.stored(_documents(spark).where("doc <> 'broken'"), "doc", "mine")
    known = lambda c: F.round(F.coalesce(c, F.lit(-1.0)), 4).alias(c)
    return t.select("system", "doc", "status", known("coverage"), known("arithmetic_reconciling"))
