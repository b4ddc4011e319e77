"""Text rules: presence, order, bags of words, digits and sentences, as column expressions or joins on counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.udfs import overlaps


def presence(document: Column, wanted: Column) -> Column:
    """The wanted text occurs, white space and case aside."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    return F.contains(flat(document), flat(wanted))


def in_order(document: Column, first: Column, second: Column) -> Column:
    """Both occur, and the first begins somewhere before the last place of the second."""
    a, back = F.position(first, document), F.position(F.reverse(second), F.reverse(document))
    return (a > 0) & (back > 0) & (a < F.length(document) - F.length(second) - back + 2)


def is_blank(document: Column) -> Column:
    """No letter or digit."""
    return ~F.coalesce(document, F.lit("")).rlike(r"[\p{L}\p{N}]")


def missing_words(pairs: DataFrame, key: str, true: str, predicted: str) -> DataFrame:
    """For each row with words: the share of true word occurrences that the prediction lacks, of predicted ones that are too many, and words that come too often."""
    t = overlaps(pairs, [key], true, predicted).where("n_a + n_b > 0")
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return t.select(key, ratio(F.col("n_a") - F.col("same"), F.col("n_a")).alias("missing"), ratio(F.col("n_b") - F.col("same"), F.col("n_b")).alias("unexpected"), "n_too_many")


def digit_counts(c: Column) -> list[Column]:
    """How often each digit occurs."""
    return [F.regexp_count(c, F.lit(str(d))) for d in range(10)]


def digit_bag(true: Column, predicted: Column) -> Column:
    """The share of the true digits that the prediction has, as multisets; 1 if there are none."""
    pairs = list(zip(digit_counts(true), digit_counts(predicted), strict=True))
    total = sum((a for a, _ in pairs), F.lit(0))
    return F.when(total > 0, sum((F.least(a, b) for a, b in pairs), F.lit(0)) / total).otherwise(1.0)


def sentences(c: Column, least: int = 12) -> Column:
    """Sentences of a text; a chunk shorter than ``least`` joins the next one, the last joins the one before."""
    chunks = F.filter(F.transform(F.split(c, r"[.!?\n]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, s: Column) -> Column:
        whole = F.trim(F.concat_ws(" ", a["open"], s))
        return F.when(F.length(whole) < least, F.struct(a["done"].alias("done"), whole.alias("open"))).otherwise(F.struct(F.concat(a["done"], F.array(whole)).alias("done"), F.lit("").alias("open")))

    def rest(a: Column) -> Column:
        n = F.size(a["done"])
        joined = F.concat(F.slice(a["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(a["done"], F.greatest(n, F.lit(1))), a["open"])))
        return F.when(a["open"] == "", a["done"]).otherwise(joined)

    return F.aggregate(chunks, start, step, rest)


def sentence_bag(true: Column, predicted: Column) -> Column:
    """The share of distinct true sentences that the prediction lacks."""
    a = F.array_distinct(sentences(true))
    return F.when(F.size(a) > 0, F.size(F.array_except(a, sentences(predicted))) / F.size(a)).otherwise(0.0)


def pass_rate(results: DataFrame, key: str) -> DataFrame:
    """Share of passed rules; a document without rules passes, a blank one fails all. ``results``: key, passed, blank."""
    return results.groupBy(key).agg(F.count("passed").alias("n_rules"), F.round(F.coalesce(F.avg((F.col("passed") & ~F.col("blank")).cast("double")), F.lit(1.0)), 6).alias("pass_rate"))


def title_levels(html: Column) -> Column:
    """(level, text) of the headings of a page, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"), F.lit(0))
    return F.transform(found, lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), text.strip_tags(h).alias("title")))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def answer_matches(expected: Column, said: Column, tolerance: float = 0.0) -> Column:
    """Numbers within the tolerance, else equal once case, punctuation and white space are dropped."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", " "), r" +", " "))
    a, b = expected.try_cast("double"), said.try_cast("double")
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= tolerance).otherwise(plain(expected) == plain(said))


def code_blocks(markdown: Column) -> Column:
    """(language, code) of the fenced blocks of a markdown text."""
    blocks = F.regexp_extract_all(markdown, F.lit(r"(?ms)^```[^\n]*\n.*?^```"), F.lit(0))
    return F.transform(blocks, lambda b: F.struct(F.trim(F.regexp_extract(b, r"^```([^\n]*)", 1)).alias("language"), F.regexp_extract(b, r"(?s)^```[^\n]*\n(.*)```$", 1).alias("code")))


def formulas(markdown: Column) -> Column:
    """The formulas of a text, between $$ or \\[ \\] or $, without white space."""
    found = F.regexp_extract_all(markdown, F.lit(r"(?s)\$\$.+?\$\$|\\\[.+?\\\]|\$[^$\n]+\$"), F.lit(0))
    return F.transform(found, lambda f: F.regexp_replace(f, r"^\$+|^\\\[|\$+$|\\\]$|\s+", ""))


def marked(html: Column, colour: str) -> Column:
    """What is marked in a colour."""
    return F.regexp_extract_all(html, F.lit(rf'(?is)<mark[^>]*{colour}[^>]*>(.*?)</mark>'), F.lit(1))


def in_section(html: Column, section: str, wanted: Column) -> Column:
    """A text stands in the header or footer of a page."""
    parts = F.regexp_extract_all(html, F.lit(rf"(?is)<{section}[^>]*>.*?</{section}>"), F.lit(0))
    return F.exists(parts, lambda p: presence(text.strip_tags(p), wanted))


def repeats(document: Column, n: int = 20, most: int = 5) -> Column:
    """A line of some length that comes more than ``most`` times: a sign of a generator that ran on."""
    lines = F.filter(F.transform(F.split(document, r"\n"), F.trim), lambda x: F.length(x) >= n)
    counted = F.transform(F.array_distinct(lines), lambda x: F.size(F.filter(lines, lambda y: y == x)))
    return F.coalesce(F.array_max(counted), F.lit(0)) > most
