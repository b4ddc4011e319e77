"""Amounts, numbers and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(28,10)"
# fixed values: the accepted shapes of an amount
GROUPED = r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"
PLAIN = r"^-?[0-9]+(\.[0-9]+)?$"
COMMA = r"^-?[0-9]+,([0-9]{1,2}|[0-9]{4,})$"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "dd.MM.yyyy", "d MMM yyyy", "MMM d, yyyy")


def parse_amount(c: Column) -> Column:
    """An exact decimal; '-' and '' are nil (0), anything else that has no accepted shape is null."""
    t = F.trim(c)
    return (
        F.when(t.isin("", "-"), F.lit(0).cast(AMOUNT))
        .when(t.rlike(GROUPED), F.regexp_replace(t, ",", "").try_cast(AMOUNT))
        .when(t.rlike(PLAIN), t.try_cast(AMOUNT))
        .when(t.rlike(COMMA), F.regexp_replace(t, ",", ".").try_cast(AMOUNT))
    )


def is_numeric_cell(c: Column) -> Column:
    return ~F.coalesce(F.trim(c), F.lit("")).isin("", "-") & parse_amount(c).isNotNull()


def digits(c: Column) -> Column:
    """What numeric exactness compares: digits and minus signs."""
    return F.regexp_replace(c, "[^0-9-]", "")


def normal_number(c: Column) -> Column:
    """Currency signs, thousands separators, unit suffixes and % dropped."""
    return F.regexp_replace(F.regexp_replace(c, r"[$€£¥,\s%]", ""), r"[a-zA-Z]+$", "").try_cast("double")


def numbers_match(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Within a relative tolerance of the first; zero matches zero alone."""
    return F.when(a == 0, b == 0).otherwise(F.abs(a - b) <= tolerance * F.abs(a))


def numeric_similarity(expected: Column, actual: Column) -> Column:
    return F.when(expected == 0, (actual == 0).cast("double")).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(expected - actual) / F.abs(expected)))


def iso_date(c: Column) -> Column:
    """A whole-string date in ISO form; digits alone and what is no date stay as they are."""
    found = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in DATE_FORMATS])
    return F.when(c.rlike(r"^[0-9]+$"), c).otherwise(F.coalesce(F.date_format(found, "yyyy-MM-dd"), c))


def f_score(true: Column, n_true: Column, n_predicted: Column) -> Column:
    """Precision is 1 if nothing is predicted, recall 1 if nothing is true; F is 0 if either is 0."""
    p = F.when(n_predicted == 0, 1.0).otherwise(true / n_predicted)
    r = F.when(n_true == 0, 1.0).otherwise(true / n_true)
    return F.when((p == 0) | (r == 0), 0.0).otherwise(2 * p * r / (p + r))
