"""Gates: what a table must fulfil before it is scored, as rows of defects rather than exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def defects(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """One row for each check that a row fails; ``checks``: name of the defect to the condition that finds it."""
    failed = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(failed).alias("defect"))


def first_failing(checks: dict[str, Column]) -> Column:
    """The first check in order that a row fails; null if it may be admitted."""
    out = F.lit(None).cast("string")
    for name, c in reversed(checks.items()):
        out = F.when(c, F.lit(name)).otherwise(out)
    return out


def freeze(rows: DataFrame, key: str, column: str) -> DataFrame:
    """The digest of each row's content, to be compared later."""
    return rows.select(key, F.sha2(F.coalesce(column, F.lit("")), 256).alias("sha256"))


def thawed(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Rows that changed, went or came since a freeze."""
    both = before.select(key, F.col("sha256").alias("was")).join(now.select(key, F.col("sha256").alias("is")), key, "full")
    state = F.when(F.col("is").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.col("is") != F.col("was"), "changed")
    return both.select(key, state.alias("state")).where("state is not null")


def leaked(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Training rows whose content is in the test set."""
    digest = lambda d: d.withColumn("_sha", F.sha2(F.coalesce(column, F.lit("")), 256))
    return digest(train).join(digest(test).select("_sha").distinct(), "_sha", "left_semi").drop("_sha")


def garbled(rows: DataFrame, key: str, column: str, least: int = 2) -> DataFrame:
    """Rows whose text looks like UTF-8 that was read as Latin-1."""
    return rows.select(key, text.mojibake_pairs(F.col(column)).cast("long").alias("pairs")).where(F.col("pairs") >= least)
