"""Joins of reports and results: A/B comparison, failures, missing attempts, matrices and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def compare(a: DataFrame, b: DataFrame, key: str, good: float) -> DataFrame:
    """Full outer join of two reports (key, score): which is better, or both bad, or only one has it."""
    both = a.select(key, F.col("score").alias("score_a")).join(b.select(key, F.col("score").alias("score_b")), key, "full")
    verdict = (
        F.when(F.col("score_b").isNull(), "only_a").when(F.col("score_a").isNull(), "only_b")
        .when((F.col("score_a") < good) & (F.col("score_b") < good), "both_bad")
        .when(F.col("score_a") > F.col("score_b"), "a_better").when(F.col("score_a") < F.col("score_b"), "b_better").otherwise("tie")
    )
    return both.withColumn("verdict", verdict)


def missing_attempts(left: DataFrame, right: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of two small dimensions that have no result: they count as zero. The dimensions bound the product, not the data."""
    return left.crossJoin(F.broadcast(right)).join(seen.select(*keys).distinct(), keys, "left_anti").withColumn("score", F.lit(0.0))


def failures(errors: DataFrame, cases: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Errors of known cases without a result."""
    return errors.join(cases.select(key), key, "left_semi").join(done.select(key), key, "left_anti")


def matrix(facts: DataFrame, row: str, column: str, columns: list, value: str) -> DataFrame:
    """Row by column; ranked by the sum with gaps as 0, while the mean shows only where no cell is missing."""
    wide = facts.groupBy(row).pivot(column, columns).agg(F.avg(value))
    cells = [F.col(str(c)) for c in columns]
    have = sum((c.isNotNull().cast("int") for c in cells), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cells), F.lit(0.0))
    wide = wide.withColumns({"n_cells": have.cast("long"), "key": F.round(total, 4), "mean": F.when(have == len(columns), F.round(total / len(columns), 4))})
    # one row a system: the ranking's single partition is bounded by their number
    return wide.select(row, "n_cells", F.col("key").alias("rank_key"), "mean", F.rank().over(W.orderBy(F.desc("key"))).cast("long").alias("rank"))


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest entry of each key; later places in the log win. ``max_by`` combines before the shuffle, where a window would not."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*key, "x.*")


def mixed_versions(log: DataFrame, key: str, version: str) -> DataFrame:
    """Keys whose entries have more than one version, which must not be compared."""
    return log.groupBy(key).agg(F.countDistinct(version).cast("long").alias("n_versions")).where("n_versions > 1")


def consensus(votes: DataFrame, cell: list[str], value: str, least: int = 2) -> DataFrame:
    """Values that at least ``least`` voters give for a cell."""
    return votes.groupBy(*cell, value).agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= least)
