"""Aggregation of metric facts: failure padding, micro and macro scores, positional percentiles, reports by grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Micro precision, recall and F1; a ratio without cases is 0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)


def micro_by(facts: DataFrame, group: str, whole: str = "overall") -> DataFrame:
    """tp, fp, fn and micro precision, recall, F1 by group and over all, in one pass. ``facts``: group, tp, fp, fn."""
    sums = facts.cube(group).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], F.grouping(group).alias("all"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    name = F.when(F.col("all") == 1, whole).otherwise(F.col(group))
    return sums.select(name.alias(group), "tp", "fp", "fn", F.round(p, 6).alias("micro_precision"), F.round(r, 6).alias("micro_recall"), F.round(f, 6).alias("micro_f1"))


def padded_average(facts: DataFrame, group: str, value: str, ok: Column) -> DataFrame:
    """Mean with failures as zeros, beside that over successes alone."""
    return facts.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((~ok).cast("long")).alias("n_failed"),
        F.round(F.avg(F.when(ok, F.col(value)).otherwise(0.0)), 6).alias("avg_padded"),
        F.round(F.avg(F.when(ok, F.col(value))), 6).alias("avg_success"),
    )


def positional(facts: DataFrame, group: list[str], value: str, percents=(50, 90, 95, 99)) -> DataFrame:
    """The value at place min(floor(n * p / 100), n - 1) of the sorted values, which is neither of Spark's percentiles.

    Places come from a window, not from one array a group, so that a group of any size streams through a sort.
    """
    w = W.partitionBy(*group)
    placed = facts.where(F.col(value).isNotNull()).withColumns({"_n": F.count(F.lit(1)).over(w), "_at": F.row_number().over(w.orderBy(value)) - 1})
    at = lambda p: F.least(F.floor(F.col("_n") * p / 100), F.col("_n") - 1)
    return placed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"),
        *[F.max(F.when(F.col("_at") == at(p), F.col(value))).alias(f"p{p}") for p in percents],
    )


def by_tag(facts: DataFrame, tags: str, value: str) -> DataFrame:
    """The same aggregate for every tag that a row carries."""
    return facts.select(F.explode(tags).alias("tag"), value).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("average"))


def report(facts: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Overall, by a, and by a and b, told apart by ``level``."""
    rolled = facts.rollup(a, b).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("average"), F.grouping_id().alias("_id"))
    level = F.when(F.col("_id") == 3, "overall").when(F.col("_id") == 1, a).otherwise("cell")
    return rolled.select(level.alias("level"), F.coalesce(a, F.lit("*")).alias(a), F.coalesce(b, F.lit("*")).alias(b), "n", "average")


def pivoted(facts: DataFrame, key: str, name: str, values: list, value: str) -> DataFrame:
    """One row a key, one column a name; names are given, so that no pass looks for them."""
    out = facts.groupBy(key).pivot(name, values).agg(F.sum(value))
    return out.select(key, *[F.round(F.col(str(v)), 2).alias(f"{name}_{v}") for v in values])


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_first", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_first = 1").drop("_first")
