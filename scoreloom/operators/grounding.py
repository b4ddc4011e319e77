"""Grounding and layout scores: attribution by tokens, page order, mean average precision, titles and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.udfs import overlaps
from .layout import touching


def best_block(elements: DataFrame, blocks: DataFrame, page: str, ioa_least: float = 0.3) -> DataFrame:
    """The block that covers most of each element, if it covers ``ioa_least`` of it: page, id, block, ioa. Boxes: page, id, x0..y1."""
    both = touching(elements, blocks, page).withColumnsRenamed({"a_id": "id", "b_id": "block"})
    both = both.withColumn("ioa", geometry.ioa(geometry.box("a_"), geometry.box("b_"))).where(F.col("ioa") >= ioa_least)
    return both.groupBy(page, "id").agg(F.max_by(F.struct("block", "ioa"), F.struct("ioa", -F.col("block"))).alias("x")).select(page, "id", "x.block", "x.ioa")


def attributed(pairs: DataFrame, key: list[str], true: str, said: str) -> DataFrame:
    """Token precision and recall of each pair, weighted over a page by the number of tokens: key, lap, lar.

    Without predicted tokens precision is 1, without true ones recall is 1.
    """
    t = overlaps(pairs, key, true, said)
    s = t.groupBy(*key).agg(F.sum("same").alias("same"), F.sum("n_a").alias("t"), F.sum("n_b").alias("s"))
    return s.select(*key, F.round(F.when(F.col("s") > 0, F.col("same") / F.col("s")).otherwise(1.0), 6).alias("lap"), F.round(F.when(F.col("t") > 0, F.col("same") / F.col("t")).otherwise(1.0), 6).alias("lar"))


def confusion(true: DataFrame, predicted: DataFrame, key: list[str], label: str) -> DataFrame:
    """Counts of true and predicted class; what only one side has is background on the other."""
    both = true.select(*key, F.col(label).alias("true_class")).join(predicted.select(*key, F.col(label).alias("said_class")), key, "full")
    return both.fillna("background", ["true_class", "said_class"]).groupBy("true_class", "said_class").agg(F.count(F.lit(1)).alias("n"))


def mean_average_precision(hits: DataFrame, group: str, threshold: str, n_true: DataFrame) -> DataFrame:
    """Average precision of each class at each threshold, then the mean over classes with support, then over thresholds."""
    w = W.partitionBy(group, threshold).orderBy(F.desc("score"), "id")
    t = hits.withColumns({"_rank": F.row_number().over(w), "_hits": F.sum(F.col("matched").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0))})
    s = t.groupBy(group, threshold).agg(F.sum(F.when(F.col("matched"), F.col("_hits") / F.col("_rank")).otherwise(0.0)).alias("s"))
    ap = s.join(n_true.where("n_true > 0"), group).withColumn("ap", F.col("s") / F.col("n_true"))
    by = ap.groupBy(threshold).agg(F.avg("ap").alias("ap"))
    return by.agg(F.round(F.avg("ap"), 6).alias("map"), F.count(F.lit(1)).alias("n_thresholds"))


def title_edges(titles: DataFrame, key: str, place: str, level: str) -> DataFrame:
    """Each title with its parent, the nearest one before it of a smaller level (1 to 6): key, place, parent (-1: none). One window, no pairs."""
    before = W.partitionBy(key).orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    last = [F.when(F.col(level) > n, F.max(F.when(F.col(level) == n, F.col(place))).over(before)) for n in range(1, 6)]
    return titles.select(key, F.col(place).alias("place"), F.coalesce(F.greatest(*last), F.lit(-1)).alias("parent"))


def header_bag(true: DataFrame, said: DataFrame, key: str, column: str) -> DataFrame:
    """Multiset overlap of header texts over the number of true ones (a recall): key, score."""
    count = lambda d, n: d.groupBy(key, column).agg(F.count(F.lit(1)).alias(n))
    both = count(true, "a").join(count(said, "b"), [key, column], "left").fillna(0, ["b"])
    return both.groupBy(key).agg(F.round(F.sum(F.least("a", "b")) / F.sum("a"), 6).alias("score"))


def count_score(a: Column, b: Column) -> Column:
    """The smaller over the larger; both nothing is 1, one of them 0."""
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def association_f1(true: DataFrame, said: DataFrame, key: str, items: str) -> DataFrame:
    """F1 of the sets that each key is associated with; a key that one side lacks has an empty set there."""
    sets = lambda d, n: d.groupBy(key).agg(F.collect_set(items).alias(n))
    both = sets(true, "a").join(sets(said, "b"), key, "full")
    nothing = F.array().cast(dict(true.dtypes)[items].join(("array<", ">")))
    both = both.withColumns({"a": F.coalesce("a", nothing), "b": F.coalesce("b", nothing)})
    same = F.size(F.array_intersect("a", "b"))
    return both.select(key, F.round(F.when(F.size("a") + F.size("b") > 0, 2 * same / (F.size("a") + F.size("b"))).otherwise(1.0), 6).alias("f1"))
