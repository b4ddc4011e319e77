"""Confidence: AUC with ties, coverage and precision by threshold, and reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _by_score(rows: DataFrame, score: str, correct: str) -> DataFrame:
    """One row a distinct score: what a window over all rows would sort, combined first."""
    return rows.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(correct).cast("long").alias("good"))


def ranged(rows: DataFrame, by: str) -> DataFrame:
    """Rows with ``_range``: ranges of ``by`` of about equal size, one a shuffle partition, in order."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    cuts = rows.agg(F.percentile_approx(by, [i / n for i in range(1, n)]).alias("cuts")).first().cuts or []
    return rows.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col(by))) if cuts else F.lit(0))


def running(rows: DataFrame, by: str, sums: dict[str, str]) -> DataFrame:
    """Rows with sums of columns over all rows before each in the order of ``by``, whose values are distinct: new name -> column.

    Ranges are summed first, as many as there are shuffle partitions, then rows within their range: no window sees all rows.
    """
    t = ranged(rows, by)
    whole, inner = (w.rowsBetween(W.unboundedPreceding, -1) for w in (W.orderBy("_range"), W.partitionBy("_range").orderBy(by)))
    totals = t.groupBy("_range").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_all_{n}").over(whole), F.lit(0)).alias(f"_all_{n}") for n in sums])
    t = t.join(F.broadcast(totals), "_range")  # a row a range
    return t.withColumns({n: F.col(f"_all_{n}") + F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in sums.items()}).drop("_range", *[f"_all_{n}" for n in sums])


def previous(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Rows with the next smaller value of ``by``, whose values are distinct; null for the least."""
    t = ranged(rows, by)
    ends = t.groupBy("_range").agg(F.max(by).alias("_end"))
    ends = ends.select("_range", F.max("_end").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_end"))
    own = F.lag(by).over(W.partitionBy("_range").orderBy(by))
    return t.join(F.broadcast(ends), "_range").withColumn(name, F.coalesce(own, "_end")).drop("_range", "_end")


def roc_auc(rows: DataFrame, score: str, correct: str) -> DataFrame:
    """Mann-Whitney with average ranks; null if all are of one kind."""
    ranked = running(_by_score(rows, score, correct), score, {"below": "n"})
    rank = F.col("below") + (F.col("n") + 1) / 2
    t = ranked.agg(F.sum(rank * F.col("good")).alias("ranks"), F.sum("good").alias("p"), F.sum(F.col("n") - F.col("good")).alias("q"))
    auc = (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))
    return t.select(F.col("p").cast("long").alias("n_positive"), F.col("q").cast("long").alias("n_negative"), F.when((F.col("p") > 0) & (F.col("q") > 0), F.round(auc, 6)).alias("auc"))


def thresholds(rows: DataFrame, score: str, correct: str) -> DataFrame:
    """For each observed score: what is kept at or above it, its coverage and precision."""
    t = _by_score(rows, score, correct)
    totals = t.agg(F.struct(F.sum("n").alias("n"), F.sum("good").alias("good")).alias("x")).scalar()
    t = running(t, score, {"below": "n", "wrong": "good"}).withColumn("total", totals)
    t = t.withColumns({"kept": F.col("total.n") - F.col("below"), "right": F.col("total.good") - F.col("wrong"), "all": F.col("total.n")})
    return t.select(F.col(score).alias("threshold"), "kept", "right", (F.col("kept") / F.col("all")).alias("coverage"), (F.col("right") / F.col("kept")).alias("precision"))


def curve(points: DataFrame) -> DataFrame:
    """The best precision of each coverage, from (0, 1) on."""
    best = points.groupBy("coverage").agg(F.max("precision").alias("precision"))
    return best.unionByName(points.sparkSession.range(1).select(F.lit(0.0).alias("coverage"), F.lit(1.0).alias("precision")))


def area(points: DataFrame) -> DataFrame:
    """Sum of coverage steps times the precision at their right end."""
    step = F.col("coverage") - F.coalesce("before", "coverage")
    return previous(points, "coverage", "before").withColumn("part", step * F.col("precision")).agg(F.round(F.sum("part"), 6).alias("area"))


def best_at(points: DataFrame, least: float) -> DataFrame:
    """The best precision at a coverage of ``least`` or more."""
    return points.where(F.col("coverage") >= least).agg(F.round(F.max("precision"), 6).alias("precision"), F.count(F.lit(1)).alias("n_thresholds"))


def local_order(rows: DataFrame, group: str, place: str, predicted: str, reach: int = 3) -> DataFrame:
    """By group: the share of elements whose predicted place lies after its ``reach`` neighbours before and before those after it."""
    w = W.partitionBy(group).orderBy(place)
    before = F.max(predicted).over(w.rowsBetween(-reach, -1))
    after = F.min(predicted).over(w.rowsBetween(1, reach))
    ok = (before.isNull() | (before < F.col(predicted))) & (after.isNull() | (after > F.col(predicted)))
    return rows.withColumn("ok", ok.cast("long")).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("n_ok"))


def adjacent_order(rows: DataFrame, group: str, place: str, predicted: str) -> DataFrame:
    """By group: neighbours whose predicted places do not fall."""
    nxt = F.lead(predicted).over(W.partitionBy(group).orderBy(place))
    return rows.withColumn("ok", (F.col(predicted) <= nxt).cast("long")).groupBy(group).agg(F.count("ok").alias("n_pairs"), F.coalesce(F.sum("ok"), F.lit(0)).alias("n_ok"))


def longest_run(rows: DataFrame, group: str, index: str) -> DataFrame:
    """The longest run of consecutive indices of each group."""
    d = rows.select(group, index).distinct().withColumn("island", F.col(index) - F.row_number().over(W.partitionBy(group).orderBy(index)))
    return d.groupBy(group, "island").agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(F.max("n").alias("longest"))


def union_length(rows: DataFrame, group: str, start: str, stop: str) -> DataFrame:
    """The length that intervals of a group cover together."""
    w = W.partitionBy(group).orderBy(start, stop)
    reach = F.max(stop).over(w.rowsBetween(W.unboundedPreceding, -1))
    own = F.greatest(F.lit(0), F.col(stop) - F.greatest(F.col(start), F.coalesce(reach, F.col(start))))
    return rows.withColumn("own", own).groupBy(group).agg(F.sum("own").cast("long").alias("covered"))
