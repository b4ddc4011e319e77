"""Runs of evaluation: which result belongs to which case, what counts as a failure, summaries of metrics and costs, and boards from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

INFRA = ("Worker error:", "Evaluation error:", "Task execution error:")


def skipped(error: Column) -> Column:
    """A result that had nothing to score."""
    return F.coalesce(F.contains(error, F.lit("No layout data")), F.lit(False))


def infra_failure(error: Column) -> Column:
    """A result that failed for reasons of the run, not of the system."""
    begins = F.lit(False)
    for p in INFRA:
        begins = begins | F.startswith(error, F.lit(p))
    return F.coalesce(~F.contains(error, F.lit("not LayoutOutput")) & begins, F.lit(False))


def match(results: DataFrame, cases: DataFrame, mode: str = "one") -> DataFrame:
    """example_id, test_id: the case of each result. ``results``: example_id; ``cases``: test_id. Names are compared in NFC.

    Modes: one (the same name, or the same without its extension), many (the same name, or else all cases below it as a folder), suffix (the same name, or the first
    case whose path ends in it). An exact name wins. Joins are on equal keys only.
    """
    r = results.select("example_id", text.nfc(F.col("example_id")).alias("_r")).distinct()
    c = cases.select("test_id", text.nfc(F.col("test_id")).alias("_c")).distinct()
    parts = F.split("_c", "/")
    at = F.sequence(F.lit(1), F.size(parts))
    keys = {
        "one": F.array(F.struct(F.lit(1).alias("rank"), F.col("_c").alias("key"))),
        "many": F.transform(at, lambda n: F.struct(F.when(n == F.size(parts), 1).otherwise(2).alias("rank"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("key"))),
        "suffix": F.transform(at, lambda n: F.struct(F.when(n == F.size(parts), 1).otherwise(2).alias("rank"), F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/").alias("key"))),
    }[mode]
    keyed = c.select("test_id", F.explode(keys).alias("x")).select("test_id", "x.*")
    own = F.array(F.struct(F.lit(0).alias("cut"), F.col("_r").alias("key")))
    if mode == "one":
        own = F.concat(own, F.array(F.struct(F.lit(1).alias("cut"), F.regexp_replace("_r", r"\.[^.]*$", "").alias("key"))))
    wanted = r.select("example_id", F.explode(F.array_distinct(own)).alias("x")).select("example_id", "x.*")
    both = wanted.join(keyed, "key").withColumn("_order", F.struct(F.col("example_id") != F.col("test_id"), "rank", "cut"))
    best = W.partitionBy("example_id")
    both = both.withColumn("_best", F.min("_order").over(best)).where("_order = _best")
    if mode == "many":
        return both.select("example_id", "test_id").distinct()
    return both.groupBy("example_id").agg(F.min("test_id").alias("test_id"))


# --- metrics -----------------------------------------------------------------------------------------------------------------------------------------------------


def grouped_aggregates(flat: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """metric, avg, min, max from rows named avg_x, min_x and max_x. ``flat``: name, value."""
    kind, base = F.regexp_extract("name", "^(avg|min|max)_", 1), F.regexp_replace("name", "^(avg|min|max)_", "")
    t = flat.select(kind.alias("kind"), base.alias("metric"), "value").where("kind <> ''")
    t = t.where(~F.col("metric").isin(*exclude)) if exclude else t
    return t.groupBy("metric").agg(*[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in ("avg", "min", "max")])


def records(groups: DataFrame) -> DataFrame:
    """rank, name, display name, avg, min, max, best averages first; what is missing is 0."""
    name = F.initcap(F.regexp_replace("metric", "_", " "))
    t = groups.select(F.col("metric").alias("name"), name.alias("display_name"), *[F.coalesce(k, F.lit(0.0)).alias(k) for k in ("avg", "min", "max")])
    return t.withColumn("rank", F.row_number().over(W.orderBy(F.desc("avg"), "name")))  # one row a metric


def costs(examples: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Costs of documents, each counted once over all splits. ``examples``: test_id, split order ``seq``, success, cost_usd, cost_per_page_usd.

    A document that failed or has no cost is counted apart.
    """
    group = group or []
    once = examples.withColumn("_n", F.row_number().over(W.partitionBy(*group, "test_id").orderBy("seq"))).where("_n = 1 or test_id is null")
    good = F.coalesce("success", F.lit(True))
    known = good & (F.col("cost_usd").isNotNull() | F.col("cost_per_page_usd").isNotNull())
    total, page = (F.when(good, F.col(c)) for c in ("cost_usd", "cost_per_page_usd"))
    return once.groupBy(*group).agg(
        F.round(F.coalesce(F.sum(total), F.lit(0.0)), 6).alias("total_usd"), F.round(F.avg(page), 6).alias("mean_per_page_usd"), F.round(F.avg(total), 6).alias("mean_per_document_usd"),
        F.greatest(F.count(total), F.count(page)).alias("documents"), F.sum((~known).cast("long")).alias("documents_without_cost"),
    )


def usd(v: Column, cents: bool = False) -> Column:
    """An amount for people: a dash for none, four places below a dollar, two from there on; or cents."""
    if cents:
        return F.coalesce(F.concat(F.format_string("%.2f", v * 100), F.lit("¢")), F.lit("—"))
    return F.coalesce(F.concat(F.lit("$"), F.when(v < 1, F.format_number(v, 4)).otherwise(F.format_number(v, 2))), F.lit("—"))


def cell_metrics(scores: DataFrame) -> DataFrame:
    """Means by system of cell and null metrics, and cells judged; nulls where nothing was scored."""
    names = ("coverage", "numeric_exact", "digit_cer", "null_accuracy", "null_fabricated", "null_dropped")
    return scores.groupBy("system").agg(*[F.round(F.avg(c), 6).alias(c) for c in names], F.sum("null_judged").cast("long").alias("cells_judged"))


def dev_report(scores: DataFrame, metric: str) -> DataFrame:
    """system, raw, text, struct, status: means over documents, with what keeps a row from the board named and nothing rejected."""
    mean = lambda p: F.round(F.avg(F.when((F.col("pass") == p) & (F.col("metric") == metric), F.col("value"))), 6).alias(p)
    flag = lambda c: F.max(F.coalesce(F.col(c), F.lit(False)).cast("int")) == 1
    status = F.when(flag("external_report"), "externally reported").when(flag("hand_imported"), "hand-imported (dev only)").otherwise("api")
    return scores.groupBy("system").agg(mean("raw"), mean("text"), mean("struct"), status.alias("status"))
