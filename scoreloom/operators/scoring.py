"""The scores of a document: three passes over its tables, kept apart from extraction and arithmetic; and the boards made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import tables

PASSES = ("raw", "text", "struct")


class CombinedScoreError(ValueError):
    """Parse, extraction and arithmetic scores are never one number."""


def passes(grid: DataFrame, table: list[str]) -> DataFrame:
    """Cells of every pass: as they are, with canonical text, and without section and blank rows."""
    canon = grid.withColumn("text", text.canonical(F.col("text"), unicode=False))
    kinds = [grid.withColumn("pass", F.lit("raw")), canon.withColumn("pass", F.lit("text")), tables.without_sections(canon, table).withColumn("pass", F.lit("struct"))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def grids(cells: DataFrame, table: list[str]) -> DataFrame:
    """One row a table: its rows in order, each its texts in order (gaps are empty)."""
    row = cells.groupBy(*table, "row").agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("x"))
    line = F.transform("x", lambda c: F.coalesce(c["text"], F.lit("")))
    return row.withColumn("line", line).groupBy(*table).agg(F.sort_array(F.collect_list(F.struct("row", "line"))).alias("y")).select(*table, F.transform("y", lambda r: r["line"]).alias("grid"))


def board(scores: DataFrame, metric: str, combined: bool = False) -> DataFrame:
    """system by pass: means of one metric over documents, failures as zeros. Metrics are never combined."""
    if combined or metric == "overall":
        raise CombinedScoreError("parse, extraction and arithmetic scores stand apart")
    wide = scores.where(F.col("metric") == metric).groupBy("system").pivot("pass", list(PASSES)).agg(F.round(F.avg(F.when(F.col("status") == "failed", 0.0).otherwise(F.col("value"))), 6))
    return wide.withColumn("metric", F.lit(metric))


def fidelity(docs: DataFrame, key: str, true: str, said: str) -> DataFrame:
    """The share of the prediction's digit runs that are in the commonest script of the true text; of equals the first by name; null without runs."""
    run = lambda c: F.explode(F.regexp_extract_all(c, F.lit(f"[0-9{text.ARABIC_INDIC}{text.EXTENDED_INDIC}]+"), F.lit(0)))
    runs = lambda c, n: docs.select(key, run(c).alias("r")).select(key, text.script_of_run(F.col("r")).alias("script")).groupBy(key, "script").agg(F.count(F.lit(1)).alias(n))
    mode = runs(true, "n").groupBy(key).agg(F.min_by("script", F.struct(-F.col("n"), F.col("script"))).alias("mode"))
    said_ = runs(said, "n").join(mode, key, "left")
    share = said_.groupBy(key).agg((F.sum(F.when(F.col("script") == F.col("mode"), F.col("n")).otherwise(0)) / F.sum("n")).alias("fidelity"))
    return docs.select(key).join(share, key, "left").select(key, F.round("fidelity", 6).alias("fidelity"))
