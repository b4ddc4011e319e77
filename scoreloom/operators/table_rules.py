"""Rules over table cells as joins: neighbours, shared rows and columns, headers, spans. Rules and cells are tables; a rule passes if some table of its document bears it out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text



def _relation(kind: str) -> Column:
    a = {n: F.col(f"a_{n}") for n in ("row", "col")}
    b = {n: F.col(f"b_{n}") for n in ("row", "col")}
    return {
        "same_row": (a["row"] == b["row"]) & (a["col"] != b["col"]),
        "same_column": (a["col"] == b["col"]) & (a["row"] != b["row"]),
        "adjacent_right": (a["row"] == b["row"]) & (b["col"] == a["col"] + 1),
        "adjacent_left": (a["row"] == b["row"]) & (b["col"] == a["col"] - 1),
        "adjacent_down": (a["col"] == b["col"]) & (b["row"] == a["row"] + 1),
        "adjacent_up": (a["col"] == b["col"]) & (b["row"] == a["row"] - 1),
        "top_header": (a["col"] == b["col"]) & (b["row"] < a["row"]),
        "left_header": (a["row"] == b["row"]) & (b["col"] < a["col"]),
    }[kind]


RELATIONS = ("same_row", "same_column", "adjacent_right", "adjacent_left", "adjacent_down", "adjacent_up", "top_header", "left_header")


def relations(rules: DataFrame, cells: DataFrame, document: str, least: float = 0.8) -> DataFrame:
    """document, rule, passed. ``rules``: document, rule, kind, anchor, other; ``cells``: document, tbl, row, col, text.

    Texts agree from a similarity of ``least`` on. A rule meets the cells of its own document only, and the anchor is
    found before the other cell is looked for.
    """
    near = lambda wanted, cell: text.similarity(F.lower(F.trim(wanted)), F.lower(F.trim(cell))) >= least
    side = lambda p: cells.select(document, "tbl", *[F.col(c).alias(f"{p}_{c}") for c in ("row", "col", "text")])
    anchored = rules.join(side("a"), document).where(near(F.col("anchor"), F.col("a_text")))
    both = anchored.join(side("b"), [document, "tbl"])
    holds = F.lit(False)
    for kind in RELATIONS:
        holds = holds | ((F.col("kind") == kind) & _relation(kind))
    found = both.where(holds & near(F.col("other"), F.col("b_text"))).select(document, "rule").distinct().withColumn("passed", F.lit(True))
    return rules.select(document, "rule").join(found, [document, "rule"], "left").select(document, "rule", F.coalesce("passed", F.lit(False)).alias("passed"))


def spans(rules: DataFrame, cells: DataFrame, document: str) -> DataFrame:
    """document, rule, passed of rules that ask for a cell's colspan and rowspan. ``rules``: document, rule, anchor, colspan, rowspan."""
    own = cells.select(document, "text", F.col("colspan").alias("_c"), F.col("rowspan").alias("_r"))
    both = rules.join(own, document).where((F.lower(F.trim("anchor")) == F.lower(F.trim("text"))) & (F.col("colspan") == F.col("_c")) & (F.col("rowspan") == F.col("_r")))
    found = both.select(document, "rule").distinct().withColumn("passed", F.lit(True))
    return rules.select(document, "rule").join(found, [document, "rule"], "left").select(document, "rule", F.coalesce("passed", F.lit(False)).alias("passed"))


def sizes(rules: DataFrame, cells: DataFrame, document: str) -> DataFrame:
    """document, rule, passed: some table has the rows and columns that a rule asks for (null asks for nothing)."""
    have = cells.groupBy(document, "tbl").agg((F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols")).drop("tbl").distinct()
    fits = lambda wanted, got: F.col(wanted).isNull() | (F.col(wanted) == F.col(got))
    found = rules.join(have, document).where(fits("n_rows", "_rows") & fits("n_cols", "_cols")).select(document, "rule").distinct().withColumn("passed", F.lit(True))
    return rules.select(document, "rule").join(found, [document, "rule"], "left").select(document, "rule", F.coalesce("passed", F.lit(False)).alias("passed"))
