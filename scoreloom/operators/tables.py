"""Tables: extraction to cells, structural canon, adjacency, cell coverage, nulls, exact arithmetic."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers, text

CELL = T.StructType([T.StructField(n, t) for n, t in (("tbl", T.IntegerType()), ("row", T.IntegerType()), ("col", T.IntegerType()), ("text", T.StringType()), ("is_th", T.BooleanType()), ("colspan", T.IntegerType()), ("rowspan", T.IntegerType()))])


class _Reader(HTMLParser):
    """Top-level tables of a markup; what nested tables hold is text of the cell around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[dict]]] = []
        self.depth, self.cell = 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.cell = None
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th"):
            span = {k: int(v) if (v or "").isdigit() and int(v) else 1 for k, v in dict(attrs).items() if k in ("colspan", "rowspan")}
            self.cell = {"text": "", "is_th": tag == "th", "colspan": span.get("colspan", 1), "rowspan": span.get("rowspan", 1)}
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
        if self.depth <= 1 and tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"] += data


def html_cells(markup: str) -> Iterator[tuple]:
    """Cells of all tables at their place in the span grid; a span repeats its cell over the places it covers."""
    reader = _Reader()
    reader.feed(markup)
    for t, rows in enumerate(reader.tables):
        taken: dict[tuple[int, int], bool] = {}
        for r, row in enumerate(rows):
            c = 0
            for cell in row:
                while (r, c) in taken:
                    c += 1
                for i in range(min(cell["rowspan"], len(rows) - r)):
                    for j in range(cell["colspan"]):
                        taken[r + i, c + j] = True
                        yield t, r + i, c + j, " ".join(cell["text"].split()), cell["is_th"], cell["colspan"], cell["rowspan"]
                c += cell["colspan"]


def pipe_cells(markdown: str, first: int = 0) -> Iterator[tuple]:
    """Cells of pipe tables; the row of dashes marks what is above it as header."""
    table, rows = first, []
    for line in [*markdown.split("\n"), ""]:
        line = line.strip()
        if line.startswith("|"):
            rows.append([c.strip() for c in line.strip("|").split("|")])
            continue
        if len(rows) > 1 and all(set(c) <= set("-: ") and "-" in c for c in rows[1]):
            for r, row in enumerate([rows[0], *rows[2:]]):
                for c, value in enumerate(row):
                    yield table, r, c, value, r == 0, 1, 1
            table += 1
        rows = []


@F.udtf(returnType=CELL, useArrow=True)
class ExtractTables:
    """Cells of the HTML and pipe tables of a markup, one row each."""

    def eval(self, markup: str):
        if markup:
            cells = list(html_cells(markup))
            yield from cells
            yield from pipe_cells(markup, 1 + max((c[0] for c in cells), default=-1))


def cells(docs: DataFrame, key: str, markup: str) -> DataFrame:
    """key, tbl, row, col, text, is_th, colspan, rowspan."""
    return docs.select(key, F.col(markup).alias("_markup")).lateralJoin(ExtractTables(F.col("_markup").outer())).select(key, *CELL.names)


def without_sections(grid: DataFrame, table: list[str]) -> DataFrame:
    """Drops blank rows and section rows (one cell with text, in a table wider than one), unless that empties the table."""
    row = W.partitionBy(*table, "row")
    full = (F.coalesce(F.trim("text"), F.lit("")) != "").cast("int")
    t = grid.withColumns({"_full": F.sum(full).over(row), "_wide": F.count(F.lit(1)).over(row)})
    t = t.withColumn("_keep", (F.col("_full") > 1) | ((F.col("_full") == 1) & (F.col("_wide") == 1)))
    t = t.withColumn("_any", F.max(F.col("_keep").cast("int")).over(W.partitionBy(*table)))
    return t.where("_keep or _any = 0").drop("_full", "_wide", "_keep", "_any")


def sizes(grid: DataFrame, table: list[str]) -> DataFrame:
    return grid.groupBy(*table).agg((F.max("row") + 1).cast("long").alias("n_rows"), (F.max("col") + 1).cast("long").alias("n_cols"), F.count(F.lit(1)).alias("n_cells"))


def neighbours(grid: DataFrame, table: list[str]) -> DataFrame:
    """Each cell with the one to its right and the one below."""
    right = F.lead("text").over(W.partitionBy(*table, "row").orderBy("col"))
    below = F.lead("text").over(W.partitionBy(*table, "col").orderBy("row"))
    return grid.withColumns({"right": right, "below": below})


def column_order(grid: DataFrame, table: list[str]) -> DataFrame:
    """Columns with the label column (the largest share of cells that are no numbers; the rightmost of equals) first, others in order."""
    share = F.avg((~F.coalesce(numbers.is_numeric_cell(F.col("text")), F.lit(False))).cast("double"))
    stat = grid.groupBy(*table, "col").agg(F.round(share, 9).alias("share"))
    label = F.row_number().over(W.partitionBy(*table).orderBy(F.desc("share"), F.desc("col"))) == 1
    stat = stat.withColumn("_label", label)
    return stat.withColumn("new_col", (F.row_number().over(W.partitionBy(*table).orderBy(F.desc("_label"), "col")) - 1).cast("long")).drop("_label", "share")


def coverage(true: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """Cells with text that the prediction has too, and the exactness of numeric ones; a missing cell is a full deletion."""
    both = true.join(predicted.select(*key, F.col("text").alias("said")), key, "left")
    has = F.coalesce(F.trim("text"), F.lit("")) != ""
    number = has & numbers.is_numeric_cell(F.col("text"))
    a, b = numbers.digits(F.col("text")), F.coalesce(numbers.digits(F.col("said")), F.lit(""))
    return both.agg(
        F.sum(has.cast("long")).alias("n_cells"), F.sum((has & ~text.is_null_form(F.col("said"))).cast("long")).alias("n_covered"),
        F.sum(number.cast("long")).alias("n_numeric"), F.sum((number & (a == b)).cast("long")).alias("n_exact"),
        F.sum(F.when(number, F.levenshtein(a, b)).otherwise(0)).cast("long").alias("n_edits"), F.sum(F.when(number, F.length(a)).otherwise(0)).cast("long").alias("n_digits"),
    )


def null_confusion(true: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """Null and value on both sides, as counts; a cell that the prediction lacks is null there."""
    both = true.join(predicted.select(*key, F.col("text").alias("said")), key, "left")
    a, b = text.is_null_form(F.col("text")), text.is_null_form(F.col("said"))
    count = lambda c: F.sum(c.cast("long"))
    return both.agg(count(a & b).alias("null_kept"), count(a & ~b).alias("fabricated"), count(~a & b).alias("dropped"), count(~a & ~b).alias("value_kept"))


def relations(terms: DataFrame, key: list[str]) -> DataFrame:
    """Exact sums: terms with role total or addend and an amount. A null amount is missing, which leaves the relation unevaluated."""
    total, addend = F.col("role") == "total", F.col("role") == "addend"
    t = terms.groupBy(*key).agg(
        F.sum(F.when(addend, F.col("amount"))).alias("added"), F.max(F.when(total, F.col("amount"))).alias("total"),
        F.sum(F.col("amount").isNull().cast("long")).alias("n_missing"),
        F.sum((F.col("amount") == 0).cast("long")).alias("n_nil"), F.count(F.lit(1)).alias("n_terms"),
    )
    evaluable = (F.col("n_missing") == 0) & F.col("total").isNotNull()
    return t.withColumns({"evaluable": evaluable, "reconciles": evaluable & (F.coalesce("added", F.lit(0)) == F.col("total")), "all_nil": F.col("n_nil") == F.col("n_terms")})


def as_cells(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A relational table in the long form of a grid: one row a cell."""
    named = F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("text")) for i, c in enumerate(columns)])
    return rows.select(F.col(key).alias("row"), F.explode(named).alias("x")).select("row", "x.col", "x.text")


def ref(tbl: Column, row: Column, col: Column) -> Column:
    return F.format_string("t%d.r%d.c%d", tbl, row, col)
