"""Readers of test cases and results, and the append-only score log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import visible

RULE = "pdf string, page int, category string, id string, type string, verified boolean, rule string"
SCORE = "seq bigint, system string, document string, canon_version string, scored_at timestamp, metric string, pass string, value double, status string"


def rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule rows of a JSONL dataset; ``rule`` may be JSON within JSON and is unwrapped. Rules marked as not verified go."""
    rows = spark.read.schema(RULE).option("mode", "PERMISSIVE").json(path)
    inner = F.get_json_object(F.concat(F.lit('{"x":'), F.col("rule"), F.lit("}")), "$.x")
    return rows.withColumn("rule", F.when(F.col("rule").startswith('"'), inner).otherwise(F.col("rule"))).where("coalesce(verified, true)")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """One row a document: category, pdf, rules in order of page and id."""
    return rules(spark, path).groupBy("category", "pdf").agg(F.sort_array(F.collect_list(F.struct("page", "id", "type", "rule"))).alias("rules"))


def sidecars(spark: SparkSession, path: str, suffix: str = ".test.json") -> DataFrame:
    """Whole JSON files beside documents: document, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), f"{suffix.replace('.', '[.]')}$", "")
    return files.select(name.alias("document"), F.decode("content", "UTF-8").alias("content"))


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result files, with those that do not parse as rows of their own (``_corrupt``)."""
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.result.json").json(path)


def score_log(spark: SparkSession, path: str) -> DataFrame:
    """The log; ``seq`` gives its order, which decides what is latest."""
    return spark.read.schema(SCORE).json(path)


def append_scores(scores: DataFrame, path: str) -> None:
    """Adds a batch; what is there is never rewritten."""
    scores.write.mode("append").json(path)


def write_csv(wide: DataFrame, path: str) -> None:
    """A report as CSV, gaps as empty fields."""
    wide.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def to_markdown(rows: DataFrame) -> str:
    """A report as a pipe table, streamed to the driver; it has as many rows as the report."""
    names = rows.columns
    lines = ["| " + " | ".join(names) + " |", "|" + "-|" * len(names)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.toLocalIterator()]
    return "\n".join(lines)


def run_errors(spark: SparkSession, path: str) -> DataFrame:
    """pipeline, example_id, error of the ``_errors.json`` files below a folder; the pipeline is the folder of the file, files that hold no list give nothing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(visible(spark, path, "_errors.json"))
    entry = F.explode(F.from_json(F.decode("content", "UTF-8"), "array<struct<example_id:string,error:string>>"))
    return files.select(F.element_at(F.split("path", "/"), -2).alias("pipeline"), entry.alias("x")).select("pipeline", "x.*")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """pipeline, test_id, metric, value of all ``_evaluation_report.json`` files below a folder."""
    schema = "per_example_results array<struct<test_id:string,metrics:array<struct<metric_name:string,value:double>>>>"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(visible(spark, path, "_evaluation_report.json"))
    t = files.select(F.element_at(F.split("path", "/"), -2).alias("pipeline"), F.from_json(F.decode("content", "UTF-8"), schema).alias("r"))
    t = t.select("pipeline", F.explode("r.per_example_results").alias("e")).select("pipeline", "e.test_id", F.explode("e.metrics").alias("m"))
    return t.select("pipeline", "test_id", F.col("m.metric_name").alias("metric"), "m.value")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a manifest's docs as JSON, in order; a manifest without docs is an error."""
    docs = F.get_json_object(F.decode("content", "UTF-8"), "$.docs")
    t = spark.read.format("binaryFile").load(path).select(F.coalesce(docs, F.raise_error(F.lit("a manifest has a docs array")).cast("string")).alias("docs"))
    entry = F.posexplode(F.from_json("docs", "array<string>"))
    return t.select(entry.alias("n", "doc"))


# --- texts of pages from what providers export -------------------------------------------------------------------------------------------------------------------


def page_text(page: dict) -> str:
    """The markup of a page of an export: its text, or its items or blocks, tables as HTML."""
    if str(page.get("text") or "").strip():
        return str(page["text"]).strip()
    items = [x for x in page.get("items") or () if isinstance(x, dict)]
    parts = [str(x.get("html") or x.get("md") or "") if x.get("type") == "table" else str(x.get("md") or x.get("value") or "") for x in items]
    for rendered in (page.get("response") or {}).get("pages") or ():
        parts += [str((b.get("table") or {}).get("html") or "") if b.get("type") == "table" else str((b.get("text") or {}).get("content") or "") for b in rendered.get("blocks") or ()]
    return "\n\n".join(p for p in parts if p)


def page_htmls(export: dict) -> list[str]:
    """The HTML of the pages of an export with nested blocks."""
    return [str(b["html"]) for b in export.get("children") or () if isinstance(b, dict) and b.get("block_type") == "Page" and b.get("html")]


def line_markup(pages: list[dict]) -> str:
    """Recognised lines as markup: regions from the top, those with several columns as tables, lines of the others from the top and right."""
    from html import escape

    out = []
    for page in pages:
        regions: dict = {}
        for u in page["lines"]:
            regions.setdefault(u.get("rid"), []).append(u)
        for units in sorted(regions.values(), key=lambda us: min(u["y"] for u in us)):
            width = max(u.get("col", 0) for u in units)
            if len({u.get("col", 0) for u in units}) > 1:
                rows: dict[int, dict[int, str]] = {}
                for u in units:
                    rows.setdefault(u.get("row", 0), {})[u.get("col", 0)] = u["t"]
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{escape(rows[r].get(c, ''), False)}</td>" for c in range(width + 1)) + "</tr>" for r in sorted(rows)) + "</table>")
            else:
                out += [escape(u["t"], False) for u in sorted(units, key=lambda u: (round(u["y"], 3), -u["x"]))]
    return "\n\n".join(out)


def truth_markup(gt: dict) -> str:
    """A ground truth as markup: its lines, then its tables."""
    from html import escape

    lines = [" ".join(str(x.get("text", "")).split()) for x in gt.get("lines") or ()]
    rows = [t.get("rows") or [] for t in gt.get("tables") or ()]
    tables = ["<table>" + "".join("<tr>" + "".join(f"<td>{escape(str(c), False)}</td>" for c in r) + "</tr>" for r in t) + "</table>" for t in rows if t]
    return "\n\n".join([x for x in (*lines, *tables) if x]) + "\n"


def image_hashes(pages: DataFrame, key: str, column: str) -> DataFrame:
    """key and the SHA-256 of each page's pixels."""
    return pages.select(key, F.sha2(column, 256).alias("sha256"))


def write_rule_csv(verdicts: DataFrame, path: str) -> None:
    """Verdicts of rules as CSV, one row a rule."""
    verdicts.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def to_html(rows: DataFrame, title: str) -> str:
    """A report as a page with one table, streamed to the driver row by row; it has as many rows as the report."""
    from html import escape

    cell = lambda tag, v: f"<{tag}>{escape('' if v is None else str(v))}</{tag}>"
    head = "".join(cell("th", c) for c in rows.columns)
    body = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows.toLocalIterator())
    return f"<html><head><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table></body></html>"
