"""The score of a document from its markup: three passes over its tables, cells, nulls, arithmetic and script fidelity. One row a document, kernels within.

Passes: ``raw`` (as written), ``text`` (canonical text on both sides) and ``struct`` (canonical tables too). The pairing and alignment of the struct pass say
which predicted cell stands for a true one wherever cells are compared. A blank prediction scores zero on record; broken encodings raise.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canon, grids, prose, text
from ..functions import table_metrics as metrics

PASSES = ("raw", "text", "struct")
HEADLINE = ("grits_con", "grits_trm_composite", "table_record_match", "structural_consistency")


class MojibakeError(ValueError):
    """A text that was decoded with a wrong encoding."""


def assert_clean(s: str | None, source: str) -> None:
    n = len(re.findall(text.MOJIBAKE, s or ""))
    if n:
        raise MojibakeError(f"{source}: {n} pairs of signs of a wrong encoding")


# --- titles --------------------------------------------------------------------------------------------------------------------------------------

_TABLE = re.compile(r"(?is)<table\b[^>]*>")


def title_rows(markup: str) -> list[str]:
    """Texts of first rows that are one cell over the whole width of a table."""
    out = []
    for t in grids.html_tables(markup):
        if len(t.rows) > 1 and len(t.rows[0]) == 1:
            cell, below = t.rows[0][0], sum(c.colspan for c in t.rows[1])
            if cell.colspan > 1 and cell.colspan >= below and cell.text:
                out.append(cell.text)
    return out


def with_titles(true: str, got: str) -> str:
    """The prediction with texts above its tables as title rows, where the truth has such a row and the texts are alike."""
    titles = [prose.prose(t) for t in title_rows(true)] if true and got else []
    if not titles:
        return got
    out, at = [], 0
    tables, found = grids.html_tables(got), list(_TABLE.finditer(got))
    if len(tables) != len(found):  # nested tables: leave the page as it is
        return got
    for m, t in zip(found, tables, strict=True):
        before = got[at : m.start()]
        # the last element or text before the table
        node = re.search(r"(?s)(<(\w+)[^>]*>(?:(?!<\2\b).)*</\2>|[^<>]+)\s*$", before)
        words = re.sub("<[^>]*>", "", node[1]).strip() if node else ""
        width = max((sum(c.colspan for c in row) for row in t.rows), default=0)
        titled = t.rows and len(t.rows[0]) == 1 and t.rows[0][0].colspan > 1
        if words and width > 1 and not titled and any(prose.ratio(prose.prose(words), x) >= 0.8 for x in titles):
            row = f'<tr><th colspan="{width}">{words}</th></tr>'
            rest = got[m.end() :]
            head = re.match(r"(?is)\s*<thead\b[^>]*>", rest)
            end = m.end() + (head.end() if head else 0)
            out += [before[: node.start(1)], got[m.start() : end], row]
            at = end
        else:
            out += [before, m[0]]
            at = m.end()
    return "".join(out) + got[at:]


# --- cells -----------------------------------------------------------------------------------------------------------------------------------------


def aligned_grids(true: str, got: str) -> list[tuple[list[list[str]], list[list[str]]]]:
    """Each true grid with the predicted cells that stand for its own, by the pairing and the alignment of rows and columns; blank where none does."""
    ours, theirs = grids.html_tables(true), grids.html_tables(got)
    partner, all_ = metrics.paired(ours, theirs)
    out = []
    for i, j in enumerate(partner):
        a = ours[i].matrix()
        b = theirs[j].matrix() if j is not None else []
        rows, cols = (dict(all_[i, j]["rows"]), dict(all_[i, j]["cols"])) if j is not None else ({}, {})
        pick = lambda r, c, b=b, rows=rows, cols=cols: b[rows[r]][cols.get(c, c)] if r in rows and cols.get(c, c) < len(b[rows[r]]) else ""
        out.append((a, [[pick(r, c) for c in range(len(row))] for r, row in enumerate(a)] if rows or cols else b))
    return out


def _at(grid: list[list[str]], r: int, c: int) -> str | None:
    return grid[r][c] if r < len(grid) and c < len(grid[r]) else None


def is_null(s: str | None) -> bool:
    return s is None or canon.canonical(s).casefold() in text.NULL_FORMS


def cell_reports(pairs: list[tuple]) -> dict[str, float | None]:
    """Coverage, numeric exactness and null correctness over all cells of pairs of grids."""
    n: Counter = Counter()
    for a, b in pairs:
        for r, row in enumerate(a):
            for c, x in enumerate(row):
                y = _at(b, r, c)
                p, q = canon.canonical(x), canon.canonical(y)
                n["cells"] += bool(p)
                n["covered"] += bool(p and q)
                n[(is_null(x), is_null(y))] += 1
                if p not in ("", "-") and canon.amount(x) is not None:
                    u, v = (re.sub("[^0-9-]", "", s) for s in (p, q))
                    n["numeric"] += 1
                    n["exact"] += bool(u) and u == v
                    n["edits"] += prose.edit_distance(u, v)
                    n["digits"] += len(u)
    share = lambda x, y: x / y if y else 0.0
    kept, made, lost, value = (n[k] for k in ((True, True), (True, False), (False, True), (False, False)))
    return {
        "coverage": share(n["covered"], n["cells"]), "numeric_exact": share(n["exact"], n["numeric"]), "digit_cer": share(n["edits"], n["digits"]),
        "null_accuracy": share(kept, kept + made + lost), "null_fabricated": share(made, kept + made), "null_dropped": share(lost, lost + value), "null_judged": float(kept + made + lost),
    }


def place(ref: str) -> tuple[int, int, int]:
    m = re.fullmatch(r"t(\d+)\.r(\d+)\.c(\d+)", ref)
    if not m:
        raise ValueError(f"{ref!r} is not of the form t<table>.r<row>.c<column>")
    return tuple(map(int, m.groups()))


def arithmetic(relations: list[dict], found: list[tuple], pairs: list[tuple]) -> dict[str, float | None]:
    """Relations between predicted values at the places of the truth's: a total and its addends, exactly. A value that is not there leaves a relation unevaluated."""

    def value(ref: str) -> str | None:
        t, r, c = place(str(ref))
        if t >= len(found) or t >= len(pairs) or r not in found[t][0] or c not in found[t][1]:
            return None
        return _at(pairs[t][1], found[t][0][r], found[t][1][c])

    n: Counter = Counter(declared=len(relations))
    for rel in relations:
        stated = value(rel["total"])
        total = canon.amount(stated) if stated is not None else None
        raw = [value(a) for a in rel["addends"]]
        amounts = [None if v is None else canon.amount(v) for v in raw]
        if total is not None and None not in amounts:
            n["evaluable"] += 1
            n["reconciling"] += sum(amounts) == total
    return {
        "arithmetic_declared": float(n["declared"]), "arithmetic_evaluable": float(n["evaluable"]), "arithmetic_reconciling": float(n["reconciling"]),
        "arithmetic_consistency": n["reconciling"] / n["declared"] if n["declared"] else None,
    }


def block_sums(name: str, table: int, total_row: int, addend_rows: list[int], columns: list[int]) -> list[dict]:
    """A relation for each column: one row is the sum of others."""
    ref = lambda r, c: f"t{table}.r{r}.c{c}"
    return [{"name": f"{name}_c{c}", "math_type": "block_sum", "total": ref(total_row, c), "addends": [ref(r, c) for r in addend_rows]} for c in columns]


def across_sums(name: str, table: int, rows: list[int], total_col: int, part_cols: list[int]) -> list[dict]:
    """A relation for each row: one column is the sum of others."""
    ref = lambda r, c: f"t{table}.r{r}.c{c}"
    return [{"name": f"{name}_r{r}", "math_type": "block_sum", "total": ref(r, total_col), "addends": [ref(r, c) for c in part_cols]} for r in rows]


def fidelity(true: str, got: str) -> float | None:
    """The share of the prediction's digit runs in the commonest script of the truth's; of equals the first by name."""

    def scripts(s: str) -> list[str]:
        runs = re.findall(f"[0-9{text.ARABIC_INDIC}{text.EXTENDED_INDIC}]+", re.sub("<[^>]*>", " ", s or ""))
        return [("western" if r.isascii() else "mixed" if re.search("[0-9]", r) else "arabic-indic") for r in runs]

    a, b = scripts(true), scripts(got)
    if not a or not b:
        return None
    n = Counter(a)
    mode = min(n, key=lambda k: (-n[k], k))
    return b.count(mode) / len(b)


# --- documents -----------------------------------------------------------------------------------------------------------------------------------------


def score(true: str, got: str | None, relations: list[dict] | None = None, letters: bool = False, source: str = "document") -> list[tuple[str, str, float | None]]:
    """(pass, metric, value) of a document; metrics that no pass has come under ``document``."""
    assert_clean(true, f"ground truth: {source}")
    if not (got or "").strip():
        return [(p, m, 0.0) for p in PASSES for m in HEADLINE] + [("document", "empty_prediction", 1.0)]
    assert_clean(got, f"prediction: {source}")
    (a, _), (b, _) = canon.markup_traced(true, letters), canon.markup_traced(got, letters)
    sides = {"raw": (true, got), "text": (a, b), "struct": (canon.structure(a)[0], canon.structure(b)[0])}
    out: list[tuple[str, str, float | None]] = []
    for name, (x, y) in sides.items():
        out += [(name, k, float(v)) for k, v in metrics.page_scores(x, with_titles(x, y)).items()]
    x, y = sides["struct"]
    pairs = aligned_grids(x, with_titles(x, y))
    more = {"script_fidelity": fidelity(true, got), "empty_prediction": 0.0} | cell_reports(pairs)
    if relations:
        more |= arithmetic(relations, canon.maps(a), pairs)
    return out + [("document", k, v) for k, v in more.items()]


def document_scores(pages: DataFrame, key: str, true: str = "expected", got: str = "actual", relations: str | None = None, letters: bool = False) -> DataFrame:
    """key, pass, metric, value for each row of ``pages``; ``relations``: a column with a JSON list. A document whose encoding is broken has an error in place of scores."""
    at = pages.select(key, F.col(true).alias("_true"), F.col(got).alias("_got"), (F.col(relations) if relations else F.lit(None).cast("string")).alias("_relations"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, rows = [], []
            for i, (x, y, r) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_true", "_got", "_relations")), strict=True)):
                try:
                    found = [(*s, None) for s in score(x or "", y, json.loads(r) if r else None, letters)]
                except (MojibakeError, ValueError) as e:
                    found = [("document", "error", None, str(e))]
                owners += [i] * len(found)
                rows += found
            keys = b.column(key).take(pa.array(owners, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.string()))]], names=[key, "pass", "metric", "value", "error"])

    return at.mapInArrow(work, f"{key} {at.schema[key].dataType.simpleString()}, pass string, metric string, value double, error string")


def stored(scores: DataFrame, key: str, system: str, version: str = text.CANON_VERSION) -> DataFrame:
    """One record a document for the score log: passes as JSON, the document's own metrics as columns, status failed where the prediction was blank."""
    own = ("script_fidelity", "coverage", "numeric_exact", "digit_cer", "null_accuracy", "null_fabricated", "null_dropped", "null_judged", "arithmetic_consistency", "arithmetic_declared", "arithmetic_evaluable", "arithmetic_reconciling")
    one = lambda m: F.max(F.when((F.col("pass") == "document") & (F.col("metric") == m), F.col("value")))
    entry = F.struct("metric", F.round("value", 6).alias("value"))
    by_pass = [F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("pass") == p, entry)))).alias(p) for p in PASSES]
    t = scores.groupBy(key).agg(*by_pass, *[one(m).alias(m) for m in own], one("empty_prediction").alias("_empty"))
    status = F.when(F.col("_empty") == 1, "failed").otherwise("api")
    return t.select(F.lit(system).alias("system"), key, F.lit(version).alias("canon_version"), F.to_json(F.struct(*PASSES)).alias("passes"), *own, status.alias("status"))
