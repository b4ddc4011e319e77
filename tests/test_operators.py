from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import geometry, numbers, text
from scoreloom.operators import align, confidence, evidence, gates, jsontree, rules, tables
from scoreloom.sources import adapters, cases
from scoreloom.streaming import score_stream


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "want"), [
    ("١٢٣٫٥", "123.5"), ("(1,000)", "-1,000"), ("a ,b ( c )", "a,b (c)"), ("2024 م", "2024م"), ("a‏b", "ab"), ("ﬁ", "fi"), ("كتـاب", "كتاب"), ("", ""), (None, None),
])
def test_canonical(spark, raw, want):
    assert one(spark, raw, text.canonical) == want


def test_trace_names_what_fired(spark):
    assert one(spark, "(١)", lambda c: text.traced(c)[1]) == ["text/fold_numerals", "text/fold_paren_negatives"]


@pytest.mark.parametrize(("raw", "want"), [("1,234.50", "1234.5"), ("12", "12"), ("1,5", "1.5"), ("1,2345", "1.2345"), ("-", "0"), ("", "0"), ("1,234", "1234"), ("n.a.", None), ("1.2.3", None), ("-7", "-7")])
def test_parse_amount(spark, raw, want):
    got = one(spark, raw, numbers.parse_amount)
    assert got == (None if want is None else Decimal(want))


def test_null_forms_do_not_hold_zero(spark):
    got = spark.createDataFrame([("0",), ("N/A",), (" - ",), (None,), ("x",)], "x string").select(text.is_null_form(F.col("x"))).collect()
    assert [r[0] for r in got] == [False, True, True, True, False]


def test_tables_with_spans_nesting_and_pipes(spark):
    markup = "<table><tr><th colspan=2>h</th></tr><tr><td rowspan=2>a</td><td>b<table><tr><td>in</td></tr></table></td></tr><tr><td>c</td></tr></table>\n| x | y |\n|---|---|\n| 1 | 2 |\n"
    got = {(r.tbl, r.row, r.col): r.text for r in tables.cells(spark.createDataFrame([(1, markup), (2, None)], "doc int, m string"), "doc", "m").collect()}
    assert got == {(0, 0, 0): "h", (0, 0, 1): "h", (0, 1, 0): "a", (0, 1, 1): "bin", (0, 2, 0): "a", (0, 2, 1): "c", (1, 0, 0): "x", (1, 0, 1): "y", (1, 1, 0): "1", (1, 1, 1): "2"}


def test_sections_go_unless_nothing_is_left(spark):
    grid = [(1, 0, 0, "title"), (1, 0, 1, ""), (1, 1, 0, "a"), (1, 1, 1, "1"), (2, 0, 0, "only"), (2, 0, 1, "")]
    out = tables.without_sections(spark.createDataFrame(grid, "tbl int, row int, col int, text string"), ["tbl"])
    assert {(r.tbl, r.row) for r in out.collect()} == {(1, 1), (2, 0)}


def test_relations_tell_missing_from_nil(spark):
    terms = [("ok", "total", "3"), ("ok", "addend", "1"), ("ok", "addend", "2"), ("off", "total", "4"), ("off", "addend", "3"), ("gap", "total", "1"), ("gap", "addend", None), ("nil", "total", "0"), ("nil", "addend", "0")]
    df = spark.createDataFrame(terms, "name string, role string, a string").withColumn("amount", F.col("a").cast(numbers.AMOUNT))
    got = {r.name: (r.evaluable, r.reconciles, r.all_nil) for r in tables.relations(df, ["name"]).collect()}
    assert got == {"ok": (True, True, False), "off": (True, False, False), "gap": (False, False, False), "nil": (True, True, True)}


def test_auc_with_ties_and_one_kind(spark):
    auc = lambda rows: confidence.roc_auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first().auc
    assert auc([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)]) == 0.875 and auc([(0.1, 1), (0.2, 1)]) is None


def test_leaves_and_subset(spark):
    docs = spark.createDataFrame([(1, '{"a":[{"b":1},{"b":"x"}],"c":null}'), (2, "no json"), (3, None)], "id int, j string")
    got = {(r.path, r.pattern, r.kind, r.value) for r in jsontree.leaves(docs, "id", "j").collect() if r.id == 1}
    assert got == {("a[0].b", "a[*].b", "number", "1"), ("a[1].b", "a[*].b", "string", "x"), ("c", "c", "null", "null")}


def test_peel_pairs_duplicates_once(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, "y")], "g int, row int, v string")
    b = spark.createDataFrame([(1, 7, "x"), (1, 8, "z")], "g int, row int, v string")
    assert [(r.true_row, r.predicted_row) for r in align.peel(a, b, "g", "row", ["v"]).collect()] == [(1, 7)]
    full = {(r.true_row, r.predicted_row) for r in align.assign(a, b, "g", "row", ["v"]).collect()}
    assert (1, 7) in full and len(full) == 2


def test_assignment_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(align, "MOST_CELLS", 4)
    a = [(1, i, f"p{i}", f"s{i}") for i in range(6)] + [(2, i, "p", f"s{i}") for i in range(3)]
    b = [(1, i + 10, f"p{i}" if i < 4 else f"q{i}", f"r{i}") for i in range(6)] + [(2, i + 10, "p", f"r{i}") for i in range(3)]
    a, b = (spark.createDataFrame(x, "g int, row int, p string, s string") for x in (a, b))
    out = align.assign(a, b, "g", "row", ["p", "s"]).collect()
    assert sorted((r.true_row, r.predicted_row, r.n_same, r.complete) for r in out if r.g == 1) == [(i, i + 10, int(i < 4), True) for i in range(6)]
    assert sorted((r.true_row or 0, r.predicted_row or 0) for r in out if r.g == 2 and not r.complete) == [(0, 0), (0, 10), (0, 11), (0, 12), (1, 0), (2, 0)]
    assert sum(r.g == 2 for r in out) == 6


def test_sentences_merge_short_chunks(spark):
    assert one(spark, "Hi. This is a longer sentence. No.", rules.sentences) == ["Hi This is a longer sentence No"]


def test_iou_and_rotation(spark):
    row = spark.range(1).select(geometry.iou(tuple(F.lit(float(v)) for v in (0, 0, 2, 2)), tuple(F.lit(float(v)) for v in (1, 1, 3, 3))).alias("i"), geometry.corners(*[F.lit(float(v)) for v in (0, 0, 2, 2, 90)])[0].alias("p")).first()
    assert row.i == pytest.approx(1 / 7) and row.p == pytest.approx([2, 0])


def test_gates(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    later = spark.createDataFrame([(1, "a"), (3, "c")], "id int, t string")
    state = {r.id: r.state for r in gates.thawed(gates.freeze(rows, "id", "t"), gates.freeze(later, "id", "t"), "id").collect()}
    assert state == {2: "gone", 3: "new"}


def test_sources_and_log(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"pdf":"d","page":1,"category":"c","id":"1","type":"t","verified":true,"rule":"\\"{\\\\\\"k\\\\\\":1}\\""}\n{"pdf":"d","page":2,"category":"c","id":"2","type":"t","verified":false,"rule":"{}"}\n')
    (case,) = cases.cases(spark, str(tmp_path / "r.jsonl")).collect()
    assert [(r.id, r.rule) for r in case.rules] == [("1", '{"k":1}')]
    (tmp_path / "a.test.json").write_text("{}")
    assert cases.sidecars(spark, str(tmp_path)).first().document == "a"
    score = spark.createDataFrame([(1, "s", "d", "1", None, "m", "raw", 0.5, "ok")], cases.SCORE)
    for _ in range(2):
        cases.append_scores(score, str(tmp_path / "log"))
    assert cases.score_log(spark, str(tmp_path / "log")).count() == 2
    assert "| s | d |" in cases.to_markdown(score.select("system", "document"))


def test_streaming_append_is_exactly_once(spark, tmp_path):
    cases.append_scores(spark.createDataFrame([(1, "s", "d", "1", None, "m", "raw", 0.5, "ok")] * 2, cases.SCORE), str(tmp_path / "in"))
    for _ in range(2):
        score_stream.append_log(score_stream.scores(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


@pytest.mark.parametrize(("kind", "a", "b", "want"), [
    ("number", "$1,000.00", "1000", True), ("number", "1", "2", False), ("date", "2024-03-01", "01/03/2024", True), ("phone", "+1 (212) 555-1234", "212.555.1234", True),
    ("boolean", "Yes", "true", True), ("boolean", "no", "true", False), ("exact", None, " ", True), ("exact", "a", None, False), ("substring", "ab", "xaby", True),
])
def test_evidence(spark, kind, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(evidence.compare(kind, F.col("a"), F.col("b"))).first()[0] is want


def test_schema_with_references():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"$ref": "#/defs/n"}, "b": {"type": "array", "items": {"anyOf": [{"type": "string"}, {"type": "null"}]}}}, "defs": {"n": {"type": ["number", "null"]}}}
    assert evidence.violations({"a": None, "b": ["x", None]}, schema) == []
    assert evidence.violations({"a": True, "b": [1]}, schema) == ["$.a: not number/null", "$.b[0]: none of anyOf"]
    assert evidence.violations({}, schema) == ["$.a: missing"]


def test_adapters_reach_one_form():
    flat = '{"analyzeResult":{"pages":[{"width":10,"height":20,"lines":[{"content":"t","polygon":[1,2,3,2,3,4,1,4]}]}]}}'
    assert list(adapters.layout(flat, adapters.SPECS["document_intelligence"])) == [(1, 0, None, "t", None, 0.1, 0.1, 0.3, 0.2)]
    points = '{"document":{"pages":[{"blocks":[]},{"blocks":[{"type":"p","text":"u","layout":{"confidence":0.5,"boundingPoly":{"normalizedVertices":[{"x":0.1,"y":0.2},{"x":0.3,"y":0.4}]}}}]}]}}'
    assert list(adapters.layout(points, adapters.SPECS["document_ai"])) == [(2, 0, "p", "u", 0.5, 0.1, 0.2, 0.3, 0.4)]
    elements = '[{"type":"Title","text":"v","metadata":{"page_number":3,"coordinates":{"points":[[0,0],[0,5],[10,5],[10,0]],"layout_width":100,"layout_height":50}}},{"type":"x"}]'
    assert list(adapters.layout(elements, adapters.SPECS["unstructured"])) == [(3, 0, "Title", "v", None, 0, 0, 0.1, 0.1)]
    assert list(adapters.layout("no", adapters.SPECS["boxes"])) == [] == list(adapters.layout(None, adapters.SPECS["boxes"]))
