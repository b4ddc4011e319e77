"""Stated cases of what works on JSON documents: paths, boxes, extraction, attribution, governance, runs; and of results by provider."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, jsonpaths
from ..functions.udfs import vectorised
from ..operators import align, attribution, extraction, governance, layout, parse_grounding, parse_score, registry, rules, runs
from ..sources import adapters
from ..sources import cases as sources
from .cases import ORACLES, QUERIES, cases, table

__all__ = ["ORACLES", "QUERIES"]


def plain(v):
    """A value as JSON has it, numbers to six places."""
    if isinstance(v, bool) or v is None or isinstance(v, (str, int)):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in sorted(v.items(), key=lambda kv: str(kv[0]))}
    if isinstance(v, (list, tuple, set)):
        return [plain(x) for x in (sorted(v) if isinstance(v, set) else v)]
    return str(v)


def outcome(f: Callable, args: list) -> str:
    try:
        return json.dumps(plain(f(*args)), ensure_ascii=False)
    except (ValueError, TypeError, KeyError) as e:
        return f"{type(e).__name__}: {e}"


def stated(name: str, ops: dict[str, Callable], rows: list[tuple]):
    """Registers a query over (op, arguments, outcome): each op is applied to its arguments."""

    def run(spark):
        given = table(spark, [(i, op, json.dumps(args, ensure_ascii=False)) for i, (op, args, _) in enumerate(rows)], "case_id bigint, op string, args string")
        apply = vectorised(lambda op, args: outcome(ops[op], json.loads(args)), "string")
        return given.select("case_id", "op", apply("op", "args").alias("outcome"))

    run.__name__, run.__doc__ = name, f"Cases of {', '.join(ops)}."
    wanted = [(i, op, out if isinstance(out, str) and out.startswith(("ValueError", "TypeError", "KeyError", "AdmissionError", "CorrectionError", "SeedError", "UnknownLabelError")) else json.dumps(plain(out), ensure_ascii=False)) for i, (op, _, out) in enumerate(rows)]
    cases("case_id bigint, op string, outcome string", wanted)(run)


# --- paths ------------------------------------------------------------------------------------------------------------------------------------------------------


def _put(target, path, value):
    jsonpaths.put(target, jsonpaths.tokens(path), value)
    return target


DOC = {"name": "Ann", "rows": [{"id": 1, "v": "x"}, {"id": 2, "v": None}], "empty": {}}
SCHEMA = {"properties": {"name": {"type": ["null", "string"]}, "rows": {"type": "array", "items": {"$ref": "#/$defs/row"}}, "n": {"anyOf": [{"type": "number"}, {"type": "null"}]}}, "$defs": {"row": {"type": "object", "properties": {"id": {"type": "integer"}, "v": {"type": "string"}}}}}

stated("json_path_cases", {
    "tokens": jsonpaths.tokens, "format": jsonpaths.formatted, "get": lambda d, p: jsonpaths.get(d, jsonpaths.tokens(p), None), "put": _put, "leaves": lambda d: list(jsonpaths.leaves(d)), "arrays": lambda d: [p for p, _ in jsonpaths.arrays(d)],
    "pattern": jsonpaths.pattern, "matching": lambda d, p: list(jsonpaths.matching(d, jsonpaths.pattern(p))), "dotted": jsonpaths.dotted, "inflated": jsonpaths.inflated, "drift": jsonpaths.drift, "rule_id": lambda a, b: jsonpaths.rule_id(a) == jsonpaths.rule_id(b),
    "projected": lambda d, ps, rules: jsonpaths.projected(d, [tuple(p.split(".")) for p in ps], jsonpaths.identity_keys(rules)), "listed": jsonpaths.listed, "lifted": jsonpaths.lifted, "claims": jsonpaths.claims_alike, "schema_type": jsonpaths.schema_type,
    "subset": lambda t, g, kw: jsonpaths.subset_score(t, g, {("rows",): kw["keys"]} if "keys" in kw else None, kw.get("schema"), kw.get("weighted", True)), "records": lambda t, g, s: dict(jsonpaths.record_counts(t, g, s) or {}),
}, [
    ("tokens", ["a.b[2].c"], ["a", "b", 2, "c"]), ("tokens", [""], "ValueError: a path is not empty"), ("format", [["a", 0, "b", 3, 4]], "a[0].b[3][4]"), ("get", [DOC, "rows[1].id"], 2), ("get", [DOC, "rows[7].id"], None),
    ("put", [{}, "a.b[1].c", 5], {"a": {"b": [None, {"c": 5}]}}), ("put", [{"a": 3}, "a.b", 1], "TypeError: a cannot hold 'b'"), ("leaves", [DOC], [["name", "Ann"], ["rows[0].id", 1], ["rows[0].v", "x"], ["rows[1].id", 2], ["rows[1].v", None]]),
    ("arrays", [{"a": [[1], [2]], "b": 3}], ["a", "a[0]", "a[1]"]), ("pattern", ["a[3].b"], ["a", None, "b"]), ("matching", [DOC, "rows[0].v"], [["rows[0].v", "x"], ["rows[1].v", None]]), ("dotted", [DOC, "rows.1.id"], 2), ("dotted", [DOC, "rows.9.id"], None),
    ("inflated", [[{"field_path": "a[1]", "expected_value": 7}, {"field_path": "b", "expected_value": None}, {"field_path": "b", "expected_value": "x"}, {"field_path": "b", "expected_value": "y"}]], {"a": [None, 7], "b": "x"}),
    ("drift", [{"a": 1, "b": [1, 2]}, {"a": 2, "b": [1], "c": 3}], ["a: value mismatch (1 vs 2)", "b[1]: missing in expected_output", "c: missing in rules-derived"]), ("drift", [{"a": 1}, {"a": "1"}], ["a: type mismatch (int vs str)"]), ("drift", [DOC, DOC], []),
    ("rule_id", [{"id": "x", "page": 1, "a": 2, "b": 3}, {"b": 3, "a": 2, "page": 1}], True), ("rule_id", [{"page": 1, "a": 2}, {"page": 2, "a": 2}], False),
    ("projected", [DOC, ["rows.v"], [{"field_path": "rows", "structural": "match_by:id"}]], {"rows": [{"id": 1, "v": "x"}, {"id": 2, "v": None}]}), ("projected", [DOC, ["name"], []], {"name": "Ann"}),
    ("listed", [[{"x": 1}, {"x": 2}], [{"field_path": "rows[0].x"}, {"field_path": "total"}], None], [{"rows": [{"x": 1}, {"x": 2}]}, "bare_rows", ["total"]]), ("listed", [[{"NAME": "a"}], [{"field_path": "name"}], {"properties": {"name": {}}}], [{"name": "a"}, "singleton_doc", []]),
    ("listed", [[{"rows": [1], "a": ""}, {"rows": [2, None], "a": "x"}], [], None], [{"a": "x", "rows": [1, 2]}, "wrapper_merge", []]), ("listed", [{"a": 1}, [], None], [{"a": 1}, "no_op", []]),
    ("lifted", [{"p": [{"k": [{"z": 1}], "y": 2}]}, {"repeated_structure": {"k": {}}}], {"k": [{"z": 1}], "p": [{"y": 2}]}), ("claims", [{"claims": [{"a": 1}]}, {"payment_details": [{"claims": [{"a": 1}], "n": 2}]}], [{"claims": [{"a": 1}]}, {"claims": [{"a": 1}], "payment_details": [{"n": 2}]}]),
    ("claims", [{"payment_details": {"n": 1}}, {"payment_details": [{"n": 1}]}], [{"payment_details": [{"n": 1}]}, {"payment_details": [{"n": 1}]}]), ("schema_type", [SCHEMA, "rows[3].id", "x"], "number"), ("schema_type", [SCHEMA, "name", None], "string"), ("schema_type", [SCHEMA, "other", True], "boolean"),
    ("subset", [{"a": "abcd", "b": 10}, {"a": "abce", "b": 10, "c": 1}, {}], 0.875), ("subset", [{"a": 10}, {"a": 30}, {}], 0.5), ("subset", [{"rows": [{"id": 2, "v": "x"}, {"id": 1, "v": "y"}]}, {"rows": [{"id": 1, "v": "y"}, {"id": 2, "v": "z"}]}, {"keys": ["id"]}], 0.75),
    ("subset", [{"n": None}, {"n": 0}, {"schema": SCHEMA}], 1.0), ("subset", [{"n": None}, {"n": 0}, {}], 0.0), ("subset", [{"d": "03/04/2024"}, {"d": "2024-03-04"}, {}], 1.0), ("subset", [[], [1], {}], 1.0), ("subset", [[1], [], {}], 0.0), ("subset", [{"a": 1}, None, {}], 0.0), ("subset", [{"rendering_provider": {"rendering_provider_identification_number": "7"}}, {"rendering_provider": {"provider_npi": "7"}}, {}], 1.0),
    ("records", [{"rows": [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}], "name": "q"}, {"rows": [{"id": 2, "v": "b"}], "name": "q"}, SCHEMA], {"arrays": 1, "correct": 3, "expected": 5, "expected_rows": 2, "predicted": 3, "predicted_rows": 1}), ("records", [{"name": "q"}, {"name": "q"}, SCHEMA], {}),
])

# --- boxes ----------------------------------------------------------------------------------------------------------------------------------------------------------

_sets = lambda rows: [(s, tuple(b)) for s, b in rows]

stated("box_cases", {
    "iou": lambda a, b: boxes.iou_xywh(a, b), "ioa": boxes.ioa, "union_area": boxes.union_area, "union_iou": lambda a, b: boxes.union_iou(_sets(a), _sets(b)), "coverage": lambda a, b: boxes.coverage(_sets(a), _sets(b)), "located": boxes.located,
    "rotated": lambda p, *k: boxes.rotated(p, *k), "polygon": boxes.polygon, "holds": boxes.holds, "degrees": boxes.degrees, "intervals": attribution.interval_union, "band": lambda t, g: attribution.band(t, g),
}, [
    ("iou", [[0, 0, 2, 2], [1, 1, 2, 2]], 1 / 7), ("iou", [[0, 0, 1, 1], [2, 2, 1, 1]], 0.0), ("iou", [[0, 0, 0, 0], [0, 0, 0, 0]], 0.0), ("ioa", [[0, 0, 2, 2], [1, 0, 5, 5]], 0.5), ("union_area", [[[0, 0, 2, 2], [1, 1, 3, 3], [0, 0, 1, 1]]], 7.0), ("union_area", [[]], 0.0),
    ("union_iou", [[["a", [0, 0, 2, 1]]], [["a", [0, 0, 1, 1]], ["a", [0, 0, 1, 1]], ["b", [5, 5, 1, 1]]]], {"intersection": 1.0, "iou": 1 / 3, "max_ioa": 0.5, "union": 3.0}), ("coverage", [[["a", [0, 0, 4, 1]]], [["a", [0, 0, 1, 1]], ["a", [1, 0, 2, 1]]]], {"iou": 0.5, "recall": 0.75}),
    ("located", [0.5, 0.5, False], True), ("located", [0.35, 0.7, True], True), ("located", [0.35, 0.7, False], False), ("located", [0.0, 0.0, False, True], True), ("located", [0.29, 1.0, True], False),
    ("rotated", [[[0, 0], [4, 0], [4, 2], [0, 2]], 8, 4], [0.0, 0.0, 0.5, 0.5, 0.0]), ("rotated", [[4, 0, 4, 4, 2, 4, 2, 0], 1, 1, False], [1.0, 1.0, 4.0, 2.0, 90.0]), ("rotated", [[0, 0, 1, 1]], None), ("rotated", [[0, 0, 0, 0, 0, 0, 0, 0]], None),
    ("polygon", [0, 0, 4, 2, 90], [[3.0, -1.0], [3.0, 3.0], [1.0, 3.0], [1.0, -1.0]]), ("holds", [[0, 0, 4, 2], 0, [4, 2]], True), ("holds", [[0, 0, 4, 2], 90, [4, 1]], False), ("holds", [[0, 0, 4, 2], 90, [2, 2.9]], True), ("degrees", [190.0], -170.0), ("degrees", [180.0], -180.0),
    ("intervals", [[[0, 2], [1, 3], [5, 6], [4, 4]]], 4.0), ("band", [[0, 0, 10, 2], [[0, 0, 2, 2], [8, 0, 10, 1], [0, 3, 4, 9]]], {"n": 2.0, "x_fill": 0.4, "x_span": 1.0, "y": 1.0}), ("band", [[0, 0, 10, 2], [[0, 5, 2, 9]]], None),
])

# --- extraction -----------------------------------------------------------------------------------------------------------------------------------------------------


def _rule(path: str, value=None, **more) -> dict:
    return {"field_path": path, "expected_value": value, **more}


LINES = [_rule("rows[0].id", 1), _rule("rows[0].v", "x"), _rule("rows[1].id", 2), _rule("rows[1].v", "y")]
BOXED = [_rule("a", "x", bboxes=[{"page": 1, "bbox": [0, 0, 2, 2]}]), _rule("b", "y", bboxes=[{"page": 1, "bbox": [4, 0, 2, 2]}])]
LEAVES = [{"path": p, "expected_path": p, "confidence": c, "correct": ok} for p, c, ok in (("a", 0.9, True), ("b", 0.8, False), ("c", 0.7, True))]

stated("extraction_cases", {
    "array_rule": extraction.array_rule, "stray": extraction.is_stray, "values": lambda rules, got: extraction.value_scores(rules, got), "pass_rate": lambda rules, got: extraction.pass_rate(rules, got), "nulls": extraction.null_scores, "evidence": extraction.evidence_scores,
    "places": lambda rules, cites, got: extraction.place_scores(rules, cites, got), "rows": lambda rules, got: extraction.record_scores(rules, got), "aligned": extraction.aligned_rows, "composite": extraction.composite_pairs,
    "blocked": lambda a, b, names: [p[:2] for p in extraction.blocked_pairs(a, b, names)], "sparse": extraction.sparse_assignment, "align": extraction.align_array, "auc": extraction.auc, "confidence": lambda rows, t: extraction.confidence_summary(rows, t), "association": extraction.association,
}, [
    ("array_rule", [{"type": "array_length", "path": "a", "operator": "gte", "value": 2}, {"a": [1, 2]}], True), ("array_rule", [{"type": "array_length", "path": "a", "operator": "lt", "value": 2}, {"a": [1, 2]}], False), ("array_rule", [{"type": "array_length", "path": "a", "operator": "eq", "value": 0}, {}], False),
    ("array_rule", [{"type": "array_head", "path": "a", "count": 1, "expected": [1]}, {"a": [1, 2]}], True), ("array_rule", [{"type": "array_tail", "path": "a", "count": 1, "expected": [1]}, {"a": [1, 2]}], False), ("array_rule", [{"type": "odd", "path": "a"}, {}], "ValueError: unknown rule type: odd"),
    ("stray", [_rule("a", None)], True), ("stray", [_rule("a", "x", tags=["q:stray"])], True), ("stray", [_rule("a", "x")], False),
    ("values", [LINES, {"rows": [{"id": 2, "v": "y"}, {"id": 1, "v": "q"}, {"id": 9}]}], {"f1": 2 * (3 / 5) * (3 / 4) / (3 / 5 + 3 / 4), "precision": 3 / 5, "recall": 3 / 4}), ("values", [[], {"a": 1}], {}), ("pass_rate", [LINES, {"rows": [{"id": 1, "v": "x"}]}], {"extract_field_value_pass_rate": 0.5}),
    ("nulls", [[_rule("a", None), _rule("b", None), _rule("c", 1), _rule("d", None, verified=False)], {"a": 3, "d": 4}], {"null_hallucination_rate": 0.5}), ("evidence", [[_rule("a", None, evidence=[{"value": "x"}, {"value": "y"}]), _rule("b", None, evidence=[{"value": "z"}])], {"a": "y", "b": "q"}], {"evidence_pass_rate": 0.5}),
    ("places", [BOXED, [{"field_path": "a", "page": 1, "bbox": [0, 0, 2, 2]}, {"field_path": "b", "page": 2, "bbox": [4, 0, 2, 2]}], {"a": "x", "b": "q"}], {"bbox_recall": 0.5, "extract_attribution_pass_rate": 0.5, "extract_localization_pass_rate": 0.5, "extract_mean_iou": 0.5, "iou": 1 / 3}), ("places", [[_rule("a", 1)], [], {}], {}),
    ("rows", [LINES, {"rows": [{"id": 2, "v": "y"}, {"id": 1, "v": "q"}, {"id": 5, "v": "w"}]}], {"record_accuracy": 0.25, "record_f1": 0.4, "record_precision": 1 / 3, "record_recall": 0.5}),
    ("aligned", [LINES, _rule("rows", structural="match_by:id"), [{"id": 2}, {"id": 1}]], {0: 1, 1: 0}), ("composite", [[{"a": 1, "b": 2, "c": 3}, {"a": 1, "b": 5, "c": 6}], [{"a": 1, "b": 5, "c": 9}, {"a": 1, "b": 2, "c": 7}], ["a", "b", "c"]], {0: 1, 1: 0}),
    ("blocked", [[{"t": "red apple"}, {"t": "blue sky"}], [{"t": "blue skies"}, {"t": "red apples"}], ["t"]], [[0, 1], [1, 0]]), ("sparse", [[[0, 0, 0.9], [0, 1, 0.8], [1, 0, 0.7], [1, 1, 0.2]]], {0: 0, 1: 1}), ("align", [[{"k": 1, "v": "a"}, {"k": 2, "v": "b"}], [{"k": 2, "v": "q"}, {"k": 1, "v": "z"}], ["k"]], {0: 1, 1: 0}), ("align", [["x", "y"], ["y", "x"], None], {0: 1, 1: 0}),
    ("auc", [[True, False, True], [0.9, 0.5, 0.5]], 0.75), ("auc", [[True], [0.5]], None), ("association", [[], []], {"association_f1_applicable": 0.0}), ("association", [{"r": [{"a": 1, "b": 2}, {"a": 3, "b": 4}]}, {"r": [{"a": 1, "b": 2}, {"a": 3, "b": 5}]}], {"association_f1": 0.5, "association_f1_applicable": 1.0}),
    ("confidence", [LEAVES, {"a": 1, "b": 2, "c": 3, "d": 4}], {"confidence_full_gt_f1": 2 * (2 / 3) * 0.5 / (2 / 3 + 0.5), "confidence_full_gt_recall": 0.5, "confidence_scoped_accuracy": 2 / 3, "confidence_scoped_auc": 1 / 3 + 0.5 / 3 + 2 / 9, "confidence_scoped_coverage_at_precision": 1 / 3, "confidence_scoped_precision_at_coverage": 2 / 3, "confidence_scoped_roc_auc": 0.5}), ("confidence", [[], {}], {}),
])


EXTRACTED = [("good", {"rows": [{"id": 1, "v": "x"}, {"id": 2, "v": "y"}]}, {"rows": [{"id": 1, "v": "x"}, {"id": 2, "v": "y"}]}, LINES), ("half", {"rows": [{"id": 1, "v": "x"}, {"id": 2, "v": "y"}]}, {"rows": [{"id": 1, "v": "x"}]}, LINES), ("bad", {"a": 1}, None, [])]


@cases("doc string, metric string, value double", [
    ("good", "accuracy", 1.0), ("good", "extract_field_value_pass_rate", 1.0), ("good", "f1", 1.0), ("good", "record_accuracy", 1.0), ("good", "association_f1", 1.0), ("half", "accuracy", 0.5), ("half", "extract_field_value_pass_rate", 0.5), ("half", "f1", 0.666667), ("half", "record_accuracy", 0.5), ("half", "association_f1", 0.666667), ("bad", "accuracy", 0.0),
])
def extraction_score_cases(spark):
    """Chosen metrics of whole documents."""
    rows = [(d, json.dumps(t), json.dumps(g), json.dumps(r)) for d, t, g, r in EXTRACTED]
    found = extraction.document_scores(table(spark, rows, "doc string, expected string, actual string, rules string"), "doc")
    return found.where(F.col("metric").isin("accuracy", "extract_field_value_pass_rate", "f1", "record_accuracy", "association_f1")).select("doc", "metric", F.round("value", 6).alias("value"))


UNITS = [{"kind": "word", "page": 1, "text": w, "box": [x, 0.1, 0.1, 0.1], "order": i} for i, (w, x) in enumerate([("Ann", 0.1), ("Smith", 0.2), ("total", 0.5), ("42", 0.7)])] + [{"kind": "line", "page": 1, "text": "Ann Smith total 42", "box": [0.1, 0.1, 0.7, 0.1], "order": 0}]
FIELDS = [_rule("name", "Ann Smith", bboxes=[{"page": 1, "bbox": [0.1, 0.1, 0.2, 0.1]}]), _rule("total", 42, bboxes=[{"page": 1, "bbox": [0.5, 0.1, 0.1, 0.1]}]), _rule("other", "zz", bboxes=[{"page": 2, "bbox": [0.1, 0.1, 0.1, 0.1]}])]


@cases("doc string, metric string, value double", [
    ("d", "extract_field_element_pass_rate", 0.333333), ("d", "extract_field_rule_pass_rate", 0.666667), ("d", "extract_field_localization_pass_rate", 0.666667), ("d", "extract_field_classification_pass_rate", 1.0), ("d", "extract_field_attribution_pass_rate", 0.333333), ("d", "extract_field_avg_iou", 0.666667),
    ("d", "extract_field_avg_iou_matched", 1.0), ("d", "extract_field_avg_iou_unmatched", 0.0), ("d", "extract_field_gt_count", 3.0), ("d", "extract_field_iou", 0.75), ("d", "extract_field_bbox_recall", 0.75), ("d", "extract_field_text_similarity", 1.0),
])
def parse_grounding_cases(spark):
    """A value said by two words where it stands, one said elsewhere on its page, one on a page without words."""
    t = table(spark, [("d", json.dumps(FIELDS), json.dumps(UNITS))], "doc string, rules string, units string")
    return parse_grounding.document_scores(t, "doc").select("doc", "metric", F.round("value", 6).alias("value"))


# --- attribution ----------------------------------------------------------------------------------------------------------------------------------------------------


def _element(box, text, cls="Text", **attributes) -> dict:
    return {"box": box, "text": text, "cls": cls, "attributes": attributes}


def _block(box, text, **more) -> dict:
    return {"box": box, "text": text, "label": "Text", **more}


PAGE = [_element([0, 0, 10, 2], "the red fox"), _element([0, 3, 10, 5], "a blue sky", "Title"), _element([0, 6, 10, 8], "e = m", "Formula")]
FOUND = [_block([0, 0, 10, 2], "the red dog"), _block([0, 3, 10, 5], "a blue sky"), _block([0, 20, 5, 25], "elsewhere")]
_page = lambda f: lambda e, b: f(attribution.Page(e, b))

stated("attribution_cases", {
    "clean": attribution.clean, "tokens": attribution.tokens, "eligible": attribution.eligible, "shares": attribution.shares, "left_over": attribution.left_over, "sample": attribution.sample, "precision": _page(lambda p: p.precision()), "recall": _page(lambda p: p.recall()), "grounded": _page(lambda p: p.grounded()),
    "order": _page(lambda p: p.order()), "supports": _page(lambda p: [k for k, _, _ in p.supports()]), "own_tokens": _page(lambda p: p.own_tokens(0, 0)), "token_f1": attribution.token_f1, "answer": attribution.answer_matches, "anls": attribution.anls,
}, [
    ("clean", ["The **Café** co-\noperates, [here](http://x)"], "the cafe cooperates, here"), ("clean", ["costs $5 and $x^{2}$ more"], "costs 5 and x more"), ("clean", [None], ""), ("tokens", ["A-1 b_c ﬁne"], ["a", "1", "b", "fine"]), ("eligible", [_element([0, 0, 1, 1], "", ignore="Yes")], False), ("eligible", [_element([0, 0, 1, 1], "", text_role="formula")], False), ("eligible", [_element([0, 0, 1, 1], "", caption="no")], True),
    ("shares", [[[0, 0, 2, 2]], [[0, 0, 1, 1], [1, 0, 3, 2]]], [[1.0, 0.5]]), ("left_over", [["a", "a", "b"], ["a", "c"]], ["a", "b"]), ("sample", [["a", "b", "b", "c"], ["a"], 2], ["b", "c"]), ("precision", [PAGE, FOUND], [5 / 7, {"Text": 2 / 3, "Title": 1.0}]), ("precision", [PAGE, []], [1.0, {}]), ("recall", [PAGE, FOUND], [5 / 6, {"Text": 2 / 3, "Title": 1.0}]), ("recall", [[], FOUND], [1.0, {}]),
    ("grounded", [PAGE, FOUND], [0.5, {"Text": 0.0, "Title": 1.0}]), ("grounded", [[], []], [1.0, {}]), ("order", [PAGE, FOUND], [1.0, 1.0]), ("order", [PAGE, FOUND[1::-1]], [0.0, 0.0]), ("order", [PAGE[:1], FOUND], [1.0, 1.0]), ("supports", [PAGE, FOUND], ["unsupported_fp", "supported_tp", "spatial_fp"]), ("supports", [PAGE, [FOUND[1], FOUND[1]]], ["supported_tp", "redundant_fp"]),
    ("supports", [[_element([0, 0, 4, 4], "x y", explicit="true")], [_block([0, 0, 4, 4], "x y")]], []), ("own_tokens", [[_element([0, 0, 4, 2], "a b"), _element([0, 2, 4, 4], "b c c")], [_block([0, 0, 4, 4], "a b b c c d")]], ["a", "b", "b", "d"]), ("token_f1", [["a", "b"], ["b", "b"]], 0.5), ("token_f1", [[], []], 1.0),
    ("answer", ["single_choice", "**B**", "b"], True), ("answer", ["multiple_choice", "A, C", "CA"], True), ("answer", ["multiple_choice", "A", "CA"], False), ("answer", ["numerical", "about $\\boxed{1,234.5}$", "1234.4", 0.2], True), ("answer", ["numerical", "none", "3"], False), ("answer", ["free_text", "red, Blue", "blue, red"], True), ("answer", ["free_text", "red", "blue"], False), ("answer", ["essay", "x", "x"], False), ("anls", [["hello", "zzz"], ["hallo", "abc"]], 0.4), ("anls", [[], []], 1.0),
])


@cases("page string, metric string, value double", [
    ("p", "lap", 0.714286), ("p", "lar", 0.833333), ("p", "af1", 0.769231), ("p", "grounding_accuracy", 0.5), ("p", "order_adjacent_accuracy", 1.0), ("p", "order_pairwise_accuracy", 1.0), ("p", "grounding_spatial_fp_rate", 0.333333), ("p", "grounding_unsupported_block_rate", 0.333333),
    ("p", "grounding_redundant_block_rate", 0.0), ("p", "grounding_supported_block_precision", 0.333333), ("p", "grounding_overclaim_rate", 0.0), ("p", "af1_Text", 0.666667), ("p", "af1_Title", 1.0),
])
def attribution_score_cases(spark):
    """All metrics of a page."""
    found = attribution.page_scores(table(spark, [("p", json.dumps(PAGE), json.dumps(FOUND))], "page string, elements string, blocks string"), "page")
    return found.select("page", "metric", F.round("value", 6).alias("value"))


# --- scores of parsed pages -----------------------------------------------------------------------------------------------------------------------------------------

VERDICTS = [("d", k, s) for k, s in (("is_bold", 1.0), ("is_bold", 0.0), ("is_not_bold", 1.0), ("order", 1.0), ("order", 0.5), ("missing_word_percent", 0.8), ("extra_content", 0.4), ("is_title", None))]


@cases("doc string, metric string, value double", [
    ("d", "rule_is_bold_score", 0.5), ("d", "rule_is_not_bold_score", 1.0), ("d", "rule_order_score", 0.75), ("d", "rule_missing_word_percent_score", 0.8), ("d", "rule_extra_content_score", 0.4), ("d", "rule_is_title_score", 0.0),
    ("d", "normalized_text_correctness", 0.6), ("d", "normalized_order", 0.75), ("d", "normalized_title_accuracy", 0.0), ("d", "normalized_text_styling", 0.555556), ("d", "normalized_text_score", 0.476389), ("d", "content_faithfulness", 0.65), ("d", "semantic_formatting", 0.277778),
])
def parse_score_cases(spark):
    """Means by type, categories and combinations of a page's rules."""
    return parse_score.scores(table(spark, VERDICTS, "doc string, kind string, score double"), "doc").select("doc", "metric", F.round("value", 6).alias("value"))


@cases("normalized_rotate double", [(0.75641,)])
def rotation_cases(spark):
    """Upright pages weigh ten times."""
    rows = [("0deg", True), ("90deg", True), ("90deg", False), ("180deg", True), ("270deg", False), ("0deg", True), ("0deg", True), ("0deg", True), ("0deg", True), ("0deg", False)]
    out = parse_score.rotation(table(spark, rows, "tag string, passed boolean"))
    return out.select(F.round("normalized_rotate", 6).alias("normalized_rotate"))


# --- governance -------------------------------------------------------------------------------------------------------------------------------------------------------

TRUE = {"lines": [{"text": "Report"}], "tables": [{"rows": [["Item", "Amount"], ["A", "10"], ["B", "1,005"], ["Total", "1015"]]}]}
SUM = {"name": "total", "total": "t0.r3.c1", "addends": ["t0.r1.c1", "t0.r2.c1"]}

stated("governance_cases", {
    "defects": governance.defects, "admission": lambda p, r: governance.verdict(json.dumps(p), json.dumps(r)), "unreconciled": governance.unreconciled, "gate": governance.gate, "corrected": lambda p, *a: governance.corrected(p, *a)["tables"][0]["rows"][1],
    "determinism": lambda outs: governance.determinism(iter(outs).__next__), "seeds": governance.check_seeds,
}, [
    ("defects", [TRUE], []), ("defects", [[1]], ["top level must be an object, got list"]), ("defects", [{"lines": [{"t": 1}], "tables": [{"rows": []}, {"rows": [["a", "b"], ["c"], 5, ["", " "]]}]}], ["lines[0] must be an object with a string 'text'", "tables[0] must have a non-empty 'rows' list", "tables[1].rows[2] must be a list of strings", "tables[1].rows[3] is blank", "tables[1] is ragged: row widths [1, 2]"]), ("defects", [{}], ["'lines' must be a list", "'tables' must be a list"]),
    ("admission", [TRUE, [SUM]], "admitted"), ("admission", [TRUE, []], "no arithmetic relations declared"), ("admission", [TRUE, [{**SUM, "addends": ["t0.r1.c1"]}]], "total: stated 1015 != computed 10"), ("admission", [TRUE, [{**SUM, "total": "t9.r0.c0"}]], "t9.r0.c0 is no cell"), ("admission", [TRUE, [{**SUM, "total": "t0.r0.c0"}]], "t0.r0.c0: 'Item' is no amount"), ("unreconciled", [TRUE, [SUM]], []),
    ("corrected", [TRUE, "t0.r1.c1", "10", "11"], ["A", "11"]), ("corrected", [TRUE, "t0.r1.c1", "9", "11"], "CorrectionError: t0.r1.c1: expected '9' but the cell holds '10'"), ("corrected", [TRUE, "t0.r1.c7", "9", "11"], "CorrectionError: t0.r1.c7: row has 2 columns"), ("corrected", [TRUE, "t3.r1.c7", "9", "11"], "CorrectionError: t3.r1.c7: no such cell"),
    ("determinism", [["a", "a"]], "verified"), ("determinism", [["a", "b"]], "nondeterministic"), ("seeds", ["nondeterministic", 3], None), ("seeds", ["nondeterministic", 2], "SeedError: nondeterministic systems need 3 seeds, not 2"), ("seeds", ["declared", 1], None), ("gate", [{"a": 1}, None], []),
])

WHOLE = {"adapter": "a1", "model_version": "1", "mode": "api", "canon_version": "1", "cost_per_page_usd": 0.1, "median_latency_ms": 5.0, "seed_count": 3, "run_timestamp": "2024", "page_image_hashes": ["x"], "prompt_sha256": "y", "determinism": "verified", "external_report": False, "hand_imported": False}
CANDIDATES = [("ok", {}), ("outside", {"external_report": True}), ("by hand", {"hand_imported": True}), ("no hashes", {"page_image_hashes": []}), ("no cost", {"cost_per_page_usd": None, "mode": ""}), ("unknown", {"adapter": "zz"}), ("one seed", {"determinism": "nondeterministic", "seed_count": 1})]


@cases("name string, rejected string", [("ok", "-"), ("outside", "externally reported"), ("by hand", "hand-imported"), ("no hashes", "missing: page_image_hashes"), ("no cost", "missing: mode, cost_per_page_usd"), ("unknown", "unknown adapter"), ("one seed", "too few seeds")])
def provenance_cases(spark):
    """Why rows may not stand on the board."""
    kinds = {"cost_per_page_usd": "double", "median_latency_ms": "double", "seed_count": "int", "page_image_hashes": "array<string>", "external_report": "boolean", "hand_imported": "boolean"}
    schema = "name string, " + ", ".join(f"{k} {kinds.get(k, 'string')}" for k in WHOLE)
    rows = [(n, *{**WHOLE, **change}.values()) for n, change in CANDIDATES]
    return governance.admission(table(spark, rows, schema), ["a1"]).select("name", F.coalesce("rejected", F.lit("-")).alias("rejected"))


@cases("doc string, name string, total string, addends string", [("d", "assets_c1", "t0.r3.c1", "t0.r1.c1 t0.r2.c1"), ("d", "assets_c2", "t0.r3.c2", "t0.r1.c2 t0.r2.c2"), ("d", "sum_r5", "t1.r5.c4", "t1.r5.c1 t1.r5.c2")])
def declared_sums(spark):
    """Sums of rows and of columns, one for each column or row that they hold for."""
    rows = [("d", "assets", 0, "block", 3, [1, 2], [1, 2]), ("d", "sum", 1, "across", 4, [1, 2], [5])]
    t = governance.declared(table(spark, rows, "doc string, name string, tbl int, kind string, total int, addends array<int>, along array<int>"))
    return t.withColumn("addends", F.array_join("addends", " "))


# --- runs -----------------------------------------------------------------------------------------------------------------------------------------------------------------

NAMES = ["doc1", "doc2.pdf", "grp/a", "grp/b", "x/y/doc3", "café"]
RESULTS = ["doc1", "doc1.pdf", "doc2.pdf", "grp", "doc3", "café", "none"]


@cases("mode string, example_id string, test_id string", [
    ("one", "doc1", "doc1"), ("one", "doc1.pdf", "doc1"), ("one", "doc2.pdf", "doc2.pdf"), ("one", "café", "café"), ("many", "doc1", "doc1"), ("many", "doc2.pdf", "doc2.pdf"), ("many", "grp", "grp/a"), ("many", "grp", "grp/b"), ("many", "café", "café"),
    ("suffix", "doc1", "doc1"), ("suffix", "doc2.pdf", "doc2.pdf"), ("suffix", "doc3", "x/y/doc3"), ("suffix", "café", "café"),
])
def case_match_modes(spark):
    """Cases of results by name, folder and path end."""
    r, c = table(spark, [(n,) for n in RESULTS], "example_id string"), table(spark, [(n,) for n in NAMES], "test_id string")
    out = None
    for mode in ("one", "many", "suffix"):
        part = runs.match(r, c, mode).select(F.lit(mode).alias("mode"), "example_id", "test_id")
        out = part if out is None else out.unionByName(part)
    return out


ERRORS = [("Worker error: x", "infra"), ("Evaluation error: got Foo, not LayoutOutput", "other"), ("Task execution error: y", "infra"), ("No layout data in result", "skipped"), ("bad json", "other"), (None, "other")]


@cases("id bigint, kind string", [(i, k) for i, (_, k) in enumerate(ERRORS)])
def failure_kinds(spark):
    """Kinds of failures."""
    t = table(spark, [(i, e) for i, (e, _) in enumerate(ERRORS)], "id bigint, error string")
    return t.select("id", F.when(runs.skipped(F.col("error")), "skipped").when(runs.infra_failure(F.col("error")), "infra").otherwise("other").alias("kind"))


@cases("rank int, name string, display_name string, avg double, min double, max double", [(1, "f1", "F1", 0.9, 0.5, 1.0), (2, "row_recall", "Row Recall", 0.4, 0.0, 0.0)])
def metric_records(spark):
    """Metrics with their average, least and greatest, best first."""
    rows = [("avg_f1", 0.9), ("min_f1", 0.5), ("max_f1", 1.0), ("avg_row_recall", 0.4), ("total", 3.0), ("avg_time", 9.0)]
    return runs.records(runs.grouped_aggregates(table(spark, rows, "name string, value double"), ["time"]))


SPENT = [("a", 1, True, 1.0, 0.5), ("a", 2, True, 9.0, 9.0), ("b", 1, False, 2.0, 2.0), ("c", 1, True, None, None), ("d", 1, None, 3.0, None)]


@cases("total_usd double, mean_per_page_usd double, mean_per_document_usd double, documents bigint, documents_without_cost bigint, text string", [(4.0, 0.5, 2.0, 2, 2, "$4.00 $0.5000 50.00¢ —")])
def cost_cases(spark):
    """Costs of documents over splits, as text too."""
    t = runs.costs(table(spark, SPENT, "test_id string, seq int, success boolean, cost_usd double, cost_per_page_usd double"))
    amounts = (runs.usd(F.col("total_usd")), runs.usd(F.col("mean_per_page_usd")), runs.usd(F.col("mean_per_page_usd"), True), runs.usd(F.lit(None).cast("double")))
    return t.withColumn("text", F.concat_ws(" ", *amounts))


@cases("system string, raw double, text double, struct double, status string", [("a", 0.5, -1.0, 0.75, "api"), ("b", -1.0, 0.25, -1.0, "externally reported"), ("c", 1.0, -1.0, -1.0, "hand-imported (dev only)")])
def dev_report_cases(spark):
    """A board for development names what keeps rows from the board."""
    rows = [("a", "raw", "m", 0.5, False, None), ("a", "struct", "m", 0.5, False, None), ("a", "struct", "m", 1.0, False, None), ("a", "raw", "other", 0.9, False, None), ("b", "text", "m", 0.25, True, None), ("c", "raw", "m", 1.0, False, True)]
    t = runs.dev_report(table(spark, rows, "system string, pass string, metric string, value double, external_report boolean, hand_imported boolean"), "m")
    return t.select("system", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("raw", "text", "struct")], "status")


# --- assignment and matching of rows ------------------------------------------------------------------------------------------------------------------------------------

ROWS_TRUE = [("g", 1, "a", "b", "c"), ("g", 2, "d", "e", "f"), ("g", 3, "x", "y", "z"), ("h", 1, "a", "a", "a")]
ROWS_SAID = [("g", 1, "d", "e", "q"), ("g", 2, "a", "b", "c"), ("g", 3, "a", "e", "w"), ("k", 1, "a", "a", "a")]


@cases("grp string, true_row bigint, predicted_row bigint, n_same bigint, complete boolean", [("g", 1, 2, 3, True), ("g", 2, 1, 2, True), ("g", 3, 3, 0, True)])
def assignment_cases(spark):
    """Rows of a group by most equal fields: an equal pair, a near one, and what is left."""
    a, b = (table(spark, rows, "grp string, n long, p string, q string, r string") for rows in (ROWS_TRUE, ROWS_SAID))
    return align.assign(a, b, "grp", "n", ["p", "q", "r"])


BOXES_TRUE = [(1, 1, 0.0, 0.0, 2.0, 2.0), (1, 2, 4.0, 0.0, 6.0, 2.0), (2, 3, 0.0, 0.0, 1.0, 1.0)]
BOXES_SAID = [(1, 1, 0.0, 0.0, 2.0, 2.0, 0.5), (1, 2, 0.0, 0.0, 2.0, 1.5, 0.9), (1, 3, 4.0, 0.0, 6.0, 1.0, 0.8), (1, 4, 9.0, 9.0, 10.0, 10.0, 0.85)]


@cases("page bigint, ap double", [(1, 0.833333), (2, 0.0)])
def detection_cases(spark):
    """Average precision by greedy matches, best scores first: hit, miss, hit, and one whose box is taken."""
    true = table(spark, BOXES_TRUE, "page long, id long, x0 double, y0 double, x1 double, y1 double")
    said = table(spark, BOXES_SAID, "page long, id long, x0 double, y0 double, x1 double, y1 double, score double")
    return layout.average_precision(layout.greedy(said, true, "page", 0.5), "page", true.groupBy("page").agg(F.count(F.lit(1)).alias("n_true")))


BAGS = [("a", "One red fox ran. Two blue birds sang! Ok.", "Two blue birds sang. Ok. Something else here."), ("b", "One red fox ran.", "One red fox ran."), ("c", "", "anything at all"), ("d", "Short. Bits. Of. Text here now.", "nothing alike"), ("e", "The first sentence. The second sentence.", "The second sentence. Another third sentence.")]


@cases("id string, missing double", [("a", 1.0), ("b", 0.0), ("c", 0.0), ("d", 1.0), ("e", 0.5)])
def sentence_cases(spark):
    """Shares of true sentences that are missing; short pieces join their neighbours."""
    t = table(spark, BAGS, "id string, true string, said string")
    return t.select("id", rules.sentence_bag(F.col("true"), F.col("said")).cast("double").alias("missing"))


# --- results by provider ------------------------------------------------------------------------------------------------------------------------------------------------------

SEGMENT = {"x": 0.25, "y": 0.5, "w": 0.5, "h": 0.25}
TYPED = {"layout_pages": [{"page_number": 2, "width": 100, "height": 200, "items": [{"type": "text", "value": "Hello world", "layout_segments": [{**SEGMENT, "label": "Text", "start_index": 0, "end_index": 4}]}, {"type": "table", "value": "<table/>", "bbox": SEGMENT}]}]}
PROVIDED = [
    ("spoken", {"raw_output": {"mode": "parse_with_layout", "model": "gemini-2"}, "output": TYPED}), ("docling", {"raw_output": {"docling_document": {}}, "output": TYPED}),
    ("chart", {"provider": "kdl_frontier_nano", "output": {"layout_pages": [{"width": 8, "height": 8, "items": [{"type": "image", "value": "v", "layout_segments": [{**SEGMENT, "label": "Chart"}]}]}]}}),
    ("chunks", {"request": {"example_id": "doc_page7"}, "raw_output": {"output": {"chunks": [{"segments": [{"segment_type": "Table", "page_number": 1, "bbox": {"left": 1, "top": 2, "width": 3, "height": 4}, "html": "<table></table>", "content": "c"}]}]}}}),
    ("aware", {"raw_output": {"image_width": 20, "image_height": 20, "pages": [{"width": 10, "height": 10, "md": "<table><tr></tr></table>", "items": [{"type": "table", "value": "v", "layoutAwareBbox": [{"label": "table", "x": 1, "y": 1, "w": 2, "h": 3, "confidence": 0.5}]}]}]}}),
    ("plain", {"output": {"predictions": [{"label": "7", "bbox": [0, 1, 2, 3], "score": 0.75, "page": 3, "content": {"type": "text", "text": "t"}}]}}), ("words", {"provider": "nemotron_ocr_v2", "output": {"predictions": [{"label": "7", "bbox": [0, 1, 2, 3]}]}}), ("broken", None),
]
LAID = [
    ("spoken", "google", 2, "Text", "text", "Hello", 1.0, "25 100 75 150"), ("docling", "docling_parse", 2, "Text", "text", "Hello", 1.0, "25 100 75 150"), ("docling", "docling_parse", 2, "table", "table", "<table/>", 1.0, "25 100 75 150"), ("chart", "kdl_frontier_nano", 1, "Picture", "text", "v", 1.0, "2 4 6 6"),
    ("chunks", "chunkr", 7, "Table", "table", "<table></table>", 1.0, "1 2 4 6"), ("aware", "layout_aware", 1, "table", "table", "<table><tr></tr></table>", 0.5, "2 2 6 8"), ("plain", "default", 3, "7", "text", "t", 0.75, "0 1 2 3"),
]


@cases("doc string, provider string, page int, label string, kind string, text string, score double, corners string", LAID)
def layout_result_cases(spark):
    """Regions of results, each read by the provider that owns it."""
    rows = [(d, "{" if r is None else json.dumps(r)) for d, r in PROVIDED]
    found = adapters.result_regions(table(spark, rows, "doc string, result string"), "doc", "result")
    corners = F.concat_ws(" ", *[F.format_string("%.0f", c) for c in ("x0", "y0", "x1", "y1")])
    return found.select("doc", "provider", "page", "label", "kind", "text", "score", corners.alias("corners"))


SEEN = ["table", "Section-Header", "doc_title", "chart", "field value", "code", "document-index", "checkbox_selected", "algorithm", "footer"]


@cases("label string, canonical string, basic string, core string", [
    ("table", "Table", "Table", "Table"), ("Section-Header", "Section-header", "Section", "Section-header"), ("doc_title", "Title", "Section", "Title"), ("chart", "Picture", "Picture", "Picture"), ("field value", "Text", "Text", "Text"), ("code", "Code", "Text", "Text"), ("document-index", "Document Index", "Text", "Text"),
    ("checkbox_selected", "Checkbox-Selected", "Text", "-"), ("algorithm", "Code", "Text", "Text"), ("footer", "Page-footer", "Page-footer", "Page-footer"),
])
def label_cases(spark):
    """Raw labels in three ontologies; a class that the core lacks goes."""
    t = table(spark, [(x,) for x in SEEN], "label string")
    all_ = adapters.projected(t, "canonical").withColumnRenamed("class", "canonical")
    basic = adapters.projected(t, "basic").select("label", F.col("class").alias("basic"))
    core = adapters.projected(t, "core").select("label", F.col("class").alias("core"))
    return all_.join(basic, "label").join(core, "label", "left").select("label", "canonical", "basic", F.coalesce("core", F.lit("-")).alias("core"))


CONFIGS = [
    ("layout_aware", {"pages": [{"items": []}]}), ("chunkr", {"output": {"chunks": []}}), ("dots_ocr_parse", {"prompt_mode": "prompt_layout_all_en"}), ("docling_parse", {"docling_document": {}}), ("qwen3vl_layout", {"items": [], "raw_content": ""}), ("google", {"mode": "parse_with_layout", "model": "gemini-3-pro"}),
    ("gemma4", {"prompt_mode": "layout", "_config": {"model": "gemma-4"}}), ("openai", {"mode": "parse_with_layout", "model": "gpt-5"}), ("openai", {"mode": "parse_with_layout", "model": "o3"}), ("anthropic", {"mode": "parse_with_layout", "model": "claude-x"}), ("reducto", {"_config": {"ocr_system": "standard", "mode": "x"}}), ("deepseekocr2", {"_config": {"server_url": "http://DeepSeek/ocr"}}),
    ("chandra2", {"_config": {"server_url": "http://chandra2"}}), ("qfocr", {"_config": {"thinking": True}}), ("datalab", {"parse_quality_score": 4}), ("datalab", {"_config": {"mode": "fast"}}), ("qwen3_5", {"_config": {"model": "qwen3.5-x"}}), ("mineru25", {"_config": {"server_url": "http://mineru25"}}), ("pulse", {"bounding_boxes": {}, "extraction_id": "x"}),
    ("infinity_parser2", {"_config": {"backend": "vllm-server", "model_name": "infly/Infinity-Parser2-7B"}}), ("textract", {"textract_response": {}}), ("landingai", {"grounding": {}, "chunks": []}), ("extend_parse", {"_extend_metadata": {}}), ("azure_document_intelligence", {"_config": {"model_id": "prebuilt"}}), ("google_docai", {"mode": "ocr", "_config": {"processor_id": "p"}}), ("unstructured", {"_config": {"strategy": "hi_res"}}), ("default", {}),
]
NAMED = ("warp_ingest", "oi_parser", "databricks_ai_parse", "nemotron_ocr_v2", "kdl_frontier_nano")
stated("provider_cases", {"provider": lambda r: adapters.provider_of(r).name}, [("provider", [{"raw_output": raw}], name) for name, raw in CONFIGS] + [("provider", [{"provider": n, "raw_output": {"_config": {"thinking": True}}}], n) for n in NAMED])


def _registered(script: list) -> list:
    """Runs calls on an empty registry."""
    r = registry.Registry("thing")
    for key, value, priority, owned in script:
        r.add(*key, value=value, priority=priority, owns=None if owned is None else lambda about, o=owned: about == o)
    return r


THINGS = [[["a", "b"], "first", 0, None], [["c"], "second", 5, "x"], [["d"], "third", 9, "x"], [[registry.DEFAULT], "other", 0, None]]
stated("registry_cases", {"names": lambda s: _registered(s).names(), "get": lambda s, k: _registered(s).get(k), "resolve": lambda s, keys, about: _registered(s).resolve(keys, about), "own": lambda kind: [n for n in getattr(registry, kind).names() if n in ("accuracy", "anls", "extract", "layout_detection", "core", "basic")], "label": lambda k, raw: registry.MAPPERS.resolve([k])(raw)}, [
    ("names", [THINGS], ["__default__", "a", "b", "c", "d"]), ("get", [THINGS, "b"], "first"), ("get", [THINGS, "zz"], "ValueError: no thing 'zz'; there are: __default__, a, b, c, d"), ("names", [[*THINGS, [["a"], "again", 0, None]]], "ValueError: thing 'a' is registered already"), ("names", [[[[], "x", 0, None]]], "ValueError: a thing needs a key"),
    ("resolve", [THINGS, ["c", "a"], None], "second"), ("resolve", [THINGS, ["zz"], "x"], "third"), ("resolve", [THINGS, ["zz"], "y"], "other"), ("resolve", [THINGS[:1], ["zz"], "y"], "ValueError: no thing for zz; there are: a, b"), ("own", ["METRICS"], ["accuracy", "anls"]), ("own", ["EVALUATORS"], ["extract", "layout_detection"]), ("own", ["MAPPERS"], ["basic", "core"]), ("label", ["core", "algorithm"], "Text"), ("label", ["any", "chart"], "Picture"),
])

stated("export_cases", {"page_text": sources.page_text, "page_htmls": sources.page_htmls, "line_markup": sources.line_markup, "truth_markup": sources.truth_markup, "version": adapters.label_version, "unknown": adapters.canonical_label, "granular": lambda r: [(k, t, x, w) for _, k, _, t, x, _, w, _ in adapters.granular(r)]}, [
    ("page_text", [{"items": [{"type": "table", "html": "<t/>", "md": "m"}, {"type": "text", "value": "v"}, {"type": "text", "md": ""}]}], "<t/>\n\nv"), ("page_text", [{"text": " whole ", "items": []}], "whole"), ("page_text", [{"response": {"pages": [{"blocks": [{"type": "table", "table": {"html": "<t/>"}}, {"type": "text", "text": {"content": "c"}}]}]}}], "<t/>\n\nc"), ("page_text", [{}], ""),
    ("page_htmls", [{"children": [{"block_type": "Page", "html": "<p/>"}, {"block_type": "Line", "html": "x"}]}], ["<p/>"]), ("line_markup", [[{"lines": [{"rid": 1, "y": 5, "x": 0, "t": "b<c"}, {"rid": 0, "y": 1, "x": 0, "t": "h", "row": 0, "col": 0}, {"rid": 0, "y": 1, "x": 5, "t": "i", "row": 0, "col": 1}, {"rid": 0, "y": 2, "x": 5, "t": "k", "row": 1, "col": 1}]}]], "<table><tr><td>h</td><td>i</td></tr><tr><td></td><td>k</td></tr></table>\n\nb&lt;c"),
    ("truth_markup", [{"lines": [{"text": "a  b"}], "tables": [{"rows": [["x", "<"]]}, {"rows": []}]}], "a b\n\n<table><tr><td>x</td><td>&lt;</td></tr></table>\n"), ("version", [["table", "form"]], "v3"), ("version", [["table"]], "v2"), ("unknown", ["zebra"], "UnknownLabelError: unknown layout label 'zebra'"),
    ("granular", [{"raw_output": {"pages": [{"predictions": [{"text": "ab c", "left": 0, "right": 8, "upper": 1, "lower": 0}, {"text": " "}]}]}}], [["line", "ab c", 0.0, 8.0], ["word", "ab", 0.0, 4.0], ["word", "c", 6.0, 2.0]]),
])
