"""Fields grounded in parsed pages: the words or lines that best say a field's value where it stands, and whether value and place agree.

A unit: kind (word or line), page, text, box (x, y, w, h as shares of the page), order. A rule: field_path, expected_value, bboxes of page and bbox.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import agreement, boxes, readings
from ..functions import jsonpaths as paths
from . import extraction

#: How far from a true box a unit may lie; units in a run; letters of a run against those of the value.
MARGIN, MOST_UNITS, LONGER, SLACK = 0.01, 20, 2, 20
RANK = {"word": 2.0, "line": 1.0}


def near(unit: dict, true: list[tuple]) -> bool:
    box = boxes.corners(unit["box"])
    grown = lambda b: (b[0] - MARGIN, b[1] - MARGIN, b[2] + MARGIN, b[3] + MARGIN)
    return any(page == unit["page"] and boxes.overlap(box, grown(boxes.corners(b))) for page, b in true)


def runs(units: list[dict], value) -> Iterator[list[dict]]:
    """Single units, and units of a page that follow one another, as long as their text is not much longer than the value."""
    pages: dict[int, list[dict]] = defaultdict(list)
    for u in sorted(units, key=lambda u: (u["page"], u.get("order", 0), u["box"][1], u["box"][0])):
        pages[u["page"]].append(u)
    for own in pages.values():
        yield from ([u] for u in own)
    most = LONGER * max(len(readings.plain(value)), 1) + SLACK
    for own in pages.values():
        for i in range(len(own)):
            for j in range(i + 2, min(i + MOST_UNITS, len(own)) + 1):
                if j > i + 2 and len(readings.plain(" ".join(u["text"] for u in own[i : j - 1]))) > most:
                    break
                yield own[i:j]


def best(rule: dict, units: list[dict], kind: str) -> tuple | None:
    """(agreement, the units, IoU and sharing of boxes) of the run that serves a rule best; None without boxes or units near them."""
    true = [(b["page"], tuple(map(float, b["bbox"]))) for b in rule.get("bboxes") or ()]
    found = None
    for name in ("word", "line"):
        for run in runs([u for u in units if u["kind"] == name and near(u, true)], rule["expected_value"]):
            a = agreement.attributed(rule["expected_value"], " ".join(u["text"] for u in run), kind, "native")
            said = [(u["page"], tuple(u["box"])) for u in run]
            u = boxes.union_iou(true, said)
            exact = a.passed and a.score >= agreement.EXACT
            area = [sum(boxes.area(boxes.corners(b)) for _, b in side) for side in (said, true)]
            key = (boxes.located(u["iou"], u["max_ioa"], exact), exact, a.passed, a.score, -len(run), RANK[name], u["iou"], u["max_ioa"], -abs(area[0] - area[1]))
            if found is None or key > found[0]:
                found = key, a, run, u
    return found and found[1:] + (found[0][0],)


def scores(rules: Iterable[dict], units: list[dict], schema=None) -> dict[str, float]:
    """Pass rates of places, of values, and of both; mean IoU, IoU and recall of all boxes, likeness of texts."""
    own = [r for r in rules if r.get("expected_value") is not None and not extraction.is_stray(r)]
    if not own:
        return {}
    n, said, text = Counter(), [], []
    for r in own:
        kind = paths.schema_type(schema, r["field_path"], r["expected_value"])
        hit = best(r, units, kind)
        n["total"] += 1
        if hit:
            a, run, u, located = hit
            said += [((x["page"], r["field_path"]), tuple(x["box"])) for x in run]
            n.update(located=int(located), attributed=int(located and a.passed))
            n["iou"] += u["iou"]
            n["iou_in" if located else "iou_out"] += u["iou"]
            text += [a.score] if kind == "string" else []
    total, missed = n["total"], n["total"] - n["located"]
    out = {
        "extract_field_element_pass_rate": n["attributed"] / total, "extract_field_rule_pass_rate": (n["located"] + total + n["attributed"]) / (3 * total), "extract_field_localization_pass_rate": n["located"] / total, "extract_field_classification_pass_rate": 1.0,
        "extract_field_attribution_pass_rate": n["attributed"] / total, "extract_field_avg_iou": n["iou"] / total, "extract_field_avg_iou_matched": n["iou_in"] / n["located"] if n["located"] else 0.0, "extract_field_avg_iou_unmatched": n["iou_out"] / missed if missed else 0.0, "extract_field_gt_count": float(total),
    }
    true = [((b["page"], r["field_path"]), tuple(map(float, b["bbox"]))) for r in own for b in r.get("bboxes") or ()]
    if true:
        out |= {"extract_field_iou": boxes.union_iou(true, said)["iou"], "extract_field_bbox_recall": boxes.coverage(true, said)["recall"]}
    return out | ({"extract_field_text_similarity": sum(text) / len(text)} if text else {})


def document_scores(docs: DataFrame, key: str) -> DataFrame:
    """key, metric, value for each row of ``docs``: key, rules and units (JSON lists), and, where there is one, schema."""
    at = docs.select(key, "rules", "units", (F.col("schema") if "schema" in docs.columns else F.lit(None).cast("string")).alias("schema"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, rows = [], []
            for i, (r, u, s) in enumerate(zip(*(b.column(c).to_pylist() for c in ("rules", "units", "schema")), strict=True)):
                found = scores(json.loads(r or "[]"), json.loads(u or "[]"), json.loads(s) if s else None)
                owners += [i] * len(found)
                rows += found.items()
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(owners, pa.int64())), pa.array([m for m, _ in rows], pa.string()), pa.array([float(v) for _, v in rows], pa.float64())], names=[key, "metric", "value"])

    return at.mapInArrow(work, f"{key} {at.schema[key].dataType.simpleString()}, metric string, value double")
