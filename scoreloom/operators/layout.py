"""Layout: box joins over a grid, greedy matching, average precision, token attribution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry, kernels
from ..functions.udfs import overlaps

# fixed values: raw layout labels and the classes they stand for
LABELS = {"Title": "heading", "Section-header": "heading", "Text": "text", "List-item": "text", "Table": "table", "Picture": "figure", "Caption": "caption", "Page-header": "furniture", "Page-footer": "furniture", "Footnote": "text", "Formula": "formula"}


def to_classes(boxes: DataFrame) -> DataFrame:
    """Raw labels to classes by a fixed mapping; unknown ones are 'other'."""
    mapping = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return boxes.withColumn("class", F.coalesce(mapping[F.col("label")], F.lit("other")))


CORNERS = ("x0", "y0", "x1", "y1")


def touching(a: DataFrame, b: DataFrame, page: str) -> DataFrame:
    """Pairs of boxes of a page that meet, each once: page and both boxes' columns id, x0..y1, as a_ and b_.

    Boxes are dealt to the cells of a grid that they touch, as wide as boxes are in the mean whatever their unit, so that an equi-join finds the
    pairs; a pair counts in the cell of the upper left corner of its overlap alone.
    """
    side = lambda d: d.select(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("side"))
    cell = side(a).unionByName(side(b)).agg(F.greatest(F.avg("side"), F.lit(1e-9)).alias("cell")).scalar()

    def dealt(d: DataFrame, p: str) -> DataFrame:
        d = d.select(page, *[F.col(c).alias(f"{p}{c}") for c in ("id", *CORNERS)], cell.alias(f"{p}cell"))
        along = lambda k: F.explode(F.sequence(*[F.floor(F.col(f"{p}{k}{i}") / F.col(f"{p}cell")) for i in (0, 1)]))
        return d.withColumn("_cx", along("x")).withColumn("_cy", along("y"))

    both = dealt(a, "a_").join(dealt(b, "b_"), [page, "_cx", "_cy"])
    first = lambda k: F.greatest(f"a_{k}0", f"b_{k}0")
    meet = [first(k) <= F.least(f"a_{k}1", f"b_{k}1") for k in "xy"]
    own = [F.floor(first(k) / F.col("a_cell")) == F.col(f"_c{k}") for k in "xy"]
    return both.where(own[0] & own[1] & meet[0] & meet[1]).drop("_cx", "_cy", "a_cell", "b_cell")


def overlapping(a: DataFrame, b: DataFrame, page: str, least: float = 0.0) -> DataFrame:
    """Pairs of boxes of a page with an IoU above ``least``."""
    both = touching(a, b, page).withColumn("iou", geometry.iou(geometry.box("a_"), geometry.box("b_")))
    return both.where(F.col("iou") > least).select(page, "a_id", "b_id", "iou")


def greedy(predicted: DataFrame, true: DataFrame, page: str, threshold: float = 0.5) -> DataFrame:
    """page, id, score, matched of every prediction, by a kernel for each page."""

    def run(key: tuple, p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if p.empty:
            return pd.DataFrame(columns=["page", "id", "score", "matched"])
        p = p.sort_values(["score", "id"], ascending=[False, True])
        if t.empty:
            return p.assign(page=key[0], matched=False)[["page", "id", "score", "matched"]]
        t = t.sort_values("id")
        a, b = p[["x0", "y0", "x1", "y1"]].to_numpy(), t[["x0", "y0", "x1", "y1"]].to_numpy()
        wide = np.clip(np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2]), 0, None)
        inter = wide[..., 0] * wide[..., 1]
        size = lambda z: (z[:, 2] - z[:, 0]) * (z[:, 3] - z[:, 1])
        union = size(a)[:, None] + size(b)[None] - inter
        hit = kernels.greedy_match(np.divide(inter, union, out=np.zeros_like(inter), where=union > 0), p["score"].to_numpy(), threshold)
        return pd.DataFrame({"page": key[0], "id": p["id"].to_numpy(), "score": p["score"].to_numpy(), "matched": hit >= 0})

    # names of its own: the two sides may come from one plan
    true = true.select(*[F.col(c).alias(c) for c in true.columns])
    return predicted.groupBy(page).cogroup(true.groupBy(page)).applyInPandas(run, "page bigint, id bigint, score double, matched boolean")


def average_precision(hits: DataFrame, group: str, n_true: DataFrame) -> DataFrame:
    """Step-sum average precision of each group. ``hits``: group, id, score, matched; ``n_true``: group, n_true."""
    w = W.partitionBy(group).orderBy(F.desc("score"), "id")
    t = hits.withColumns({"_rank": F.row_number().over(w), "_hits": F.sum(F.col("matched").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0))})
    s = t.groupBy(group).agg(F.sum(F.when(F.col("matched"), F.col("_hits") / F.col("_rank")).otherwise(0.0)).alias("s"))
    return n_true.join(s, group, "left").select(group, F.round(F.coalesce("s", F.lit(0.0)) / F.col("n_true"), 6).alias("ap"))


def token_f1(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Multiset overlap of two token arrays of each row that has tokens: key, precision, recall, f1."""
    t = overlaps(pairs, [key], a, b).where("n_a + n_b > 0")
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return t.select(key, F.round(ratio(F.col("same"), F.col("n_b")), 6).alias("precision"), F.round(ratio(F.col("same"), F.col("n_a")), 6).alias("recall"), F.round(ratio(2 * F.col("same"), F.col("n_a") + F.col("n_b")), 6).alias("f1"))
