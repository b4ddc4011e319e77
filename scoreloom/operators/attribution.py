"""Attribution of text to layout: which predicted blocks speak for which true elements, and how well. A page is one kernel call.

An element: box (corners), cls, text, order, attributes (ignore, explicit, caption, text_role). A block: box, label, text, order. Boxes overlap from a share of
either's area on.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, prose

#: Overlap of boxes, recall of a grounded element, and support of a block.
OVERLAP, GROUNDED, SUPPORT = 0.3, 0.8, 0.8
TRUTHY = ("true", "1", "yes")

# fixed values: signs that attribution takes for others
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
PLAIN = {"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "…": "..."}

_clean = prose.steps(
    lambda s: "".join(ch for ch in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s)) if not unicodedata.combining(ch)).replace("ß", "ss"),
    prose.sub(r"(?s)\$\$.*?\$\$", " "), lambda s: re.sub(r"\$[^$]+\$", lambda m: " " if re.search(r"[\\^_{}]", m[0][1:-1]) else m[0], s), prose.sub(r"[_^]\{[^}]*\}", " "), prose.sub(r"[_^][a-zA-Z0-9]+", " "),
    prose.swap(str.maketrans(LIGATURES)), prose.sub(r"(?i)</?(?:sup|sub|b|i|u|ins|mark|span|div|br/?)\b[^>]*>", " "), prose.sub(r'\bstyle\s*=\s*"[^"]*"', " "),
    prose.sub(r"\*\*(.*?)\*\*", r"\1"), prose.sub(r"__(.*?)__", r"\1"), prose.sub(r"\*(.*?)\*", r"\1"), prose.sub(r"_(.*?)_", r"\1"), prose.sub(r"#{1,6}\s*"), prose.sub(r"\$\$?"),
    prose.sub(r"(?<!!)\[([^\]]*)\]\([^)]*\)", r"\1"), prose.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2"), prose.swap(str.maketrans(PLAIN)), str.lower, prose.sub(r"\s+", " "), prose.sub(r"[^a-z0-9\s.,;:!?\-()\[\]{}/'\"%]", " "), str.strip,
)


def clean(s: str | None, images: bool = False) -> str:
    """Text as attribution compares it: plain letters, no formulas, markup or links; with ``images`` the words for pictures stay."""
    if images:
        s = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", s or "")
    return _clean(s) if s else ""


def tokens(s: str | None) -> list[str]:
    return re.findall("[a-z0-9]+", clean(s))


def truthy(v) -> bool:
    return v is not None and str(v).strip().lower() in TRUTHY


def eligible(e: dict) -> bool:
    """Elements that count: not ignored, no formula, no caption of a picture's own."""
    a = e.get("attributes") or {}
    return not (truthy(a.get("ignore")) or truthy(a.get("caption")) or str(e.get("cls") or "").lower() == "formula" or str(a.get("text_role") or "").lower() == "formula")


def shares(a: list, b: list) -> list[list[float]]:
    """For each pair of boxes the larger share of either's area that both cover."""
    return [[max(boxes.ioa(x, y), boxes.ioa(y, x)) for y in b] for x in a]


def common(a: list[str], b: list[str]) -> int:
    return sum((Counter(a) & Counter(b)).values())


def left_over(a: list[str], b: list[str]) -> list[str]:
    """The multiset difference."""
    return list((Counter(a) - Counter(b)).elements())


def sample(a: list[str], b: list[str], most: int) -> list[str]:
    """Up to ``most`` distinct tokens of the difference, in order."""
    return list(dict.fromkeys(left_over(a, b)))[: max(most, 0)]


def _weighted(rows: list[tuple[str, list[str], list[str]]]) -> tuple[float, dict[str, float]]:
    """(share of tokens that the other side has, by class) of rows (class, tokens, the other side's)."""
    n, hits = Counter(), Counter()
    for cls, own, other in rows:
        n[cls] += len(own)
        hits[cls] += common(own, other)
    total = sum(n.values())
    return (sum(hits.values()) / total if total else 1.0), {c: hits[c] / n[c] for c in n if n[c]}


class Page:
    def __init__(self, elements: list[dict], blocks: list[dict], least: float = OVERLAP):
        self.elements = [e for e in elements if eligible(e)]
        self.blocks = blocks
        self.true = [e.get("tokens") or tokens(e.get("text")) for e in self.elements]
        self.said = [b.get("tokens") or tokens(b.get("text")) for b in blocks]
        over = shares([e["box"] for e in self.elements], [b["box"] for b in blocks])
        self.share = over
        self.near = [[j for j, s in enumerate(row) if s >= least] for row in over]  # blocks of an element
        self.under = [[i for i, row in enumerate(self.near) if j in row] for j in range(len(blocks))]  # elements of a block
        self.explicit = [truthy((e.get("attributes") or {}).get("explicit")) for e in self.elements]

    def scored_blocks(self) -> list[int]:
        """Blocks but those that lie on explicit elements alone."""
        return [j for j, own in enumerate(self.under) if not own or not all(self.explicit[i] for i in own)]

    def precision(self) -> tuple[float, dict[str, float]]:
        """(precision of all scored blocks' tokens, by the class of the elements under them)."""
        plain = lambda j: [i for i in self.under[j] if not self.explicit[i]]
        rows, by = [], []
        for j in self.scored_blocks():
            rows.append(("", self.said[j], [t for i in plain(j) for t in self.true[i]]))
            of = defaultdict(list)
            for i in plain(j):
                of[self.elements[i]["cls"]] += self.true[i]
            by += [(c, self.said[j], t) for c, t in of.items() if self.said[j]]
        return _weighted(rows)[0], _weighted(by)[1]

    def recall(self) -> tuple[float, dict[str, float]]:
        return _weighted([(e["cls"], t, [x for j in near for x in self.said[j]]) for e, t, near in zip(self.elements, self.true, self.near, strict=True)])

    def grounded(self) -> tuple[float, dict[str, float]]:
        """(share of elements with text of which blocks have most tokens, by class)."""
        rows = [(e["cls"], common(t, [x for j in near for x in self.said[j]]) / len(t) >= GROUNDED) for e, t, near in zip(self.elements, self.true, self.near, strict=True) if t]
        by = defaultdict(list)
        for c, ok in rows:
            by[c].append(ok)
        return (sum(ok for _, ok in rows) / len(rows) if rows else 1.0), {c: sum(v) / len(v) for c, v in by.items()}

    def order(self) -> tuple[float, float]:
        """Shares of adjacent pairs, and of all pairs, of elements in reading order whose first blocks do not come in the other order."""
        at = sorted(range(len(self.elements)), key=lambda i: self.elements[i].get("order", i))
        first = [min(self.blocks[j].get("order", j) for j in self.near[i]) for i in at if self.near[i]]
        if len(first) < 2:
            return 1.0, 1.0
        pairs = [(a, b) for k, a in enumerate(first) for b in first[k + 1 :]]
        mean = lambda ps: sum(a <= b for a, b in ps) / len(ps)
        return mean(list(zip(first, first[1:], strict=False))), mean(pairs)

    def supports(self) -> list[tuple[str, float, list[tuple[int, int]]]]:
        """(kind, precision, places of matched tokens) of each scored block, by its longest common subsequence with the tokens of the elements under it.

        Kinds: spatial_fp (over nothing), unsupported_fp, supported_tp, redundant_fp (others own all its tokens). A token belongs to the block of
        highest precision, then overlap.
        """
        out = []
        for j in self.scored_blocks():
            under = sorted(self.under[j], key=lambda i: (self.elements[i].get("order", i), i))
            places = [(i, k) for i in under for k in range(len(self.true[i]))]
            hit = [places[k] for k in self._aligned(self.said[j], [self.true[i][k] for i, k in places])]
            p = len(hit) / len(self.said[j]) if self.said[j] else 0.0
            out.append([j, "spatial_fp" if not under else "supported_tp" if p >= SUPPORT else "unsupported_fp", p, hit])
        claims = defaultdict(list)
        for s in out:
            if s[1] == "supported_tp":
                for at in s[3]:
                    claims[at].append(s)
        owned = {max(c, key=lambda s, i=at[0]: (s[2], self.share[i][s[0]], -s[0]))[0] for at, c in claims.items()}
        return [("redundant_fp" if kind == "supported_tp" and j not in owned else kind, p, hit) for j, kind, p, hit in out]

    @staticmethod
    def _aligned(a: list[str], b: list[str]) -> list[int]:
        """Places in b of a longest common subsequence with a."""
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        out, i, j = [], len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                out.append(j)
            elif best[i - 1][j] > best[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return out[::-1]

    def own_tokens(self, i: int, j: int) -> list[str]:
        """A block's tokens without those that only other elements under it account for."""
        other = [t for k in self.under[j] if k != i for t in self.true[k]]
        return left_over(self.said[j], left_over(other, self.true[i]))

    def scores(self) -> dict[str, float]:
        p, by_p = self.precision()
        r, by_r = self.recall()
        g, _ = self.grounded()
        adjacent, pairs = self.order()
        kinds = self.supports()
        n, claimed = Counter(k for k, _, _ in kinds), Counter(at for _, p_, hit in kinds if p_ >= SUPPORT for at in hit)
        rate = lambda x, y: x / y if y else 0.0
        out = {"lap": p, "lar": r, "af1": af1(p, r), "grounding_accuracy": g, "order_adjacent_accuracy": adjacent, "order_pairwise_accuracy": pairs}
        out |= {f"grounding_{k}_rate": rate(n[name], len(kinds)) for k, name in (("spatial_fp", "spatial_fp"), ("unsupported_block", "unsupported_fp"), ("redundant_block", "redundant_fp"))}
        out["grounding_supported_block_precision"] = rate(n["supported_tp"], len(kinds))
        out["grounding_overclaim_rate"] = rate(sum(c - 1 for c in claimed.values()), sum(claimed.values()))
        return out | {f"af1_{c}": af1(by_p.get(c, 0.0), by_r.get(c, 0.0)) for c in sorted(by_p.keys() | by_r.keys())}


def af1(p: float, r: float) -> float:
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def token_f1(a: list[str], b: list[str]) -> float:
    if not a or not b:
        return float(not a and not b)
    n = common(a, b)
    return af1(n / len(b), n / len(a))


# --- furniture of pages ---------------------------------------------------------------------------------------------------------------------------------------


def interval_union(spans: list[tuple[float, float]]) -> float:
    total, reach = 0.0, float("-inf")
    for a, b in sorted(s for s in spans if s[1] > s[0]):
        total += max(0.0, b - max(a, reach))
        reach = max(reach, b)
    return total


def band(true: tuple, got: list[tuple], least: float = 0.5) -> dict[str, float] | None:
    """How boxes that lie mostly in a header or footer band fill it: the span and the fill of its width, and its height; None if none does."""
    cut = [c for b in got if boxes.ioa(b, true) >= least and (c := boxes.overlap(b, true))]
    w, h = true[2] - true[0], true[3] - true[1]
    if not cut or w <= 0 or h <= 0:
        return None
    span = max(c[2] for c in cut) - min(c[0] for c in cut)
    fill = interval_union([(c[0], c[2]) for c in cut])
    return {"n": float(len(cut)), "x_span": min(span / w, 1.0), "x_fill": min(fill / w, 1.0), "y": min(interval_union([(c[1], c[3]) for c in cut]) / h, 1.0)}


# --- pages as rows ---------------------------------------------------------------------------------------------------------------------------------------------


def page_scores(pages: DataFrame, key: str) -> DataFrame:
    """key, metric, value for each row of ``pages``: key, elements and blocks (JSON lists)."""
    at = pages.select(key, "elements", "blocks")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, rows = [], []
            for i, (e, k) in enumerate(zip(b.column("elements").to_pylist(), b.column("blocks").to_pylist(), strict=True)):
                found = Page(json.loads(e or "[]"), json.loads(k or "[]")).scores()
                owners += [i] * len(found)
                rows += found.items()
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(owners, pa.int64())), pa.array([m for m, _ in rows], pa.string()), pa.array([float(v) for _, v in rows], pa.float64())], names=[key, "metric", "value"])

    return at.mapInArrow(work, f"{key} {at.schema[key].dataType.simpleString()}, metric string, value double")


def report(scores: DataFrame) -> DataFrame:
    """metric, n_pages, average over pages."""
    return scores.groupBy("metric").agg(F.count("value").alias("n_pages"), F.round(F.avg("value"), 6).alias("average"))


# --- answers ------------------------------------------------------------------------------------------------------------------------------------------------------


def plain_answer(s: str) -> str:
    for part in ("**", ":", "$\\boxed{", "}$", "\\$", "$", "{", "\\boxed"):
        s = s.replace(part, "")
    return s.strip()


def answer_matches(kind: str, said: str, true: str, tolerance: float = 0.0) -> bool:
    """single_choice (the same choice), multiple_choice (the same set of letters), numerical (within a tolerance), free_text (equal, or equal sets between commas)."""
    if kind == "numerical":
        a, b = (re.search(r"[-+]?\d[\d,]*\.?\d*(?:[eE][-+]?\d+)?", plain_answer(s)) for s in (said, true))
        return bool(a and b) and abs(float(a[0].replace(",", "")) - float(b[0].replace(",", ""))) <= tolerance
    if kind == "multiple_choice":
        letters = lambda s: set(re.findall(r"[A-Z]", plain_answer(s).upper())) if re.fullmatch(r"[\sA-Za-z,;]*", plain_answer(s)) else {plain_answer(s).lower()}
        return letters(said) == letters(true)
    if kind == "single_choice":
        return plain_answer(said).lower() == plain_answer(true).lower()
    if kind != "free_text":
        return False
    a, b = said.strip().lower(), true.strip().lower()
    parts = lambda s: {x.strip() for x in s.split(",")}
    return parts(a) == parts(b) if "," in b else a == b


def anls(said: list[str], true: list[str], least: float = 0.5) -> float:
    """Average normalised Levenshtein similarity of two lists (Biten and others 2019; lists by assignment): a pair below ``least`` is 0."""
    import numpy as np

    from ..functions import kernels

    if not said or not true:
        return float(not said and not true)
    like = np.array([[1 - prose.edit_distance(a.lower(), b.lower()) / max(len(a), len(b), 1) for b in said] for a in true])
    like[like < least] = 0
    return float(sum(like[p] for p in kernels.assign(-like)) / max(len(said), len(true)))
