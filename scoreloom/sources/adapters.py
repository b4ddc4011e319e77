"""Provider layouts to one form: boxes with page, label, text and score.

A provider's JSON is described, not coded: where its items are, and what their fields mean (``SPECS``, boxes in 0..1); or, for results of inference that
come with typed pages, which results are its own, in what order providers are asked, and what is special about its labels (``PROVIDERS``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAYOUT = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("item", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType()), *[T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")]])


@dataclass(frozen=True)
class Spec:
    """``items``: path to the items, [] where a list is walked. ``form`` of the box: xyxy, xywh, ltwh (an object), points (list of pairs or x/y objects), flat (x, y, x, y, ...)."""

    items: str
    box: str
    label: str
    text: str
    page: str | None = None
    score: str | None = None
    form: str = "xyxy"
    width: str | None = None  # path from the page of what boxes are divided by; None: they are in 0..1
    height: str | None = None
    keep: tuple[str, ...] = ()


# fixed values: published response formats of providers
SPECS = {
    "boxes": Spec("pages[].items[]", "bbox", "label", "text", score="score"),
    "textract": Spec("Blocks[]", "Geometry.BoundingBox", "BlockType", "Text", page="Page", score="Confidence", form="ltwh", keep=("LINE", "TABLE", "LAYOUT_TITLE", "LAYOUT_TEXT", "LAYOUT_TABLE", "LAYOUT_FIGURE", "LAYOUT_HEADER", "LAYOUT_FOOTER", "LAYOUT_SECTION_HEADER", "LAYOUT_LIST")),
    "document_ai": Spec("document.pages[].blocks[]", "layout.boundingPoly.normalizedVertices", "type", "text", score="layout.confidence", form="points"),
    "document_intelligence": Spec("analyzeResult.pages[].lines[]", "polygon", "role", "content", form="flat", width="width", height="height"),
    "unstructured": Spec("[]", "metadata.coordinates.points", "type", "text", page="metadata.page_number", form="points", width="metadata.coordinates.layout_width", height="metadata.coordinates.layout_height"),
}


def get(value, path: str | None):
    if path is None:
        return None
    for part in path.split("."):
        if part and value is not None:
            value = value.get(part) if isinstance(value, dict) else None
    return value


def walk(value, path: str, parent=None) -> Iterator[tuple]:
    """(item, the page it is in, number of the page) along a path."""
    head, _, rest = path.partition("[]")
    value = get(value, head.strip("."))
    if not isinstance(value, list):
        return
    for i, x in enumerate(value):
        if rest:
            yield from ((item, x, i + 1) for item, _, _ in walk(x, rest))
        else:
            yield x, parent if parent is not None else x, 1


def box(raw, form: str) -> tuple[float, float, float, float] | None:
    if form == "ltwh":
        raw = [raw.get(k) for k in ("Left", "Top", "Width", "Height")] if isinstance(raw, dict) else raw
    if not raw or any(v is None for v in raw):
        return None
    if form in ("ltwh", "xywh"):
        return raw[0], raw[1], raw[0] + raw[2], raw[1] + raw[3]
    if form == "points":
        pairs = [(p.get("x", 0), p.get("y", 0)) if isinstance(p, dict) else (p[0], p[1]) for p in raw]
    elif form == "flat":
        pairs = list(zip(raw[::2], raw[1::2], strict=True))
    else:
        return tuple(raw[:4])
    xs, ys = zip(*pairs, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def layout(document: str | None, spec: Spec) -> Iterator[tuple]:
    """Rows of LAYOUT; what has no box is left out, and a text that is no JSON has no rows."""
    try:
        value = json.loads(document) if document else None
    except ValueError:
        return
    if spec.items == "[]":
        value, path = {"_": value}, "_[]"
    else:
        path = spec.items
    for n, (item, page, number) in enumerate(walk(value, path)):
        label, b = get(item, spec.label), box(get(item, spec.box), spec.form)
        if b is None or spec.keep and label not in spec.keep:
            continue
        of = item if spec.page and spec.width else page
        w, h = (get(of, spec.width) or 1, get(of, spec.height) or 1) if spec.width else (1, 1)
        score = get(item, spec.score)
        yield int(get(item, spec.page) or number) if spec.page else number, n, label, get(item, spec.text), None if score is None else float(score), b[0] / w, b[1] / h, b[2] / w, b[3] / h


def layouts(docs: DataFrame, key: str, column: str, provider: str | Spec) -> DataFrame:
    """key and the layout rows of every document."""
    spec = SPECS[provider] if isinstance(provider, str) else provider

    @F.udtf(returnType=LAYOUT, useArrow=True)
    class Rows:
        def eval(self, document: str):
            yield from layout(document, spec)

    return docs.select(key, F.col(column).alias("_json")).lateralJoin(Rows(F.col("_json").outer())).select(key, *LAYOUT.names)


# --- results of inference -------------------------------------------------------------------------------------------------------------------------

Raw = dict


@dataclass(frozen=True)
class Provider:
    """``own``: whether a raw response is this provider's; the provider of highest priority that owns a result, or is named by it, reads it.

    ``kind``: typed (pages of items with segments in shares of the page), chunks (absolute boxes), layout_aware (items with boxes in page units), predictions
    (boxes as they are) or words (text only). ``default``: the label of a segment without one; ``fallback``: an item's own box stands for segments
    where it has none.
    """

    name: str
    priority: int
    own: Callable[[Raw], bool]
    kind: str = "typed"
    default: str = "Text"
    fallback: bool = False
    labels: dict[str, str] | None = None


PROVIDERS: dict[str, Provider] = {}


def register(provider: Provider) -> Provider:
    """Adds a provider; one that is there under the name is replaced."""
    PROVIDERS[provider.name] = provider
    return provider


def _config(raw: Raw, key: str):
    config = raw.get("_config")
    return config.get(key) if isinstance(config, dict) else None


def _starts(v, *prefixes: str) -> bool:
    return isinstance(v, str) and v.startswith(prefixes)


def _served(name: str) -> Callable[[Raw], bool]:
    return lambda raw: name in str(_config(raw, "server_url") or "").lower()


def _spoken(*models: str) -> Callable[[Raw], bool]:
    return lambda raw: raw.get("mode") == "parse_with_layout" and _starts(raw.get("model"), *models)


# fixed values: keys by which responses are told apart, and labels that stand for others
for _p in (
    Provider("layout_aware", 100, lambda raw: isinstance(raw.get("pages"), list) and bool(raw["pages"]) and isinstance(raw["pages"][0], dict) and isinstance(raw["pages"][0].get("items"), list), "layout_aware"),
    Provider("warp_ingest", 100, lambda raw: False, "predictions"),
    Provider("chunkr", 90, lambda raw: isinstance(raw.get("output"), dict) and isinstance(raw["output"].get("chunks"), list), "chunks"),
    Provider("dots_ocr_parse", 90, lambda raw: _starts(raw.get("prompt_mode"), "prompt_layout")),
    Provider("docling_parse", 90, lambda raw: isinstance(raw.get("docling_document"), dict), default="text", fallback=True),
    Provider("qwen3vl_layout", 90, lambda raw: "items" in raw and "raw_content" in raw),
    Provider("google", 90, _spoken("gemini")),
    Provider("gemma4", 90, lambda raw: raw.get("prompt_mode") == "layout" and _starts(_config(raw, "model"), "gemma")),
    Provider("openai", 90, _spoken("gpt", "o3", "o4")),
    Provider("anthropic", 90, _spoken("claude")),
    Provider("reducto", 90, lambda raw: _config(raw, "ocr_system") is not None),
    Provider("oi_parser", 90, lambda raw: False),
    Provider("databricks_ai_parse", 90, lambda raw: False),
    Provider("deepseekocr2", 90, _served("deepseek")),
    Provider("chandra2", 90, _served("chandra2")),
    Provider("qfocr", 90, lambda raw: _config(raw, "thinking") is True),
    Provider("datalab", 90, lambda raw: "parse_quality_score" in raw or _config(raw, "mode") is not None and _config(raw, "ocr_system") is None),
    Provider("qwen3_5", 90, lambda raw: _starts(_config(raw, "model"), "qwen3.5", "qwen3.6")),
    Provider("mineru25", 90, _served("mineru25")),
    Provider("nemotron_ocr_v2", 90, lambda raw: False, "words"),
    Provider("kdl_frontier_nano", 90, lambda raw: False, labels={"Chart": "Picture", "Flowchart": "Picture"}),
    Provider("pulse", 90, lambda raw: "bounding_boxes" in raw and "extraction_id" in raw),
    Provider("infinity_parser2", 90, lambda raw: _config(raw, "backend") == "vllm-server" and _starts(_config(raw, "model_name"), "infly/Infinity-Parser2")),
    Provider("textract", 89, lambda raw: "textract_response" in raw),
    Provider("landingai", 89, lambda raw: "grounding" in raw and "chunks" in raw),
    Provider("extend_parse", 89, lambda raw: "_extend_metadata" in raw),
    Provider("azure_document_intelligence", 89, lambda raw: _config(raw, "model_id") is not None),
    Provider("google_docai", 89, lambda raw: _config(raw, "processor_id") is not None and raw.get("mode") in ("ocr", "layout_parser")),
    Provider("unstructured", 89, lambda raw: _config(raw, "strategy") is not None),
    Provider("default", -100, lambda raw: True, "predictions"),
):
    register(_p)


def provider_of(result: Raw) -> Provider:
    """By the name the result gives, or else the provider of highest priority (the first of equals) that owns its raw response."""
    named = PROVIDERS.get(str(result.get("provider") or ""))
    raw = result.get("raw_output") if isinstance(result.get("raw_output"), dict) else {}
    return named or next(p for p in sorted(PROVIDERS.values(), key=lambda p: -p.priority) if p.own(raw))


def content_of(label: str, text: str | None) -> tuple[str | None, str | None]:
    """(table, text or nothing; the text): pictures hold nothing."""
    name = label.strip().lower()
    return (None, None) if not text or name == "picture" else ("table" if name == "table" else "text", text)


def _page_of(example: str | None) -> int | None:
    m = re.search(r"_page(\d+)(?:_|$)", example or "")
    return max(int(m[1]), 1) if m else None


def _typed(result: Raw, p: Provider) -> Iterator[tuple]:
    pages = get(result, "output.layout_pages") or []
    first = pages[0] if pages else {}
    for page in pages:
        w, h = (float(page.get(k) or first.get(k) or 1) for k in ("width", "height"))
        for item in page.get("items") or ():
            own = item.get("layout_segments") or ([item["bbox"]] if p.fallback and item.get("bbox") else [])
            for seg in own:
                label = seg.get("label") or item.get("type") or p.default
                kind, text = content_of(item.get("type") or "" if p.fallback else label, item.get("value"))
                at, stop = seg.get("start_index"), seg.get("end_index")
                if kind == "text" and isinstance(at, int) and isinstance(stop, int) and stop >= at:
                    text = text[at : stop + 1]
                label = (p.labels or {}).get(label, label)
                x, y = seg["x"] * w, seg["y"] * h
                yield page.get("page_number", 1), label, kind, text, float(seg.get("confidence") or 1.0), x, y, x + seg["w"] * w, y + seg["h"] * h


def _chunks(result: Raw, p: Provider) -> Iterator[tuple]:
    inferred = _page_of(get(result, "request.example_id"))
    for chunk in get(result, "raw_output.output.chunks") or ():
        for seg in (chunk.get("segments") if isinstance(chunk, dict) else None) or ():
            label, number = seg.get("segment_type"), int(seg.get("page_number", 1))
            if isinstance(label, str):
                b, html, text = seg.get("bbox") or {}, seg.get("html"), seg.get("content") or seg.get("text")
                x, y, w, h = (float(b.get(k, 0.0)) for k in ("left", "top", "width", "height"))
                table = label.strip().lower() == "table" and bool(html)
                kind = "table" if table else "text" if text or html else None
                yield inferred if inferred and number == 1 else number, label, kind, html if table else text or html, float(seg.get("confidence", 1.0)), x, y, x + w, y + h


def _layout_aware(result: Raw, p: Provider) -> Iterator[tuple]:
    """Boxes scaled to the first page (or the image of a single page); table items take the page's HTML tables in turn, texts the signs their segment names."""
    raw = result.get("raw_output") or {}
    pages = [x for x in raw.get("pages") or () if isinstance(x, dict)]
    size = [(raw.get(f"image_{k}") if len(pages) == 1 else None) or (pages[0].get(k, 1) if pages else 1) for k in ("width", "height")]
    for number, page in enumerate(pages, 1):
        sx, sy = (out / float(page.get(k) or out or 1) for out, k in zip(size, ("width", "height"), strict=True))
        tables = iter(re.findall(r"(?is)<table>.*?</table>", page.get("md") or page.get("text") or ""))
        for item in page.get("items") or ():
            for seg in (item.get("layoutAwareBbox") if isinstance(item, dict) else None) or ():
                if isinstance(seg, dict) and isinstance(seg.get("label"), str):
                    text, at, stop = str(item.get("value") or ""), seg.get("startIndex"), seg.get("endIndex")
                    html = next(tables, None) if item.get("type") == "table" else None
                    if item.get("type") != "table" and isinstance(at, int) and isinstance(stop, int) and stop >= at:
                        text = text[at : stop + 1]
                    x, y, w, h = (float(seg.get(k, 0)) for k in "xywh")
                    kind = "table" if html else "text" if text else None
                    yield number, seg["label"], kind, html or text or None, float(seg.get("confidence", 0.0)), x * sx, y * sy, (x + w) * sx, (y + h) * sy


def _predictions(result: Raw, p: Provider) -> Iterator[tuple]:
    for q in get(result, "output.predictions") or get(result, "raw_output.predictions") or ():
        content = q.get("content") or {}
        text = content.get("html") or content.get("text") if isinstance(content, dict) else None
        yield q.get("page", 1), str(q.get("label", "")), content.get("type") if text else None, text, float(q.get("score", 1.0)), *map(float, q["bbox"])


def granular(result: Raw) -> Iterator[tuple]:
    """(page, line or word, number, text, x, y, w, h) of recognised lines and the words in them, whose boxes share a line's width by their signs."""
    for number, page in enumerate(get(result, "raw_output.pages") or (), 1):
        n = {"line": 0, "word": 0}
        for q in page.get("predictions") or ():
            text = str(q.get("text") or "")
            (x, x2), (y, y2) = (sorted(float(q.get(k, 0.0)) for k in ks) for ks in (("left", "right"), ("upper", "lower")))
            if not text.strip():
                continue
            yield number, "line", n["line"], text, x, y, x2 - x, y2 - y
            n["line"] += 1
            words = text.split()
            units, at = sum(map(len, words)) + len(words) - 1, 0
            for w in words if x2 > x else ():
                yield number, "word", n["word"], w, x + (x2 - x) * at / units, y, (x2 - x) * len(w) / units, y2 - y
                n["word"] += 1
                at += len(w) + 1


READERS = {"typed": _typed, "chunks": _chunks, "layout_aware": _layout_aware, "predictions": _predictions, "words": lambda result, p: iter(())}
REGION = T.StructType([T.StructField("provider", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("item", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType()), *[T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")]])


def regions(result: Raw, page: int | None = None) -> Iterator[tuple]:
    """Rows of REGION of a result, of one page if it is named."""
    p = provider_of(result)
    for n, row in enumerate(READERS[p.kind](result, p)):
        if page is None or row[0] == page:
            yield p.name, int(row[0]), n, *row[1:]


def result_regions(results: DataFrame, key: str, column: str) -> DataFrame:
    """key and the regions of every result (JSON), whatever its provider; a text that is no JSON object has none."""

    @F.udtf(returnType=REGION, useArrow=True)
    class Regions:
        def eval(self, document: str):
            try:
                value = json.loads(document) if document else None
            except ValueError:
                return
            if isinstance(value, dict):
                yield from regions(value)

    return results.select(key, F.col(column).alias("_json")).lateralJoin(Regions(F.col("_json").outer())).select(key, *REGION.names)


# --- labels -----------------------------------------------------------------------------------------------------------------------------------------------

# fixed values: raw labels of two label versions and what they stand for, and the coarse classes of these
VERSION_3 = ("caption", "list-item", "page-footer", "page-header", "picture", "section-header", "title", "document-index", "code", "checkbox-selected", "checkbox-unselected", "form", "key-value-region")
CANONICAL = {
    "Title": ("title", "doc_title"), "Section-header": ("section_header", "paragraph_title", "heading"),
    "Text": ("text", "number", "abstract", "content", "reference", "aside_text", "reference_content", "formula_number", "paragraph", "grading_scale", "handwritten_text", "empty_value", "field_heading", "field_item", "field_key", "field_value", "field_hint", "marker"),
    "Page-header": ("page_header", "header"), "Page-footer": ("page_footer", "footer"), "Footnote": ("footnote",), "Picture": ("picture", "image", "chart", "seal"), "Caption": ("caption", "figure_title"), "Table": ("table",), "Formula": ("formula",),
    "List-item": ("list_item",), "Code": ("code", "algorithm"), "Document Index": ("document_index",), "Checkbox-Selected": ("checkbox_selected",), "Checkbox-Unselected": ("checkbox_unselected",), "Form": ("form",), "Key-Value Region": ("key_value_region", "field_region"),
}
#: Raw labels, with underscores -> class.
RAW = {raw: name for name, raws in CANONICAL.items() for raw in raws}
BASIC = {**dict.fromkeys(CANONICAL, "Text"), "Title": "Section", "Section-header": "Section", "Page-footer": "Page-footer", "Page-header": "Page-header", "Picture": "Picture", "Table": "Table"}
CORE = ("Caption", "Footnote", "Formula", "List-item", "Page-footer", "Page-header", "Picture", "Section-header", "Table", "Text", "Title")
#: Classes beyond the core that count as text there; the others beyond it have no equal.
TO_CORE = {**dict(zip(CORE, CORE, strict=True)), "Code": "Text", "Document Index": "Text", "Key-Value Region": "Text"}


class UnknownLabelError(ValueError):
    """A raw label that no mapping knows."""


def label_version(labels: list[str]) -> str:
    return "v3" if set(labels) & set(VERSION_3) else "v2"


def canonical_label(raw: str) -> str:
    """The canonical class of a raw label, in any case, with dashes or underscores."""
    name = RAW.get(re.sub("[- ]", "_", raw.strip().lower()))
    if name is None:
        raise UnknownLabelError(f"unknown layout label {raw!r}")
    return name


def target_label(label: str | None, ontology: str = "basic") -> str | None:
    """A canonical class in an ontology: canonical and core keep it, basic makes it coarse; what is not canonical stays."""
    name = ontology.strip().lower()
    if not name.startswith(("basic", "canonical", "core")):
        raise ValueError(f"unsupported ontology {ontology!r}")
    return BASIC.get(label, label) if label is not None and name.startswith("basic") else label


def core_label(raw: str) -> str | None:
    """The core class nearest to a raw label's; None where none is."""
    return TO_CORE.get(canonical_label(raw))


def projected(regions_: DataFrame, ontology: str = "canonical") -> DataFrame:
    """Regions with their class in an ontology; with core those that have none there go. A label that is not known is an error."""
    to = core_label if ontology.startswith("core") else lambda raw: target_label(canonical_label(raw), ontology)
    mapping = F.create_map(*[F.lit(v) for raw in RAW for v in (raw, to(raw) or "")])
    found = mapping[F.regexp_replace(F.lower(F.trim("label")), "[- ]", "_")]
    out = regions_.withColumn("class", F.coalesce(found, F.raise_error(F.concat(F.lit("unknown layout label "), F.col("label"))).cast("string")))
    return out.where("class <> ''")
