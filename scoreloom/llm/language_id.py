"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies count every document that may be learnt from, in one pass; the model is fitted on a bounded sample
of them, about ``SAMPLE`` for each language (fewer where all languages together would pass ``SAMPLE_ALL``), by follow-the-regularised-leader (proximal, per-coordinate
rates) with L1 and L2 penalties, so that most weights are exactly zero. Every lang value is learnt. Tasks turn the sample into vectors; no text comes to
the driver. A part of the sample that the fit does not see sets the temperature of the softmax. Prediction reads every whole text.

Defined cases: a text that is null or without a letter is ``und`` with score 0; with no row to learn from all documents
are; repeated rows each get a row; languages with fewer rows than ``SAMPLE`` give all of theirs; extra columns are ignored. Of languages
with equal scores the first in order is named. A very long text is hashed in parts of CHUNK code points, which counts the space between parts once more.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, held_out, record_batch, slices, small_batches

FEATURES = 1 << 15
ORDERS = (1, 2, 3)
#: Documents in the sample: of each language, and of all together.
SAMPLE, SAMPLE_ALL = 400, 20_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.05
#: Code points that are hashed at once; a longer text goes in overlapping parts.
CHUNK = 1 << 20
#: Bytes of text that become Python strings at once.
SLICE = 4 << 20


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, how often each occurs) of a text; runs of white space count as one space."""
    total = np.zeros(FEATURES, np.int32)
    for at in range(0, len(text), CHUNK):
        code = np.frombuffer((" " + " ".join(text[max(0, at - 2) : at + CHUNK].lower().split()) + " ").encode("utf-32-le", "replace"), np.uint32)
        h = np.zeros(len(code), np.uint32)
        for n in ORDERS:
            if len(code) < n:
                break
            h = h[: len(code) - n + 1] * np.uint32(0x01000193) ^ code[n - 1 :] * np.uint32(0x9E3779B1)
            total += np.bincount((h * np.uint32(0x85EBCA6B) >> np.uint32(17)).astype(np.int32), minlength=FEATURES).astype(np.int32)
    found = np.flatnonzero(total)
    return found, total[found]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, TF-IDF values of unit length)."""
    found, n = counts(text)
    x = (1 + np.log(n)) * idf[found]
    return found, x / max(float(np.sqrt(x @ x)), 1e-12)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Of every text: in how many each feature occurs, and how many there are. Tasks send at most ``FEATURES`` sums, which Spark adds up."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES + 1, np.int64), 0
        for b in batches:
            for part in slices(b, "text", SLICE):
                for t in part.column("text").to_pylist():
                    df[counts(t)[0]] += 1
                    n += 1
        df[FEATURES] = n
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(df[found])], names=["feature", "n"])

    rows = texts.mapInArrow(sums, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES + 1, np.int64)
    df[rows["feature"]] = rows["n"]
    return df[:FEATURES], int(df[FEATURES])


def vectors(sample: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, lang, features, x (its TF-IDF vector, both packed) of the rows of a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "text", SLICE)):
            both = [vector(t, idf) for t in b.column("text").to_pylist()]
            columns = [pa.array([f.astype(np.int32).tobytes() for f, _ in both], pa.binary()), pa.array([x.tobytes() for _, x in both], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *columns], names=["doc_id", "lang", "features", "x"])

    return sample.mapInArrow(run, "doc_id bigint, lang string, features binary, x binary")


def fit(data: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature by class) and biases by FTRL-proximal with an elastic net."""
    z, n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))
    bias, rng = np.zeros(classes), np.random.default_rng(seed)

    def weights(f) -> np.ndarray:
        shrunk = np.sign(z[f]) * np.maximum(np.abs(z[f]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[f])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            f, x = data[i]
            w = weights(f)
            p = softmax((x @ w + bias)[None])[0]
            p[y[i]] -= 1
            g = x[:, None] * p[None]
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
            z[f] += g - sigma * w
            n[f] += g * g
            bias -= 0.01 * p
    return weights(slice(None)), bias


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    loss = lambda t: float(-np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean())
    a, b, r = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, heat: float):
        self.languages, self.idf, self.bias, self.heat = languages, idf.astype(np.float32), bias, heat
        self.rows = np.flatnonzero(np.any(weights != 0, axis=1)).astype(np.int32)  # sparse: the others don't go to the tasks
        self.weights = weights[self.rows].astype(np.float32)

    @functools.cached_property
    def dense(self) -> np.ndarray:
        w = np.zeros((FEATURES, len(self.languages)), np.float32)
        w[self.rows] = self.weights
        return w

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0
        f, x = vector(text, self.idf)
        p = softmax(((x @ self.dense[f] + self.bias) / self.heat)[None])[0]
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def train(learn: DataFrame) -> Model:
    """``learn``: doc_id, text, lang, the rows that may be learnt from."""
    learn = learn.where("text is not null and lang is not null")
    # one row a language
    known = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("of_lang"))
    languages = sorted(r["lang"] for r in known.select("lang").collect())
    if not languages:
        return Model([], np.ones(FEATURES), np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    df, n = document_frequencies(learn.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    # by a share of a hash: about so many rows a language however many there are; the table of languages is as small as their number
    each = max(1, min(SAMPLE, SAMPLE_ALL // len(languages)))
    lot = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    sample = learn.join(F.broadcast(known), "lang").where(lot < each / F.col("of_lang")).select("doc_id", "text", "lang")
    sample = vectors(sample, idf).toPandas().sort_values(["doc_id", "lang"])
    data = [(np.frombuffer(f, np.int32), np.frombuffer(x)) for f, x in zip(sample["features"], sample["x"], strict=True)]
    y = sample["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy()
    aside = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in sample["doc_id"]], bool)
    if aside.all() or not aside.any():
        aside[:] = False
    w, bias = fit([d for d, a in zip(data, aside, strict=True) if not a], y[~aside], len(languages))
    heat = temperature(np.array([x @ w[f] + bias for (f, x), a in zip(data, aside, strict=True) if a]), y[aside]) if aside.any() else 1.0
    return Model(languages, idf, w, bias, heat)


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "text", SLICE)):
            said = [shared.value.predict(t) for t in b.column("text").to_pylist()]
            yield record_batch({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": [s[0] for s in said], "score": [s[1] for s in said]}, OUT)

    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")))
