"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples and unlabelled text train a linear numpy classifier over the presence of character n-grams of words.
The risk is prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]): unlabelled text stands for a mixture of
both classes, and where the estimate of the negative part falls below zero its gradient is turned round. The class prior
comes from all labels that may be learnt from, which need not be a fair sample of the corpus: it is held to ROOM times how much rarer the most
telling features are in unlabelled text than among positives. The fit takes a bounded sample, about ``POSITIVES`` and ``UNLABELLED`` documents, of which
tasks send the distinct hashes to the driver, not the texts; scores read every whole text.

Defined cases: a null or empty text has no feature and gets the score of the bias alone; without a confirmed toxic example all
scores are 0; repeated rows each get a row; labels without a document and a null label teach nothing; extra columns pass ``keep`` under any name. A very
long text is hashed in parts of CHUNK code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, held_out, record_batch, slices, small_batches

HASHES = 1 << 18
ORDERS = (4, 5)
POSITIVES, UNLABELLED = 3000, 8000
#: Kept features: the most telling FEATURES of those whose share among positives is LEAST_LIFT times that in unlabelled text.
FEATURES, LEAST_Z, LEAST_LIFT = 1024, 4.0, 3.0
PURE, ROOM = 20, 1.25
STEPS, RATE, DECAY = 250, 0.05, 1e-4
THRESHOLD = 0.3
CHUNK = 1 << 20
SLICE = 4 << 20


def hashes(text: str) -> Iterator[np.ndarray]:
    """Hashed character n-grams of the words of a text, by parts of it."""
    for at in range(0, len(text), CHUNK):
        code = np.frombuffer((" " + " ".join(text[max(0, at - max(ORDERS)) : at + CHUNK].lower().split()) + " ").encode("utf-32-le", "replace"), np.uint32)
        h, blank = np.zeros(len(code), np.uint32), np.zeros(len(code), bool)
        space = code == 32
        for n in range(1, max(ORDERS) + 1):
            if len(code) < n:
                break
            h = h[: len(code) - n + 1] * np.uint32(0x01000193) ^ code[n - 1 :] * np.uint32(0x9E3779B1)
            if n > 2:  # a space may begin or end an n-gram
                blank = blank[: len(code) - n + 1] | space[n - 2 : len(code) - 1]
            if n in ORDERS:
                yield (h[~blank] * np.uint32(0x85EBCA6B) >> np.uint32(14)).astype(np.int32)


class Presence:
    """The distinct hashes of a text, in linear time."""

    def __init__(self):
        self.last = np.zeros(HASHES, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        h = np.concatenate([*hashes(text or ""), np.zeros(0, np.int32)])
        at = np.arange(len(h), dtype=np.int32)
        self.last[h] = at
        return h[self.last[h] == at]


def packed(hashes_: np.ndarray) -> bytes:
    """Distinct hashes as compressed steps, about a third of their size: what goes to the driver."""
    steps = np.diff(np.sort(hashes_.astype(np.int32)), prepend=np.int32(0))
    return len(steps).to_bytes(4, "little") + (pa.compress(steps.tobytes(), codec="zstd", asbytes=True) if len(steps) else b"")


def unpacked(body: bytes) -> np.ndarray:
    n = int.from_bytes(body[:4], "little")
    return np.cumsum(np.frombuffer(pa.decompress(body[4:], 4 * n, codec="zstd", asbytes=True), np.int32), dtype=np.int32) if n else np.zeros(0, np.int32)


def presences(docs: DataFrame) -> list[np.ndarray]:
    """The distinct hashes of each document of a sample, in the order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = Presence()
        for b in (part for whole in batches for part in slices(whole, "text", SLICE)):
            found = pa.array([packed(present(t)) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), found], names=["doc_id", "found"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, found binary").toPandas()
    return [unpacked(x) for x in rows.sort_values("doc_id", kind="stable")["found"]]


class Model:
    def __init__(self, picked: np.ndarray, weights: np.ndarray, bias: float):
        self.picked, self.weights, self.bias = picked.astype(np.int32), weights.astype(np.float32), bias
        self.place = np.full(HASHES, -1, np.int32)
        self.place[self.picked] = np.arange(len(self.picked))

    def __reduce__(self):
        return Model, (self.picked, self.weights, self.bias)

    def score(self, text: str | None) -> float:
        seen = np.zeros(len(self.picked), bool)
        for h in hashes(text or ""):
            p = self.place[h]
            seen[p[p >= 0]] = True
        g = self.weights[seen].sum() / np.sqrt(max(1, int(seen.sum()))) + self.bias
        return float(1 / (1 + np.exp(-np.clip(g, -30, 30)))) if len(self.picked) else 0.0


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 at unit length, so that a short text with two telling words weighs as much as a long one with twenty."""
    return x / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))


def risks(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(positive part, negative part, and the gradients of both) of the PU risk with logistic loss; the last weight is the bias."""
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    gp, gu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    wrong, found, claimed = sigmoid(-gp), sigmoid(gp), sigmoid(gu)
    positive = -prior * np.r_[wrong @ p, wrong.sum()] / len(p)
    negative = np.r_[claimed @ u, claimed.sum()] / len(u) - prior * np.r_[found @ p, found.sum()] / len(p)
    return prior * np.logaddexp(0, -gp).mean(), np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean(), positive, negative


def fit(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative PU risk with logistic loss, by Adam on the whole sample. ``p``, ``u``: rows of features."""
    n = p.shape[1]
    w, m, v = np.zeros((3, n + 1), np.float32)
    w[n] = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        _, risk, positive, negative = risks(w, p, u, prior)
        g = positive + negative if risk >= 0 else -negative
        g[:n] += DECAY * w[:n]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:n], float(w[n])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic; only rows that may be learnt from."""
    empty = Model(np.zeros(0, np.int32), np.zeros(0), 0.0)
    told = labels.where("toxic is not null").agg(F.sum((F.col("toxic") == 1).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    if not told["p"]:
        return empty
    prior = min(0.5, max(0.005, told["p"] / told["n"]))
    lot = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    # some POSITIVES ids by their share of a hash: the bound of this broadcast
    ids = labels.where((F.col("toxic") == 1) & (lot < POSITIVES / told["p"])).select("doc_id", lot.alias("lot")).distinct().orderBy("lot", "doc_id").limit(2 * POSITIVES)
    positive = presences(docs.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi"))
    known = docs.select("doc_id").count()
    unlabelled = presences(docs.where(lot < UNLABELLED / max(known, 1)))
    if not positive or not unlabelled:
        return empty
    np_, nu = np.zeros(HASHES), np.zeros(HASHES)
    for found, n in ((positive, np_), (unlabelled, nu)):
        for h in found:
            n[h] += 1
    a, b = len(positive), len(unlabelled)
    both = (np_ + nu + 1) / (a + b + 2)
    z = (np_ / a - nu / b) / np.sqrt(both * (1 - both) * (1 / a + 1 / b))
    z[(np_ + 0.5) / (a + 1) < LEAST_LIFT * (nu + 0.5) / (b + 1)] = 0
    picked = np.argsort(-z, kind="stable")[:FEATURES]
    picked = np.sort(picked[z[picked] >= LEAST_Z])
    if not len(picked):
        return empty
    best = picked[np.argsort(-z[picked], kind="stable")[:PURE]]
    prior = min(prior, max(0.005, ROOM * float((nu[best].sum() / b) / (np_[best].sum() / a))))
    model = Model(picked, np.zeros(len(picked)), 0.0)

    def matrix(found: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(found), len(picked)), np.float32)
        for i, h in enumerate(found):
            at = model.place[h]
            x[i, at[at >= 0]] = 1
        found.clear()  # what the matrix holds is not held twice
        return unit(x)

    w, bias = fit(matrix(positive), matrix(unlabelled), prior)
    return Model(picked, w, bias)


def model_of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    small_batches(spark)
    may = ~held_out(F.col("doc_id"))
    return train(docs.where(may).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").where(may).select("doc_id", "toxic"))


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "text", SLICE)):
            s = [shared.value.score(t) for t in b.column("text").to_pylist()]
            yield record_batch({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": s, "predicted": [int(x >= THRESHOLD) for x in s]}, OUT)

    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, in one pass and without a shuffle."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in (part for whole in batches for part in slices(whole, "text", SLICE)):
            yield b.filter(pa.array([shared.value.score(t) < THRESHOLD for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return scores(docs, model_of(spark, docs, sf_dir))
