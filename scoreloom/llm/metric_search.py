"""Exact top-k by integer inner product: best-first search in M-trees.

A vector x gets one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm of all, and a query a zero; then
d(q, x)^2 = |q|^2 + M^2 - 2 q.x, so the highest inner products are the nearest in a metric. Rows go to the cell of the nearest of
at most PIVOTS pivots, rows picked by hash, and each cell to trees of about TREE vectors. A tree is built top-down into pages: an inner page holds for each child its pivot, covering radius and distance to the
parent's pivot, a leaf its vectors and their distances to the leaf's pivot. The search keeps pages in a queue by their least
possible distance and stops at the first that cannot reach the k-th best. Stored distances give |d(q, p) - d(x, p)| <= d(q, x),
which spares computing d for entries and children. Bounds have a slack for rounding; scores are integers.

A query first meets one tree of the cell of its nearest pivot, whose k-th score it takes along; then the trees of those cells whose ball
(pivot and covering radius) may hold something as good, in blocks of queries. The best k of each meeting are ranked once more for each query. Vectors
that fill space evenly leave no cell out: then every query meets every tree.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do empty ones; shorter
vectors count as padded with zeros; a row is not a candidate for itself, but a repeated row is; ties go to the smaller vec_id; fewer than k
candidates are all returned; an empty table gives no rows. Scaled components beyond 2^62 are held to it; products
beyond 2^53 are added with unbounded integers and held to the range of long.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .near_dedup import groups
from .shared import Scratch, deal, record_batch

TREE, BLOCK, LEAF, FAN = 8192, 2048, 512, 16
#: Pivots of cells, and the bytes that they may have.
PIVOTS, PIVOT_BYTES = 1024, 8 << 20
TOP, EVERY = 5, 50
SLACK = 1e-9
ITEM = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("vec", pa.binary()), ("norm", pa.float64()), ("size", pa.int32())])


def items(embeddings: DataFrame) -> DataFrame:
    """row, vec_id, vec (floor(256 * x) as packed int64), norm (squared), size of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in ITEM}
            for row, vec_id, x in zip(b.column("row").to_pylist(), b.column("vec_id").to_pylist(), b.column("embedding"), strict=True):
                if not x.is_valid or not len(x) or x.values.null_count:
                    continue
                v = np.asarray(x.values, np.float64)
                if np.isfinite(v).all():
                    v = np.clip(np.floor(256 * v), -(2.0**62), 2.0**62)
                    for k, y in zip(out, (row, vec_id, v.astype(np.int64).tobytes(), float(v @ v), len(v)), strict=True):
                        out[k].append(y)
            yield record_batch(out, ITEM)

    rows = embeddings.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(run, "row bigint, vec_id bigint, vec binary, norm double, size int")


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        x = np.frombuffer(v, np.int64)
        out[i, : len(x)] = x
    return out


def slack_of(size: float, most: float) -> float:
    """What rounding may add to a distance. ``size``: the query's squared norm."""
    return SLACK * (np.sqrt(size) + np.sqrt(most) + 1)


def distance_of(size: float, most: float, score: float) -> float:
    return np.sqrt(max(0.0, size + most - 2.0 * score))


class Cells:
    """At most PIVOTS pivots as doubles, with one coordinate more; ``radii`` once they are known."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.plain, self.most = pivots.astype(np.float64), most
        self.last = np.sqrt(np.maximum(0, most - np.square(self.plain).sum(axis=1)))
        self.radii = np.zeros(len(pivots))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance from its pivot) of rows."""
        last = np.sqrt(np.maximum(0, self.most - np.square(vectors).sum(axis=1)))
        cell = (vectors @ self.plain.T + last[:, None] * self.last[None] - (np.square(self.plain).sum(axis=1) + self.last**2) / 2).argmax(axis=1)
        return cell, np.sqrt(np.square(vectors - self.plain[cell]).sum(axis=1) + np.square(last - self.last[cell]))

    def home(self, queries: np.ndarray) -> np.ndarray:
        return (queries @ self.plain.T - (np.square(self.plain).sum(axis=1) + self.last**2) / 2).argmax(axis=1)

    def open(self, q: np.ndarray, known: int | None) -> np.ndarray:
        """The cells whose ball may hold a score of at least ``known``."""
        if known is None:
            return np.arange(len(self.radii))
        size = float(q @ q)
        far = np.sqrt(np.square(self.plain - q).sum(axis=1) + self.last**2)
        return np.flatnonzero(far - self.radii <= distance_of(size, self.most, known) + 2 * slack_of(size, self.most))


class Tree:
    """Pages of one M-tree; ``x`` has the augmented vectors as doubles, ``whole`` the integers, both in the order of the leaves."""

    def __init__(self, whole: np.ndarray, rows: np.ndarray, ids: np.ndarray, most: float, seed: int):
        plain = whole.astype(np.float64)
        self.largest = float(np.abs(plain).max(initial=0))
        self.x = np.c_[plain, np.sqrt(np.maximum(0, most - (plain * plain).sum(axis=1)))]
        self.pages: list[dict] = []
        self.order: list[np.ndarray] = []
        self.filled = 0
        self.rng = np.random.default_rng(seed)
        self.top = self.x[0].copy() if len(whole) else None  # the pivot of the root
        self.root = self.page(np.arange(len(whole)), self.top) if len(whole) else None
        order = np.concatenate([*self.order, np.zeros(0, np.int64)])
        self.order = []
        self.whole, self.rows, self.ids, self.x = whole[order], rows[order], ids[order], self.x[order]
        self.plain = np.ascontiguousarray(self.x[:, :-1])

    def distances(self, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.sqrt(np.square(self.x[at] - to).sum(axis=1))

    def page(self, at: np.ndarray, pivot: np.ndarray) -> int:
        """The number of a page of the entries ``at`` around ``pivot``, children first."""
        d = self.distances(at, pivot)
        if len(at) <= LEAF or d.max() == d.min() == 0:
            order = np.argsort(d, kind="stable")
            self.order.append(at[order])
            self.pages.append({"leaf": True, "from": self.filled, "to": self.filled + len(at), "d": d[order]})
            self.filled += len(at)
            return len(self.pages) - 1
        seeds = self.x[self.rng.choice(at, min(FAN, len(at)), replace=False)]
        near = np.stack([self.distances(at, s) for s in seeds])
        owner = near.argmin(axis=0)
        parts = [at[owner == k] for k in range(len(seeds)) if (owner == k).any()]
        if len(parts) == 1:  # the seeds coincide: cut by distance from the pivot
            parts = np.array_split(at[np.argsort(d, kind="stable")], FAN)
        pivots = np.stack([self.x[p].mean(axis=0) for p in parts])
        children = [self.page(p, v) for p, v in zip(parts, pivots, strict=True)]
        radii = np.array([self.distances(p, v).max() for p, v in zip(parts, pivots, strict=True)])
        self.pages.append({"leaf": False, "pivots": pivots, "radii": radii, "d": np.sqrt(np.square(pivots - pivot).sum(axis=1)), "children": children})
        return len(self.pages) - 1

    def scores(self, at: slice | np.ndarray, q: np.ndarray, plain: np.ndarray, exact: bool) -> np.ndarray:
        if exact:
            return self.plain[at] @ plain
        limit = (1 << 63) - 1
        return np.array([max(-limit - 1, min(limit, int(s))) for s in self.whole[at].astype(object) @ q.astype(object)], object)

    def search(self, q: np.ndarray, row: int, most: float, k: int, known: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, -vec_id) of all vectors but that of ``row``; only those of at least the score ``known``, if it is given."""
        if self.root is None:
            return []
        plain = q.astype(np.float64)
        size = float(plain @ plain)
        exact = self.largest * float(np.abs(plain).max(initial=0)) * len(q) < 2.0**53
        target, slack = np.r_[plain, 0.0], slack_of(size, most)
        best: list[tuple[int, int]] = []
        worst = lambda: best[0][0] if len(best) == k else known

        def reach() -> float:
            """The distance of the k-th best: what is farther is worse."""
            return np.inf if worst() is None else distance_of(size, most, worst()) + slack

        queue, count = [(0.0, 0, self.root, float(np.sqrt(np.square(target - self.top).sum())))], 1
        while queue:
            low, _, number, from_pivot = heapq.heappop(queue)
            bound = reach()
            if low > bound:
                break
            page = self.pages[number]
            spared = np.abs(from_pivot - page["d"])
            if page["leaf"]:
                near = spared <= bound + slack
                some = 2 * np.count_nonzero(near) < len(near)
                at = page["from"] + np.flatnonzero(near) if some else slice(page["from"], page["to"])
                s = self.scores(at, q, plain, exact)
                good = range(len(s)) if worst() is None else np.flatnonzero(s >= worst())
                for i in good:
                    entry, place = (int(s[i]), -int(self.ids[at][i])), at[i] if some else page["from"] + i
                    if self.rows[place] == row or len(best) == k and entry <= best[0]:
                        continue
                    heapq.heappush(best, entry)
                    if len(best) > k:
                        heapq.heappop(best)
                continue
            open_ = np.flatnonzero(spared - page["radii"] <= bound + slack)
            d = np.sqrt(np.square(page["pivots"][open_] - target).sum(axis=1))
            for i, dist in zip(open_.tolist(), d.tolist(), strict=True):
                least = max(0.0, dist - page["radii"][i], spared[i] - page["radii"][i])
                if least <= bound + slack:
                    heapq.heappush(queue, (least, count, page["children"][i], dist))
                    count += 1
        return sorted(best, reverse=True)


def top(vectors: DataFrame, spark: SparkSession, wanted, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` (vec_id, embedding) that the condition ``wanted`` picks, against all rows."""
    scratch = Scratch(spark, "mtree")
    all_ = scratch.table(items(vectors), "items")
    told = all_.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most"), F.max("size").alias("width"), F.sum(wanted.cast("long")).alias("q")).first()
    blocks = max(1, -(-(told["q"] or 0) // BLOCK))
    most, width = float(told["most"] or 0.0) * (1 + 1e-12), told["width"] or 1
    n_cells = min(PIVOTS, max(1, PIVOT_BYTES // (8 * width)), max(1, -(-told["n"] // TREE)))
    chosen = all_.select("vec", F.xxhash64("row").alias("h")).orderBy("h").limit(n_cells).toPandas()  # at most PIVOT_BYTES
    cells = Cells(matrix(chosen["vec"].tolist() or [b""], width), most)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vec").to_pylist(), width).astype(np.float64)
            cell, d = cells.nearest(x)
            extra = [pa.array(cell, pa.int32()), pa.array(d, pa.float64()), pa.array(cells.home(x), pa.int32())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("row", "vec_id", "vec")], *extra], names=["row", "vec_id", "vec", "cell", "d", "home"])

    all_ = scratch.table(all_.select("row", "vec_id", "vec").mapInArrow(place, "row bigint, vec_id bigint, vec binary, cell int, d double, home int"), "placed")
    sizes, first = all_.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).toPandas(), []  # a row a cell
    lots, cells.radii = np.zeros(len(cells.radii), np.int64), np.full(len(cells.radii), -np.inf)
    lots[sizes["cell"]], cells.radii[sizes["cell"]] = -(-sizes["n"].to_numpy(np.int64) // TREE), sizes["d"]
    first = np.cumsum(lots) - lots
    trees = max(1, int(lots.sum()))
    laid = spark.createDataFrame(list(zip(range(len(lots)), first.tolist(), lots.tolist(), strict=True)), "cell int, first int, lots int")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "part"):
            tree = Tree(matrix(t.column("vec").to_pylist(), width), np.asarray(t.column("row")), np.asarray(t.column("vec_id")), most, 11)
            yield pa.RecordBatch.from_arrays([t.column("part").combine_chunks().slice(0, 1), pa.array([pickle.dumps(tree)], pa.binary())], names=["tree", "pages"])

    def meet(ids: tuple, tree: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(tree) and len(queries):  # an empty side comes without its columns
            built = pickle.loads(tree["pages"].iloc[0])
            known = [None if pd.isna(x) else int(x) for x in queries["known"]]
            for row, vec_id, v, least in zip(queries["row"], queries["vec_id"], matrix(queries["vec"].tolist(), width), known, strict=True):
                out += [(row, vec_id, -i, s) for s, i in built.search(v, row, most, k, least)]
        return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"])

    def met(asked: DataFrame) -> DataFrame:
        """What queries (row, vec_id, vec, tree, known) find in their trees."""
        asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), F.col("row")), F.lit(blocks)).cast("int"))
        # names of its own: the two sides come from one plan
        sides = built.join(asked.select("tree", "block").distinct(), "tree"), asked.select(*[F.col(c).alias(c) for c in ("tree", "block", "row", "vec_id", "vec", "known")])
        a, b = (side.groupBy("tree", "block") for side in sides)
        return a.cogroup(b).applyInPandas(meet, "row bigint, query_id bigint, vec_id bigint, score bigint")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vec").to_pylist(), width).astype(np.float64)
            own = [cells.open(v, least).tolist() for v, least in zip(x, b.column("known").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.list_(pa.int32()))], names=[*b.schema.names, "cells"])

    lot = F.pmod(F.xxhash64("row"), F.col("lots")).cast("int")
    parts = all_.join(F.broadcast(laid), "cell").select("row", "vec_id", "vec", (F.col("first") + lot).alias("part"))
    built = scratch.table(deal(parts, trees).sortWithinPartitions("part", "row").mapInArrow(build, "tree int, pages binary"), "trees")
    # first round: one tree of the nearest cell that has rows
    asked = all_.where(wanted).select("row", "vec_id", "vec", F.col("home").alias("cell")).join(F.broadcast(laid), "cell")
    asked = asked.select("row", "vec_id", "vec", F.when(F.col("lots") > 0, F.col("first") + lot).otherwise(0).alias("tree"), F.lit(None).cast("long").alias("known"))
    asked = scratch.table(asked, "asked")
    near = scratch.table(met(asked), "near")
    known = near.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("known"))
    # second round: all trees of the cells that may hold as good ones
    rest = asked.withColumnRenamed("tree", "seen").drop("known").join(known, "row", "left")
    rest = rest.mapInArrow(opened, "row bigint, vec_id bigint, vec binary, seen int, known bigint, cells array<int>")
    rest = rest.withColumn("cell", F.explode("cells")).drop("cells").join(F.broadcast(laid.where("lots > 0")), "cell")
    rest = rest.withColumn("tree", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("lots") - 1))).where("tree <> seen")
    found = near.unionByName(met(scratch.table(rest.select("row", "vec_id", "vec", "tree", "known"), "rest")))
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The TOP best of every row whose vec_id is divisible by EVERY, against all rows of ``embeddings``."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top(vectors, spark, F.col("vec_id") % EVERY == 0)


SQL = """
with v as (select vec_id, [floor(256 * x::double)::bigint for x in embedding] e from embeddings
           where embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
     s as (select q.vec_id as query_id, c.vec_id, list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)])::bigint as score
           from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
     r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
