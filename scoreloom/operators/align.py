"""Alignment: exact peels and identity keys by hash joins; only what remains goes to bounded assignment kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels

#: Cells of one assignment matrix, as in the reference; beyond it the rows of a piece stay unmatched, each with a row that says so.
MOST_CELLS = 100_000_000


def peel(true: DataFrame, predicted: DataFrame, group: str, row: str, fields: list[str]) -> DataFrame:
    """Rows equal in all fields pair off, the n-th of a value with the n-th: group, true row, predicted row."""
    number = lambda d: d.withColumn("_n", F.row_number().over(W.partitionBy(group, *fields).orderBy(row)))
    a, b = number(true).withColumnRenamed(row, "true_row"), number(predicted).withColumnRenamed(row, "predicted_row")
    return a.join(b, [group, "_n", *fields]).select(group, "true_row", "predicted_row")


def by_identity(true: DataFrame, predicted: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Rows of equal identity pair in list order; what only one side has keeps a null."""
    number = lambda d, to: d.select(*keys, F.col(row).alias(to)).withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(to)))
    return number(true, "true_row").join(number(predicted, "predicted_row"), [*keys, "_n"], "full").drop("_n")


def unique_identity(true: DataFrame, predicted: DataFrame, key: str, row: str) -> DataFrame:
    """Rows pair only where their key occurs once on both sides."""
    once = lambda d, to: d.groupBy(key).agg(F.min(row).alias(to), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return once(true, "true_row").join(once(predicted, "predicted_row"), key)


def pieces(a: list[np.ndarray], b: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows (of a, of b; a column a field) that are tied by equal values, directly or through others: no pair across pieces has an equal field."""
    n, up, seen = len(a[0]), list(range(len(a[0]) + len(b[0]))), {}

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for f, (x, y) in enumerate(zip(a, b, strict=True)):
        for i, value in enumerate([*x, *y]):
            up[root(i)] = root(seen.setdefault((f, value), i))
    of = np.array([root(i) for i in range(len(up))])
    order = np.argsort(of, kind="stable")
    return [(g[g < n], g[g >= n] - n) for g in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)]


def assign(true: DataFrame, predicted: DataFrame, group: str, row: str, fields: list[str], buckets: int | None = None) -> DataFrame:
    """Assignment of the rows of a group at the least number of differing fields: group, true row, predicted row, n_same, complete.

    Rows that are equal in all fields are peeled off by a join first, so that the kernel sees only what remains. Small groups share a
    call of the kernel, a bucket of them; there are eight buckets a shuffle partition unless ``buckets`` says otherwise. A group whose matrix is too large is assigned piece by piece of rows that share values, and
    what is left is paired in order, with nothing equal: the same least cost. Only the rows of a piece that is too large by itself are not
    assigned: each, of either side, comes with a null partner and complete = false.
    """
    equal = peel(true, predicted, group, row, fields)
    rest_true = true.join(equal.select(group, F.col("true_row").alias(row)), [group, row], "left_anti")
    rest_predicted = predicted.join(equal.select(group, F.col("predicted_row").alias(row)), [group, row], "left_anti")
    names = [group, "true_row", "predicted_row", "n_same", "complete"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            a, b = a.sort_values(row), b.sort_values(row)
            of_b = b.groupby(group).indices
            for key, at in a.groupby(group).indices.items():
                to = of_b.get(key)
                if to is None:
                    continue
                x, y = [a[f].to_numpy(object)[at] for f in fields], [b[f].to_numpy(object)[to] for f in fields]
                large = len(at) * len(to) > MOST_CELLS
                left = (set(range(len(at))), set(range(len(to)))) if large else (set(), set())
                for own, its in pieces(x, y) if large else [(np.arange(len(at)), np.arange(len(to)))]:
                    if len(own) * len(its) > MOST_CELLS:
                        out += [(key, int(a[row].iloc[at[i]]), None, 0, False) for i in own] + [(key, None, int(b[row].iloc[to[j]]), 0, False) for j in its]
                        left[0].difference_update(own.tolist())
                        left[1].difference_update(its.tolist())
                    elif len(own) and len(its):
                        same = np.zeros((len(own), len(its)), np.int16)
                        for v, w in zip(x, y, strict=True):
                            same += v[own][:, None] == w[its][None]
                        pairs = [(own[i], its[j], int(same[i, j])) for i, j in kernels.assign(-same) if same[i, j] or not large]
                        out += [(key, int(a[row].iloc[at[i]]), int(b[row].iloc[to[j]]), n, True) for i, j, n in pairs]
                        for k in (0, 1):
                            left[k].difference_update(int(p[k]) for p in pairs)
                out += [(key, int(a[row].iloc[at[i]]), int(b[row].iloc[to[j]]), 0, True) for i, j in zip(*map(sorted, left), strict=False)]
        return pd.DataFrame(out, columns=names).astype({"true_row": "Int64", "predicted_row": "Int64"})

    buckets = buckets or 8 * int(true.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(group), F.lit(buckets)).alias("_bucket")
    # names of its own: the two sides may come from one plan
    sides = [d.select(bucket, *[F.col(c).alias(c) for c in (group, row, *fields)]).groupBy("_bucket") for d in (rest_true, rest_predicted)]
    kind = dict(true.dtypes)[group]
    found = sides[0].cogroup(sides[1]).applyInPandas(run, f"{group} {kind}, true_row bigint, predicted_row bigint, n_same bigint, complete boolean")
    return equal.select(group, "true_row", "predicted_row", F.lit(len(fields)).cast("long").alias("n_same"), F.lit(True).alias("complete")).unionByName(found)


def key_quality(true: DataFrame, predicted: DataFrame, fields: list[str]) -> DataFrame:
    """How well each field would do as a key: the share of distinct values on either side and their overlap, best first.

    A field may serve from a distinct share of 0.9 and an overlap of 0.2 on (``usable``). One pass a side: fields are laid out as rows.
    """

    def values(d: DataFrame, n: str) -> DataFrame:
        named = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
        return d.select(F.explode(named).alias("x")).select("x.*").where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias(n))

    both = values(true, "a").join(values(predicted, "b"), ["field", "value"], "full").fillna(0, ["a", "b"])
    have = lambda c: F.sum((F.col(c) > 0).cast("long"))
    met = F.sum(((F.col("a") > 0) & (F.col("b") > 0)).cast("long"))
    ratio = lambda x, y: F.round(F.when(y > 0, x / y).otherwise(0.0), 6)
    t = both.groupBy("field").agg(ratio(have("a"), F.sum("a")).alias("unique_true"), ratio(have("b"), F.sum("b")).alias("unique_predicted"), ratio(met, F.least(have("a"), have("b"))).alias("overlap"))
    return t.withColumn("usable", (F.col("unique_true") >= 0.9) & (F.col("unique_predicted") >= 0.9) & (F.col("overlap") >= 0.2))


def distinctive(true: DataFrame, predicted: DataFrame, row: str, fields: list[str]) -> DataFrame:
    """Rows that share values which occur once on either side; each true row takes the partner with most of them, the smaller row of equals.

    A partner that several rows would take goes to the one with most shared values.
    """

    def once(d: DataFrame, to: str) -> DataFrame:
        named = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
        flat = d.select(F.col(row).alias(to), F.explode(named).alias("x")).select(to, "x.*").where("value is not null")
        return flat.groupBy("field", "value").agg(F.min(to).alias(to), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")

    votes = once(true, "true_row").join(once(predicted, "predicted_row"), ["field", "value"]).groupBy("true_row", "predicted_row").agg(F.count(F.lit(1)).alias("n_shared"))
    best = votes.groupBy("true_row").agg(F.max_by(F.struct("predicted_row", "n_shared"), F.struct("n_shared", -F.col("predicted_row"))).alias("x")).select("true_row", "x.*")
    return best.groupBy("predicted_row").agg(F.max_by(F.struct("true_row", "n_shared"), F.struct("n_shared", -F.col("true_row"))).alias("x")).select("x.true_row", "predicted_row", "x.n_shared")
