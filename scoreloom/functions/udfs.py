"""Python kernels as columns: Arrow batches, each distinct row of arguments computed once a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows whose tokens are counted at once.
ROWS = 512


def vectorised(f: Callable, returns: str) -> Callable[..., Column]:
    """A column of f(*arguments); arguments are columns, f gets Python values (None for null)."""

    @F.pandas_udf(returns)
    def run(*columns: pd.Series) -> pd.Series:
        seen: dict[tuple, object] = {}
        out = []
        for row in zip(*columns, strict=True):
            row = tuple(None if v is None or v is pd.NA or isinstance(v, float) and v != v else v for v in row)
            if row not in seen:
                seen[row] = f(*row)
            out.append(seen[row])
        return pd.Series(out, dtype=object)

    return run


def structured(f: Callable, returns: str) -> Callable[..., Column]:
    """Like ``vectorised``, for a function that returns a tuple of the fields of a struct."""
    names = [part.strip().split(" ")[0] for part in returns.split(",")]

    @F.pandas_udf(f"struct<{', '.join(':'.join(p.strip().split(' ', 1)) for p in returns.split(','))}>")
    def run(*columns: pd.Series) -> pd.DataFrame:
        seen: dict[tuple, tuple] = {}
        out = []
        for row in zip(*columns, strict=True):
            row = tuple(None if v is None or v is pd.NA or isinstance(v, float) and v != v else v for v in row)
            if row not in seen:
                seen[row] = tuple(f(*row))
            out.append(seen[row])
        return pd.DataFrame(out, columns=names)

    return run


def overlaps(rows: DataFrame, keep: list[str], a: str, b: str) -> DataFrame:
    """``keep`` and, of two token arrays in each row: n_a, n_b, same (their multiset overlap), n_too_many (tokens of a that b has more often).

    Rows stay where they are: tokens are counted batch by batch, with no shuffle. A null array is empty.
    """
    at = rows.select(*keep, F.col(a).alias("_a"), F.col(b).alias("_b"))
    found = ("n_a", "n_b", "same", "n_too_many")

    def counted(part: pa.RecordBatch) -> list[np.ndarray]:
        sizes = [np.asarray(part.column(c).value_lengths().fill_null(0), np.int64) for c in ("_a", "_b")]
        token = pa.concat_arrays([part.column(c).flatten() for c in ("_a", "_b")]).dictionary_encode(null_encoding="encode")
        code, wide, n = np.asarray(token.indices, np.int64), len(token.dictionary) + 1, part.num_rows
        cut = int(sizes[0].sum())
        (x, cx), (y, cy) = (np.unique(np.repeat(np.arange(n), size) * wide + own, return_counts=True) for size, own in zip(sizes, (code[:cut], code[cut:]), strict=True))
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        owner = x[i] // wide
        return [*sizes, np.bincount(owner, np.minimum(cx[i], cy[j]), n).astype(np.int64), np.bincount(owner, cy[j] > cx[i], n).astype(np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *map(pa.array, counted(part))], names=[*keep, *found])

    schema = T.StructType([*[at.schema[c] for c in keep], *[T.StructField(c, T.LongType()) for c in found]])
    return at.mapInArrow(run, schema)
