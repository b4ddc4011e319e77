"""JSON: leaves of a document as rows, and subset scores between two leaf tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "pattern", "kind", "value")])


def walk(value, path: str = "") -> Iterator[tuple[str, str, str]]:
    """(path, kind, text) of every leaf; an empty object or array is a leaf of its own."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")
    else:
        kind = {bool: "bool", int: "number", float: "number", str: "string", type(None): "null", dict: "object", list: "array"}[type(value)]
        yield path, kind, value if isinstance(value, str) else json.dumps(value)


@F.udtf(returnType=LEAF, useArrow=True)
class Leaves:
    """Leaves of a JSON text; none if it does not parse."""

    def eval(self, document: str):
        try:
            value = json.loads(document) if document else None
        except ValueError:
            return
        for path, kind, text in walk(value):
            yield path, re.sub(r"\[\d+\]", "[*]", path), kind, text


def leaves(docs: DataFrame, key: str, column: str) -> DataFrame:
    return docs.select(key, F.col(column).alias("_json")).lateralJoin(Leaves(F.col("_json").outer())).select(key, *LEAF.names)


def flat_leaves(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Leaves of an object without nesting, by built-in functions alone."""
    return docs.select(key, F.explode(F.from_json(column, "map<string,string>")).alias("path", "value"))


def subset(true: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """By document: the share of true leaves whose path the prediction has with an equal value; extra leaves cost nothing."""
    said = predicted.select(key, "path", F.col("value").alias("said"))
    both = true.join(said, [key, "path"], "left")
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("n_leaves"), F.round(F.avg(F.col("value").eqNullSafe(F.col("said")).cast("double")), 6).alias("score"))


def pattern(path: Column) -> Column:
    return F.regexp_replace(path, r"\[[0-9]+\]", "[*]")
