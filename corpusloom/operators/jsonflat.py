"""String leaves of JSON documents with their key paths.

Spark's JSON functions need a schema or a bounded depth, so the walk over
documents of any shape is a Python table function fed by Arrow batches.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaves(value, path: str = ""):
    """``(path, text)`` of the strings in a parsed document: dots between keys, ``[i]`` for items; iterative, so of any depth."""
    todo = [(path, value)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, str):
            if path:
                yield path, value
        elif isinstance(value, list):
            todo += [(f"{path}[{i}]", v) for i, v in reversed([*enumerate(value)])]
        elif isinstance(value, dict):
            todo += [(f"{path}.{k}" if path else k, v) for k, v in reversed(value.items())]


_LEAVES = T.ArrayType(T.StructType([T.StructField("key_path", T.StringType()), T.StructField("value", T.StringType())]))


def _no_number(name: str):
    """NaN and the infinities are no JSON."""
    raise ValueError(f"{name} is not a JSON number")


@F.arrow_udf(T.StructType([T.StructField("leaves", _LEAVES), T.StructField("error", T.StringType())]))
def _flat(texts: pa.Array) -> pa.Array:
    found, errors = [], []
    for t in texts.to_pylist():
        try:
            found.append([{"key_path": p, "value": v} for p, v in leaves(json.loads(t, parse_constant=_no_number))] if t is not None else [])
            errors.append(None)
        except (ValueError, RecursionError) as e:
            found.append([])
            errors.append(f"Failed to parse JSON: {e}")
    return pa.StructArray.from_arrays([pa.array(found, pa.list_(pa.struct([("key_path", pa.string()), ("value", pa.string())]))), pa.array(errors, pa.string())], ["leaves", "error"])


def string_leaves(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``key_path, value`` of every string leaf.  Null and broken documents have none; see ``parse_errors``."""
    each = docs.select(*keep, F.explode(_flat(F.col(text_col))["leaves"]).alias("leaf"))
    return each.select(*keep, "leaf.key_path", "leaf.value")


def parse_errors(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return docs.select(*keep, _flat(F.col(text_col))["error"].alias("error")).where("error is not null")
