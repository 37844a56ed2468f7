"""Functions over JSON documents of any shape and Unicode forms, in Arrow batches."""

from __future__ import annotations

import json
import math
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower())


def nfkc_lower(c: Column) -> Column:
    """Width and compatibility forms folded, lower case."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        # text by text: a batch is held as it came and as it goes, never as strings
        return pa.array((None if (t := x.as_py()) is None else unicodedata.normalize("NFKC", t).lower() for x in texts), pa.string())

    return run(c)


def merged(old, new):
    """new over old, member by member; nulls change nothing."""
    out = dict(old or {})
    for name, value in (new or {}).items():
        if isinstance(value, dict):
            out[name] = merged(out[name] if isinstance(out.get(name), dict) else None, value)
        elif value is not None:
            out[name] = value
    return out


def deep_merge(base: Column, patch: Column) -> Column:
    """Two JSON objects as one; what is not an object counts as empty."""

    def load(text):
        try:
            value = json.loads(text) if text else {}
        except ValueError:
            value = {}
        return value if isinstance(value, dict) else {}

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(merged(load(x), load(y)), ensure_ascii=False, sort_keys=True) for x, y in zip(a, b, strict=True)])

    return run(base, patch)


def storable(value, depth: int, drop: frozenset):
    if depth == 0:
        return "<max_depth_reached>"
    if isinstance(value, dict):
        return {k: storable(v, depth - 1, drop) for k, v in value.items() if k not in drop}
    if isinstance(value, list):
        return [storable(v, depth - 1, drop) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def json_safe(c: Column, depth: int = 6, drop: tuple = ("element",)) -> Column:
    """JSON without the named members, not-a-numbers as null, and nothing below the depth."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(storable(json.loads(t), depth, frozenset(drop)), ensure_ascii=False, sort_keys=True))

    return run(c)


def json_empty(c: Column) -> Column:
    """Missing, null, or a document without members or items, however it is spaced."""
    return F.coalesce(F.regexp_replace(c, r"\s", "").isin("", "null", "{}", "[]"), F.lit(True))


def json_number(c: Column, name: str) -> Column:
    """A member as a whole number, or null."""
    return F.get_json_object(c, f"$.{name}").try_cast("long")


def nested(name: str, members: dict[str, Column]) -> Column:
    """A JSON document with the members under one name."""
    return F.to_json(F.struct(F.struct(*[v.alias(k) for k, v in members.items()]).alias(name)))
