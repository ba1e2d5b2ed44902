"""Joins on keys that may be null: null is a key like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined to right where all keys are the same; the keys appear once, as in left."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = None
    for k in keys:
        same = left[k].eqNullSafe(other[f"_right_{k}"])
        on = same if on is None else on & same
    joined = left.join(other, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{k}" for k in keys])
