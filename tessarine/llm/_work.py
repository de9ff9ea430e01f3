"""Joins that stay even when one key holds a large part of the rows, and the shared working tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.shared import free, materialize, shared_dir, work_path

__all__ = ["free", "join_counted", "materialize", "shared_dir", "work_path"]

HOT_PARTS = 1000
"""A key is hot when it holds 1/HOT_PARTS of all rows, so at most HOT_PARTS keys are hot."""


def join_counted(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``left`` with ``right``, which has one row per key and in ``n_rows`` how many rows of ``left`` hold it.

    Keys with at least 1/HOT_PARTS of ``total`` are at most HOT_PARTS rows and are broadcast; all others are
    shuffled, and none of those can fill a task. ``how``: inner or left. Null keys match nothing.
    """
    least = max(1000, total // HOT_PARTS)
    hot = right.filter(F.col("n_rows") >= least)
    cold = right.filter(F.col("n_rows") < least).drop("n_rows")
    of_hot = left.join(F.broadcast(hot.drop("n_rows")), key)
    of_cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return of_hot.unionByName(of_cold)
