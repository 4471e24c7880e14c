"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_by_md5(ids: DataFrame, n: int) -> DataFrame:
    """``n`` rows of ``ids`` (a column id, and others), those with the least MD5 of their id."""
    return ids.orderBy(F.md5(F.col("id").cast("string")), "id").limit(n)
