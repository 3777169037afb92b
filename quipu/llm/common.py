"""Helpers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quipu.operators.lineage import bounded, cut, drop, folder, place, small, store
from quipu.operators.timestamps import name_key

__all__ = ["bounded", "cut", "drop", "folder", "name_key", "null_if_blank", "place", "small", "store"]


def null_if_blank(c: Column) -> Column:
    """Missing for null, blank and the word nan."""
    return F.when(F.lower(F.trim(c)).isin("", "nan", "none", "null"), None).otherwise(c)
