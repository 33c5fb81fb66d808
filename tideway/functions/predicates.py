"""Predicates that are false, never null, for missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(x: Column) -> Column:
    """NULL for NaN; every double is passed through this at a boundary."""
    return F.when(~F.isnan(x), x)


def sure(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def abs_gt(x: Column, limit: float) -> Column:
    return sure(F.abs(known(x)) > limit)


def abs_le(x: Column, limit: float) -> Column:
    return sure(F.abs(known(x)) <= limit)


def ge(x: Column, limit: float) -> Column:
    return sure(known(x) >= limit)
