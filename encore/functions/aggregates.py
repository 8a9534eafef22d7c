"""Aggregate helpers shared by the stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_true(c: Column) -> Column:
    """COUNTIF(flag): NULL counts as not true."""
    return F.count_if(F.coalesce(c, F.lit(False)))


def flag(c: Column) -> Column:
    """1 where true, 0 where false or NULL: its sum is COUNTIF."""
    return F.when(c, 1).otherwise(0).cast("long")


def count_all() -> Column:
    return F.count(F.lit(1))
