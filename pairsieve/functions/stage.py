"""Compute-once columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns behind a one-row generator.

    A filter on a plain computed column is pushed below the projection with
    its whole formula written out once per use; for formulas built on
    formulas that multiplies the work. A generator keeps the columns as
    values: later filters and projections read them. It stays inside
    whole-stage codegen and moves no rows.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(n) for n, v in cols.items()]))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once.

    For expressions inside ``aggregate`` and ``transform``, where common
    subexpressions are not shared.
    """
    return F.transform(F.array(value), use)[0]
