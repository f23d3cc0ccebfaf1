"""Small helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _Columns:
    """``k.name`` is ``F.col("name")``, resolved when a query runs."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


k = _Columns()


def tidy(df: DataFrame, nd: int = 9, **places: int) -> DataFrame:
    """Doubles rounded (``nd`` digits, or as named), whole numbers as BIGINT."""
    fixed = []
    for name, t in df.dtypes:
        col = F.col(f"`{name}`")
        if t in ("double", "float"):
            # adding 0.0 turns a negative zero into zero
            fixed.append((F.round(col.cast("double"), places.get(name, nd)) + F.lit(0.0)).alias(name))
        elif t in ("int", "tinyint", "smallint"):
            fixed.append(col.cast("bigint").alias(name))
        else:
            fixed.append(col)
    return df.select(*fixed)


def out(df: DataFrame, key: str = "sample_key", nd: int = 9, places: dict[str, int] | None = None, **cols: Column) -> DataFrame:
    """Key plus computed columns, tidied."""
    return tidy(df.select(key, *[v.alias(n) for n, v in cols.items()]), nd, **(places or {}))
