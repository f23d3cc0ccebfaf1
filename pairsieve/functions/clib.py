"""Logarithms, powers and rounding with the last bit of the C library.

Spark's ``log2`` and ``pow`` are those of Java and differ from the C library's
in the last bit of some values. Where a result is a difference of large numbers,
rounded to many places, that bit decides; such results take these functions,
one Arrow call on a batch of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _power(base: float, exponent: float) -> float:
    try:
        return math.pow(base, exponent)
    except OverflowError:
        return math.inf if base > 0 or exponent % 2 == 0 else -math.inf
    except ValueError:  # a negative base has no root, 0 no reciprocal
        return math.inf if base == 0 else math.nan


# named as Spark shows its own functions in a plan
def LOG2(x: pa.Array) -> pa.Array:  # noqa: N802
    value = x.to_numpy(zero_copy_only=False)
    none = (value <= 0) | x.is_null().to_numpy(zero_copy_only=False)
    return pa.array(np.array([*map(math.log2, np.where(none, 1.0, value).tolist())], np.float64), mask=none)


def POWER(base: pa.Array, exponent: pa.Array) -> pa.Array:  # noqa: N802
    b, e = base.to_numpy(zero_copy_only=False), exponent.to_numpy(zero_copy_only=False)
    none = base.is_null().to_numpy(zero_copy_only=False) | exponent.is_null().to_numpy(zero_copy_only=False)
    return pa.array(np.array([*map(_power, np.where(none, 1.0, b).tolist(), np.where(none, 1.0, e).tolist())], np.float64), mask=none)


def log2(x: Column) -> Column:
    """NULL where ``x`` is not above 0."""
    return F.arrow_udf(LOG2, "double")(x)


def power(base: Column, exponent: Column) -> Column:
    return F.arrow_udf(POWER, "double")(base, exponent)


def round_half(x: Column, places: int) -> Column:
    """Halves of the product away from zero, as C's ``round``; Spark rounds the decimal digits of the number itself."""
    scale = F.lit(float(10**places))
    return F.round(x * scale, 0) / scale
