"""Order-dependent operators that never put one key in one task.

A plain window ``partitionBy(session)`` sorts a whole session in one task,
which fails when one session holds a third of the table. Here the order
column is cut in buckets, the window runs inside (key, bucket), and what
must be carried from bucket to bucket comes from a small summary table with
one row per (key, bucket). The summary is aggregated map-side. Its join
back uses the same partitioning as the window. Input that is costly to
compute is read by both branches; write it first where that matters.

For an integer order column that is unique within the key, a bucket holds
at most ``width`` rows. For md5 text the bucket is a digit prefix, as long
as the size of the table asks for. Numbers of any spread are cut at quantiles
(``equi_depth``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16
LEAST_DIGITS, MOST_DIGITS = 3, 10
ROW_BYTES = 32  # estimated size of a row at least


def bucket_of(order: str, width: int = WIDTH) -> Column:
    return F.floor(F.col(order) / width)


def prefix_digits(df: DataFrame) -> int:
    """Hex digits with which a prefix holds about WIDTH rows, from the optimizer's size estimate (no job)."""
    return digits_for(int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // ROW_BYTES)


def digits_for(rows: int) -> int:
    """The same for a known number of rows."""
    prefixes = max(1, rows // WIDTH)
    return min(MOST_DIGITS, max(LEAST_DIGITS, -(-(prefixes.bit_length() - 1) // 4)))


def prefix_of(order: str, digits: int = LEAST_DIGITS) -> Column:
    return F.substring(F.col(order), 1, digits)


SPLITTER_SLACK = 8  # places a splitter may be off, in parts of a bucket


def equi_depth(df: DataFrame, value: str, width: int = WIDTH) -> Callable[[DataFrame], DataFrame]:
    """Cuts a numeric order into buckets of about ``width`` rows, whatever the spread of its values.

    Splitters come from a mergeable quantile summary of ``value`` (one
    aggregate; its size is bounded by the number of buckets). Returns a
    function that adds ``_b``, the bucket, to a table; rows of equal values
    share one, nulls have one of their own.
    """
    rows = df.agg(F.count(value)).first()[0]
    buckets = -(-rows // width)
    if buckets <= 1:
        return lambda t: t.withColumn("_b", F.when(F.col(value).isNull(), F.lit(-1)).otherwise(F.lit(0)))
    shares = F.array(*[F.lit(k / buckets) for k in range(1, buckets)]) if buckets <= 64 else F.expr(f"transform(sequence(1, {buckets - 1}), k -> cast(k / {buckets}D AS DOUBLE))")
    cuts = df.agg(F.percentile_approx(F.col(value).cast("double"), shares, min(SPLITTER_SLACK * buckets, (1 << 31) - 1)).alias("cuts")).first()["cuts"]
    splits = [-math.inf, *sorted({x for x in cuts if math.isfinite(x)}), math.inf]
    model = Bucketizer(splits=splits, inputCol="_as_double", outputCol="_bucket", handleInvalid="keep")  # binary search in the JVM

    def cut(t: DataFrame) -> DataFrame:
        placed = model.transform(t.withColumn("_as_double", F.col(value).cast("double")))
        return placed.withColumn("_b", F.when(F.col(value).isNull(), F.lit(-1)).otherwise(F.col("_bucket").cast("int"))).drop("_as_double", "_bucket")

    return cut


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    specs: dict[str, tuple[str, Column]],
    bucket: Column | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Running sum, min, max or count along ``order`` within ``keys``.

    ``specs`` maps an output name to (function, value). With
    ``inclusive=False`` the current row is left out (NULL, or 0 for sums
    and counts, on the first row). ``order`` must be unique within the key.
    """
    base = df.withColumn("_b", bucket if bucket is not None else bucket_of(order))
    for name, (_, value) in specs.items():
        base = base.withColumn(f"_v_{name}", value)
    fold = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    totals = base.groupBy(*keys, "_b").agg(
        *[fold[fn](F.col(f"_v_{name}")).alias(f"_t_{name}") for name, (fn, _) in specs.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    again = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}
    carried = totals.select(
        *keys,
        "_b",
        *[again[fn](F.col(f"_t_{name}")).over(before).alias(f"_c_{name}") for name, (fn, _) in specs.items()],
    )
    local = Window.partitionBy(*keys, "_b").orderBy(order)
    local = local.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    windowed = base.select(
        *base.columns,
        *[fold[fn](F.col(f"_v_{name}")).over(local).alias(f"_l_{name}") for name, (fn, _) in specs.items()],
    )
    joined = windowed.join(carried, [*keys, "_b"], "left")

    def merge(name: str, fn: str) -> Column:
        here, there = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if fn in ("sum", "count"):
            zero = F.lit(0)
            return F.coalesce(here, zero) + F.coalesce(there, zero)
        return F.least(here, there) if fn == "min" else F.greatest(here, there)

    return joined.select(*df.columns, *[merge(name, fn).alias(name) for name, (fn, _) in specs.items()])


def positions(
    df: DataFrame, keys: list[str], order: str, out: str = "pos", start: int = 1, bucket: Column | None = None
) -> DataFrame:
    """Dense position (from ``start``) along ``order`` within ``keys``."""
    base = df.withColumn("_b", bucket if bucket is not None else bucket_of(order))
    counts = base.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c"))
    numbered = base.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(order)))
    joined = numbered.join(carried, [*keys, "_b"])
    return joined.select(*df.columns, (F.col("_c") + F.col("_r") + (start - 1)).cast("bigint").alias(out))


def positions_in(df: DataFrame, keys: list[str], order: str, subsets: dict[str, Column], start: int = 0, bucket: Column | None = None) -> DataFrame:
    """Dense positions along ``order`` in several subsets of each key at once, NULL outside a subset.

    ``subsets`` maps an output name to a flag. One summary counts all flags per
    bucket, and one window counts them within it; so nested subsets cost one
    scan for the summary and one for the rows, however many they are.
    """
    base = df.withColumn("_b", bucket if bucket is not None else bucket_of(order))
    base = base.select("*", *[F.coalesce(flag, F.lit(False)).cast("int").alias(f"_f_{name}") for name, flag in subsets.items()])
    counts = base.groupBy(*keys, "_b").agg(*[F.sum(f"_f_{name}").alias(f"_n_{name}") for name in subsets])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(*keys, "_b", *[F.coalesce(F.sum(f"_n_{name}").over(before), F.lit(0)).alias(f"_c_{name}") for name in subsets])
    upto = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = base.select("*", *[F.sum(f"_f_{name}").over(upto).alias(f"_r_{name}") for name in subsets])
    joined = placed.join(carried, [*keys, "_b"])
    place = lambda name: F.when(F.col(f"_f_{name}") == 1, F.col(f"_c_{name}") + F.col(f"_r_{name}") + (start - 1)).cast("bigint")
    return joined.select(*[F.col(n) for n in df.columns if n not in subsets], *[place(name).alias(name) for name in subsets])


def previous(
    df: DataFrame, keys: list[str], order: str, values: dict[str, Column], bucket: Column | None = None
) -> DataFrame:
    """Values of the row just before, in order, within ``keys`` (NULL on the first)."""
    base = df.withColumn("_b", bucket if bucket is not None else bucket_of(order))
    base = base.withColumn("_s", F.struct(*[v.alias(k) for k, v in values.items()]))
    last = base.groupBy(*keys, "_b").agg(F.max_by("_s", order).alias("_last"))
    carried = last.select(*keys, "_b", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")).alias("_carry"))
    local = base.withColumn("_p", F.lag("_s").over(Window.partitionBy(*keys, "_b").orderBy(order)))
    joined = local.join(carried, [*keys, "_b"], "left")
    prev = F.coalesce(F.col("_p"), F.col("_carry"))
    return joined.select(*df.columns, *[prev[k].alias(k) for k in values])


def mark_smallest(
    df: DataFrame,
    keys: list[str],
    digest: str,
    size: Callable[[Column], Column],
    out: str,
    digits: int | None = None,
) -> DataFrame:
    """Exact-size random subset: flag the rows with the smallest digests in each key.

    ``size`` maps the row count of a key to the wanted number. A histogram
    over digest prefixes finds the prefix at which that number is reached;
    rows below it are in, rows above it are out, and the rank inside the one
    prefix decides the rest. The rank runs per (key, prefix), so no key is
    ever sorted as a whole.
    """
    base = df.withColumn("_p", prefix_of(digest, digits or prefix_digits(df)))
    hist = base.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # the size of a key is added up from the histogram; keys are rows here, not groups
    need = hist.select(
        *keys, "_p", "_n",
        (size(F.sum("_n").over(Window.partitionBy(*keys))) - F.coalesce(F.sum("_n").over(upto), F.lit(0))).alias("_need"),
    ).where(F.col("_need") > 0)
    joined = base.join(need, [*keys, "_p"], "left")
    split = F.coalesce(F.col("_need") < F.col("_n"), F.lit(False))  # only here the rank decides
    rank = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(digest))
    whole = joined.where(~split).select(*df.columns, F.col("_need").isNotNull().alias(out))
    ranked = joined.where(split).withColumn("_r", rank).select(*df.columns, (F.col("_r") <= F.col("_need")).alias(out))
    return whole.unionByName(ranked)
