"""Finite automata along an order, without one task per key.

What a row does to the state is a small table (next state by state). Tables
compose, and composition is associative, so a key's rows can be cut in buckets:
each bucket's rows are composed to one table, the tables of a key's buckets are
scanned in order (one row a bucket), and within a bucket the state before each
row follows from the tables before it. A task reads its rows in order and keeps
one table; rows of one Arrow batch are composed by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import bucket_of

c = F.col
TABLE = "_table"
_LIST = pa.list_(pa.int32())


def then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Tables (rows) that do ``first``, then ``second``."""
    return np.take_along_axis(second, first, axis=1)


def prefix_composed(tables: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Composition of each row's table with all before it since the last row marked ``new``."""
    out, n = tables.copy(), len(tables)
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    while step < n:
        at = np.flatnonzero(np.arange(n) - step >= begin)
        if not len(at):
            break
        out[at] = then(out[at - step], out[at])
        step *= 2
    return out


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before (the first row: True)."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        a, b = batch.column(k).slice(1), batch.column(k).slice(0, batch.num_rows - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= differ | nulls
    return new


def _walk(keys: list[str], last_only: bool):
    """Arrow function over rows sorted by ``keys``: the composed table of each key, or what stands before each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, carry = None, None  # keys of the open segment (one row) and its table so far
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tables = batch.column(TABLE).flatten().to_numpy().reshape(n, -1)
            identity = np.arange(tables.shape[1], dtype=tables.dtype)
            new = _changes(batch, keys)
            joined = held is not None and not _changes(pa.Table.from_batches([held, batch.slice(0, 1).select(keys)]).combine_chunks().to_batches()[0], keys)[1]
            if joined:  # the open segment goes on: its table stands before the first row
                whole = prefix_composed(np.vstack((carry, tables)), np.concatenate(([True, False], new[1:])))[1:]
            else:
                whole = prefix_composed(tables, new)
            if last_only:
                if held is not None and not joined:
                    yield _with_tables(held, carry)
                ends = np.flatnonzero(new[1:])
                if len(ends):
                    yield _with_tables(batch.select(keys).take(pa.array(ends)), whole[ends])
            else:
                before = np.vstack((carry if joined else identity[None, :], whole[:-1]))
                if not joined:
                    before[0] = identity
                before[1:][new[1:]] = identity
                yield _with_tables(batch.drop_columns([TABLE]), before)
            held, carry = batch.slice(n - 1, 1).select(keys), whole[-1:]
        if last_only and held is not None:
            yield _with_tables(held, carry)

    return run


def _with_tables(rows: pa.RecordBatch, tables: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(tables) + 1) * tables.shape[1], pa.int32())
    column = pa.ListArray.from_arrays(offsets, pa.array(tables.ravel(), pa.int32()))
    return pa.RecordBatch.from_arrays([*rows.columns, column], [*rows.schema.names, TABLE])


def _scanned(df: DataFrame, keys: list[str], order: list[str], last_only: bool) -> DataFrame:
    fields = [df.schema[k] for k in keys] if last_only else [f for f in df.schema if f.name != TABLE]
    schema = T.StructType([*fields, T.StructField(TABLE, T.ArrayType(T.IntegerType()))])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(_walk(keys, last_only), schema)


def transition(*targets: int) -> Column:
    """A table: the state that follows each state."""
    return F.array(*[F.lit(t) for t in targets])


def states_along(
    df: DataFrame, keys: list[str], order: str, table: Column, start: DataFrame | None = None, first_state: int = 0, bucket: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``state`` (before each row), and (keys, ``state``) after all rows of each key.

    ``table`` gives for every row the state that follows each state; all tables
    have the same length and no nulls. ``start`` has keys and ``state`` for
    keys that begin elsewhere than in ``first_state``. Rows of equal order are
    taken in any order; null keys are keys like others.
    """
    base = df.withColumn(TABLE, table.cast("array<int>")).withColumn("_b", bucket if bucket is not None else bucket_of(order))
    parts = _scanned(base.select(*keys, "_b", order, TABLE), [*keys, "_b"], [order], True)
    carried = _scanned(parts, keys, ["_b"], False).withColumnRenamed(TABLE, "_carry")
    whole = _scanned(parts, keys, ["_b"], True)
    local = _scanned(base, [*keys, "_b"], [order], False)

    def from_start(rows: DataFrame) -> DataFrame:
        if start is None:
            return rows.withColumn("_s", F.lit(first_state))
        known = start.select(*[c(k).alias(f"_k_{k}") for k in keys], c("state").cast("int").alias("_s"))
        same = [c(k).eqNullSafe(c(f"_k_{k}")) for k in keys]
        joined = rows.join(known, on=_all(same), how="left").drop(*[f"_k_{k}" for k in keys])
        return joined.withColumn("_s", F.coalesce("_s", F.lit(first_state)))

    carried = from_start(carried).select(*[c(k).alias(f"_k_{k}") for k in keys], c("_b").alias("_k_b"), c("_carry")[c("_s")].alias("_entry"))
    same = [c(k).eqNullSafe(c(f"_k_{k}")) for k in keys] + [c("_b").eqNullSafe(c("_k_b"))]
    rows = local.join(carried, on=_all(same)).select(*df.columns, c(TABLE)[c("_entry")].alias("state"))
    return rows, from_start(whole).select(*keys, c(TABLE)[c("_s")].alias("state"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for x in conditions[1:]:
        out = out & x
    return out
