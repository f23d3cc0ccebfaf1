"""Key extraction with a Toeplitz matrix: out_i = XOR_j r[i + j] * x[j], i < m.

The sums are a correlation, so all output bits follow from one circular
convolution of length N = power of two >= n + m - 1 over whole numbers,
taken modulo 2. Work is N log N instead of n * m, and no bit is ever paired
with every other bit.

A short key fits one group and is convolved there. A long key uses the
transform in two passes over an N1 x N2 grid: transforms along columns, a
shuffle, transforms along rows, the product, and the same way back. Every
group holds at most ``2**limit_log2`` numbers (one column or row of about
sqrt(N) beyond that), however long the key is. Counts stay far below 2^53,
so rounding the double-precision result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT_LOG2 = 16


def seeded_rows(keyed: DataFrame, keys: list[str], seed_bit) -> DataFrame:
    """Numbers that enter the convolution, derived row by row from the key rows.

    ``keyed`` has keys, pos, bit, n (key length) and m (output length, at
    most n). ``seed_bit(column)`` gives the matrix bit r at an index. The
    n + m - 1 matrix bits come from the n key rows, so no row explodes into
    a long sequence.
    """
    n, m, pos = F.col("n"), F.col("m"), F.col("pos")

    def number(t: Column, r: Column, x: Column) -> Column:
        return F.struct(t.alias("t"), r.cast("double").alias("r"), x.cast("double").alias("x"))

    none = F.lit(0.0)
    numbers = F.array(
        number(n - 1 - pos, none, F.col("bit")),
        number(pos, seed_bit(pos), none),
        number(pos + n, F.when(pos < m - 1, seed_bit(pos + n)).otherwise(F.lit(0)), none),
    )
    rows = keyed.select(*keys, "n", "m", F.inline(numbers)).where("r <> 0 OR x <> 0")
    size = F.greatest(F.lit(1), F.ceil(F.log2((F.col("n") + F.col("m") - 1).cast("double")) - 1e-12)).cast("int")
    return rows.withColumn("lg", size)


def toeplitz(rows: DataFrame, keys: list[str], limit_log2: int = LIMIT_LOG2) -> DataFrame:
    """Output bits (keys, i, bit) for the rows of ``seeded_rows``."""
    short = _short(rows.where(F.col("lg") <= limit_log2), keys)
    long = _long(rows.where(F.col("lg") > limit_log2), keys, limit_log2)
    return short.unionByName(long)


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{k}` {types[k]}" for k in keys)


def _short(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that fit one convolution, streamed key by key through sorted partitions.

    A task holds one key at a time and pays no start-up cost per key.
    """

    def convolve(pdf: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        t, r, x = (pdf[c].to_numpy() for c in ("t", "r", "x"))
        n, m, lg = (pdf[c].to_numpy()[starts] for c in ("n", "m", "lg"))
        bits = []
        for j, (a, b) in enumerate(zip(starts, ends)):
            size = 1 << int(lg[j])
            fr = np.fft.rfft(np.bincount(t[a:b], r[a:b], size))
            fx = np.fft.rfft(np.bincount(t[a:b], x[a:b], size))
            y = np.fft.irfft(fr * fx, size)[n[j] - 1 : n[j] - 1 + m[j]]
            bits.append(np.rint(y).astype(np.int64) & 1)
        counts = [len(b) for b in bits]
        out = {k: np.repeat(pdf[k].to_numpy()[starts], counts) for k in keys}
        out["i"] = np.concatenate([np.arange(k, dtype=np.int64) for k in counts])
        out["bit"] = np.concatenate(bits).astype(np.int32)
        return pd.DataFrame(out)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if pdf.empty:
                continue
            new = np.zeros(len(pdf), bool)
            for k in keys:
                col = pdf[k].to_numpy()
                new[1:] |= col[1:] != col[:-1]
            cuts = np.flatnonzero(new)
            rest = pdf.iloc[cuts[-1] if len(cuts) else 0 :]  # the last key may go on in the next batch
            if len(cuts):
                yield convolve(pdf, np.concatenate([[0], cuts[:-1]]), cuts)
        if rest is not None:
            rest = rest.reset_index(drop=True)
            yield convolve(rest, np.array([0]), np.array([len(rest)]))

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartition(tasks, *keys).sortWithinPartitions(*keys)
    return sorted_rows.mapInPandas(stream, f"{_key_schema(rows, keys)}, i bigint, bit int")


def _long(rows: DataFrame, keys: list[str], limit_log2: int) -> DataFrame:
    """Two-pass transform. Index t = N2 * n1 + n2, frequency k = k1 + N1 * k2."""
    meta = "n bigint, m bigint, lg int"
    schema = _key_schema(rows, keys)

    def dims(lg: int) -> tuple[int, int, int, int]:
        n1, n2 = 1 << (lg // 2), 1 << (lg - lg // 2)
        width = 1 << limit_log2
        return n1, n2, max(1, width // n1), max(1, width // n2)

    lg = F.col("lg")
    log_n2 = lg - F.floor(lg / 2)
    n2_of = (F.col("t") % F.pow(F.lit(2), log_n2).cast("bigint")).cast("bigint")
    per_group = F.greatest(F.lit(1), F.pow(F.lit(2), limit_log2 - F.floor(lg / 2)).cast("bigint"))
    columns = rows.withColumn("n2", n2_of).withColumn("chunk", F.floor(F.col("n2") / per_group))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        n, m, lg_ = int(pdf.n.iloc[0]), int(pdf.m.iloc[0]), int(pdf.lg.iloc[0])
        n1, n2, c2, c1 = dims(lg_)
        c2 = min(c2, n2)
        base = int(pdf.chunk.iloc[0]) * c2
        grid = np.zeros((2, n1, c2))
        a, b = (pdf.t // n2).to_numpy(), (pdf.n2 - base).to_numpy()
        np.add.at(grid[0], (a, b), pdf.r.to_numpy())
        np.add.at(grid[1], (a, b), pdf.x.to_numpy())
        turn = np.exp(-2j * np.pi * np.outer(np.arange(n1), base + np.arange(c2)) / (n1 * n2))
        f = np.fft.fft(grid, axis=1) * turn
        return _cut(pdf, keys, f, axis=1, width=min(c1, n1), other=int(pdf.chunk.iloc[0]), n=n, m=m, lg=lg_)

    step1 = columns.groupBy(*keys, "chunk").applyInPandas(first, f"{schema}, {meta}, target bigint, source bigint, data binary")

    def middle(pdf: pd.DataFrame) -> pd.DataFrame:
        n, m, lg_ = int(pdf.n.iloc[0]), int(pdf.m.iloc[0]), int(pdf.lg.iloc[0])
        n1, n2, c2, c1 = dims(lg_)
        c1, c2 = min(c1, n1), min(c2, n2)
        base = int(pdf.target.iloc[0]) * c1
        f = np.concatenate([np.frombuffer(d, np.complex128).reshape(2, c1, c2) for d in pdf.sort_values("source").data], axis=2)
        f = np.fft.fft(f, axis=2)
        y = np.fft.ifft(f[0] * f[1], axis=1)
        y = y * np.exp(2j * np.pi * np.outer(base + np.arange(c1), np.arange(n2)) / (n1 * n2))
        return _cut(pdf, keys, y[None], axis=2, width=c2, other=int(pdf.target.iloc[0]), n=n, m=m, lg=lg_)

    step2 = step1.groupBy(*keys, "target").applyInPandas(middle, f"{schema}, {meta}, target bigint, source bigint, data binary")

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        n, m, lg_ = int(pdf.n.iloc[0]), int(pdf.m.iloc[0]), int(pdf.lg.iloc[0])
        n1, n2, c2, c1 = dims(lg_)
        c1, c2 = min(c1, n1), min(c2, n2)
        base = int(pdf.target.iloc[0]) * c2
        y = np.concatenate([np.frombuffer(d, np.complex128).reshape(c1, c2) for d in pdf.sort_values("source").data], axis=0)
        y = np.rint(np.fft.ifft(y, axis=0).real).astype(np.int64)
        t = np.arange(n1)[:, None] * n2 + base + np.arange(c2)[None, :]
        i = (t - (n - 1)).ravel()
        keep = (i >= 0) & (i < m)
        out = pd.DataFrame({"i": i[keep], "bit": (y.ravel()[keep] & 1).astype(np.int32)})
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[*keys, "i", "bit"]]

    return step2.groupBy(*keys, "target").applyInPandas(last, f"{schema}, i bigint, bit int")


def _cut(pdf: pd.DataFrame, keys: list[str], block: np.ndarray, axis: int, width: int, other: int, n: int, m: int, lg: int) -> pd.DataFrame:
    """Cut a block along ``axis`` in pieces for the next pass."""
    pieces = np.split(block, range(width, block.shape[axis], width), axis=axis)
    out = pd.DataFrame(
        {
            "n": n, "m": m, "lg": lg, "target": np.arange(len(pieces), dtype=np.int64), "source": other,
            "data": [np.ascontiguousarray(p).tobytes() for p in pieces],
        }
    )
    for key in keys:
        out[key] = pdf[key].iloc[0]
    return out[[*keys, "n", "m", "lg", "target", "source", "data"]]


def output_text(bits: DataFrame, keys: list[str], frame: int = 4096) -> DataFrame:
    """0/1 text of the output in pieces of at most ``frame`` bits."""
    ordered = F.array_sort(F.collect_list(F.struct("i", F.col("bit").cast("string").alias("b"))))
    return bits.groupBy(*keys, F.floor(F.col("i") / frame).alias("piece")).agg(
        F.array_join(F.transform(ordered, lambda x: x["b"]), "").alias("text")
    )


def seed_from(tag: str, partition: Column):
    """Matrix bit at an index, from the digest of tag, partition and index."""
    from ..sources.views import coin

    return lambda index: coin(tag, partition, index)
