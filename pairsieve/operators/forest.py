"""A random forest fitted level by level from histograms.

Rows are binned once and written as packed blocks of one byte a feature. For
each level a task walks its blocks down the trees known so far and counts, for
every open node, bins by class; the counts of a tree are added up in one group,
which picks the splits. So a pass reads some ten bytes a row, the driver gets
only splits, and what tasks hold and send depends on the trees, not on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

BINS = 32
BLOCK_ROWS = 1 << 15
SCORE_ROWS = 1 << 13
CUT_ERROR = 1e-3
_SHARES = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(9)])
POISSON = np.searchsorted(_SHARES, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)  # count by a 16-bit draw


@dataclass
class Forest:
    """Trees by level: for each level the split feature and bin of every place (trees x 2^level), and the class shares at the ends.

    A place without split has bin 255: its rows go on to the left, where the
    places below repeat its shares.
    """

    features: list[str]
    cuts: list[np.ndarray]
    seed: int
    feature: list[np.ndarray]
    cut: list[np.ndarray]
    shares: np.ndarray  # share of class 0 at each place of the next level, trees x 2^levels
    open: np.ndarray  # whether such a place may be split

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        if any(np.isnan(x).any() for x in columns):
            raise ValueError("features must not be null or NaN")
        return np.stack([np.searchsorted(cut, x, side="left").astype(np.uint8) for cut, x in zip(self.cuts, columns, strict=True)])

    def places(self, tree: int, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The place of each of ``rows`` on the level not yet split."""
        at, flat, n = np.zeros(len(rows), dtype=np.int64), bins.ravel(), bins.shape[1]
        for feature, cut in zip(self.feature, self.cut, strict=True):
            value = flat.take(feature[tree].take(at) * n + rows)
            at = 2 * at + (value > cut[tree].take(at))
        return at

    def p_fail(self) -> Column:
        """Mean share of class 0 over the trees."""
        from pyspark.sql import SparkSession

        shared = SparkSession.active().sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def mean_share(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            model = shared.value
            for one in columns:
                out, bins = np.zeros(len(one[0])), model.binned([x.to_numpy(dtype=float) for x in one])
                for start in range(0, len(out), SCORE_ROWS):
                    block = np.ascontiguousarray(bins[:, start : start + SCORE_ROWS])
                    rows = np.arange(block.shape[1])
                    for tree in range(len(model.shares)):
                        out[start : start + SCORE_ROWS] += model.shares[tree].take(model.places(tree, block, rows))
                yield pd.Series(out / len(model.shares))

        return mean_share(*[F.col(n) for n in self.features])


def candidates(seed: int, level: int, trees: int, features: int, size: int) -> np.ndarray:
    """The features each place of a level may split on: trees x 2^level x size."""
    return np.argsort(np.random.default_rng([seed, level]).random((trees, 1 << level, features)), axis=2)[:, :, :size]


def _blocks(model: Forest, df: DataFrame, label: str) -> DataFrame:
    """Packed rows: bins by feature, and the class of each row; a block's number decides its rows' draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, bins, classes = TaskContext.get().partitionId() << 32, np.empty((len(model.features), 0), dtype=np.uint8), np.empty(0, dtype=np.uint8)
        for batch in batches:
            if batch.column(label).null_count:
                raise ValueError("labels must not be null")
            more = model.binned([batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in model.features])
            bins = np.concatenate([bins, more], axis=1)
            classes = np.concatenate([classes, batch.column(label).to_numpy(zero_copy_only=False).astype(np.uint8)])
            while len(classes) >= BLOCK_ROWS:
                yield packed(number, bins[:, :BLOCK_ROWS], classes[:BLOCK_ROWS])
                number, bins, classes = number + 1, bins[:, BLOCK_ROWS:], classes[BLOCK_ROWS:]
        if len(classes):
            yield packed(number, bins, classes)

    def packed(number: int, bins: np.ndarray, classes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": [number], "bins": [bins.tobytes()], "classes": [classes.tobytes()]})

    blocks = df.select(*model.features, label).mapInArrow(run, "block bigint, bins binary, classes binary")
    # dealt anew, so that every core has its part in each pass even if the rows came in few files
    return written(blocks.repartition(df.sparkSession.sparkContext.defaultParallelism), "blocks")


def _counts(shared, level: int, size: int):
    """Arrow function over blocks: for each tree the drawn rows by place, candidate feature, bin and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        trees, width = len(model.open), len(model.features)
        subsets = candidates(model.seed, level, trees, width, size)
        total = np.zeros((trees, (1 << level) * size * BINS * 2))
        for batch in batches:
            for number, packed, marks in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                classes = np.frombuffer(marks, dtype=np.uint8).astype(np.int64)
                n = len(classes)
                bins = np.frombuffer(packed, dtype=np.uint8).reshape(width, n)
                flat = bins.ravel()
                draws = np.random.default_rng([model.seed, number]).integers(0, 1 << 16, (trees, n), dtype=np.uint16)
                for tree in range(trees):
                    drawn = POISSON.take(draws[tree])
                    rows = np.flatnonzero(drawn)
                    at = model.places(tree, bins, rows)
                    if not model.open[tree].all():
                        kept = model.open[tree].take(at)
                        rows, at = rows[kept], at[kept]
                    if not len(rows):
                        continue
                    times, base = drawn[rows].astype(float), at * (size * BINS * 2) + classes[rows]
                    for j in range(size):
                        value = flat.take(subsets[tree, :, j].take(at) * n + rows)
                        total[tree] += np.bincount(base + (value.astype(np.int64) * 2 + j * BINS * 2), times, total.shape[1])
        for tree in range(trees):
            yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), "counts": pa.array([total[tree].tobytes()], pa.binary())})

    return run


def _splits(level: int, size: int, weights: tuple[float, float]):
    """Arrow function over the counts of one tree: gain, candidate, bin and the weights of both classes on both sides, by place."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), dtype=float) for x in table.column("counts")).reshape(1 << level, size, BINS, 2)
        left = total.cumsum(axis=2)
        whole = left[:, :, -1:, :]
        right = whole - left
        weigh = np.array(weights)

        def impurity(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            w = counts * weigh
            n = w.sum(axis=-1)
            return n, 1 - ((w / np.maximum(n, 1e-300)[..., None]) ** 2).sum(axis=-1)

        (n, gini), (nl, gl), (nr, gr) = impurity(whole), impurity(left), impurity(right)
        gain = gini - (nl * gl + nr * gr) / np.maximum(n, 1e-300)
        gain = np.where((left.sum(axis=-1) >= 1) & (right.sum(axis=-1) >= 1), gain, -1.0).reshape(1 << level, -1)
        best = gain.argmax(axis=1)
        place = np.arange(1 << level)
        sides = np.stack([x.reshape(1 << level, -1, 2)[place, best] * weigh for x in (left, right)], axis=1)
        found = np.column_stack([gain[place, best], best // BINS, best % BINS, sides.reshape(1 << level, 4), (whole[:, 0, 0] * weigh)])
        return pa.table({"tree": table.column("tree").slice(0, 1), "found": pa.array([found.tobytes()], pa.binary())})

    return run


def fit(df: DataFrame, features: list[str], label: str, weights: tuple[float, float], trees: int, depth: int, seed: int) -> Forest:
    """Forest on all rows of ``df``: ``label`` is 0 or 1, weighted by ``weights``.

    Each tree sees every row as often as a Poisson draw of mean 1 says, and each
    place the root of the number of features (rounded up); splits are those of
    largest decrease in Gini impurity between ``BINS`` quantile bins.
    """
    cuts = df.approxQuantile(features, [k / BINS for k in range(1, BINS)], CUT_ERROR)
    size = int(np.ceil(np.sqrt(len(features))))
    model = Forest(list(features), [np.unique(x) for x in cuts], seed, [], [], np.full((trees, 1), 0.5), np.ones((trees, 1), dtype=bool))
    spark = df.sparkSession
    blocks = _blocks(model, df, label)
    for level in range(depth):
        if not model.open.any():
            break
        shared = spark.sparkContext.broadcast(model)
        # as many tasks as run at once: each sends its counts once, however many rows there are
        counted = blocks.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(_counts(shared, level, size), "tree int, counts binary")
        rows = counted.groupBy("tree").applyInArrow(_splits(level, size, weights), "tree int, found binary").collect()
        found = np.stack([np.frombuffer(r["found"], dtype=float).reshape(1 << level, 9) for r in sorted(rows, key=lambda r: r["tree"])])
        _grow(model, level, found, candidates(seed, level, trees, len(features), size))
        shared.destroy()
    return model


def _grow(model: Forest, level: int, found: np.ndarray, subsets: np.ndarray) -> None:
    """Add a level: splits where they gain, all else goes left with the shares it has."""
    split = model.open & (found[..., 0] > 0)
    chosen = np.take_along_axis(subsets, found[..., 1:2].astype(np.int64), axis=2)[..., 0]
    model.feature.append(np.where(split, chosen, 0))
    model.cut.append(np.where(split, found[..., 2], 255).astype(np.uint8))

    def share(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
        return zero / np.maximum(zero + one, 1e-300)

    own = np.where(model.open, share(found[..., 7], found[..., 8]), model.shares)
    sides = [np.where(split, share(found[..., k], found[..., k + 1]), own) for k in (3, 5)]
    pure = [found[..., k] * found[..., k + 1] == 0 for k in (3, 5)]
    model.shares = np.stack(sides, axis=2).reshape(len(own), -1)
    model.open = np.stack([split & ~p for p in pure], axis=2).reshape(len(own), -1)
