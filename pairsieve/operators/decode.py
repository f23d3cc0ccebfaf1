"""Sum-product message passing over an edge table, many frames at once.

A code of up to ``MAX_EDGES`` edges, shared by all frames, travels to the tasks
as two packed arrays. Frames are packed to one row each in a single shuffle and
decoded with all their iterations and retries inside one task, a few hundred
thousand edges at a time: a half-iteration is one segmented sum over the edges
sorted by check or by variable. Frames that converge leave the batch.

Larger codes are decoded edge by edge as tables (``decode_wide``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .skew import attach

c = F.col
CLIP = 0.999999
LLR_LIMIT = 30.0
MAX_EDGES = 1 << 22
BATCH_EDGES = 1 << 18
ITERATIONS, RETRIES, DAMPING_STEP, ITERATION_SCALE = 50, 2, 0.15, 0.5


@dataclass
class Code:
    """A bipartite graph as arrays; edges are sorted by check, ``by_var`` sorts them by variable."""

    checks: np.ndarray  # ids in ascending order
    variables: np.ndarray
    check_at: np.ndarray  # place of each edge's check among ``checks``
    var_at: np.ndarray

    def __post_init__(self):
        self.check_starts = np.searchsorted(self.check_at, np.arange(len(self.checks)))
        self.by_var = np.argsort(self.var_at, kind="stable")
        self.var_starts = np.searchsorted(self.var_at[self.by_var], np.arange(len(self.variables)))

    @classmethod
    def of(cls, edges: np.ndarray) -> Code:
        """From (check_id, var_id) rows; repeated edges count once."""
        edges = np.unique(edges.reshape(-1, 2), axis=0)
        checks, check_at = np.unique(edges[:, 0], return_inverse=True)
        variables, var_at = np.unique(edges[:, 1], return_inverse=True)
        return cls(checks, variables, check_at, var_at)


def sum_product(code: Code, llr: np.ndarray, target: np.ndarray, bound: np.ndarray, max_iterations: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits, iterations and failing checks of each frame (row of ``llr``); checks that don't bind a frame send nothing."""
    n = len(llr)
    bits, used, failing = np.zeros(llr.shape, dtype=np.int8), np.full(n, max_iterations), np.zeros(n, dtype=np.int64)
    open_ = np.arange(n)
    llr = np.clip(llr, -LLR_LIMIT, LLR_LIMIT)
    q = llr[:, code.var_at]
    at = code.check_at
    for iteration in range(1, max_iterations + 1):
        t = np.tanh(q / 2)
        zero, negative = t == 0, (t < 0).view(np.int8)
        logs = np.log(np.abs(t), out=np.zeros_like(t), where=~zero)
        size = np.minimum(np.exp(np.add.reduceat(logs, code.check_starts, axis=1).take(at, axis=1) - logs), CLIP)
        odd = (np.bitwise_xor.reduceat(negative, code.check_starts, axis=1) ^ target[open_]).take(at, axis=1) ^ negative
        r = np.log((1 + size) / (1 - size))
        np.negative(r, out=r, where=odd == 1)
        silent = ~bound[open_].take(at, axis=1) if not bound[open_].all() else None
        if zero.any():
            others = np.add.reduceat(zero, code.check_starts, axis=1, dtype=np.int32).take(at, axis=1) - zero > 0
            silent = others if silent is None else silent | others
        if silent is not None:
            r[silent] = 0.0
        belief = llr[open_] + np.add.reduceat(r[:, code.by_var], code.var_starts, axis=1)
        bit = (belief < 0).astype(np.int8)
        parity = np.bitwise_xor.reduceat(bit[:, code.var_at], code.check_starts, axis=1)
        wrong = ((parity != target[open_]) & bound[open_]).sum(axis=1)
        bits[open_], failing[open_] = bit, wrong
        left = wrong > 0
        used[open_[~left]] = iteration
        if not left.any():
            break
        open_ = open_[left]
        q = (belief[:, code.var_at] - r)[left]
    return bits, used, failing


def ladder(
    code: Code, llr: np.ndarray, target: np.ndarray, bound: np.ndarray, max_iterations: int, retries: int, damping_step: float, iteration_scale: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``sum_product``, then again for unconverged frames, damped and with more iterations; the best result stays."""
    bits, used, failing = sum_product(code, llr, target, bound, max_iterations)
    attempts = np.zeros(len(llr), dtype=np.int64)
    for attempt in range(1, retries + 1):
        again = np.flatnonzero(failing > 0)
        if not len(again):
            break
        limit = int(max_iterations * (1 + iteration_scale * attempt))
        b, u, f = sum_product(code, llr[again] * (1 - damping_step * attempt), target[again], bound[again], limit)
        better = f < failing[again]
        to = again[better]
        bits[to], used[to], failing[to], attempts[to] = b[better], u[better], f[better], attempt
    return bits, used, failing, attempts


def bound_ladder(code: Code, llr: np.ndarray, target: np.ndarray, bound: np.ndarray, *settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``ladder`` on the checks that bind any of the frames; the others send 0 and are never wrong, so the result is the same."""
    met = bound.any(axis=0)
    if met.all():
        return ladder(code, llr, target, bound, *settings)
    bits, n = (llr < 0).astype(np.int8), len(llr)
    if not met.any():
        return bits, np.ones(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    kept = met[code.check_at]
    part = Code.of(np.column_stack([code.check_at[kept], code.var_at[kept]]))  # places of the whole code as ids
    bits[:, part.variables], *rest = ladder(part, llr[:, part.variables], target[:, part.checks], bound[:, part.checks], *settings)
    return bits, *rest


def packed_code(edges: DataFrame) -> Code | None:
    """The graph as arrays, or None where it has more than ``MAX_EDGES`` edges."""
    distinct = cut_lineage(edges.select(c("check_id").cast("long"), c("var_id").cast("long")).distinct())
    if distinct.count() > MAX_EDGES:
        return None
    rows = distinct.toArrow()
    return Code.of(np.column_stack([rows.column(n).to_numpy() for n in ("check_id", "var_id")]))


def packed_frames(llr: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """One row per frame: its values by variable and its targets by check."""
    item = F.struct(c("id").cast("long").alias("id"), c("value").cast("double").alias("value"))
    values = llr.select(*keys, F.lit(0).alias("kind"), c("var_id").alias("id"), c("llr").alias("value"))
    targets = target.select(*keys, F.lit(1).alias("kind"), c("check_id").alias("id"), c("target").alias("value"))
    return values.unionByName(targets).groupBy(*keys).agg(
        F.collect_list(F.when(c("kind") == 0, item)).alias("llr"), F.collect_list(F.when(c("kind") == 1, item)).alias("target")
    )


def decode_frames(
    edges: DataFrame, llr: DataFrame, target: DataFrame, max_iterations: int = ITERATIONS, retries: int = RETRIES, damping_step: float = DAMPING_STEP,
    iteration_scale: float = ITERATION_SCALE, keys: list[str] | None = None, missing: float = 0.0, whole: bool = True,
) -> DataFrame:
    """One row per frame of ``llr``: ``bits`` by ascending var_id, converged, iterations, attempt, n_failing.

    ``bits`` has all variables of the code or, without ``whole``, those up to
    the last one that has a value in the frame.

    A variable without value in a frame has ``missing`` (0: punctured; a large
    value: known to be 0); a check without target doesn't bind that frame.
    Null ids and values count as absent. The code must be within ``MAX_EDGES``.
    """
    keys = keys or ["frame_id"]
    code = packed_code(edges)
    if code is None:
        raise ValueError(f"the code has more than {MAX_EDGES} edges; use decode_wide")
    if not len(code.checks):
        raise ValueError("the code has no edges")
    shared = llr.sparkSession.sparkContext.broadcast(code)
    frames = packed_frames(llr, target, keys)
    schema = T.StructType([frames.schema[k] for k in keys])
    for name, kind in (("bits", T.ArrayType(T.ByteType())), ("converged", T.BooleanType()), ("iterations", T.LongType()), ("attempt", T.LongType()), ("n_failing", T.LongType())):
        schema.add(name, kind)

    def dense(lists: pa.ListArray, ids: np.ndarray, fill: float) -> np.ndarray:
        out = np.full((len(lists), len(ids)), fill)
        items = lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        name, value = items.field("id"), items.field("value")
        good = name.is_valid().to_numpy(zero_copy_only=False) & value.is_valid().to_numpy(zero_copy_only=False)
        name, value, row = name.fill_null(0).to_numpy()[good], value.fill_null(0).to_numpy()[good], row[good]
        at = np.minimum(np.searchsorted(ids, name), len(ids) - 1)
        known = ids[at] == name
        out[row[known], at[known]] = value[known]
        return out

    def reach(lists: pa.ListArray, ids: np.ndarray) -> np.ndarray:
        """How many variables of the code there are up to each frame's last one."""
        items = lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        good = items.field("id").is_valid().to_numpy(zero_copy_only=False) & items.field("value").is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(lists), dtype=np.int64)
        np.maximum.at(out, row[good], np.searchsorted(ids, items.field("id").fill_null(0).to_numpy()[good], side="right"))
        return out

    def most(graph: Code, sizes: np.ndarray) -> int:
        """How many of the next frames, by ascending number of targets, keep within ``BATCH_EDGES`` edges."""
        edges = np.minimum(sizes, len(graph.checks)) * (len(graph.check_at) / len(graph.checks))
        fit = np.arange(1, len(sizes) + 1) * np.maximum(edges, len(graph.variables) / 4) <= BATCH_EDGES
        return max(1, int(fit.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        for batch in batches:
            # short frames bind few checks: frames of like size go together, more of them at once
            sizes = np.diff(batch.column("target").offsets.to_numpy())
            order = np.argsort(sizes, kind="stable")
            start = 0
            while start < batch.num_rows:
                step = most(graph, sizes[order[start:]])
                rows = batch.take(pa.array(order[start : start + step]))
                start += step
                values = dense(rows.column("llr"), graph.variables, missing)
                goal = dense(rows.column("target"), graph.checks, -1)
                bound = goal >= 0
                bits, used, failing, attempts = bound_ladder(graph, values, np.where(bound, goal, 0).astype(np.int8), bound, max_iterations, retries, damping_step, iteration_scale)
                width = np.full(len(bits), bits.shape[1]) if whole else reach(rows.column("llr"), graph.variables)
                offsets = pa.array(np.append(0, np.cumsum(width)), pa.int32())
                columns = [pa.ListArray.from_arrays(offsets, pa.array(bits[np.arange(bits.shape[1]) < width[:, None]], pa.int8())), pa.array(failing == 0), *[pa.array(x, pa.int64()) for x in (used, attempts, failing)]]
                yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in keys], *columns], [*keys, "bits", "converged", "iterations", "attempt", "n_failing"])

    return frames.where(F.size("llr") > 0).mapInArrow(run, schema)


def bit_rows(decoded: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per frame and variable of the code instead of the packed bits."""
    ids = decoded.sparkSession.sparkContext.broadcast(packed_code(edges).variables)
    kept = [f for f in decoded.schema if f.name != "bits"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(ids.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                again = row.select(names).take(pa.array(np.zeros(n, dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(ids.value, pa.int64()), row.column("bits").flatten().cast(pa.int32())], [*names, "var_id", "bit"])

    return decoded.mapInArrow(run, T.StructType([*kept, T.StructField("var_id", T.LongType()), T.StructField("bit", T.IntegerType())]))


def decode(edges: DataFrame, llr: DataFrame, target: DataFrame, max_iterations: int = ITERATIONS) -> DataFrame:
    """Bits per (frame_id, var_id) with convergence flag, iterations and failing checks, in one attempt."""
    return decode_with_retries(edges, llr, target, max_iterations, retries=0).drop("attempt")


def decode_with_retries(
    edges: DataFrame, llr: DataFrame, target: DataFrame, max_iterations: int = ITERATIONS, retries: int = RETRIES, damping_step: float = DAMPING_STEP,
    iteration_scale: float = ITERATION_SCALE,
) -> DataFrame:
    """Bits per (frame_id, var_id); later attempts run on unconverged frames only, damped and with more iterations; the best result stays."""
    if edges.limit(MAX_EDGES + 1).count() > MAX_EDGES:
        return wide_with_retries(edges, llr, target, max_iterations, retries, damping_step, iteration_scale)
    return bit_rows(decode_frames(edges, llr, target, max_iterations, retries, damping_step, iteration_scale), edges)


def regular_code(spark, n: int, var_degree: int = 3, check_degree: int = 6) -> DataFrame:
    """Edges of a regular code of ``n`` variables: in each of ``var_degree`` layers the variables are dealt to checks in the order of a digest."""
    rows = spark.range(n).select(c("id").alias("var_id"), F.explode(F.sequence(F.lit(0), F.lit(var_degree - 1))).alias("layer"))
    name = F.md5(F.concat_ws(":", F.lit("code"), c("layer").cast("string"), c("var_id").cast("string")))
    place = F.row_number().over(Window.partitionBy("layer").orderBy(name)) - 1  # n rows, the length of a frame
    per_layer = -(-n // check_degree)
    return rows.select("var_id", (c("layer") * per_layer + F.floor(place / check_degree)).cast("bigint").alias("check_id")).select("check_id", "var_id")


def frame_syndromes(edges: DataFrame, bits: DataFrame, keys: list[str]) -> DataFrame:
    """Parity (``target``) of every check that has bits in a frame; ``bits`` has keys, var_id, bit."""
    met = bits.select(*keys, "var_id", "bit").join(edges.select("check_id", "var_id"), "var_id")
    return met.groupBy(*keys, "check_id").agg(F.bit_xor(c("bit").cast("int")).alias("target"))


def _atanh(x):
    return 0.5 * F.log((1 + x) / (1 - x))


def decode_wide(edges: DataFrame, llr: DataFrame, target: DataFrame, max_iterations: int) -> DataFrame:
    """Bits per (frame_id, var_id) with convergence flag, iterations and failing checks, for codes of any size.

    ``edges`` (check_id, var_id) is shared by all frames; ``llr`` has
    frame_id, var_id, llr; ``target`` has frame_id, check_id, target. The
    state is one row per frame and edge. A half-iteration is one map-side
    combined sum per check or variable: products run as sums of logarithms
    with a sign and a zero count. Converged frames leave the loop. Each
    half-round is written to the shared folder, so a lost executor costs
    one half-round.
    """
    sized = F.greatest(F.lit(-LLR_LIMIT), F.least(F.lit(LLR_LIMIT), c("llr")))
    state = llr.select("frame_id", "var_id", sized.alias("llr")).join(edges, "var_id").join(target, ["frame_id", "check_id"])
    state = cut_lineage(state.select("frame_id", "check_id", "var_id", "llr", c("target").cast("int").alias("target"), c("llr").alias("q")))
    done = None
    for iteration in range(1, max_iterations + 1):
        t = F.tanh(c("q") / 2)
        rows = state.withColumn("t", t)
        sums = rows.groupBy("frame_id", "check_id").agg(
            F.count_if(c("t") == 0).alias("zeros"),
            F.count_if(c("t") < 0).alias("negative"),
            F.sum(F.when(c("t") != 0, F.log(F.abs(c("t")))).otherwise(0.0)).alias("logs"),
        )
        met = attach(rows, sums, ["frame_id", "check_id"], ["var_id"], salts=4)
        own_zero = c("t") == 0
        size = F.exp(c("logs") - F.when(own_zero, 0.0).otherwise(F.log(F.abs(c("t")))))
        odd = (c("negative") - (c("t") < 0).cast("int") + c("target")) % 2
        others_zero = c("zeros") - own_zero.cast("int") > 0
        r = F.when(others_zero, F.lit(0.0)).otherwise(
            F.when(odd == 1, F.lit(-1.0)).otherwise(F.lit(1.0)) * 2 * _atanh(F.least(size, F.lit(CLIP)))
        )
        sent = cut_lineage(met.select("frame_id", "check_id", "var_id", "llr", "target", r.alias("r")))
        beliefs = sent.groupBy("frame_id", "var_id").agg((F.first("llr") + F.sum("r")).alias("total"))
        updated = attach(sent, beliefs, ["frame_id", "var_id"], ["check_id"], salts=4)
        updated = cut_lineage(updated.withColumn("bit", (c("total") < 0).cast("int")).withColumn("q", c("total") - c("r")))
        parity = updated.groupBy("frame_id", "check_id").agg(F.bit_xor("bit").alias("parity"), F.first("target").alias("target"))
        verdict = cut_lineage(parity.groupBy("frame_id").agg(F.count_if(c("parity") != c("target")).alias("n_failing")))
        last = iteration == max_iterations
        leaving = verdict if last else verdict.where("n_failing = 0")
        bits = updated.select("frame_id", "var_id", "bit").distinct()
        out = attach(bits, leaving, ["frame_id"], ["var_id"]).withColumn("converged", c("n_failing") == 0).withColumn("iterations", F.lit(iteration))
        out = cut_lineage(out)
        done = out if done is None else done.unionByName(out)
        if last:
            break
        staying = verdict.where("n_failing > 0").select("frame_id")
        if staying.isEmpty():
            break
        state = cut_lineage(
            attach(updated, staying, ["frame_id"], ["var_id"]).select("frame_id", "check_id", "var_id", "llr", "target", "q")
        )
    return done


def wide_with_retries(
    edges: DataFrame, llr: DataFrame, target: DataFrame, max_iterations: int, retries: int, damping_step: float, iteration_scale: float
) -> DataFrame:
    """The ladder of retries over ``decode_wide``."""
    best = decode_wide(edges, llr, target, max_iterations).withColumn("attempt", F.lit(0))
    for attempt in range(1, retries + 1):
        failed = cut_lineage(best.where("NOT converged").select("frame_id", c("n_failing").alias("old")).distinct())
        if failed.isEmpty():
            break
        damped = llr.join(failed.select("frame_id"), "frame_id").withColumn("llr", c("llr") * (1 - damping_step * attempt))
        again = decode_wide(edges, damped, target.join(failed.select("frame_id"), "frame_id"), int(max_iterations * (1 + iteration_scale * attempt)))
        better = again.join(failed, "frame_id").where("n_failing < old").drop("old").withColumn("attempt", F.lit(attempt))
        kept = best.join(better.select("frame_id").distinct(), "frame_id", "left_anti")
        best = cut_lineage(kept.unionByName(better))
    return best
