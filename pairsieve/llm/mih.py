"""Nearest neighbours by multi-index hashing.

Vectors get 64-bit codes: principal directions, then a rotation learned to
bring the sample close to the corners of a cube. The code is split into four
substrings, each indexed on its own. Two codes within Hamming radius r agree
in some substring up to r / 4 bits (the first r mod 4 + 1 substrings up to
floor(r / 4), the others one less), so probing every substring's neighbourhood
finds every code within r. What is found is reranked by the inner product of
the original vectors.

The radius is measured: a bounded set of calibration queries is searched
exactly over all rows, and the radius is the one that holds ``COVER`` of their
true neighbours. Queries that find too few rows are searched exactly as well.

Index rows of a substring are dealt into cells by its upper bits; cells with
many rows are split into blocks, and so are the queries that probe a cell. A
task holds one block of rows and one of queries. Equal vectors are represented
by the k + 1 smallest ids, which is all that a result of k can hold. For inner
products of vectors of unequal length the codes see one more component that
brings all vectors to the same length.

Bounds: SAMPLE vectors to learn the rotation, CALIBRATION queries; every row
is indexed. Defined cases: vectors that are null, empty, zero, of another than
the most frequent length, or that hold null or non-finite components take no
part, nor do null ids; of rows with equal ids one counts, that with the
least vector; ties go to the smaller id; with fewer than k other vectors all
are returned; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BITS, PARTS = 64, 4
PART_BITS = BITS // PARTS
SAMPLE = 10_000
CALIBRATION = 96
COVER = 0.97
ROTATION_ROUNDS = 30
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 4_096


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) with v as little-endian doubles; one row per id."""
    plain = vectors.select(vectors[id_column].cast("long").alias("id"), vectors[vector_column].cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = plain.where(F.col("id").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda c: c != 0))
    sizes = good.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    good = good.where(F.size("x") == (sizes[0]["n"] if sizes else 0))
    least = good.groupBy("id").agg(F.min("x").alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("x").flatten().to_numpy().astype("<f8")
            rows = flat.reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "v"])

    return least.mapInArrow(pack, "id long, v binary")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype="<f8").reshape(len(values), -1)


def lengthened(x: np.ndarray, longest: float, is_query: bool) -> np.ndarray:
    """Directions whose angles order as the inner products do."""
    if is_query:
        return np.column_stack((x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))))
    y = x / longest
    return np.column_stack((y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))))


def learned_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = ROTATION_ROUNDS) -> np.ndarray:
    """Directions by bits: principal directions, rotated towards the corners of a cube; repeated with other starts until there are enough."""
    rng = np.random.default_rng(11)
    dims = sample.shape[1]
    _, vectors = np.linalg.eigh(sample.T @ sample)
    out, have = [], 0
    while have < bits:
        n = min(dims, bits - have)
        directions = vectors[:, ::-1][:, :n]
        z = sample @ directions
        r, _ = np.linalg.qr(rng.normal(size=(n, n)))
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(z @ r >= 0, 1.0, -1.0).T @ z)
            r = (u @ vt).T
        out.append(directions @ r)
        have += n
    return np.hstack(out)


def codes_of(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return np.packbits(x @ rotation >= 0, axis=1, bitorder="little").view("<u8").reshape(-1)


def part_radii(radius: int) -> list[int]:
    """How far each substring is probed so that every code within ``radius`` is found; -1: not at all."""
    q, rest = divmod(radius, PARTS)
    return [q if j <= rest else q - 1 for j in range(PARTS)]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :])


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed in the order of the components."""
    out = np.zeros(len(q))
    for c in range(q.shape[1]):
        out += q[:, c] * x[:, c]
    return out


def best_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query the k allowed rows of largest inner product, ties to smaller ids."""
    rough = np.where(allowed & (q_ids[:, None] != ids[None, :]), q @ x.T, -np.inf)
    for row in range(len(q_ids)):
        some = np.flatnonzero(rough[row] > -np.inf)
        if not len(some):
            continue
        if len(some) > k:  # the rounding of matrix products must not decide between equals
            edge = np.partition(rough[row, some], len(some) - k)[len(some) - k]
            some = some[rough[row, some] >= edge - 1e-9 * max(1.0, abs(edge))]
        score = _exact(np.broadcast_to(q[row], (len(some), q.shape[1])), x[some])
        order = np.lexsort((ids[some], -score))[:k]
        yield row, ids[some][order], score[order]


BEST = "array<struct<minus: double, id: long>>"


def _best_rows(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    pairs = [[{"minus": -s, "id": i} for i, s in zip(ids.tolist(), scores.tolist(), strict=True)] for _, ids, scores in found]
    kind = pa.list_(pa.struct([("minus", pa.float64()), ("id", pa.int64())]))
    return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "best": pa.array(pairs, kind)})


def _merged(found: DataFrame, k: int) -> DataFrame:
    """One list per query from lists of blocks, in two steps so that no list is long."""
    top = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
    return found.groupBy("query_id", F.pmod(F.spark_partition_id(), F.lit(32)).alias("part")).agg(top).groupBy("query_id").agg(top)


def probe(index: DataFrame, queries: DataFrame, radii: list[int], radius: int, k: int, n_rows: int) -> DataFrame:
    """(query_id, best) over all rows within ``radius`` that the substrings' neighbourhoods hold."""
    cell_bits = min(PART_BITS, max(0, int(np.ceil(np.log2(max(1, n_rows) / BLOCK_ROWS)))))
    used = [j for j in range(PARTS) if radii[j] >= 0]

    part = F.expr(f"shiftrightunsigned(code, cast(j * {PART_BITS} as int)) & {(1 << PART_BITS) - 1}")
    cell = F.shiftright(part, PART_BITS - cell_bits).cast("int")

    def masks(j: int) -> list[int]:
        reach = min(radii[j], cell_bits)
        return [sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(cell_bits), n)]

    parts = F.explode(F.array(*[F.lit(j) for j in used])).alias("j")
    rows = index.select("id", "code", "v", parts).withColumn("cell", cell)
    by_part = F.create_map(*[v for j in used for v in (F.lit(j), F.array(*[F.lit(m) for m in masks(j)]))])
    asked = queries.select("id", "code", "v", parts).withColumn("home", cell)
    asked = asked.select("id", "code", "v", "j", F.explode(F.transform(by_part[F.col("j")], lambda m: F.col("home").bitwiseXOR(m))).alias("cell"))
    row_blocks = rows.groupBy("j", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("row_blocks"))
    query_blocks = asked.groupBy("j", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("query_blocks"))
    blocks = written(row_blocks.join(query_blocks, ["j", "cell"]), "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    key = ["j", "cell", "row_block", "query_block"]
    left = rows.join(blocks, ["j", "cell"]).withColumn("row_block", own("row_blocks")).withColumn("query_block", every("query_blocks")).select(*key, "id", "code", "v")
    right = asked.join(blocks, ["j", "cell"]).withColumn("query_block", own("query_blocks")).withColumn("row_block", every("row_blocks")).select(*key, "id", "code", "v")

    def search(rows_: pa.Table, asked_: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if rows_.num_rows and asked_.num_rows:
            j = rows_.column("j")[0].as_py()
            ids, codes, x = rows_.column("id").to_numpy(), rows_.column("code").to_numpy().view(np.uint64), _matrix(rows_.column("v"))
            q_ids, q_codes, q = asked_.column("id").to_numpy(), asked_.column("code").to_numpy().view(np.uint64), _matrix(asked_.column("v"))
            part = lambda c, p: (c >> np.uint64(p * PART_BITS)) & np.uint64((1 << PART_BITS) - 1)
            for at in range(0, len(q_ids), 64):
                some = slice(at, at + 64)
                allowed = _distance(q_codes[some], codes) <= radius
                allowed &= _distance(part(q_codes[some], j), part(codes, j)) <= radii[j]
                for earlier in range(j):  # found there already
                    allowed &= _distance(part(q_codes[some], earlier), part(codes, earlier)) > radii[earlier]
                found += [(int(q_ids[at + row]), i, s) for row, i, s in best_of(q_ids[some], q[some], ids, x, allowed, k)]
        return _best_rows(found)

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, f"query_id long, best {BEST}")
    return _merged(found, k)


def calibrated_radius(index: DataFrame, queries: DataFrame, k: int) -> int:
    """Smallest radius that holds COVER of the true neighbours of a bounded set of queries."""
    chosen = queries.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION).toArrow()
    if not chosen.num_rows:
        return 0
    q_ids, q_codes, q = chosen.column("id").to_numpy(), chosen.column("code").to_numpy().view(np.uint64), np.array(_matrix(chosen.column("v")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, codes, x = b.column("id").to_numpy(), b.column("code").to_numpy().view(np.uint64), _matrix(b.column("v"))
            rows = []
            for row, i, s in best_of(q_ids, q, ids, x, np.ones((len(q_ids), len(ids)), dtype=bool), k):
                where = {v: c for v, c in zip(ids.tolist(), codes.tolist(), strict=True)}
                rows += [(int(q_ids[row]), -float(a), v, int(np.bitwise_count(np.uint64(where[v]) ^ q_codes[row]))) for v, a in zip(i.tolist(), s.tolist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["query_id", "minus", "id", "distance"])

    near = index.mapInArrow(run, "query_id long, minus double, id long, distance long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("minus", "id"))
    counts = near.withColumn("r", rank).where(F.col("r") <= k).groupBy("distance").count().orderBy("distance").collect()
    total, seen = sum(r["count"] for r in counts), 0
    for r in counts:
        seen += r["count"]
        if seen >= COVER * total:
            return int(r["distance"])
    return BITS


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``is_query`` (on column ``id``) holds."""
    rows = written(usable(vectors, id_column, vector_column), "vectors")

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(np.linalg.norm(_matrix(b.column("v")), axis=1).max())])], ["longest"])

    longest = rows.select("v").mapInArrow(norms, "longest double").agg(F.max("longest")).first()[0] or 1.0
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    rotation = learned_rotation(lengthened(_matrix(sample.column("v")), longest, False))

    def encode(as_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    code = codes_of(lengthened(_matrix(b.column("v")), longest, as_query), rotation)
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(code.view(np.int64)), b.column("v")], ["id", "code", "v"])

        return run

    kind = "id long, code long, v binary"
    least = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    index = written(rows.withColumn("r", least).where(F.col("r") <= k + 1).drop("r").mapInArrow(encode(False), kind), "index")
    queries = written(rows.where(is_query).mapInArrow(encode(True), kind), "queries")
    n_rows = index.count()
    radius = calibrated_radius(index, queries, k)
    found = written(probe(index, queries, part_radii(radius), radius, k, n_rows), "found")
    # every query must have its k rows, or all there are
    own = index.select("id", F.lit(1).alias("own"))
    needed = F.least(F.lit(k), F.lit(n_rows) - F.coalesce("own", F.lit(0)))
    short = queries.join(own, "id", "left").join(found.select(F.col("query_id").alias("id"), F.size("best").alias("n")), "id", "left").where(F.coalesce("n", F.lit(0)) < needed)
    short = written(short.select("id", "code", "v"), "short")
    if short.count():
        all_rows = probe(index, short, [PART_BITS] + [-1] * (PARTS - 1), BITS, k, n_rows)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(all_rows)
    return found.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.minus")).alias("score")
    )
