"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over whole texts: set of word shingles (64-bit hashes), its size, a
   key of the whole set, and a MinHash signature. Texts with equal sets are one
   class from here on, with the least doc_id as representative. A class's node
   is that id, or a number of its own when classes share one.
2. Signatures are cut into bands; representatives that agree in a band share a
   bucket. With 32 bands of 4 a pair at the threshold is missed with 5e-6.
3. Round one compares every member of a bucket with the bucket's hub, the member
   that shares most buckets with others: in a group of near copies that is the
   version closest to the rest. Round two takes the buckets whose members are
   still in different components. Members outside a bucket's main component are
   compared with all members in other components, in blocks of bounded size
   that give out confirmed links only, so no group's pairs are ever listed and
   no link that could join two components is left untested.
4. Each candidate pair is compared a batch of signature positions at a time.
   After each batch it is dropped when the posterior probability (uniform
   prior) that its similarity reaches the threshold is below ``MISS``.
5. Survivors are verified on the full shingle sets. Only sets of documents in
   surviving pairs are moved; partners of one document are dealt into blocks of
   bounded total size.
6. Connected components of the links give the groups.

Defined cases: null and empty texts and texts without words have the empty set
and are linked with nothing; fewer than five words are one shingle; rows with
equal ids are rows of their own, each linked by its own text (``near_duplicates``
marks all rows of a group's least id as kept, ``judged`` those of one set); a null id has
component null, takes part in no link and is kept; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import attach
from ..session import written
from .common import rows_at_a_time, texts_of, word_shingles
from .components import components
from .idfilter import id_filter, id_slot, in_filter

WIDTH = 5
BANDS, ROWS = 32, 4
SIGNATURE = BANDS * ROWS
BATCH = 32
NUMERATOR, DENOMINATOR = 75, 100
MISS = 1e-5
BLOCK_SHINGLES = 1 << 19

_seed = np.random.default_rng(7919)
_MULTIPLIERS = _seed.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _seed.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)


def signatures_of(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """MinHash signatures (rows of 128 uint32) of non-empty sets that lie behind each other."""
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), SIGNATURE), dtype=np.uint32)
    for k in range(SIGNATURE):
        out[:, k] = np.minimum.reduceat((shingles * _MULTIPLIERS[k] + _ADDENDS[k]) >> np.uint64(32), starts)
    return out


def shingle_sets(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text, in groups that keep arrays small."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held > 1 << 20 or k == len(texts) - 1:
            h, n, _ = word_shingles(texts[start : k + 1], WIDTH)
            at = 0
            for row, size in enumerate(n.tolist(), start):
                yield row, np.unique(h[at : at + size])
                at += size
            start, held = k + 1, 0


def text_key(text: Column) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(text.cast("string"))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key, signature of every row (set key and signature null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rows_at_a_time(batches, 1 << 20):
            sets = [s for _, s in shingle_sets([t or b"" for t in table.column("text").to_pylist()])]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(sizes)
            signature: list[bytes | None] = [None] * len(sets)
            key: list[str | None] = [None] * len(sets)
            if len(full):
                for row, sig in zip(full, signatures_of(np.concatenate(sets), sizes[full]), strict=True):
                    signature[row] = sig.astype("<u4").tobytes()
                    key[row] = blake2b(sets[row].tobytes(), digest_size=16).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), table.column("text_key").combine_chunks(), pa.array(sizes), pa.array(key, pa.string()), pa.array(signature, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "set_key", "signature"],
            )

    raw = texts_of(docs).select("doc_id", text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary").alias("text"))
    return raw.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key string, signature binary")


def fewest_matches(threshold: float = NUMERATOR / DENOMINATOR, miss: float = MISS) -> dict[int, int]:
    """For each number n of compared positions, the fewest matches with which a pair stays.

    With a uniform prior and m of n matches, similarity >= t has posterior
    probability P(Binomial(n + 1, t) <= m).
    """
    out = {}
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        below, m = 0.0, 0
        while (below := below + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < miss:
            m += 1
        out[n] = m
    return out


def plausible(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (a, b) that sequential comparison of their signatures doesn't rule out."""
    fewest = fewest_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u4").reshape(-1, SIGNATURE) for c in ("sig_a", "sig_b"))
            alive = np.arange(batch.num_rows)
            matches = np.zeros(batch.num_rows, dtype=np.int64)
            for n, least in fewest.items():
                span = slice(n - BATCH, n)
                matches[alive] += (left[alive, span] == right[alive, span]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    left = signatures.select(F.col("node").alias("a"), F.col("signature").alias("sig_a"))
    right = signatures.select(F.col("node").alias("b"), F.col("signature").alias("sig_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, set_key, shingles) of the given ids. What the filter lets through besides goes in the join."""
    lets_in = id_filter(ids)
    shared = docs.sparkSession.sparkContext.broadcast(lets_in)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            keep = np.flatnonzero(in_filter(bits, batch.column("slot").to_numpy()))
            if not len(keep):
                continue
            for table in rows_at_a_time([batch.take(pa.array(keep))], 1 << 20):
                sets = [s.tobytes() for _, s in shingle_sets([t or b"" for t in table.column("text").to_pylist()])]
                keys = [blake2b(s, digest_size=16).hexdigest() for s in sets]
                yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(keys, pa.string()), pa.array(sets, pa.binary())], ["rep", "set_key", "shingles"])

    raw = texts_of(docs).where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("text"), id_slot(F.col("doc_id"), lets_in).alias("slot"))
    return raw.mapInArrow(run, "rep long, set_key string, shingles binary")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if not len(a) or not len(b) or DENOMINATOR * min(len(a), len(b)) < NUMERATOR * max(len(a), len(b)):
        return False
    common = int(np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b))
    return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of representatives whose full sets are similar enough.

    The partners of each a are dealt into blocks of about BLOCK_SHINGLES
    shingles in total; a task holds one block and a's own set.
    """
    sizes = classes.select(F.col("node").alias("b"), F.col("n_shingles").alias("size_b"))
    sized = written(pairs.join(sizes, "b"), "sized-pairs")
    blocks = sized.groupBy("a").agg(F.ceil(F.sum("size_b") / BLOCK_SHINGLES).alias("blocks"))
    dealt = sized.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), "b")
    roles = dealt.select("a", "block", F.col("b").alias("id")).unionByName(dealt.select("a", "block", F.col("a").alias("id")).distinct())
    roles = written(roles.join(classes.select(F.col("node").alias("id"), "rep", "set_key"), "id"), "roles")
    # an id may have rows with other texts: the class's own set is the one that counts
    own = roles.join(sets_of(docs, roles.select("rep")), ["rep", "set_key"])

    def check(group: pa.Table) -> pa.Table:
        a = group.column("a")[0].as_py()
        sets = {}
        for id_, s in zip(group.column("id").to_pylist(), group.column("shingles").to_pylist(), strict=True):
            sets[id_] = np.frombuffer(s, dtype=np.uint64)
        mine, good = sets.pop(a, np.zeros(0, dtype=np.uint64)), []
        for id_, other in sets.items():
            if similar(mine, other):
                good.append(id_)
        return pa.table({"a": pa.array([a] * len(good), pa.int64()), "b": pa.array(good, pa.int64())})

    return own.groupBy("a", "block").applyInArrow(check, "a long, b long")


def _with_component(df: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
    return df.join(labels.select(F.col("id").alias(column), F.col("component").alias(out)), column, "left").withColumn(out, F.coalesce(out, column))


def links(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirmed links between representatives, and the components they form."""
    bands = classes.select(
        F.col("node").alias("id"),
        F.explode(F.array(*[F.xxhash64(F.lit(k), F.substring("signature", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)])).alias("bucket"),
    )
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(bands.join(shared, "bucket"), "bucket-members")
    popular = members.groupBy("id").agg(F.sum("n").alias("popularity"))
    known = members.drop("n").join(popular, "id")
    hubs = known.groupBy("bucket").agg(F.max_by("id", F.struct("popularity", -F.col("id"))).alias("hub"))
    starred = members.drop("n").join(hubs, "bucket").where("id <> hub")
    candidates = written(starred.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "candidates")
    first = written(confirmed(plausible(candidates, classes), docs, classes), "links")
    labels = written(components(first), "labels")
    both = first.unionByName(written(between_components(members, labels, docs, classes), "links"))
    return both, written(components(both), "labels")


def between_components(members: DataFrame, labels: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between members of a bucket that are in different components so far.

    Everything is grouped by the main component of the bucket. Members outside
    it make the blocks of one side, all members those of the other; a task
    compares one block of either side, by band, then by signature batch after
    batch, then on the full sets.
    """
    placed = _with_component(members.select("bucket", "id"), labels, "id", "c")
    counts = placed.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("bucket").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    facts = classes.select(F.col("node").alias("id"), "rep", "set_key", "n_shingles", "signature")
    people = placed.join(main, "bucket").select("main", "id", "c").distinct().join(facts.drop("signature"), "id")
    people = written(people, "open-members")
    outside = F.col("c") != F.col("main")
    amount = lambda what: F.ceil(F.sum(what) / BLOCK_SHINGLES).cast("int")
    blocks = people.groupBy("main").agg(amount(F.when(outside, F.col("n_shingles"))).alias("x_blocks"), amount(F.col("n_shingles")).alias("y_blocks"))
    found = written(sets_of(docs, people.select("rep")), "sets")
    full = people.join(found, ["rep", "set_key"]).join(facts.select("id", "signature"), "id").join(blocks, "main")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["main", "x", "y", "id", "c", "signature", "shingles"]
    xs = full.where(outside).withColumn("x", own("x_blocks")).withColumn("y", every("y_blocks")).select(*[F.col(n).alias(f"x_{n}") for n in columns])  # names of its own, as both sides come from one table
    ys = full.withColumn("y", own("y_blocks")).withColumn("x", every("x_blocks")).select(*columns)
    fewest = fewest_matches()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if left.num_rows and right.num_rows:
            left = left.rename_columns(columns)
            main_ = right.column("main")[0].as_py()
            x_ids, x_c, y_ids, y_c = (t.column(n).to_numpy() for t in (left, right) for n in ("id", "c"))
            x_sig, y_sig = (np.frombuffer(b"".join(t.column("signature").to_pylist()), dtype="<u4").reshape(-1, SIGNATURE) for t in (left, right))
            x_sets, y_sets = ([np.frombuffer(s, dtype=np.uint64) for s in t.column("shingles").to_pylist()] for t in (left, right))
            for k in range(len(x_ids)):
                same = y_sig == x_sig[k]
                alive = np.flatnonzero(same.reshape(-1, BANDS, ROWS).all(axis=2).any(axis=1) & (y_c != x_c[k]) & ((y_c == main_) | (y_ids > x_ids[k])))
                for n, least in fewest.items():
                    alive = alive[same[alive, :n].sum(axis=1) >= least]
                for y in alive.tolist():
                    if similar(x_sets[k], y_sets[y]):
                        out_a.append(int(x_ids[k]))
                        out_b.append(int(y_ids[y]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    key = ["main", "x", "y"]
    return xs.groupBy(*[f"x_{n}" for n in key]).cogroup(ys.groupBy(*key)).applyInArrow(compare, "a long, b long").distinct()


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept of every row of ``docs``."""
    rows = written(signed(docs), "signatures")
    alive = rows.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = alive.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = written(classes.withColumn("number", F.monotonically_increasing_id()), "classes")
    shared = not classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    classes = classes.withColumn("node", F.col("number" if shared else "rep")).drop("number")
    _, labels = links(docs, classes)
    groups = _with_component(classes.select("set_key", "rep", "node"), labels, "node", "component_id")
    if shared:  # the least id of a component and, of its sets, one
        groups = written(groups.withColumnRenamed("component_id", "c"), "groups")
        heads = groups.groupBy("c").agg(F.min(F.struct("rep", "set_key")).alias("head"))
        groups = attach(groups, heads, ["c"], ["set_key"]).select("set_key", F.col("head.rep").alias("component_id"), (F.col("set_key") == F.col("head.set_key")).alias("chosen"))
    else:
        groups = groups.select("set_key", "component_id", F.lit(True).alias("chosen"))
    out = rows.select("doc_id", "text_key", "n_shingles", "set_key").join(groups, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce((F.col("doc_id") == component) & F.coalesce("chosen", F.lit(True)), F.lit(True))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id is the component's; so all rows of that id) of every row of ``docs``."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return judged(docs).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
