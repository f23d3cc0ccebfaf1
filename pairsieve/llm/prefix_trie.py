"""Prefix trie of conversations by the splitter-skeleton method.

A turn is the MD5 of its role and text and the bytes of its text; a
conversation is its turns behind each other (16 bytes a turn), so equal
prefixes stand together in byte order whatever the turns say.

1. Equal conversations become one row with a count, the least id and the
   digest of all their ids. The ids are joined in blocks of ``ID_BLOCK`` first.
2. These paths are range-partitioned and sorted. Only a prefix shared by the
   last path of one shard and the first path of the next can be a node of
   several shards: the prefixes at these splitters are the skeleton, broadcast
   as a trie (at most one path a shard; checked against ``SKELETON_BYTES``).
3. Each shard walks its sorted paths with one stack. Other nodes are finished
   there; skeleton nodes give what the shard knows of them.
4. Skeleton nodes add up their partial rows over shards, then over their
   subtree in the skeleton. Children of skeleton nodes learn their parent's id.

A first turn that a third of all conversations share is a skeleton node or a
node inside a shard, never a group. A shard keeps one stack and the rows of
open nodes' children.

Defined cases: null turns come first; equal turn numbers stand in the order of
their digests; null roles and texts are empty; repeated rows are turns of their
own; rows without conv_id belong to no conversation; an empty table has no
node, not even a root; other columns are not looked at. A conversation's
digests (not its texts) pass through one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..session import written

DIGEST = 16
ID_BLOCK = 1 << 16
SKELETON_BYTES = 64 << 20
NO_IDS = hashlib.sha256(b"").hexdigest()

PATHS = "path binary, bytes array<bigint>, n bigint, least bigint, ends string"
NODES = (
    "node binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string, last_bytes bigint, shared boolean"
)
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): digests and text bytes of each conversation's turns, in order."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")).cast("binary") for c in ("role", "text"))
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role, text))).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    ).where("conv_id IS NOT NULL")
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "bytes"))).alias("turns"))
    return lists.withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))))


def rebuilt(conversations: DataFrame, heads_of: int = 5, heads: int = 9) -> DataFrame:
    """(conv_id, path, bytes): the first h turns of conversation c - c % 5, then c's own turns after its first h."""
    lists = written(turn_lists(conversations), "turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = lists.withColumn("base", F.col("conv_id") - F.col("conv_id") % heads_of).withColumn("h", h)
    bases = lists.where(F.col("conv_id") % heads_of == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    empty = F.slice("turns", 1, 0)
    both = own.join(bases, "base", "left").select(
        "conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), empty), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns")
    )
    return both.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("path"), F.col("turns.bytes").alias("bytes"))


def distinct_paths(convs: DataFrame) -> DataFrame:
    """One row per distinct path: bytes of its turns, members that end there, the least of them, digest of their ids."""
    keyed = convs.withColumn("key", F.md5("path"))
    blocks = keyed.groupBy("key", F.floor(F.col("conv_id") / ID_BLOCK).alias("block")).agg(
        F.first("path").alias("path"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"),
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"),
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row, digest, done = None, None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["key"] == key:
                    digest.update(b"," + r["ids"].encode())
                    row["n"] += r["n"]
                    continue
                if row is not None:
                    done.append(row | {"ends": digest.hexdigest()})
                key, digest = r["key"], hashlib.sha256(r["ids"].encode())
                row = {"path": r["path"], "bytes": r["bytes"], "n": r["n"], "least": r["least"]}
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_PATHS)
                done = []
        if row is not None:
            yield pa.RecordBatch.from_pylist([row | {"ends": digest.hexdigest()}], schema=_PATHS)

    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(joined, PATHS)


_PATHS = pa.schema([("path", pa.binary()), ("bytes", pa.list_(pa.int64())), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])
_NODES = pa.schema(
    [("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64())]
    + [(c, pa.int64()) for c in ("n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("last_bytes", pa.int64()), ("shared", pa.bool_())]
)


def shared_prefix(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common from the start."""
    n = min(len(a), len(b)) // DIGEST
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[: mid * DIGEST] == b[: mid * DIGEST]:
            lo = mid
        else:
            hi = mid - 1
    return lo


@F.pandas_udf(BinaryType())
def _common(before: pd.Series, here: pd.Series) -> pd.Series:
    return pd.Series([b"" if a is None else bytes(b[: shared_prefix(a, b) * DIGEST]) for a, b in zip(before, here, strict=True)])


def skeleton_of(shards: DataFrame) -> set[bytes]:
    """All prefixes of the paths at which shards meet; the root is always one."""
    ends = shards.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    met = ends.select("first", F.lag("last").over(Window.orderBy("shard")).alias("before"))
    splitters = written(met.select(_common("before", "first").alias("splitter")).distinct(), "splitters")
    # a splitter of t turns has t + 1 prefixes of up to its length
    size = splitters.agg(F.sum(F.length("splitter").cast("double") * (F.length("splitter") / DIGEST + 1))).first()[0] or 0.0
    if size > SKELETON_BYTES:
        raise ValueError(f"splitters share prefixes of {int(size)} bytes; the skeleton may hold {SKELETON_BYTES}: use fewer shards")
    nodes = {b""}
    for (splitter,) in splitters.collect():
        nodes.update(bytes(splitter[:k]) for k in range(0, len(splitter) + 1, DIGEST))
    return nodes


class _Open:
    """A node whose subtree is being read."""

    __slots__ = ("depth", "node", "last_bytes", "shared", "n", "least", "n_children", "leaves", "saved", "ends", "waiting")

    def __init__(self, depth: int, node: bytes | None, last_bytes: int, shared: bool):
        self.depth, self.node, self.last_bytes, self.shared = depth, node, last_bytes, shared
        self.n, self.least, self.n_children, self.leaves, self.saved, self.ends = 0, None, 0, 0, 0, NO_IDS
        self.waiting: list[dict] = []

    def add(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


class _Walk:
    """Sorted paths of one shard to finished nodes and partial rows of skeleton nodes."""

    def __init__(self, skeleton: set[bytes]):
        self.skeleton, self.stack, self.path, self.done = skeleton, [], b"", []

    def close(self, depth: int) -> None:
        """Finish the open nodes deeper than ``depth``."""
        while self.stack and self.stack[-1].depth > depth:
            top = self.stack.pop()
            row = {
                "node": top.node, "parent": None, "conv_id": top.least, "depth": top.depth, "parent_conv_id": None, "n_convs": top.n,
                "n_children": top.n_children, "n_leaves": top.leaves, "saved_tokens": top.saved, "ends_sha256": top.ends,
                "last_bytes": top.last_bytes, "shared": top.shared,
            }
            for child in top.waiting:
                child["parent_conv_id"] = top.least
            self.done += top.waiting
            if top.shared:
                self.done.append(row)
                continue
            up = self.stack[-1]
            row["n_leaves"] = top.leaves = max(top.leaves, 1) if top.n_children == 0 else top.leaves
            row["saved_tokens"] = top.saved = top.saved + (top.n - 1) * top.last_bytes
            up.add(top.n, top.least)
            up.n_children, up.leaves, up.saved = up.n_children + 1, up.leaves + top.leaves, up.saved + top.saved
            if up.shared:
                row["parent"] = up.node
                self.done.append(row)
            else:
                up.waiting.append(row)

    def add(self, path: bytes, sizes: list[int], n: int, least: int, ends: str) -> None:
        depth = shared_prefix(self.path, path) if self.stack else -1
        self.close(depth)
        for d in range(depth + 1, len(path) // DIGEST + 1):
            shared = (not self.stack or self.stack[-1].shared) and path[: d * DIGEST] in self.skeleton
            self.stack.append(_Open(d, path[: d * DIGEST] if shared else None, sizes[d - 1] if d else 0, shared))
        end = self.stack[-1]
        end.add(n, least)
        end.ends = ends
        self.path = path


def walked(shards: DataFrame, skeleton: set[bytes]) -> DataFrame:
    """Nodes of each shard; those of the skeleton with what the shard knows of them."""
    trie = shards.sparkSession.sparkContext.broadcast(skeleton)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, state = None, _Walk(trie.value)
        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "path", "bytes", "n", "least", "ends")]
            for k in range(batch.num_rows):
                here, path, sizes, n, least, ends = (c[k].as_py() for c in columns)
                if here != shard:
                    state.close(-1)
                    shard = here
                state.add(path, sizes, n, least, ends)
                if len(state.done) > 10_000:
                    yield pa.RecordBatch.from_pylist(state.done, schema=_NODES)
                    state.done = []
        state.close(-1)
        if state.done:
            yield pa.RecordBatch.from_pylist(state.done, schema=_NODES)

    return shards.repartition("shard").sortWithinPartitions("shard", "path").mapInArrow(walk, NODES)


def _up(nodes: DataFrame) -> Column:
    """A skeleton node and all nodes above it."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.col("depth").cast("int")), lambda d: F.substring(F.col("node"), F.lit(1), d * DIGEST)))


def reduced(partial: DataFrame) -> DataFrame:
    """Skeleton nodes from the partial rows of all shards."""
    sums = partial.groupBy("node").agg(
        F.first("depth").alias("depth"), F.first("last_bytes").alias("last_bytes"), F.min("conv_id").alias("least"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.coalesce(F.max(F.when(F.col("ends_sha256") != NO_IDS, F.col("ends_sha256"))), F.lit(NO_IDS)).alias("ends_sha256"),
    )
    sums = written(sums, "skeleton")
    members = sums.select(_up(sums).alias("above"), "least", "n_convs").groupBy("above").agg(F.min("least").alias("conv_id"), F.sum("n_convs").alias("members"))
    inner = sums.where("depth > 0").groupBy(F.substring(F.col("node"), F.lit(1), (F.col("depth").cast("int") - 1) * DIGEST).alias("above")).agg(F.count(F.lit(1)).alias("inner"))
    known = sums.drop("n_convs", "least").join(members, F.col("node") == F.col("above")).drop("above")
    known = known.join(inner, F.col("node") == F.col("above"), "left").drop("above")
    known = known.withColumn("n_children", F.col("n_children") + F.coalesce(F.col("inner"), F.lit(0))).drop("inner")
    known = written(known, "skeleton")
    below = known.select(
        _up(known).alias("above"),
        F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves")).alias("leaves"),
        (F.col("saved_tokens") + (F.col("members") - 1) * F.col("last_bytes")).alias("saved"),
    ).groupBy("above").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return known.join(below, F.col("node") == F.col("above")).select(
        "node", "conv_id", "depth", F.col("members").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256"
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    paths = distinct_paths(rebuilt(conversations))
    shards = written(paths.repartitionByRange("path").withColumn("shard", F.spark_partition_id()), "shards")
    nodes = written(walked(shards, skeleton_of(shards)), "nodes")
    skeleton = written(reduced(nodes.where("shared")), "skeleton")
    # no more rows than the skeleton, whose size is checked above
    names = F.broadcast(skeleton.select(F.col("node").alias("_above"), F.col("conv_id").alias("_above_id")))
    top = skeleton.withColumn("parent", F.when(F.col("depth") > 0, F.substring(F.col("node"), F.lit(1), (F.col("depth").cast("int") - 1) * DIGEST)))
    top = top.withColumn("parent_conv_id", F.lit(None).cast("long"))
    all_nodes = nodes.where("NOT shared").select("parent", *OUT).unionByName(top.select("parent", *OUT))
    named = all_nodes.join(names, F.col("parent") == F.col("_above"), "left")
    return named.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above_id")).select(*OUT)


TRIE_SQL = """
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, md5(strlen(role) || ':' || role || text) AS x, strlen(text) AS bytes,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS pos FROM t),
bits AS (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS step FROM range(256) r(i)),
tab AS (SELECT list(step ORDER BY i) AS steps FROM bits),
c AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
  lambda r, b: xor(steps[((xor(r, b) & 255) + 1)::BIGINT], r >> 8)))::BIGINT % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), tab),
r AS (SELECT c.conv_id, b.pos AS d, b.x, b.bytes FROM c JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 5 AND b.pos <= c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, (SELECT count(*) FROM o b WHERE b.conv_id = c.conv_id - c.conv_id % 5)) + o.pos - c.h, o.x, o.bytes FROM c JOIN o USING (conv_id) WHERE o.pos > c.h),
p(conv_id, d, node, above, bytes) AS (SELECT conv_id, 0::BIGINT, '', NULL::VARCHAR, 0::BIGINT FROM c
  UNION ALL SELECT p.conv_id, p.d + 1, md5(p.node || r.x), p.node, r.bytes FROM p JOIN r ON r.conv_id = p.conv_id AND r.d = p.d + 1),
m AS (SELECT conv_id, max(d) AS last FROM p GROUP BY conv_id),
n AS (SELECT p.d, p.node, first(p.above) AS above, first(p.bytes) AS bytes, min(p.conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CASE WHEN p.d = m.last THEN p.conv_id::VARCHAR END, ',' ORDER BY p.conv_id), '')) AS ends FROM p JOIN m USING (conv_id) GROUP BY p.d, p.node),
k AS (SELECT n.*, coalesce(ch.kids, 0) AS n_children FROM n LEFT JOIN (SELECT d - 1 AS d, above AS node, count(*) AS kids FROM n WHERE d > 0 GROUP BY d, above) ch USING (d, node)),
s AS (SELECT p.d, p.node, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum((k.n_convs - 1) * k.bytes) AS saved
  FROM k JOIN p ON p.conv_id = k.conv_id AND p.d <= k.d GROUP BY p.d, p.node)
SELECT k.conv_id, k.d AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, k.ends AS ends_sha256
FROM k JOIN s USING (d, node) LEFT JOIN n u ON u.d = k.d - 1 AND u.node = k.above
"""
