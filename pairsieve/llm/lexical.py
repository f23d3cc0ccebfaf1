"""Ranked lexical search of many queries by shared subexpressions.

Queries are taken in blocks of bounded size (``BLOCK_ITEMS``, ``BLOCK_TERMS``);
for each block of queries:

1. Plan (``query_plan``, in a task): a query is its terms in the order of how
   many queries hold them, a repeated term counted up as a term of its own.
   The neighbours that most queries share are taken as one new symbol, again
   and again until no two queries share neighbours. The symbols are a DAG:
   a symbol is the sum of two earlier ones, a query the sum of what is left.
2. Matches: each document's length and counts of the block's terms, from one
   pass over the whole texts. Document frequencies are counted from these.
3. Scores: per piece of documents one row of integers a symbol; every shared
   symbol is added up once, in the order of the DAG, and the queries from them.
   Each task keeps the best documents of each query; the rest is a top-k by
   query over those, in two steps.

Everything after the weights is 64-bit integers, so the order of additions
doesn't change a score. Documents are dealt to tasks by number, never by term,
so a word that all documents hold is a full row of numbers and nothing else.

Defined cases: null and empty texts have no terms and don't count; rows with
equal ids are documents of their own; a null id ranks before all others at
equal scores; an empty table gives no rows. Rows of queries that are equal in
id and text are one query; queries without terms find nothing. Very long texts
are read whole, in pieces cut between terms. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import CHUNK_CHARS, rows_at_a_time, texts_of

BEST = 20
BLOCK_ITEMS = 2048  # queries of one block
BLOCK_TERMS = 1 << 17  # and their terms, repeats included; one longer query is a block of its own
PIECE_BYTES = 64 << 20  # sums held at once
TASK_DOCS = 1 << 13
MOST_TASKS = 10_000
NO_ID = np.iinfo(np.int64).min  # stands for a null doc_id

#: Letters, digits and all beyond ASCII stay, A-Z in lower case; everything else parts terms.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()

ITEMS = "item_id bigint, n_terms bigint, terms array<string>"
MATCHES = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
FOUND = "item int, doc_id bigint, score bigint, part int"


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text, in lists of bounded size."""
    clean = (text or "").encode().translate(_TERM_BYTES)
    at = 0
    while at < len(clean):
        stop = len(clean) if len(clean) - at <= CHUNK_CHARS else clean.find(b" ", at + CHUNK_CHARS)
        stop = len(clean) if stop < 0 else stop
        yield clean[at:stop].split()
        at = stop


def items_of(queries: DataFrame) -> DataFrame:
    """(item_id, n_terms, terms) of each distinct query."""
    rows = queries.select(queries["item_id"].cast("long").alias("item_id"), queries["text"].cast("string").alias("text")).distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_at_a_time(batches):
            lists = [[t.decode() for part in terms_of(text) for t in part] for text in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column("item_id").combine_chunks(), pa.array([len(x) for x in lists], pa.int64()), pa.array(lists, pa.list_(pa.string()))], ["item_id", "n_terms", "terms"]
            )

    return rows.mapInArrow(split, ITEMS).where("n_terms > 0")


def in_blocks(items: DataFrame) -> DataFrame:
    """Adds ``block``: queries of near ids, at most BLOCK_ITEMS and about BLOCK_TERMS terms in one.

    Queries and terms before each are counted within ranges of ids; what a
    range needs to know of those before it is one row a range.
    """
    cut = written(items.repartitionByRange("item_id").withColumn("_part", F.spark_partition_id()), "queries")
    ranges = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_terms").alias("_t"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_n", "_t")])
    inside = Window.partitionBy("_part").orderBy("item_id", F.xxhash64("terms")).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_i", F.count(F.lit(1)).over(inside)).withColumn("_s", F.coalesce(F.sum("n_terms").over(inside), F.lit(0)))
    place = F.struct(F.floor((F.col("_n") + F.col("_i")) / BLOCK_ITEMS).alias("a"), F.floor((F.col("_t") + F.col("_s")) / BLOCK_TERMS).alias("b"))
    placed = local.join(carried, "_part").withColumn("_place", place).select("item_id", "terms", "_place")
    blocks = placed.select("_place").distinct().withColumn("block", F.row_number().over(Window.orderBy("_place")))
    return placed.join(blocks, "_place").drop("_place")


def shared_symbols(lists: list[list[int]], n_terms: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Pairs that make up new symbols (numbered from ``n_terms``), and the lists written with them.

    Each round counts neighbours over all lists and replaces those that at
    least two lists hold, the most shared first; a round is linear in the
    lists, and every replacement shortens them.
    """
    pairs: list[tuple[int, int]] = []
    names: dict[tuple[int, int], int] = {}
    while True:
        seen: Counter = Counter()
        for x in lists:
            seen.update(set(zip(x, x[1:], strict=False)))
        rank = {p: k for k, (p, c) in enumerate(sorted(seen.items(), key=lambda e: (-e[1], e[0]))) if c > 1}
        if not rank:
            return pairs, lists
        shorter = []
        for x in lists:
            places = sorted((rank[p], k) for k, p in enumerate(zip(x, x[1:], strict=False)) if p in rank)
            taken: set[int] = set()
            for _, k in places:
                if k not in taken and k + 1 not in taken and k - 1 not in taken:
                    taken.add(k)
            out, k = [], 0
            while k < len(x):
                if k in taken:
                    pair = (x[k], x[k + 1])
                    if pair not in names:
                        names[pair] = n_terms + len(pairs)
                        pairs.append(pair)
                    out.append(names[pair])
                    k += 2
                else:
                    out.append(x[k])
                    k += 1
            shorter.append(out)
        lists = shorter


PLAN = "block int, terms array<string>, leaf_terms array<int>, left array<int>, right array<int>, item_ids array<bigint>, sums array<array<int>>"


def query_plan(table: pa.Table) -> pa.Table:
    """Plan of one block of queries."""
    rows = sorted(table.select(["item_id", "terms"]).to_pylist(), key=lambda r: (r["item_id"] is not None, r["item_id"] or 0, r["terms"]))
    leaves = []  # a query as (term, how many before it in the query)
    for r in rows:
        before: Counter = Counter()
        leaves.append([])
        for t in r["terms"]:
            leaves[-1].append((t, before[t]))
            before[t] += 1
    shared = Counter(leaf for x in leaves for leaf in x)
    order = {leaf: k for k, leaf in enumerate(sorted(shared, key=lambda e: (-shared[e], e)))}
    terms = sorted({t for t, _ in order})
    number = {t: k for k, t in enumerate(terms)}
    pairs, sums = shared_symbols([sorted(order[leaf] for leaf in x) for x in leaves], len(order))
    plan = {
        "block": table.column("block")[0].as_py(), "terms": terms, "leaf_terms": [number[t] for t, _ in order],
        "left": [a for a, _ in pairs], "right": [b for _, b in pairs], "item_ids": [r["item_id"] for r in rows], "sums": sums,
    }
    kinds = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))]
    return pa.table([pa.array([v], k) for v, k in zip(plan.values(), kinds, strict=True)], names=list(plan))


def matches_of(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with terms: length, and numbers and counts of the given terms (a block's, of bounded size)."""
    shared = docs.sparkSession.sparkContext.broadcast({t.encode(): k for k, t in enumerate(terms)})

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for rows in rows_at_a_time(batches):
            ids, lengths, starts, found, counts, at = [], [], [0], [], [], 0
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                n, here = 0, None
                for part in terms_of(text):
                    n += len(part)
                    new = Counter(map(number, part))
                    here = new if here is None else here + new
                if not n:
                    continue
                here.pop(None, None)
                at += len(here)
                ids.append(doc_id)
                lengths.append(n)
                starts.append(at)
                found += here.keys()
                counts += here.values()
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, pa.int32())) for x in (found, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return texts_of(docs).mapInArrow(match, MATCHES)


def weights_of(matches: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, all their terms, and the weight of each term of the block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(n_terms, dtype=np.int64), 0, 0
        for b in batches:
            df += np.bincount(b.column("terms").flatten().to_numpy(), minlength=n_terms)
            docs, length = docs + b.num_rows, length + int(np.sum(b.column("n").to_numpy()))
        held = np.flatnonzero(df)
        names, values = np.concatenate((held, [-1, -2])), np.concatenate((df[held], [docs, length]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(values, pa.int64())], ["term", "df"])

    # at most a row for each term of the block, whose number is bounded
    rows = matches.select("n", "terms").mapInArrow(count, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    known = dict(zip(rows.column("term").to_pylist(), rows.column("df").to_pylist(), strict=True))
    n = known.get(-1, 0)
    return n, known.get(-2, 0), np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * known.get(t, 0) + 1))) for t in range(n_terms)], dtype=np.int64)


class _Best:
    """The best documents of each query seen so far."""

    def __init__(self, n_items: int, best: int):
        self.best = best
        self.scores = np.zeros((n_items, best), dtype=np.int64)
        self.ids = np.full((n_items, best), np.iinfo(np.int64).max, dtype=np.int64)

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        worst = self.scores[item, -1]
        hits = np.flatnonzero(scores >= max(worst, 1))
        if len(hits) == 0:
            return
        s, d = np.concatenate((self.scores[item], scores[hits])), np.concatenate((self.ids[item], ids[hits]))
        top = np.lexsort((d, -s))[: self.best]
        self.scores[item], self.ids[item] = s[top], d[top]

    def batch(self, part: int) -> pa.RecordBatch:
        item, place = np.nonzero(self.scores)
        ids = self.ids[item, place]
        columns = [pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(self.scores[item, place], pa.int64()), pa.array(np.full(len(item), part), pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score", "part"])


def scored(matches: DataFrame, plan: dict, n_docs: int, all_terms: int, weights: np.ndarray, best: int) -> DataFrame:
    """(item, doc_id, score, part): each task's best documents of each query of the block."""
    leaf_terms = np.array(plan["leaf_terms"], dtype=np.int64)
    pairs = list(zip(plan["left"], plan["right"], strict=True))
    sums = [np.array(x, dtype=np.int64) for x in plan["sums"]]
    n_leaves, n_terms = len(leaf_terms), len(weights)
    first_leaf = np.full(n_terms, -1, dtype=np.int64)
    first_leaf[leaf_terms[::-1]] = np.arange(n_leaves)[::-1]
    repeats = np.flatnonzero(first_leaf[leaf_terms] != np.arange(n_leaves))
    shared = matches.sparkSession.sparkContext.broadcast((weights, first_leaf, leaf_terms, repeats, pairs, sums))
    piece = max(16, PIECE_BYTES // 8 // (n_leaves + len(pairs) + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, first, leaf_terms, repeats, pairs, sums = shared.value
        found, acc = _Best(len(sums), best), None
        for batch in batches:
            for start in range(0, batch.num_rows, piece):
                rows = batch.slice(start, piece)
                n = rows.column("n").to_numpy().astype(np.int64)
                ids = rows.column("doc_id").fill_null(NO_ID).to_numpy()
                lists = rows.column("terms")
                term, tf = lists.flatten().to_numpy().astype(np.int64), rows.column("counts").flatten().to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
                m = 100 - 25 + (25 * n * n_docs) // all_terms
                if acc is None or acc.shape[1] < len(n):
                    acc = np.zeros((n_leaves + len(pairs), len(n)), dtype=np.int64)
                sheet = acc[:, : len(n)]
                sheet[:n_leaves] = 0
                sheet[first[term], doc] = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                for leaf in repeats:
                    sheet[leaf] = sheet[first[leaf_terms[leaf]]]
                for k, (a, b) in enumerate(pairs):
                    np.add(sheet[a], sheet[b], out=sheet[n_leaves + k])
                for item, parts in enumerate(sums):
                    found.add(item, sheet[parts].sum(axis=0), ids)
        yield found.batch(TaskContext.get().partitionId())

    return matches.mapInArrow(score, FOUND)


def search(docs: DataFrame, queries: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each query."""
    items = in_blocks(items_of(queries))
    plans = written(items.groupBy("block").applyInArrow(query_plan, PLAN), "plans")
    out = None
    for (block,) in plans.select("block").orderBy("block").collect():
        plan = plans.where(F.col("block") == block).first().asDict()
        matches = written(matches_of(docs, plan["terms"]), "matches")
        n_docs, all_terms, weights = weights_of(matches, len(plan["terms"]))
        tasks = max(1, -(-n_docs // max(TASK_DOCS, n_docs // MOST_TASKS)))
        found = scored(matches.coalesce(tasks), plan, n_docs, max(all_terms, 1), weights, best)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
        nearly = found.withColumn("_r", F.row_number().over(Window.partitionBy("item", F.col("part") % 64).orderBy(*order))).where(F.col("_r") <= best)
        ranked = nearly.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)).cast("int")).where(F.col("rank") <= best)
        names = F.array(*[F.lit(i).cast("long") for i in plan["item_ids"]])
        result = written(ranked.select(F.element_at(names, F.col("item") + 1).alias("item_id"), "rank", "doc_id", "score"), "ranked")
        out = result if out is None else out.unionByName(result)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return out


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_transform(regexp_extract_all(text, '{TERM}'),
  lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents WHERE text IS NOT NULL),
f AS (SELECT row, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
g AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS all_terms FROM f),
p AS (SELECT row, doc_id, n, t, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS t FROM f) GROUP BY ALL),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(list_transform(regexp_extract_all(text, '{TERM}'),
  lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS t FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY t, n_docs),
s AS (SELECT item_id, row, doc_id, sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // all_terms))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t), g GROUP BY item_id, row, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {BEST}
"""
