"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Sizes: words of each row; equal rows (id, source, size) become one row
   with a count before anything is shuffled on.
2. Targets: sources share the wanted words by weight, none above ``most``
   times its own; the excess is reshared until none is above. Each round is
   one sum over the table of sources, of which two numbers reach the driver.
3. Quotas: the mix is a number of blocks of equal size. Sources get them by
   highest quotients target / (2k - 1); so do the sections of a source and
   the shards of a section from the quota above them, by their words.
4. Selection: a shard's documents stand in seeded order and are cut in blocks
   that are equal but for one word, as many as its words hold. Whole passes over the shard first, then the rest of the quota from a seeded
   block on, cyclically: only documents at the ends of that run are cut.

A source with a third of all rows is many shards of about ``SHARD_WORDS``
words; only the tables of sources, sections and shards are ranked as such.

Defined cases: a null text has no words and takes none; rows without source are
the last source; rows without id are dealt by their size and count; repeated
rows are rows of their own; an empty table gives no rows; a text of any length is
one row; other columns are not looked at. A source's words differ from its
target by rounding to blocks: by at most two blocks for each of its shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3  # times a document may be taken
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 20
SECTION_SHARDS = 1 << 10
CHUNK_COPIES = 1 << 10  # equal rows that travel as one
SEED = "mix"


def _hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _numbered(df: DataFrame, out: str, *order: Column) -> DataFrame:
    """Place (from 1) of each row in the order of the whole table: ranges are numbered apart, one row a range is added up."""
    cut = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    here = cut.withColumn("_here", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return here.join(before, "_part").withColumn(out, (F.col("_before") + F.col("_here")).cast("long")).drop("_part", "_before", "_here")


def sizes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, chunk, copies): rows counted by id, source and size, in chunks of bounded counts."""
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    counted = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK_COPIES}"))).alias("chunk")
    return counted.select("doc_id", "source", "size", "n", chunk).select(
        "doc_id", "source", "size", "chunk", F.least(F.lit(CHUNK_COPIES), F.col("n") - F.col("chunk") * CHUNK_COPIES).cast("long").alias("copies")
    )


def weighted_sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, sid, weight): sources by code point, null last, with weights in turn."""
    sums = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    named = _numbered(sums, "sid", F.col("source").asc_nulls_last())
    return named.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))


def with_targets(sources: DataFrame, percent: int = 100, most: int = MOST) -> DataFrame:
    """Adds ``target``: weight's share of ``percent`` of all words, at most ``most`` times the source."""
    total, weight_sum = (int(x or 0) for x in sources.agg(F.sum("source_size"), F.sum("weight")).first())
    wanted = total * percent // 100
    limit, rest, open_weight, capped = F.col("source_size") * most, wanted, weight_sum, 0
    while open_weight:
        share = F.col("weight") * F.lit(rest).cast("long") / F.lit(open_weight).cast("long")
        row = sources.agg(
            F.count_if(share > limit), F.sum(F.when(share > limit, limit)), F.sum(F.when(share > limit, 0).otherwise(F.col("weight")))
        ).first()
        if row[0] == capped:
            return sources.withColumn("target", F.when(share > limit, limit.cast("double")).otherwise(share))
        capped, rest, open_weight = row[0], wanted - int(row[1] or 0), int(row[2] or 0)
    return sources.withColumn("target", limit.cast("double"))


def _candidates(parties: DataFrame, seats: Column, votes_sum: Column, n_parties: Column) -> DataFrame:
    """Each party's sure seats ``_low`` and, one row each, the further seats ``_k`` it may get, with their quotients.

    With the divisor V/(T+m) all parties together get at least T seats, with
    V/(T-m) at most T; so the seats in between, at most about five for each
    party, are the only open ones. ``_low`` and ``_high`` allow for rounding.
    """
    votes = F.col("votes")

    def at(house: Column) -> Column:
        return F.when(votes_sum > 0, F.floor(votes * F.greatest(house, F.lit(0)) / F.when(votes_sum > 0, votes_sum) + 0.5)).otherwise(0).cast("long")

    bounded = parties.withColumn("_low", F.greatest(at(seats - n_parties) - 1, F.lit(0).cast("long"))).withColumn("_high", at(seats + n_parties) + 1)
    return bounded.withColumn("_k", F.explode(F.expr("sequence(_low + 1, _high)"))).withColumn("_quotient", votes / (2 * F.col("_k") - 1))


def apportion_sources(sources: DataFrame, blocks: int) -> DataFrame:
    """(sid, quota): ``blocks`` seats among the sources by highest quotients, ties to the lower sid."""
    votes_sum, n = sources.agg(F.sum("target"), F.count(F.lit(1))).first()
    parties = sources.select("sid", F.col("target").alias("votes"))
    open_seats = _candidates(parties, F.lit(blocks).cast("long"), F.lit(float(votes_sum or 0)), F.lit(int(n)).cast("long"))
    ranked = written(_numbered(open_seats, "_place", F.col("_quotient").desc(), F.col("sid"), F.col("_k")), "seats")
    sure = int(ranked.where("_k = _low + 1").agg(F.sum("_low")).first()[0] or 0)
    got = F.count_if(F.col("_place") <= blocks - sure)
    return ranked.groupBy("sid").agg((F.first("_low") + got).alias("quota"))


def apportion_within(parties: DataFrame, group: list[str], order: str) -> DataFrame:
    """Adds ``quota``: ``seats`` of the group among its parties by highest quotients of ``votes``; groups are of bounded size."""
    whole = Window.partitionBy(*group)
    known = parties.withColumn("_sum", F.sum("votes").over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))
    known = known.withColumn("votes", F.col("votes").cast("double"))
    open_seats = _candidates(known, F.col("seats"), F.col("_sum").cast("double"), F.col("_n"))
    ranked = open_seats.withColumn("_place", F.row_number().over(whole.orderBy(F.col("_quotient").desc(), order, "_k")))
    ranked = ranked.withColumn("_left", F.col("seats") - F.sum(F.when(F.col("_k") == F.col("_low") + 1, F.col("_low")).otherwise(0)).over(whole))
    return ranked.groupBy(*group, order).agg((F.first("_low") + F.count_if(F.col("_place") <= F.col("_left"))).cast("long").alias("quota"))


def shard_quotas(placed: DataFrame, quotas: DataFrame) -> DataFrame:
    """(sid, shard, words, quota): quotas of sources handed down to sections and shards."""
    shards = placed.groupBy("sid", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    shards = written(shards.withColumn("section", F.expr(f"shard div {SECTION_SHARDS}")), "shards")
    sections = shards.groupBy("sid", "section").agg(F.sum("words").alias("votes")).join(quotas.withColumnRenamed("quota", "seats"), "sid")
    seats = apportion_within(sections, ["sid"], "section").withColumnRenamed("quota", "seats")
    parties = shards.join(seats, ["sid", "section"]).withColumn("votes", F.col("words"))
    return apportion_within(parties, ["sid", "section"], "shard").join(shards, ["sid", "section", "shard"]).select("sid", "shard", "words", "quota")


def _overlap(lo: Column, hi: Column) -> Column:
    """Words of a copy [at, at + size) in [lo, hi)."""
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("at") + F.col("size"), hi) - F.greatest(F.col("at"), lo))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 100, most: int = MOST, block: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target of its source, and the words the mix takes."""
    sizes = written(sizes_of(docs), "sizes")
    sources = written(with_targets(weighted_sources(sizes, weights), percent, most), "sources")
    mixed = float(sources.agg(F.sum("target")).first()[0] or 0.0)
    quotas = apportion_sources(sources, int(mixed / block + 0.5))

    known = sources.select(F.col("source").alias("_source"), "source_size", "sid", "target")
    placed = sizes.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size"), F.col("chunk"))
    n_shards = F.expr(f"(source_size + {SHARD_WORDS - 1}) div {SHARD_WORDS}")
    full = placed.where("size > 0").withColumn("order", F.md5(name)).withColumn("shard", F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % n_shards)

    shards = shard_quotas(full, quotas).withColumn("blocks", F.expr(f"greatest(1L, (2 * words + {block}) div {2 * block})"))
    shards = shards.withColumn("quota", F.least(F.col("quota"), F.col("blocks") * most))
    start = _hash32(F.concat_ws(":", F.lit(seed), F.col("sid"), F.col("shard"))) % F.col("blocks")
    shards = shards.select(
        "sid", "shard", "words", F.expr("quota div blocks").alias("passes"), (F.col("quota") % F.col("blocks")).alias("run"), "blocks", start.alias("start")
    )
    before = Window.partitionBy("sid", "shard").orderBy("order", "doc_id", "size", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    lined = full.withColumn("line", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(before), F.lit(0))).join(shards, ["sid", "shard"])
    copies = lined.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)"))).withColumn("at", F.col("line") + F.col("copy") * F.col("size"))
    run = _overlap(F.expr("start * words div blocks"), F.expr("least(start + run, blocks) * words div blocks")) + _overlap(
        F.lit(0).cast("long"), F.expr("greatest(start + run - blocks, 0L) * words div blocks")
    )
    out = ["doc_id", "size", "source_size", "target"]
    taken = copies.select(*out, (F.col("passes") * F.col("size") + run).cast("long").alias("taken"))
    empty = placed.where("size = 0").withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)"))).select(*out, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty)


#: The same in one statement, with the fixed parameters above; for sources of up to a section of shards.
MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, len(coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), [])) AS size FROM documents),
c AS (SELECT doc_id, source, size, count(*) AS n FROM d GROUP BY ALL),
z AS (SELECT doc_id, source, size, chunk, least({CHUNK_COPIES}, n - chunk * {CHUNK_COPIES}) AS copies
  FROM (SELECT *, unnest(range((n - 1) // {CHUNK_COPIES} + 1)) AS chunk FROM c)),
s AS (SELECT *, (sid - 1) % 3 + 1 AS weight FROM
  (SELECT source, sum(size * copies)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM z GROUP BY source)),
-- sources by the share at which they reach their limit: those before the turning point stop there
o AS (SELECT *, {MOST} * source_size AS top,
  sum(source_size) OVER () - coalesce(sum({MOST} * source_size) OVER w, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight
  FROM s WINDOW w AS (ORDER BY source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT rest, open_weight FROM o WHERE weight * rest / open_weight <= top ORDER BY source_size / weight, sid LIMIT 1),
t AS (SELECT s.*, CASE WHEN weight * rest / open_weight > {MOST} * source_size THEN ({MOST} * source_size)::DOUBLE ELSE weight * rest / open_weight END AS target FROM s, p),
g AS (SELECT sum(target) AS votes, floor(sum(target) / {BLOCK_WORDS} + 0.5)::BIGINT AS seats, count(*) AS m FROM t),
k AS (SELECT sid, low, unnest(range(low + 1, high + 1)) AS k, target FROM (SELECT sid, target,
  greatest(CASE WHEN votes > 0 THEN floor(target * greatest(seats - m, 0) / votes + 0.5) ELSE 0 END::BIGINT - 1, 0) AS low,
  CASE WHEN votes > 0 THEN floor(target * (seats + m) / votes + 0.5) ELSE 0 END::BIGINT + 1 AS high FROM t, g)),
kr AS (SELECT *, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, sid, k) AS place FROM k),
q AS (SELECT sid, first(low) + count(*) FILTER (place <= (SELECT seats FROM g) - (SELECT sum(low) FROM k WHERE k = low + 1)) AS seats FROM kr GROUP BY sid),
f AS (SELECT *, ('0x' || substr("order", 1, 8))::BIGINT % ((source_size + {SHARD_WORDS - 1}) // {SHARD_WORDS}) AS shard FROM (
  SELECT z.*, t.source_size, t.sid, t.target, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size || ':' || chunk) AS "order"
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source WHERE size > 0)),
h AS (SELECT *, sum(words) OVER (PARTITION BY sid) AS votes, count(*) OVER (PARTITION BY sid) AS m FROM
  (SELECT sid, shard, sum(size * copies)::BIGINT AS words, greatest(1, (2 * sum(size * copies)::BIGINT + {BLOCK_WORDS}) // {2 * BLOCK_WORDS}) AS blocks FROM f GROUP BY sid, shard) JOIN q USING (sid)),
hk AS (SELECT *, unnest(range(low + 1, high + 1)) AS k FROM (SELECT *,
  greatest(floor(words::DOUBLE * greatest(seats - m, 0) / votes::DOUBLE + 0.5)::BIGINT - 1, 0) AS low, floor(words::DOUBLE * (seats + m) / votes::DOUBLE + 0.5)::BIGINT + 1 AS high FROM h)),
hr AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY words / (2 * k - 1) DESC, shard, k) AS place,
  seats - sum(CASE WHEN k = low + 1 THEN low ELSE 0 END) OVER (PARTITION BY sid) AS open_seats FROM hk),
hq AS (SELECT sid, shard, words, blocks, least(first(low) + count(*) FILTER (place <= open_seats), {MOST} * blocks) AS quota FROM hr GROUP BY sid, shard, words, blocks),
hs AS (SELECT *, quota // blocks AS passes, quota % blocks AS run, ('0x' || substr(md5('{SEED}:' || sid || ':' || shard), 1, 8))::BIGINT % blocks AS start FROM hq),
l AS (SELECT *, coalesce(sum(size * copies) OVER (PARTITION BY sid, shard ORDER BY "order", doc_id NULLS FIRST, size, chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM f),
a AS (SELECT l.*, hs.words, hs.blocks, passes, run, start, line + unnest(range(copies)) * size AS spot FROM l JOIN hs USING (sid, shard))
SELECT doc_id, size, source_size, target, (passes * size
  + greatest(0, least(spot + size, least(start + run, blocks) * words // blocks) - greatest(spot, start * words // blocks))
  + greatest(0, least(spot + size, greatest(start + run - blocks, 0) * words // blocks) - spot))::BIGINT AS taken FROM a
UNION ALL
SELECT doc_id, size, source_size, target, 0 AS taken FROM (SELECT z.*, unnest(range(copies)) AS i, t.source_size, t.target FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source WHERE size = 0)
"""
