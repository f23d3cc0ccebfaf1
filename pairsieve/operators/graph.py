"""Jobs on a bipartite edge table (check_id, var_id).

Per-check and per-variable summaries replace self joins wherever the
result allows it, so a check or variable that holds a third of all edges
costs no more than its edges. Summaries go back to the edges through
``attach``, which spreads hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, written
from . import skew
from .ordered import equi_depth, positions, running

c = F.col
SALTS = 4  # per-node tables are about as large as the edges, so they are repeated less often


def attach(big: DataFrame, per_key: DataFrame, keys: list[str], spread: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    return skew.attach(big, per_key, keys, spread, how, SALTS, rows)


HOT_PARTS = 16


def _folded(df: DataFrame, rows: int, key: str, other: str, first: list[Column], then: list[Column]) -> DataFrame:
    """Aggregates per ``key``, in tasks of a bounded number of rows: ``first`` over each of the key's HOT_PARTS parts, cut by ``other``, and ``then`` over these."""
    parted = df.withColumn("_part", F.pmod(F.xxhash64(other), F.lit(HOT_PARTS)))
    per = skew.in_parts(parted, rows, key, "_part").groupBy(key, "_part").agg(*first)
    return skew.in_parts(per, rows, key).groupBy(key).agg(*then)


def with_bits(edges: DataFrame, bits: DataFrame, rows: int | None = None) -> DataFrame:
    return attach(edges, bits.select("var_id", "bit"), ["var_id"], ["check_id"], rows=rows)


# these count the edges first, to deal them out: write the edges where they are costly to compute


def syndrome(edges: DataFrame, bits: DataFrame) -> DataFrame:
    """Parity of the member bits per check."""
    rows = edges.count()
    xor = F.bit_xor("bit").alias("bit")
    return _folded(with_bits(edges, bits, rows), rows, "check_id", "var_id", [xor], [xor]).withColumnRenamed("bit", "parity")


def mismatches(edges: DataFrame, bits: DataFrame, target: DataFrame) -> DataFrame:
    """Checks whose parity differs from the target."""
    both = syndrome(edges, bits).join(target, "check_id")
    return both.where(c("parity") != c("target")).select("check_id")


def degrees(edges: DataFrame, side: str) -> DataFrame:
    return edges.groupBy(side).agg(F.count(F.lit(1)).alias("degree"))


def degree_stats(edges: DataFrame) -> DataFrame:
    return degrees(edges, "var_id").agg(
        F.sum("degree").alias("n_edges"), F.count(F.lit(1)).alias("n_vars"), F.max("degree").alias("max_degree"), F.avg("degree").alias("mean_degree")
    )


def reliability(edges: DataFrame, failing: DataFrame) -> DataFrame:
    """Failing checks per variable and 1 - failing / largest variable degree."""
    rows = edges.count()
    flagged = attach(edges, failing.withColumn("bad", F.lit(1)), ["check_id"], ["var_id"], "left", rows)
    first = [F.count("bad").alias("n_failing"), F.count(F.lit(1)).alias("degree")]
    per = written(_folded(flagged, rows, "var_id", "check_id", first, [F.sum(n).alias(n) for n in ("n_failing", "degree")]), "reliability")
    top = per.agg(F.greatest(F.max("degree"), F.lit(1)).alias("top")).first()["top"] or 1
    return per.select("var_id", "n_failing", (1 - c("n_failing") / F.lit(top)).alias("reliability"))


def reach_two_hops(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Variables that share a check with any seed (the seeds included); linear in the edges."""
    touched = attach(edges, seeds.select("var_id").distinct(), ["var_id"], ["check_id"]).select("check_id").distinct()
    return attach(edges, touched, ["check_id"], ["var_id"]).select("var_id").distinct()


HEAVY = 128


WIDE = 8


def _narrow_reach(counted: DataFrame) -> DataFrame:
    """Members of the narrow classes that share a check with each narrow class, by inclusion and exclusion over its checks."""
    masks = F.explode(F.expr("sequence(1, cast(pow(2, size(cls)) as int) - 1)"))
    subsets = counted.where(F.size("cls") <= WIDE).withColumn("m", masks).select(
        "cls", "n", F.expr("filter(cls, (x, i) -> (shiftright(m, i) & 1) = 1)").alias("part"), F.expr("if(bit_count(m) % 2 = 1, 1, -1)").alias("sign")
    )
    held = subsets.groupBy("part").agg(F.sum("n").alias("held"))
    return attach(subsets, held, ["part"], ["cls"]).groupBy("cls").agg(F.sum(c("sign") * c("held")).alias("k"))


def _wide_reach(classes: DataFrame, counted: DataFrame) -> DataFrame:
    """What wide classes add: all members they reach, and for narrow classes the wide classes' members they reach.

    The members of each large check are bitmaps over numbered variables (32,768
    to a row), and a class reaches the union of its checks' bitmaps. There is
    one row for a class, a check of it and a piece of the numbers, whatever the
    number of classes at a check.
    """
    numbered = written(positions(classes.withColumn("wide", F.size("cls") > WIDE), ["wide"], "var_id", out="number"), "numbered")
    member = numbered.select("wide", "number", F.explode("cls").alias("check_id"))
    maps = member.groupBy("check_id", "wide", F.bitmap_bucket_number("number").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    maps = written(maps, "bitmaps")
    at = counted.select("cls", (F.size("cls") > WIDE).alias("is_wide"), F.explode("cls").alias("check_id"))
    met = at.join(maps, "check_id").where(c("wide") | c("is_wide"))
    pieces = met.groupBy("cls", "wide", "piece").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("k"))
    return pieces.groupBy("cls").agg(F.sum("k").alias("k"))


def _class_reach(classes: DataFrame) -> DataFrame:
    """Members of all classes that share a check with each class, from (var_id, cls): (cls, big_count)."""
    counted = written(classes.groupBy("cls").agg(F.count(F.lit(1)).alias("n")), "classes")
    among_narrow = _narrow_reach(counted)
    if counted.where(F.size("cls") > WIDE).isEmpty():
        return among_narrow.withColumnRenamed("k", "big_count")
    return among_narrow.unionByName(_wide_reach(classes, counted)).groupBy("cls").agg(F.sum("k").alias("big_count"))


PART_ROWS = 1 << 20


def _dealt(pairs: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows by ``keys`` in as many parts as ``rows`` pairs fill with about ``PART_ROWS`` each.

    Rows that will be joined to pairs are dealt so too: then what a task joins,
    sends on or groups takes the same memory whatever the size of the table.
    """
    return pairs.repartition(max(1, -(-rows // PART_ROWS)), *keys)


def _fresh_pairs(light: DataFrame, others: DataFrame, classes: DataFrame, rows: int) -> DataFrame:
    """Variables that share a light check and no large one with each variable of ``light``, itself included, from the pairs."""
    own, other = light.select("check_id", "var_id"), others.select("check_id", c("var_id").alias("other"))
    pairs = _dealt(own, rows, "check_id").join(_dealt(other, rows, "check_id"), "check_id").select("var_id", "other")
    pairs = _dealt(pairs, rows, "var_id", "other").distinct()
    tagged = pairs.join(classes, "var_id", "left").join(classes.select(c("var_id").alias("other"), c("cls").alias("cls2")), "other", "left")
    fresh = tagged.where(~F.coalesce(F.arrays_overlap("cls", "cls2"), F.lit(False)))
    return fresh.groupBy("var_id").agg(F.count(F.lit(1)).alias("light_count"))


def _repeats(light: DataFrame, rows: int) -> DataFrame:
    """For each variable, how often its light checks hold a variable again that another of them holds already.

    Two variables with k common checks repeat k - 1 times, and they are the
    ends of k * (k - 1) / 2 pairs of checks. So pairs are formed of the checks of
    a variable, and of variables only where two checks share several.
    """
    own, other = light.select("check_id", "var_id"), light.select(c("check_id").alias("other"), "var_id")
    checks = _dealt(own, rows, "var_id").join(_dealt(other, rows, "var_id"), "var_id").where(c("check_id") < c("other"))
    shared = _dealt(checks, rows, "check_id", "other").groupBy("check_id", "other").agg(
        F.count(F.lit(1)).alias("n"), F.min("var_id").alias("low"), F.max("var_id").alias("high")
    )
    shared = written(shared.where("n > 1"), "shared")
    met = shared.where("n = 2").select("low", "high")
    more = shared.where("n > 2").select("check_id", "other")
    if not more.isEmpty():
        held = written(checks.join(more, ["check_id", "other"]).select("check_id", "other", c("var_id").alias("low")), "shared-members")
        again = held.select("check_id", "other", c("low").alias("high"))
        met = met.unionByName(held.join(again, ["check_id", "other"]).where(c("low") < c("high")).select("low", "high"))
    per = met.groupBy("low", "high").agg(F.count(F.lit(1)).alias("m")).withColumn("again", F.round((F.sqrt(1 + 8 * c("m")) - 1) / 2).cast("bigint"))
    ends = per.select(c("low").alias("var_id"), "again").unionByName(per.select(c("high").alias("var_id"), "again"))
    return ends.groupBy("var_id").agg(F.sum("again").alias("again"))


def _light_counts(light: DataFrame, classes: DataFrame) -> DataFrame:
    """Variables met through light checks only, itself included, by whichever side forms fewer pairs."""
    reach = written(light.groupBy("var_id").agg(F.count(F.lit(1)).alias("n"), F.sum("degree").alias("members")), "light-reach")
    pairs = (c("n") * (c("n") - 1) / 2).cast("bigint")
    of_members, of_checks, most = (x or 0 for x in reach.agg(F.sum("members"), F.sum(pairs), F.max(pairs)).first())
    if 2 * of_checks >= of_members or most > PART_ROWS:  # the checks of one variable are paired in one task
        return _fresh_pairs(light, light, classes, of_members)
    free = reach.join(classes.select("var_id"), "var_id", "left_anti").join(_repeats(light, of_checks), "var_id", "left")
    counts = free.select("var_id", (c("members") - c("n") + 1 - F.coalesce("again", F.lit(0))).alias("light_count"))
    if classes.isEmpty():
        return counts
    return counts.unionByName(_fresh_pairs(light.join(classes.select("var_id"), "var_id"), light, classes, of_members))


def two_hop_sizes(edges: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Number of distinct variables within two hops of each variable, itself included, from distinct edges.

    Checks of more than ``heavy`` members are never paired. Variables that
    lie in the same set of large checks form one class; how many variables a
    class reaches is counted by inclusion and exclusion over the subsets of its
    checks, so classes that share a check don't meet. Classes of more than
    ``WIDE`` large checks reach the union of their checks' bitmaps.

    Through light checks a variable meets all their members, less those it
    meets again: these follow from pairs of its checks. Where variables have many
    checks, members of light checks meet pairwise instead; that multiplies an
    edge by at most ``heavy``. Light pairs already reached through a large
    check are left out, so the two counts add up exactly.
    """
    sized = written(attach(edges, degrees(edges, "check_id"), ["check_id"], ["var_id"]), "sized-edges")
    big = sized.where(c("degree") > heavy)
    classes = big.groupBy("var_id").agg(F.array_sort(F.collect_set("check_id")).alias("cls"))
    classes = written(classes, "var-classes")
    through_big = _class_reach(classes)
    light_count = _light_counts(sized.where(c("degree") <= heavy), classes)
    every = sized.select("var_id").distinct()
    joined = every.join(light_count, "var_id", "left").join(classes.join(through_big, "cls").select("var_id", "big_count"), "var_id", "left")
    zero = F.lit(0)
    return joined.select("var_id", (F.coalesce("light_count", zero) + F.coalesce("big_count", zero)).alias("n2_size"))


def check_counts(edges: DataFrame, punctured: DataFrame) -> DataFrame:
    """Edges with the degree and punctured count of their check, and the variable's own flag."""
    rows = edges.count()
    flagged = attach(edges, punctured.select("var_id", "punctured"), ["var_id"], ["check_id"], rows=rows)
    first = [F.count(F.lit(1)).alias("degree"), F.count_if("punctured").alias("n_punctured")]
    per = _folded(flagged, rows, "check_id", "var_id", first, [F.sum(n).alias(n) for n in ("degree", "n_punctured")])
    return attach(flagged, per, ["check_id"], ["var_id"], rows=rows)


def extrinsic_score(edges: DataFrame, punctured: DataFrame) -> DataFrame:
    """Smallest share of open neighbours over the checks of a variable; 0 without neighbours."""
    rows = check_counts(edges, punctured)
    own = (~c("punctured")).cast("int")
    share = F.when(c("degree") > 1, (c("degree") - c("n_punctured") - own) / (c("degree") - 1))
    return rows.groupBy("var_id").agg(F.coalesce(F.min(share), F.lit(0.0)).alias("score"))


def excess_degree(edges: DataFrame) -> DataFrame:
    """Sum of max(0, degree - 2) over all co-members, counted per shared check."""
    over = degrees(edges, "var_id").select("var_id", F.greatest(F.lit(0), c("degree") - 2).alias("over"))
    rows = attach(edges, over, ["var_id"], ["check_id"])
    per = rows.groupBy("check_id").agg(F.sum("over").alias("total"))
    return attach(rows, per, ["check_id"], ["var_id"]).groupBy("var_id").agg(F.sum(c("total") - c("over")).alias("score"))


def untainted(edges: DataFrame, punctured: DataFrame) -> DataFrame:
    """Variables without any punctured variable in any of their checks."""
    rows = check_counts(edges, punctured)
    return rows.groupBy("var_id").agg(F.max("n_punctured").alias("worst")).where("worst = 0").select("var_id")


def dead_checks(edges: DataFrame, punctured: DataFrame) -> DataFrame:
    """Checks that would lose their last open variable if this variable were punctured too."""
    rows = check_counts(edges, punctured)
    last = ~c("punctured") & (c("degree") - c("n_punctured") == 1)
    return rows.groupBy("var_id").agg(F.count_if(last).alias("n_dead"))


def first_by(df: DataFrame, rank: str, tie: str, target: int) -> DataFrame:
    """The ``target`` rows of least (rank, tie), without a sort in one task: whole ranks from a histogram, places within the rank at the edge."""
    hist = written(df.groupBy(rank).agg(F.count(F.lit(1)).alias("_k")), "ranks")
    before = running(equi_depth(hist, rank)(hist), [], rank, {"_before": ("sum", c("_k"))}, bucket=c("_b"), inclusive=False)
    edge = before.where(c("_before") < target).select(c(rank).alias("_rank"), "_before", "_k")
    near = df.join(edge, c(rank) == c("_rank")).drop("_rank")
    whole = near.where(c("_before") + c("_k") <= target)
    cut = positions(near.where(c("_before") + c("_k") > target), [rank], tie, out="_place").where(c("_before") + c("_place") <= target)
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))


def _placed(priority: DataFrame, rank: str) -> DataFrame:
    """(var_id, rank, place): the place of each variable in the order of (rank, var_id), from the histogram of ranks."""
    hist = written(priority.groupBy(rank).agg(F.count(F.lit(1)).alias("_k")), "ranks")
    before = running(equi_depth(hist, rank)(hist), [], rank, {"_before": ("sum", c("_k"))}, bucket=c("_b"), inclusive=False).select(rank, "_before")
    inside = positions(priority.select("var_id", rank), [rank], "var_id", out="_inner")
    return attach(inside, before, [rank], ["var_id"]).select("var_id", c(rank).alias("rank"), (c("_before") + c("_inner")).alias("place"))


def untainted_selection(edges: DataFrame, priority: DataFrame, rank: str, target: int) -> DataFrame:
    """Greedy choice by (rank, var_id), each pick removing its two-hop set, up to ``target`` picks.

    The order is fixed beforehand, so all variables that come first in each
    of their checks can be picked in the same round: the result is the same
    as picking one at a time. A variable leaves with all its edges, so it is
    first in each of its checks when it is first in as many as it ever had, and
    the checks it takes along are those. A round is linear in the edges; no pairs
    are formed, and variables are told by their place in the order. The
    remaining edges are written out each round. It ends as soon as ``target``
    picks come before all variables that are left.
    """
    places = written(_placed(priority, rank), "places")
    left = cut_lineage(attach(edges, places.select("var_id", "place"), ["var_id"], ["check_id"]).select("check_id", "place").distinct())
    variables = written(left.groupBy("place").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    picks = None
    while True:
        least = left.agg(F.min("place").alias("least")).first()["least"]
        if least is None:
            break
        if picks is not None and picks.where(c("place") < least).count() >= target:
            break
        first = written(left.groupBy("check_id").agg(F.min("place").alias("place")), "first")
        times = first.groupBy("place").agg(F.count(F.lit(1)).alias("degree"))
        chosen = cut_lineage(times.join(variables, ["place", "degree"]).select("place"))
        picks = chosen if picks is None else picks.unionByName(chosen)
        taken = first.join(chosen, "place").select("check_id")
        gone = attach(left, taken, ["check_id"], ["place"]).select("place").distinct().withColumn("gone", F.lit(True))
        left = cut_lineage(attach(left, gone, ["place"], ["check_id"], "left").where("gone IS NULL").drop("gone"))
    if picks is None:
        return priority.where("false").select("var_id", c(rank).alias("rank"))
    return first_by(places.join(picks, "place").select("var_id", "rank"), "rank", "var_id", target)


def reachable_checks(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """Checks reached from the seeds by alternating steps, with the depth of the first visit.

    Each step joins the frontier to the edges and drops what was seen; the
    frontier and the visited sets are written out.
    """
    seen_vars = cut_lineage(seeds.select("var_id").distinct())
    frontier = seen_vars
    found = None
    for depth in range(0, max_depth, 2):
        hit = attach(edges, frontier, ["var_id"], ["check_id"]).select("check_id").distinct()
        if found is not None:
            hit = hit.join(found, "check_id", "left_anti")
        hit = cut_lineage(hit.withColumn("depth", F.lit(depth)))
        found = hit if found is None else cut_lineage(found.unionByName(hit))
        if depth + 1 >= max_depth or hit.isEmpty():
            break
        step = attach(edges, hit.select("check_id"), ["check_id"], ["var_id"]).select("var_id").distinct()
        frontier = cut_lineage(step.join(seen_vars, "var_id", "left_anti"))
        seen_vars = cut_lineage(seen_vars.unionByName(frontier))
        if frontier.isEmpty():
            break
    return found


def four_cycles(edges: DataFrame) -> DataFrame:
    """Number of cycles of length four.

    Nodes of both sides are ordered by (degree, id). A cycle is counted at
    its highest node from paths that only go down in that order, so a hot
    check is walked along its edges and its members are never paired; the
    work is bounded by edges * sqrt(edges).
    """
    cd = degrees(edges, "check_id").select("check_id", F.struct(c("degree").alias("d"), F.lit(0).alias("s"), c("check_id").alias("i")).alias("co"))
    vd = degrees(edges, "var_id").select("var_id", F.struct(c("degree").alias("d"), F.lit(1).alias("s"), c("var_id").alias("i")).alias("vo"))
    rows = attach(attach(edges, cd, ["check_id"], ["var_id"]), vd, ["var_id"], ["check_id"])
    both = rows.select(c("co").alias("a"), c("vo").alias("b")).unionByName(rows.select(c("vo").alias("a"), c("co").alias("b")))
    # a -> b -> e with b and e below a
    down = both.where(c("b") < c("a"))
    step = both.select(c("a").alias("b"), c("b").alias("e"))
    paths = down.join(step, "b").where(c("e") < c("a"))
    shared = paths.groupBy("a", "e").agg(F.count(F.lit(1)).alias("k"))
    n = F.coalesce(F.sum(c("k") * (c("k") - 1) / 2), F.lit(0.0)).cast("bigint")
    return shared.agg(n.alias("n_cycles")).withColumn("girth_is_four", c("n_cycles") > 0)


def degree_targets(dist: DataFrame, node_count: int) -> DataFrame:
    """Nodes per degree for a distribution (rate, degree, probability), by largest remainder."""
    per_rate = dist.groupBy("rate").agg(F.sum(c("probability") / c("degree")).alias("factor"))
    rows = dist.join(per_rate, "rate")
    total = F.bround(F.lit(node_count) / c("factor"))
    rows = rows.withColumn("expected", c("probability") * total / c("degree")).withColumn("base", F.floor("expected"))
    whole = Window.partitionBy("rate")  # a distribution has a few dozen degrees
    rows = rows.withColumn("missing", node_count - F.sum("base").over(whole)).withColumn(
        "rk", F.row_number().over(whole.orderBy((c("expected") - c("base")).desc(), c("degree").desc()))
    )
    return rows.select("rate", "degree", (c("base") + F.when(c("rk") <= c("missing"), 1).otherwise(0)).alias("n_nodes"))


def nested_patterns(ordered: DataFrame, node_count: int, rates: list[float], mother: float = 0.5) -> DataFrame:
    """First rate whose pattern holds each variable; patterns are prefixes of one order."""
    sizes = F.array(*[F.struct(F.floor(F.lit((1 - mother / r) * node_count + 1e-9)).alias("k"), F.lit(r).alias("rate")) for r in rates])
    fits = F.filter(sizes, lambda s: c("place") <= s["k"])
    return ordered.withColumn("first_rate", F.array_min(F.transform(fits, lambda s: s["rate"]))).where("first_rate IS NOT NULL")


def pattern_sizes(patterns: DataFrame, rates: list[float]) -> Column:
    return F.explode(F.filter(F.array(*[F.lit(r) for r in rates]), lambda r: c("first_rate") <= r))
