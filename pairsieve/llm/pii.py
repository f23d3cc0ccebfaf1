"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them.

Only DataFrame expressions touch rows. Candidates come from patterns; each is
one row with its place and a little context. Four labelers vote for, against or
not at all: a strict check of the form, a gazetteer (domains, address ranges,
issuer digits, calling codes, key prefixes), words in the context, and the
edges of the span. The votes of all candidates are counted per pattern of
votes; that table has at most kinds x 3^4 x lengths rows whatever the corpus
size. From it expectation-maximisation estimates, without labels, how reliable
each labeler is for each kind, and a logistic span classifier is trained on the
posteriors. The classifier is applied to all candidates as an expression.

Base spans (email, ip, card, phone that pass their checks) always stay; the
classifier decides on the others: long-key secrets and account numbers.

Positions are code points, end exclusive. Defined cases: a null text is empty;
no spans give zero counts, the digest of the empty string and an empty list;
rows with equal ids are judged each by its own text; null ids are kept; an
empty table gives an empty result; texts are read whole; other columns pass
through ``redacted`` and are not looked at elsewhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "secret")
CONTEXT = 40

_LOCAL = "[A-Za-z0-9._%+-]"
_RUN = "(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
# A match starts where its run starts or where the last match ended, so a long run is scanned once.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": _RUN,  # maximal runs with 12 to 19 digits; other lengths never pass
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
}
MAY_HOLD = "[0-9@]"

# Fixed values of the gazetteer.
DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info|biz|dev|app"
CALLING_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|2[2-6][0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-3]|50[0-9]|59[0-9]|85[0-6]|88[06]|96[0-8]|97[0-7]|99[2-8]"
KEY_PREFIXES = "sk-|pk_|ghp_|gho_|AKIA|AIza|xox[abp]-"
KEYWORDS = {
    "email": "e-?mail|contact|write|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|master|credit|pay|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon",
    "account": "account|acct|iban|konto|compte|cuenta|customer|number",
    "secret": "token|key|secret|password|passwd|api|bearer|auth",
}
AGAINST = r"version|v\.|page|isbn|doi|commit|sha|md5|total|sum|rev"
LABELERS = ("form", "gazetteer", "context", "edges")


def _luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _byte_parts(text: Column) -> Column:
    bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(text, r"\."), lambda p: (F.length(bare(p)) <= 3) & (bare(p).try_cast("int") <= 255))


def row_key(text: Column) -> list[Column]:
    """Stands for the text of a row where texts aren't carried along."""
    return [F.xxhash64(text).alias("text_key"), F.length(text).alias("text_length")]


def matches(docs: DataFrame, kind: str) -> DataFrame:
    """Rows (doc_id, text_key, text_length, pattern, start, stop, value, before, behind) of one pattern's matches."""
    pattern = F.lit(PATTERNS[kind])
    parts = docs.select(
        "doc_id", *row_key(F.col("text")), F.split("text", PATTERNS[kind], -1).alias("between"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("found")
    ).where(F.size("found") > 0)
    each = parts.select(
        "doc_id", "text_key", "text_length",
        F.posexplode(F.arrays_zip(F.col("found").alias("value"), F.slice("between", F.lit(1), F.size("found")).alias("lead"), F.slice("between", F.lit(2), F.size("found")).alias("tail"))).alias("k", "m"),
    )
    small = each.select(
        "doc_id", "text_key", "text_length", "k", "m.value", F.length("m.lead").alias("lead"), F.right("m.lead", F.lit(CONTEXT)).alias("before"), F.left("m.tail", F.lit(CONTEXT)).alias("behind")
    ).dropDuplicates(["doc_id", "text_key", "text_length", "k"])
    upto = Window.partitionBy("doc_id", "text_key", "text_length").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("lead") + F.length("value")).over(upto)
    return small.withColumn("stop", stop).select(
        "doc_id", "text_key", "text_length", F.lit(kind).alias("pattern"), (F.col("stop") - F.length("value")).alias("start"), "stop", "value", "before", "behind"
    )


def candidates(docs: DataFrame) -> DataFrame:
    """All candidate spans of the rows of ``docs`` (doc_id, text), with kind, base flag and labelers' votes."""
    rows = docs.where(F.col("text").rlike(MAY_HOLD))
    found = matches(rows, "email")
    for kind in ("ip", "card", "phone", "secret"):
        found = found.unionByName(matches(rows, kind))
    digits = F.regexp_replace("value", "[^0-9]", "")
    p = F.col("pattern")
    luhn = F.when(p == "card", _luhn(digits)).otherwise(F.lit(False))
    kind = F.when((p == "card") & ~F.col("luhn"), "account").otherwise(p)
    base = (
        F.when(p == "email", F.lit(True))
        .when(p == "ip", _byte_parts(F.col("value")))
        .when(p == "card", F.col("luhn"))
        .when(p == "phone", F.length(digits).between(9, 15))
        .otherwise(F.lit(False))
    )
    found = found.withColumn("luhn", luhn).withColumn("kind", kind).withColumn("base", base)
    found = found.where(F.col("base") | F.col("kind").isin("account", "secret"))
    return found.select("doc_id", "text_key", "text_length", "kind", "base", "start", "stop", *_votes(digits))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _votes(digits: Column) -> list[Column]:
    k, v = F.col("kind"), F.col("value")
    mixed = v.rlike("[0-9].*[A-Za-z]|[A-Za-z].*[0-9]") & (F.length(F.regexp_replace(v, "[^0-9]", "")) >= 4)
    form = (
        F.when(k == "email", _vote(v.rlike(r"\.[A-Za-z]{2,}$"), v.rlike(r"\.[0-9-]+$")))
        .when(k == "ip", _vote(~v.rlike(r"(^|\.)0[0-9]"), v.rlike(r"(^|\.)0[0-9]")))
        .when(k == "card", _vote(F.length(digits).isin(13, 14, 15, 16), F.length(digits).isin(12, 18)))
        .when(k == "phone", _vote(v.rlike(r"[ ().-]"), v.rlike(r"[-.(]{3}")))
        .when(k == "account", _vote(F.length(digits).between(14, 18), v.rlike("^(.)\\1+$")))
        .otherwise(_vote(mixed & v.rlike("^([0-9a-f]{24,}|[0-9A-F]{24,}|[A-Za-z0-9]{20,64})$"), ~mixed | v.rlike("-.*-.*-")))
    )
    first = F.split(v, r"\.")[0].try_cast("int")
    gazetteer = (
        F.when(k == "email", _vote(v.rlike(rf"(?i)\.({DOMAINS})$"), F.lit(False)))
        .when(k == "ip", _vote(first.between(1, 223), first.isin(0, 127) | (first >= 240)))
        .when(k == "card", _vote(digits.rlike("^(4|5[1-5]|2[2-7]|3[47]|6)"), digits.rlike("^[01789]")))
        .when(k == "phone", _vote(digits.rlike(f"^({CALLING_CODES})"), digits.rlike("^0")))
        .when(k == "account", _vote(digits.rlike("^[1-9]"), digits.rlike("^0000")))
        .otherwise(_vote(v.rlike(f"^({KEY_PREFIXES})"), F.lit(False)))
    )
    near = F.lower(F.col("before"))
    words = F.lit(False)
    for kind, pattern in KEYWORDS.items():
        words = words | ((k == kind) & near.rlike(rf"\b({pattern})\b[^.]*$"))
    context = _vote(words, near.rlike(rf"({AGAINST})\W{{0,3}}$"))
    open_left, open_right = F.col("before").rlike(r"(^|[\s(\[<\"'=:,;])$"), F.col("behind").rlike(r"^($|[\s)\]>\"',;.!?*#$%&])")
    edges = _vote(open_left & open_right, F.col("before").rlike(r"[A-Za-z0-9_]$") | F.col("behind").rlike(r"^[A-Za-z0-9_]"))
    size = F.least(F.floor(F.length(v) / 8), F.lit(6)).cast("int")
    return [form.alias("form"), gazetteer.alias("gazetteer"), context.alias("context"), edges.alias("edges"), size.alias("size")]


# -- learning from counts of vote patterns ----------------------------------

Pattern = tuple[str, tuple[int, ...], int]  # kind, votes, length class


def reliabilities(counts: dict[Pattern, int], rounds: int = 40) -> dict[Pattern, float]:
    """Posterior of each vote pattern being personal data, by expectation-maximisation.

    Per kind: a prior, and for each labeler the probabilities of its three
    votes given a true and a false span; labelers are independent given the
    truth. It starts from the majority of votes.
    """
    post = {p: 1 / (1 + math.exp(-1.5 * sum(p[1]))) for p in counts}
    for _ in range(rounds):
        prior: dict[str, list[float]] = {}
        table: dict[tuple[str, int, int], list[float]] = {}
        for p, n in counts.items():
            kind, votes, _ = p
            for truth, w in ((1, n * post[p]), (0, n * (1 - post[p]))):
                prior.setdefault(kind, [1.0, 1.0])[truth] += w
                for j, v in enumerate(votes):
                    # a labeler is taken to be better than chance until the data say more
                    table.setdefault((kind, j, v), [2.0 if v == -1 else 1.0, 2.0 if v == 1 else 1.0])[truth] += w
        totals: dict[tuple[str, int], list[float]] = {}
        for (kind, j, _), (f, t) in table.items():
            s = totals.setdefault((kind, j), [0.0, 0.0])
            s[0] += f
            s[1] += t
        for p in counts:
            kind, votes, _ = p
            odds = math.log(prior[kind][1] / prior[kind][0])
            for j, v in enumerate(votes):
                f, t = table[kind, j, v]
                sf, st = totals[kind, j]
                odds += math.log(t / st) - math.log(f / sf)
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def span_classifier(counts: dict[Pattern, int], post: dict[Pattern, float], steps: int = 300) -> dict[str, float]:
    """Weights of a logistic classifier trained on the posteriors (full-batch gradient, ridge)."""
    def active(p: Pattern) -> list[str]:
        return [f"kind={p[0]}", f"size={p[0]}/{p[2]}", *[f"{LABELERS[j]}={p[0]}/{v}" for j, v in enumerate(p[1])]]

    weights: dict[str, float] = {name: 0.0 for p in counts for name in active(p)}
    total = sum(counts.values()) or 1
    for _ in range(steps):
        grad = {name: -1e-4 * w for name, w in weights.items()}
        for p, n in counts.items():
            names = active(p)
            z = sum(weights[name] for name in names)
            g = n / total * (post[p] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            for name in names:
                grad[name] += g
        for name in weights:
            weights[name] += 4.0 * grad[name]
    return weights


def learn(found: DataFrame) -> dict[str, float]:
    """Classifier weights from the counted vote patterns of all candidates."""
    rows = found.groupBy("kind", *LABELERS, "size").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {(r["kind"], tuple(r[name] for name in LABELERS), r["size"]): r["n"] for r in sorted(rows, key=str)}
    return span_classifier(counts, reliabilities(counts))


def _accepted(weights: dict[str, float]) -> Column:
    if not weights:
        return F.col("base")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    names = [F.concat(F.lit("kind="), "kind"), F.concat(F.lit("size="), "kind", F.lit("/"), F.col("size").cast("string"))]
    names += [F.concat(F.lit(f"{name}="), "kind", F.lit("/"), F.col(name).cast("string")) for name in LABELERS]
    z = F.lit(0.0)
    for name in names:
        z = z + F.coalesce(F.try_element_at(table, name), F.lit(0.0))
    return F.col("base") | (z >= 0)


def spans(docs: DataFrame) -> DataFrame:
    """Final spans of ``docs`` (doc_id, text): base ones and those the classifier accepts, one row each."""
    found = written(candidates(docs), "span-candidates")
    return found.where(_accepted(learn(found))).select("doc_id", "text_key", "text_length", "kind", "base", "start", "stop")


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def _joined(condition: Column) -> Column:
    item = F.struct("start", _order(F.col("kind")).alias("place"), "stop", "kind")
    items = F.array_sort(F.collect_list(F.when(condition, item)))
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256, spans of every row of ``docs``."""
    rows = texts_of(docs).withColumn("text", F.coalesce("text", F.lit("")))
    of = spans(rows).groupBy("doc_id", "text_key", "text_length").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.lit(True)).alias("spans"),
    )
    keyed = rows.select("doc_id", *row_key(F.col("text")))
    same = keyed["doc_id"].eqNullSafe(of["doc_id"]) & (keyed["text_key"] == of["text_key"]) & (keyed["text_length"] == of["text_length"])
    joined = keyed.join(of, same, "left")
    return joined.select(
        keyed["doc_id"],
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE_KINDS],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span's text replaced by its kind in brackets; overlapping spans are one, named by the first.

    Rows without a digit or an at sign can hold no span and aren't moved.
    """
    t = F.col("text")
    may_hold = F.coalesce(t.rlike(MAY_HOLD), F.lit(False))
    rows = texts_of(docs)
    inside = Window.partitionBy("doc_id", "text_key", "text_length").orderBy("start", _order(F.col("kind")), "stop")
    before = F.coalesce(F.max("stop").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = spans(rows.where(F.col("text").isNotNull())).withColumn("begin", before).where(F.col("stop") > F.col("begin"))
    cut = cut.withColumn("from", F.greatest("start", "begin")).withColumn("shown", F.col("start") >= F.col("begin"))
    lists = cut.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("text_length").alias("_length")).agg(
        F.array_sort(F.collect_list(F.struct("from", "begin", "stop", "kind", "shown"))).alias("_cuts")
    )
    held = docs.where(may_hold)
    same = held["doc_id"].cast("long").eqNullSafe(lists["_id"]) & (F.xxhash64(held["text"]) == lists["_key"]) & (F.length(held["text"]) == lists["_length"])
    kept = F.transform(
        F.col("_cuts"),
        lambda c: F.concat(
            F.substring(t, (c["begin"] + 1).cast("int"), (c["from"] - c["begin"]).cast("int")),
            F.when(c["shown"], F.concat(F.lit("["), F.upper(c["kind"]), F.lit("]"))).otherwise(F.lit("")),
        ),
    )
    end = F.element_at("_cuts", -1)["stop"]
    new = F.when(F.col("_cuts").isNull(), t).otherwise(F.concat(F.array_join(kept, ""), F.substring(t, (end + 1).cast("int"), F.length(t))))
    changed = held.join(lists, same, "left").withColumn("text", new).select(*docs.columns)
    return docs.where(~may_hold).unionByName(changed)
