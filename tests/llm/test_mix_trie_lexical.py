import collections
import hashlib
import math
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairsieve.llm import lexical, mixing, prefix_trie

DOCS = "doc_id long, text string, source string, size long, target double, n long, chunk string"
CONVS = "conv_id long, turn long, role string, text string, path string, bytes long"
ITEMS = "item_id long, text string, block int, terms string"


# --- op11 -------------------------------------------------------------------


def highest_quotients(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        k = min(range(len(votes)), key=lambda i: (-votes[i] / (2 * got[i] + 1), i))
        got[k] += 1
    return got


@pytest.mark.parametrize("votes,seats", [([5, 3, 1], 9), ([1, 1, 1, 1], 2), ([1000.0] + [3.9] * 40, 100), ([7, 0, 0.5], 4), ([10] * 5, 0), ([0.1] * 30 + [500], 31)])
def test_seats_go_to_the_highest_quotients(spark, votes, seats):
    rows = [(k + 1, float(v)) for k, v in enumerate(votes)]
    want = highest_quotients([float(v) for v in votes], seats)
    got = mixing.apportion_sources(spark.createDataFrame(rows, "sid long, target double"), seats).orderBy("sid").collect()
    assert [r.quota for r in got] == want
    grouped = spark.createDataFrame([(g, k, v, seats) for g in (1, 2) for k, v in rows], "g int, k long, votes double, seats long")
    got = mixing.apportion_within(grouped, ["g"], "k").orderBy("g", "k").collect()
    assert [r.quota for r in got] == want * 2


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest, open_ = total - sum(most * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and weight[s] * rest / open_ > most * sizes[s]}
        if not more:
            return {s: float(most * sizes[s]) if s in capped else weight[s] * rest / open_ for s in names}
        capped |= more


def test_mix_reaches_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 700)
    monkeypatch.setattr(mixing, "SECTION_SHARDS", 2)
    rows = [(i, "wört " * (i % 90) + "x", "hot", 0, 0.0, 0, "") for i in range(300)]
    rows += [(1000 + i, "a\tb\nc" * (i % 5), f"s{i % 7}", 0, 0.0, 0, "") for i in range(200)]
    rows += [(2000, "tiny", "B", 0, 0.0, 0, ""), (2001, None, "b", 0, 0.0, 0, ""), (2002, "", None, 0, 0.0, 0, ""), (None, "no id here", None, 0, 0.0, 0, ""), (None, None, None, 0, 0.0, 0, "")]
    rows += [(3000, "again and again", "z", 0, 0.0, 0, "")] * 3000 + [(3001, "w " * 5000, "z", 0, 0.0, 0, "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == collections.Counter((r[0], size(r[1])) for r in rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[2]] += size(r[1])
    want = targets(sizes)
    assert sorted({(r.source_size, r.target) for r in got}) == sorted({(sizes[s], want[s]) for s in sizes})
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    taken = collections.Counter()
    by_id = {(r[0], size(r[1])): r[2] for r in rows}
    for r in got:
        taken[by_id[r.doc_id, r["size"]]] += r.taken
    for s, t in want.items():
        shards = -(-sizes[s] // 700) + 1
        assert abs(taken[s] - t) <= 2 * mixing.BLOCK_WORDS * shards, s
    again = mixing.mix(docs.repartition(13)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "a", 0, 0.0, 0, ""), (2, "", None, 0, 0.0, 0, "")], DOCS)).collect()
    assert sorted((r.doc_id, r.target, r.taken) for r in got) == [(1, 0.0, 0), (2, 0.0, 0)]


# --- op12 -------------------------------------------------------------------


def brute_trie(rows):
    def key(role, text):
        return hashlib.md5(str(len(role.encode())).encode() + b":" + role.encode() + text.encode()).hexdigest()

    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, key(role, text), role, text))
    turns = {c: [(r[3], r[4]) for r in sorted(x)] for c, x in own.items()}
    paths = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
    members = collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = collections.Counter(n[:-1] for n in members if n)
    out = []
    for n, cs in members.items():
        below = [x for x in members if x[: len(n)] == n]
        out.append((
            min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), kids[n], sum(kids[x] == 0 for x in below),
            sum((len(members[x]) - 1) * (len(x[-1][1].encode()) if x else 0) for x in below),
            hashlib.sha256(",".join(str(c) for c in sorted(cs) if paths[c] == n).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def spread(spark, rows):
    """The trie with many shards, whatever the size."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, "clash", 7) for r in rows], CONVS))
        return sorted((tuple(r) for r in got.select(*prefix_trie.OUT).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_trie_against_brute_force(spark):
    rows = []
    for c in range(160):
        for t in range(c % 8):
            rows.append((c, t, "user" if t % 2 else "system", "hello é" if t == 0 and c % 3 else f"turn {t} {(c * 7 % 11) if c % 4 else 'same'}"))
    rows += [(c, t, "user", f"long {t}") for c in (200, 205, 210) for t in range(60)]  # equal long conversations
    rows += [(300, None, None, None), (300, None, "user", ""), (300, 1, None, "x"), (300, 1, None, "x"), (301, 5, "", "only"), (None, 0, "user", "nobody")]
    rows += [(1000 + 5 * k, 0, "user", "one for all") for k in range(300)]
    assert spread(spark, rows) == brute_trie(rows)
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, "", 0) for r in rows], CONVS)).select(*prefix_trie.OUT).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_ids_of_many_equal_conversations_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 7)
    rows = [(k, 0, "user", "same") for k in range(0, 200, 5)]
    assert spread(spark, rows) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert spread(spark, []) == []
    assert spread(spark, [(None, 0, "user", "x")]) == []


def test_walk_needs_no_order_of_ids():
    walk = prefix_trie._Walk({b""})
    a, b = b"a" * 16, b"b" * 16
    for path, n, least in [(a, 2, 9), (a + b, 1, 3), (b, 1, 5)]:
        walk.add(path, [10] * (len(path) // 16), n, least, "x")
    walk.close(-1)
    rows = {(r["depth"], r["conv_id"]): r for r in walk.done}
    assert rows[2, 3]["parent_conv_id"] == 3 and rows[1, 3]["n_convs"] == 3 and rows[1, 3]["saved_tokens"] == 20
    assert rows[0, 3]["n_children"] == 2 and rows[0, 3]["n_leaves"] == 2


def test_skeleton_has_a_limit(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SKELETON_BYTES", 10)
    shards = spark.createDataFrame([(0, b"a" * 32), (1, b"a" * 32 + b"b" * 16)], "shard int, path binary")
    with pytest.raises(ValueError, match="skeleton"):
        prefix_trie.skeleton_of(shards)


# --- op13 -------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_search(docs, items, best=20):
    docs = [(i, collections.Counter(words(t))) for i, t in docs if words(t)]
    n_docs, total = len(docs), sum(sum(d.values()) for _, d in docs)
    df = collections.Counter(t for _, d in docs for t in d)
    out = []
    for item, text in items:
        scores = []
        for i, d in docs:
            m = 100 - 25 + 25 * sum(d.values()) * n_docs // total
            s = 0
            for t in words(text):
                if t in d:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * ((1000000000 * d[t]) // (1000 * d[t] + 12 * m))
            if s > 0:
                scores.append((-s, -1 if i is None else i, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:best])]
    return sorted(out, key=str)


def search_both(spark, docs, items):
    d = spark.createDataFrame([(i, t, "s", 0, 0.0, 0, "") for i, t in docs], DOCS).repartition(5)
    q = spark.createDataFrame([(i, t, 1, "clash") for i, t in items], ITEMS)
    got = lexical.search(d, q).select("item_id", "rank", "doc_id", "score").collect()
    return sorted((tuple(r) for r in got), key=str), brute_search(docs, items)


def test_search_against_brute_force(spark, monkeypatch):
    docs = [(i, " ".join(f"W{(i * j) % 17}-é{j % 5}" for j in range(1, i % 40 + 1)) + " common Common") for i in range(200)]
    docs += [(500 + i, "common words here") for i in range(60)]  # equal scores
    docs += [(None, "common words"), (700, None), (701, ""), (702, "... !"), (703, "x_y`z{3}\x7fÀ"), (3, docs[3][1])]
    items = [(i, " ".join(f"w{(i + j) % 17} common é{j % 5}" for j in range(i + 1))) for i in range(12)]
    items += [(20, "nothing of it"), (21, None), (22, ""), (23, "x y z 3 à À"), (None, "common words"), (24, "common " * 50), (24, "common " * 50)]
    distinct = list(dict.fromkeys(items))
    got, _ = search_both(spark, docs, items)
    want = brute_search(docs, distinct)
    assert got == want
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(lexical, "PIECE_BYTES", 1 << 14)
    assert search_both(spark, docs, items)[0] == want


def test_search_in_nothing(spark):
    assert search_both(spark, [], [(1, "a")])[0] == []
    assert search_both(spark, [(1, "a")], [])[0] == []
    assert search_both(spark, [(1, "a b")], [(1, "a c")])[0] == brute_search([(1, "a b")], [(1, "a c")])


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK_CHARS", 10)
    text = "Aa bb-cc " * 9 + "d" * 50 + " ee"
    assert [t.decode() for part in lexical.terms_of(text) for t in part] == words(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=9, unique=True).map(sorted), max_size=12))
def test_symbols_add_up_to_the_terms(lists):
    pairs, sums = lexical.shared_symbols(lists, 13)
    parts = [collections.Counter([k]) for k in range(13)]
    for a, b in pairs:
        parts.append(parts[a] + parts[b])
    assert [sum((parts[s] for s in x), collections.Counter()) for x in sums] == [collections.Counter(x) for x in lists]
    assert sum(map(len, sums)) + len(pairs) <= sum(map(len, lists))


def test_shared_terms_are_added_once():
    lists = [[1, 2, 3, 4, k] for k in range(10, 20)]
    pairs, sums = lexical.shared_symbols(lists, 20)
    assert len(pairs) == 3 and all(len(x) == 2 for x in sums)
