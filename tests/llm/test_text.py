import random

import numpy as np
import pytest

from pairsieve.llm import decontam, langid, minhash, pfp, pii, quality
from pairsieve.llm.common import text_chunks

from .brute import base_spans, near_components, repeats

SCHEMA = "doc_id long, text string, score string, component_id long, start long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], SCHEMA)


# -- near duplicates ---------------------------------------------------------


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base[:]
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(300)]
    texts = []
    for size, edits in ((60, 4), (90, 12), (200, 30)):
        texts += family(rng, [rng.choice(vocabulary) for _ in range(size)], 60, edits)
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    texts += ["Same Words Here", "same words\there", "", " \n ", None, "a b c d e f", "a b c d e f", "éÉ Z"]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    want = near_components(docs)
    got = minhash.near_duplicates(frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd_rows(spark):
    got = minhash.near_duplicates(frame(spark, [(5, "one two three four five six")] * 3 + [(None, "one two three four five six"), (2, "one two three four five six")])).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got) == [("2", 2, True), ("5", 2, False), ("5", 2, False), ("5", 2, False), ("None", None, True)]
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    import corpus_pipeline

    a, b, c = ([f"{x}{k}" for k in range(60)] for x in "abc")
    near = lambda words: " ".join([*words[:-1], "z"])
    a, near_a, b, c, near_c = " ".join(a), near(a), " ".join(b), " ".join(c), near(c)
    # 5 is near 3 by one text only, and the least id of two groups; 7 holds near copies of itself
    docs = frame(spark, [(3, a), (5, near_a), (5, b), (9, b), (7, c), (7, near_c), (8, near_c), (5, b), (None, b)])
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(3, 3), (5, 3), (5, 5), (9, 5), (7, 7), (8, 7), (None, None)}
    left = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert left in ([("3", a), ("5", b), ("7", x), ("None", b)] for x in (c, near_c))


def test_sequential_bounds():
    fewest = minhash.fewest_matches(0.75, 1e-5)
    assert list(fewest) == [32, 64, 96, 128] and fewest[128] < 0.75 * 128 and fewest[32] < fewest[64] < fewest[96] < fewest[128]


# -- repeated strings ---------------------------------------------------------


def test_repeats_match_brute_force(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(40, 130))) for _ in range(12)]
    rows = [(i, "".join(rng.choice([*parts, "x" * rng.randint(1, 90), "ab" * 40, "é" * 30]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(3, parts[0] + parts[1]), (3, parts[0] + parts[1]), (None, parts[2]), (70, None), (71, ""), (72, "ab" * 600_000 + parts[3] * 3), (73, parts[3] + "ab" * 100)]
    want = repeats([(i, (t or "").encode()) for i, t in rows if i is not None])
    got = pfp.report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in want[r.doc_id]
    assert pfp.report(frame(spark, [])).count() == 0


def test_repeats_around_a_common_line(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, tails = word(120), [word(90) for _ in range(20)]
    rows = [(i, word(70) + line + rng.choice([word(60), *tails])) for i in range(150)]
    shared, kept = [], pfp._by_share
    monkeypatch.setattr(pfp, "HOT_PHRASES", 20)
    monkeypatch.setattr(pfp, "_by_share", lambda d: shared.append(d.groupBy("share").count().agg({"count": "max"}).first()[0]) or kept(d))
    want = repeats([(i, t.encode()) for i, t in rows])
    got = pfp.report(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in want[r.doc_id] for r in got)
    assert (shared[0] or 0) <= 20


def test_every_window_is_in_one_phrase():
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"ab ") for _ in range(n)) for n in (0, 10, 49, 50, 51, 500, 3000)]
    p = pfp.Phrases(texts)
    assert p.windows.sum() == sum(max(0, len(t) - 49) for t in texts)
    assert p.windows.max() <= pfp.SPAN and (p.at >= p.start + p.windows - 1).all() and (p.at - p.start < pfp.SPAN).all()


# -- personal data ------------------------------------------------------------

PII_TEXTS = [
    "a@b.c_d@e.f x@y.z", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.4.5", "4111 1111 1111 1111 4111-1111-1111-1111  4111111111111111", "+1 (555) 123-4567..9 +1 2",
    "é𝒳 a@b.co 4111111111111111é", None, "", "1 2 3 4 " * 20_000, "a" * 50_000 + "@b.c", "9" * 30_000, "a@b..c a@b. @b.c", "4111 1111 1111 1111 4",
    "000001.0.0.255", 'token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" 0.1.2.3', "12.12.12.12@a.b", "+49.89.1.1.1.1 1-800-555-0199", "no digits",
]


def test_personal_data(spark):
    import hashlib

    rows = [*enumerate(PII_TEXTS), (0, PII_TEXTS[0]), (None, "x@y.zz")]
    got = pii.report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base_spans("x@y.zz" if r.doc_id is None else PII_TEXTS[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}
    red = {r.doc_id: r.text for r in pii.redacted(frame(spark, rows)).collect()}
    assert red[0] == "[EMAIL][EMAIL] [EMAIL]" and red[4] == "é𝒳 [EMAIL] [CARD]é" and red[5] is None and red[6] == "" and red[None] == "[EMAIL]"
    assert red[13] == 'token = "[SECRET]" [IP]' and red[16] == "no digits"
    assert pii.report(frame(spark, [])).count() == 0 and pii.redacted(frame(spark, [])).count() == 0


def test_votes_are_weighed_by_reliability():
    good, noise = ("secret", (1, 0, 1, 1), 4), ("secret", (-1, 0, 0, -1), 2)
    counts = {good: 50, noise: 200, ("secret", (1, 0, -1, 1), 4): 5, ("secret", (-1, 0, 1, -1), 2): 5}
    post = pii.reliabilities(counts)
    assert post[good] > 0.9 > 0.1 > post[noise]
    weights = pii.span_classifier(counts, post)
    assert weights["form=secret/1"] > weights["form=secret/-1"]


# -- decontamination ------------------------------------------------------------


def test_decontamination(spark):
    items = [
        (1, "If Anna buys 12 apples for 3.50 dollars and Bob buys 12 pears, how many kg of fruit does Anna carry home today?"),
        (2, ""), (3, None), (4, "Every window of this plain passage is made of ordinary words that nobody would exchange for others"), (None, "nothing to report at all here"),
    ]
    swapped = "x y. If Carla buys 17 apples for 4 dollars and Tom buys 17 pears, how many kg of fruit does Carla carry home today? z"
    torn = "If Carla buys 17 apples for 4 dollars and Tom buys 19 pears, how many kg of fruit does Mia carry home today?"
    docs = [(1, swapped), (2, torn), (3, "clean text " * 50), (4, None), (5, "so, " + items[3][1].upper() + " and on"), (5, "again"), (None, swapped), (6, "long " * 300_000 + items[3][1])]
    got = decontam.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.reparameterised) for r in got.collect()) == [(1, 1, True), (5, 4, False), (6, 4, False)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(frame(spark, docs), none).count() == 0
    assert decontam.contaminated(frame(spark, []), none).count() == 0


def test_decontamination_without_points_or_case(spark):
    item = "Tom Reed lives in a small town. There he sells fresh bread to people.\nEvery morning Anna Bell walks by with 2 bags. She buys 7 loaves. How many loaves are left?"
    swapped = item.replace("Tom Reed", "Max Ford").replace("Anna Bell", "Eve Long")
    joined = lambda t: t.replace(".", "").replace("?", "").replace("\n", " ")
    texts = [item, item.replace(".", ""), joined(item), item.lower(), item.upper(), item.title(), joined(swapped), swapped.replace("with", "\nwith"), item.replace("There", "Here")]
    texts += [item.replace("Every morning Anna Bell walks by with", "Each evening Eve Long comes home with").replace("She buys", "They sell")]
    docs = [(k, f"Some words before. {t} And behind.") for k, t in enumerate(texts)]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contaminated(frame(spark, docs), items).collect()}
    assert sorted(got) == list(range(9))
    assert all(got[k].n_covered == got[k].n_windows and not got[k].reparameterised for k in range(6))
    assert got[6].reparameterised
    back = decontam.contaminated(frame(spark, [(1, f"x {item} y")]), spark.createDataFrame([(k, f(item)) for k, f in enumerate((joined, str.lower, str.title))], "item_id long, text string"))
    assert sorted(r.item_id for r in back.collect()) == [0, 1, 2]


# -- language -------------------------------------------------------------------

WORDS = {"en": "the of and that with this from have", "fr": "les des une que pour dans sur avec", "de": "der die und das nicht mit sich auf"}


def language_rows(n=300):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(2, 60))).capitalize() + ".", lang))
    return rows


def test_language_held_out(spark):
    rows = language_rows()
    odd = [(1000, None, "en"), (1001, "", "fr"), (1002, "12 34 !!", "en"), (1003, "漢字", None), (1003, "漢字", None), (None, "the and of that with", "en"), (1004, "die " * 600_000, None)]
    got = langid.identify_held_out(spark.createDataFrame([(*r, 0.0) for r in rows + odd], "doc_id long, text string, lang string, score double")).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].lang_pred == by_id[1001].lang_pred == by_id[1002].lang_pred == "und" and by_id[1000].score == 0
    assert by_id[1003].lang_pred in WORDS and by_id[1004].lang_pred == "de" and by_id[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got)


def test_language_without_training(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify_held_out(df).collect()] == ["und"]
    assert langid.identify_held_out(df.limit(0)).count() == 0


def test_pieces_overlap():
    pieces = list(text_chunks(["abcdefghij"], 2, 4))
    assert [p for _, _, p in pieces] == ["abcd", "cdef", "efgh", "ghij"]


# -- quality ----------------------------------------------------------------------


def quality_rows(n=400):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice("the cat of and house that river stone".split()) for _ in range(rng.randint(20, 80))]
        bad = i % 3 == 0
        text = " ".join(w.upper() + "!!" if bad and i % 2 else w + "***" if bad else w for w in words)
        docs.append((i, text))
        labels.append((i, 0 if bad else 1, 0))
    return docs, labels


def test_quality_held_out(spark):
    docs, labels = quality_rows()
    odd = [(1000, None), (1001, ""), (None, "the cat"), (3, "the cat and the river"), (1002, "| " * 3_000_000)]
    extra = [(None, 1, 0), (1, None, 0), (2, 7, 0), (4, 1, 0)]
    got = quality.score_held_out(frame(spark, docs + odd), spark.createDataFrame(labels + extra, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs) + len(odd)
    truth = {i: q for i, q, _ in labels if i != 3}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and np.mean([truth[r.doc_id] == r.predicted for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


@pytest.mark.parametrize("labels, share", [([], 0.5), ([(1, 1, 0)], 1.0)])
def test_quality_without_two_classes(spark, labels, share):
    got = quality.score_held_out(frame(spark, [(1, "a"), (2, "b")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(abs(r.score - share) < 1e-3 for r in got)


def test_pair_tables_find_interactions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.8
