import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pairsieve.llm import packing, token_files
from pairsieve.llm.tokens import WordEncoder
from pairsieve.session import scratch_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "İ. x", "Σας ΟΔΟΣ. a", "<|endoftext|> <|ENDOFTEXT|>a", "a\tb\x1cc  d\n\ne", "it's IT'S don't.", "éa. ́.", "x" * 300 + " y.", "x,. y..", " ", "",
    "ÀÉ, ß. 12.5, ñ b", "ⅷ. Å Kelvin K.", "The cat sat. " * 700, None,
]
SCHEMA = "doc_id long, text string, sequence_id string, start long"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")


@pytest.mark.parametrize("room", [600_000, 7])
def test_words_give_the_ids_of_whole_texts(plain, room):
    coder = WordEncoder(VOCABULARY, room)
    for text in TEXTS * 2:
        assert [*coder.encode(text).tolist(), 2] == plain(text).tolist()


def rows():
    """Repeated rows, ties, nulls, columns with clashing names."""
    return [(i, t, "s", 7) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], "s", 7), (1, "other", None, None), (None, "no id", None, None), (-5, "before all", "x", 0)]


def test_pieces_cover_every_id_once(spark, plain):
    pieces = packing.pack(spark.createDataFrame(rows(), SCHEMA).repartition(3), VOCABULARY, load_ids=3000).collect()
    sequences, covered = collections.defaultdict(list), collections.Counter()
    texts = collections.defaultdict(list)
    for i, t, *_ in rows():
        texts[i].append(plain(t))
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        covered[p.doc_id] += p.length
        fitting = [x for x in texts[p.doc_id] if len(x) == p.doc_tokens]
        assert p.ids_crc32 in {zlib.crc32(x[p.start : p.start + p.length].tobytes()) for x in fitting}
    assert covered == {i: sum(map(len, x)) for i, x in texts.items()}
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0


def test_packed_fills_tiers():
    sequences = packing.packed([5000, 100, 300, 600, 900, 1500, 3000, 4096, 1])
    sizes = [sum(n for _, _, n in s) for s in sequences]
    assert sum(sizes) == 15497 and all(n & (n - 1) == 0 for n in sizes)
    assert max(packing.step_groups([4096] * 16)) == 1


def test_files_round_trip(spark, plain):
    folder = scratch_path(spark, "test-tokens")
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    token_files.write_token_files(df, folder, VOCABULARY)
    got = token_files.read_token_files(spark, folder).collect()
    at = 0
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for want, r in zip(order, sorted(got, key=lambda r: r.start), strict=True):
        ids = plain(want[1])
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (want[0], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    folder = scratch_path(spark, "test-tokens")
    token_files.write_token_files(empty, folder, VOCABULARY)
    assert token_files.read_token_files(spark, folder).count() == 0
    assert packing.pack(empty, VOCABULARY).count() == 0
