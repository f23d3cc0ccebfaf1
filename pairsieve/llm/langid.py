"""Language identification with bit-sliced Bloom filters over letter n-grams.

One array of slots holds a Bloom filter per language: bit l of every slot is
language l's filter (64 languages a word, more words for more languages). The
bitwise AND over an n-gram's slots gives all languages that contain it at
once. Per-language popcounts over a text, corrected for each filter's false
positive rate, decide.

Learning counts n-grams per language over all training documents. A language
contains an n-gram that makes up at least ``RARE`` of its n-grams and is at
least ``SHARE`` as frequent there as in the language where it is most
frequent. So a filter holds at most 1 / RARE n-grams whatever the corpus size,
and the whole filter, SLOTS words, is what the driver collects and broadcasts.

Defined cases: a null text or one without letters is ``und`` with score 0;
letters without any known n-gram give the most frequent training language with
score 1 / languages; without training rows everything is ``und``; ties go to
the more frequent, then to the alphabetically first language; long texts are
read in overlapping pieces whose counts add up; rows with equal ids are judged
each by its own text; a null id is never trained on nor held out; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of_id, mixed, rows_at_a_time, text_chunks, texts_of

UNKNOWN = "und"
GRAM = 4
SLOTS = 1 << 20
PROBES = 3
RARE = 1e-5
SHARE = 0.2
WORD = 64

_LETTERS: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if "table" not in _LETTERS:
        _LETTERS["table"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS["table"]


def grams(text: str, n: int = GRAM) -> np.ndarray:
    """Hashes of the n-grams of a lower-cased text.

    Everything between words counts as one blank; an n-gram may begin or end
    with a blank but has none inside.
    """
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _letters()[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first sign behind a word
    keep[0] = True
    codes = np.where(is_letter, codes, 32)[keep]
    is_letter = codes != 32
    if len(codes) < n:
        return np.zeros(0, dtype=np.uint64)
    stop = len(codes) - n + 1
    h = codes[:stop].astype(np.uint64)
    good = is_letter[1 : 1 + stop].copy()
    for k in range(1, n):
        h = h * np.uint64(0x100000001B3) + codes[k : k + stop]
        if 1 < k < n - 1:
            good &= is_letter[k : k + stop]
    return mixed(h[good])


def slots_of(h: np.ndarray, slots: int = SLOTS, probes: int = PROBES) -> list[np.ndarray]:
    bits = slots.bit_length() - 1
    return [((h >> np.uint64(k * bits)) & np.uint64(slots - 1)).astype(np.int64) for k in range(probes)]


class Filters:
    """Slots with one bit per language, and each language's false positive rate."""

    def __init__(self, languages: list[str], planes: np.ndarray):
        self.languages = languages
        self.planes = planes
        fill = [np.count_nonzero(planes[k // WORD] >> np.uint64(k % WORD) & np.uint64(1)) / planes.shape[1] for k in range(len(languages))]
        self.false_rate = np.minimum(np.array(fill) ** PROBES, 0.99)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: hits of each language, number of n-grams."""
        hits, total = np.zeros((len(texts), len(self.languages)), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        pending: list[tuple[int, np.ndarray]] = []
        held = 0
        for row, _, piece in text_chunks(texts, GRAM + 1):
            pending.append((row, grams(piece)))
            held += len(pending[-1][1])
            if held > 1 << 18:
                self._add(pending, hits, total)
                pending, held = [], 0
        self._add(pending, hits, total)
        return hits, total

    def _add(self, pending: list[tuple[int, np.ndarray]], hits: np.ndarray, total: np.ndarray) -> None:
        pending = [(row, h) for row, h in pending if len(h)]
        if not pending:
            return
        rows = np.array([row for row, _ in pending])
        sizes = np.array([len(h) for _, h in pending])
        first = np.cumsum(sizes) - sizes
        places = slots_of(np.concatenate([h for _, h in pending]), self.planes.shape[1])
        np.add.at(total, rows, sizes)
        for p, plane in enumerate(self.planes):
            masks = plane[places[0]]
            for at in places[1:]:
                masks &= plane[at]
            for k in range(p * WORD, min(len(self.languages), (p + 1) * WORD)):
                bit = ((masks >> np.uint64(k % WORD)) & np.uint64(1)).astype(np.int32)
                np.add.at(hits[:, k], rows, np.add.reduceat(bit, first))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        hits, total = self.counts([t or "" for t in texts])
        real = np.maximum((hits - total[:, None] * self.false_rate) / (1 - self.false_rate), 0)
        best, known = real.argmax(axis=1), real.sum(axis=1)
        score = np.where(known > 0, real[np.arange(len(texts)), best] / np.where(known > 0, known, 1), 1 / len(self.languages))
        has = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, has, strict=True)], np.where(has, np.clip(score, 0, 1), 0.0)


def gram_counts(training: DataFrame) -> DataFrame:
    """Rows (lang, gram, n): counted within each task first, so that a frequent n-gram is one row per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts):
            g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return g, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                g, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for table in rows_at_a_time(batches):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(table.column("lang").to_pylist(), table.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                parts = held.setdefault(lang, [])
                for _, _, piece in text_chunks(["\n".join(texts)], GRAM + 1):
                    g, n = np.unique(grams(piece), return_counts=True)
                    parts.append((g, n))
                if len(parts) > 8:
                    held[lang] = [merged(parts)]
            size = sum(len(p[0]) for parts in held.values() for p in parts)
            if size > 4_000_000:
                yield from rows()
                held, size = {}, 0
        yield from rows()

    return training.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(training: DataFrame) -> Filters:
    """Filters from ``training`` (text, lang; neither null)."""
    from ..session import written

    counts = written(gram_counts(training), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    order = [r["lang"] for r in totals.orderBy(F.desc("total"), "lang").collect()]
    planes = np.zeros((max(1, -(-len(order) // WORD)), SLOTS), dtype=np.uint64)
    if not order:
        return Filters([], planes)
    places = {lang: k for k, lang in enumerate(order)}
    bit = F.create_map(*[F.lit(v) for pair in places.items() for v in pair])[F.col("lang")]
    frequent = counts.join(totals, "lang").withColumn("f", F.col("n") / F.col("total")).where(F.col("f") >= RARE)
    top = frequent.groupBy("gram").agg(F.max("f").alias("top"))
    own = frequent.join(top, "gram").where(F.col("f") >= SHARE * F.col("top")).withColumn("bit", bit)
    bits = SLOTS.bit_length() - 1
    places_of = F.array(*[F.shiftrightunsigned(F.col("gram"), k * bits).bitwiseAND(SLOTS - 1) for k in range(PROBES)])
    slots = (
        own.select(F.explode(places_of).alias("slot"), (F.floor(F.col("bit") / WORD)).alias("plane"), F.expr(f"shiftleft(1L, cast(bit % {WORD} as int))").alias("mask"))
        .groupBy("plane", "slot")
        .agg(F.bit_or("mask").alias("mask"))
        .toArrow()
    )
    planes[slots.column("plane").to_numpy(), slots.column("slot").to_numpy()] = slots.column("mask").to_numpy().view(np.uint64)
    return Filters(order, planes)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.planes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Filters(*shared.value)
        for table in rows_at_a_time(batches):
            names, score = mine.predict(table.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return texts_of(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify_held_out(docs: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """Learn from documents whose fold isn't ``held``; predict all. Adds ``held_out``."""
    fold = bucket_of_id(F.col("doc_id"), modulus)
    training = texts_of(docs, "lang").where((fold != held) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    found = identify(docs, learn(training))
    return found.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
