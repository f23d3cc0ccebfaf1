"""Benchmark decontamination by template canonicalisation.

Words are canonicalised: numbers, names (capitalised inside a sentence) and
units behind numbers become typed placeholders, all else is lower case. Windows
of five canonical words of the documents are joined by hash with those of the
benchmark items. On each alignment of a document with an item, the values that
stand in the item's slots must map consistently: one value of the item goes to
one value of the document wherever it recurs. A document is contaminated by an
item when consistent alignments cover at least 75 of 100 of the item's windows,
so a question whose numbers or names were exchanged is caught too.

A capitalised word is surely a name where no sentence or line begins; at such
a place it may be one. As copies lose points, line ends and capitals, every
window comes on both sides in all readings of its capitalised words, as a name
and as a plain word: words match when they are equal apart from case, or as
names. Two words that only may be names don't stand for each other. Values of
words that only may be names are left aside, with the windows that need an
exchange of them, where they are all that makes an alignment inconsistent.

Windows with fewer than three plain words are too general and are used on
neither side, unless all windows of an item are; then all of its windows count.
That is told by the reading in which only sure names are names. Items with
fewer than five words are one window.

Before the join, documents' windows pass a bit array of fixed size that holds
all benchmark hashes (no false negatives); what it lets through besides goes in
the join. Nothing else is broadcast, whatever the size of the benchmark.

Defined cases: null and empty texts, and texts without words, hold no window;
an item without words contaminates nothing; rows with equal ids count together
as one document or item; null ids are left out (there is nothing to report);
empty tables give an empty result; long texts are read whole, in pieces that
overlap by a window; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import mixed, prefix_hashes, range_hashes, rows_at_a_time

WIDTH = 5
LEAST_PLAIN = 3
COVER_NUMERATOR, COVER_DENOMINATOR = 75, 100
FILTER_BITS = 1 << 24
PIECE_BYTES = 1 << 20

# Words that are units behind a number.
UNITS = (
    "mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet g kg mg lb lbs oz ton tons gram grams kilogram kilograms pound pounds "
    "l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "c f k degree degrees percent pct usd eur gbp dollar dollars euro euros cent cents kb mb gb tb bit bits byte bytes hz khz mhz ghz w kw v a j kj cal kcal n pa"
).split()

PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3
MAYBE = "?"  # no word holds it

_WORD, _DIGIT, _UPPER, _STOP, _JOIN = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, dtype=np.uint8)
for _c in range(256):
    if 48 <= _c <= 57:
        _CLASS[_c] = _WORD | _DIGIT
    elif 65 <= _c <= 90:
        _CLASS[_c] = _WORD | _UPPER
    elif 97 <= _c <= 122 or _c >= 128:
        _CLASS[_c] = _WORD
for _c in b".!?\n":
    _CLASS[_c] |= _STOP
for _c in b".,":
    _CLASS[_c] |= _JOIN
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
# Subsets of every set of a window's words, as bits, one set's behind another's.
_LISTS = [[m for m in range(p + 1) if m & p == m] for p in range(1 << WIDTH)]
_SUBSETS = np.array([len(m) for m in _LISTS])
_FIRST_SUBSET = np.cumsum(_SUBSETS) - _SUBSETS
_SUBSET = np.array([m for ms in _LISTS for m in ms])


class Words:
    """Canonical words of one text: bounds, kinds and hashes."""

    def __init__(self, text: bytes):
        data = np.frombuffer(text, dtype=np.uint8)
        kind = _CLASS[data]
        word = (kind & _WORD).astype(bool)
        digit = (kind & _DIGIT).astype(bool)
        if len(data) > 2:  # a point or comma between digits is part of the number
            word[1:-1] |= ((kind[1:-1] & _JOIN) > 0) & digit[:-2] & digit[2:]
        folded = _FOLD[data]
        upper = (kind & _UPPER).astype(bool)
        if len(data) > 1:  # capitals of Latin-1 in UTF-8
            after = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))
            folded[after + 1] += 32
            upper[after] = True
        edge = np.diff(np.concatenate(([0], word.astype(np.int8), [0])))
        self.data = folded
        self.starts, self.stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        n = len(self.starts)
        self.kinds = np.zeros(n, dtype=np.int8)
        self.hashes = np.zeros(0, dtype=np.uint64)
        if not n:
            return
        upto = lambda flags: np.concatenate(([0], np.cumsum(flags, dtype=np.int32)))
        capitals, digits, stops = upto(upper), upto(digit), upto((kind & _STOP) > 0)
        self.hashes = range_hashes(prefix_hashes(folded), self.starts, self.stops)
        number = digits[self.stops] > digits[self.starts]
        self.titled = upper[self.starts] & (capitals[self.stops] - capitals[self.starts] == 1) & (self.stops - self.starts > 1) & ~number
        opens = np.ones(n, dtype=bool)
        opens[1:] = stops[self.starts[1:]] > stops[self.stops[:-1]]
        self.kinds[self.titled & ~opens] = NAME
        self.kinds[number] = NUMBER
        behind = np.flatnonzero(number[:-1]) + 1
        self.kinds[behind[np.isin(self.hashes[behind], _unit_hashes()) & ~number[behind]]] = UNIT
        self.titled &= self.kinds != UNIT
        self.opens = opens

    def __len__(self) -> int:
        return len(self.starts)

    def value(self, k: int) -> str:
        return self.data[self.starts[k] : self.stops[k]].tobytes().decode("utf-8", "replace")

    def plain(self, width: int) -> np.ndarray:
        """Number of plain words of every window of ``width`` words, sure names being names."""
        upto = np.concatenate(([0], np.cumsum(self.kinds == PLAIN)))
        return upto[width:] - upto[:-width]

    def readings(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(names, at, h): windows with each set of their capitalised words, as bits, read as names, and their hashes."""
        n = len(self) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        c = np.where(self.titled | (self.kinds == PLAIN), self.hashes, self.kinds.astype(np.uint64))
        pattern = np.zeros(n, dtype=np.int64)
        for k in range(width):
            pattern |= self.titled[k : k + n].astype(np.int64) << k
        counts = _SUBSETS[pattern]
        at = np.repeat(np.arange(n), counts)
        names = _SUBSET[_FIRST_SUBSET[pattern][at] + np.arange(len(at)) - (np.cumsum(counts) - counts)[at]]
        h = np.full(len(at), width, dtype=np.uint64)
        for k in range(width):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + np.where(names >> k & 1, np.uint64(NAME), c[at + k]))
        return names, at, h

    def slots(self, at: int, width: int, names: int) -> list[str | None]:
        """Values of the placeholders; MAYBE stands before those of words that only may be names."""
        out: list[str | None] = []
        for k in range(at, at + width):
            if self.titled[k]:
                out.append((MAYBE * bool(self.opens[k]) + self.value(k)) if names >> (k - at) & 1 else None)
            else:
                out.append(None if self.kinds[k] == PLAIN else self.value(k))
        return out


_CACHE: dict[str, np.ndarray] = {}


def _unit_hashes() -> np.ndarray:
    if "units" not in _CACHE:
        text = np.frombuffer(" ".join(UNITS).encode(), dtype=np.uint8)
        stops = np.concatenate((np.flatnonzero(text == 32), [len(text)]))
        _CACHE["units"] = range_hashes(prefix_hashes(text), np.concatenate(([0], stops[:-1] + 1)), stops)
    return _CACHE["units"]


WINDOWS = "id long, h long, at long, width int, slots array<string>"


def item_windows(benchmark: DataFrame, id_column: str = "item_id") -> DataFrame:
    """Windows of the items: item_id, h, at (first word), width, slots, n_windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = Words((text or "").encode())
                if not len(words):
                    continue
                width = min(WIDTH, len(words))
                base = words.plain(width)
                general = width < WIDTH or not (base >= LEAST_PLAIN).any()
                chosen, ats, hashes = words.readings(width)
                for names, at, h in zip(chosen.tolist(), ats.tolist(), hashes.view(np.int64).tolist(), strict=True):
                    maybe = sum(names >> k & 1 and bool(words.opens[at + k]) for k in range(width))
                    sure = sum(bool(words.titled[at + k] and not words.opens[at + k]) and not names >> k & 1 for k in range(width))
                    # names that are read as words make a window less general; one opening word may be a name
                    if general or base[at] >= LEAST_PLAIN and (maybe <= 1 or base[at] - maybe + sure >= LEAST_PLAIN):
                        rows.append((item, h, at, width, words.slots(at, width, names)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "h", "at", "width", "slots"])

    raw = benchmark.select(benchmark[id_column].cast("long").alias("id"), benchmark["text"].cast("string").alias("text")).where("id IS NOT NULL")
    found = raw.mapInArrow(run, WINDOWS)
    totals = found.groupBy("id").agg(F.countDistinct("at").alias("n_windows"))
    return found.join(totals, "id").select(F.col("id").alias("item_id"), "h", F.col("at").alias("item_at"), "width", F.col("slots").alias("item_slots"), "n_windows")


def _filter(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bit array over the upper 24 bits of the hashes, and the widths in use (at most WIDTH different ones)."""
    slot = F.shiftrightunsigned("h", 40)
    rows = windows.groupBy(F.shiftright(slot, 6).alias("word"), "width").agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 40) % 64 as int))")).alias("mask")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    np.bitwise_or.at(bits, rows.column("word").to_numpy(), rows.column("mask").to_numpy().view(np.uint64))
    return bits, sorted(set(rows.column("width").to_pylist()))


def document_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows of documents that may be among ``windows``."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(windows))

    def pieces(text: bytes) -> Iterator[tuple[bytes, int, int]]:
        """(piece, its first byte, first byte of the next one's own part); pieces begin and end at blanks."""
        start, stop = 0, len(text)
        while stop - start > PIECE_BYTES:
            cut = text.rfind(b" ", start + 1, start + PIECE_BYTES)
            cut = stop if cut < 0 else cut
            over = cut
            for _ in range(2 * WIDTH):  # words of the next piece, so that no window is lost
                over = text.find(b" ", over + 1)
                if over < 0:
                    over = stop
                    break
            yield text[start:over], start, cut
            start = cut
        yield text[start:stop], start, stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, widths = shared.value
        for table in rows_at_a_time(batches):
            rows = []
            for doc, text in zip(table.column("id").to_pylist(), table.column("text").to_pylist(), strict=True):
                for piece, first, _ in pieces(text or b""):
                    words = Words(piece)
                    for width in widths:
                        names, ats, h = words.readings(width)
                        s = (h >> np.uint64(40)).astype(np.int64)
                        for k in np.flatnonzero((bits[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1)).tolist():
                            at = int(ats[k])
                            rows.append((doc, int(h[k].view(np.int64)), first + at, width, words.slots(at, width, int(names[k]))))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "h", "at", "width", "slots"])

    raw = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").cast("binary").alias("text")).where("id IS NOT NULL")
    return raw.mapInArrow(run, WINDOWS)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs (doc_id, item_id) with covered and total windows; ``reparameterised`` where some slot's value was exchanged."""
    items = written(item_windows(benchmark), "item-windows")
    found = document_windows(docs, items).select(F.col("id").alias("doc_id"), "h", F.col("at").alias("doc_at"), "width", "slots")
    value = lambda c: F.ltrim(c, F.lit(MAYBE))
    pair = lambda s: F.struct(value(s["item"]).alias("item"), value(s["doc"]).alias("doc"), (s["item"].startswith(MAYBE).cast("int") + s["doc"].startswith(MAYBE).cast("int")).alias("maybe"))
    both = F.filter(F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc")), lambda s: s["item"].isNotNull() & s["doc"].isNotNull())
    other = lambda p: p["item"] != p["doc"]
    hits = found.join(items, ["h", "width"]).select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift"), "item_at", "n_windows", F.transform(both, pair).alias("pairs"))
    hits = hits.where(~F.exists("pairs", lambda p: other(p) & (p["maybe"] == 2)))
    hits = hits.withColumn("loose", F.exists("pairs", lambda p: other(p) & (p["maybe"] == 1)))
    # an alignment has at most as many different rows as the item has windows, in each of their readings
    aligned = hits.groupBy("doc_id", "item_id", "shift", "n_windows").agg(
        F.collect_set("item_at").alias("ats"), F.collect_set(F.when(~F.col("loose"), F.col("item_at"))).alias("sure_ats"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    )
    bare = lambda p: F.struct(p["item"], p["doc"])
    aligned = aligned.withColumn("sure", F.array_distinct(F.transform(F.filter("pairs", lambda p: p["maybe"] == 0), bare))).withColumn("pairs", F.array_distinct(F.transform("pairs", bare)))
    one_to_one = lambda c: F.size(c) == F.size(F.array_distinct(F.transform(c, lambda p: p["item"])))
    aligned = aligned.withColumn("all", one_to_one("pairs"))
    used = aligned.where(F.col("all") | one_to_one("sure")).select(
        "doc_id", "item_id", "n_windows", F.when(F.col("all"), F.col("ats")).otherwise(F.col("sure_ats")).alias("ats"), F.exists(F.when(F.col("all"), F.col("pairs")).otherwise(F.col("sure")), other).alias("changed")
    )
    return (
        used.groupBy("doc_id", "item_id", "n_windows")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_set("ats")))).cast("long").alias("n_covered"), F.bool_or("changed").alias("reparameterised"))
        .where(F.col("n_covered") * COVER_DENOMINATOR >= F.col("n_windows") * COVER_NUMERATOR)
        .select("doc_id", "item_id", "n_covered", "n_windows", "reparameterised")
    )
