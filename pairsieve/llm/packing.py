"""Hierarchical multi-length packing of documents into training sequences.

Each task packs what it has read, in loads of a bounded number of ids:

1. whole windows are cut from the front of long documents;
2. every rest is routed to the shortest context tier that holds it;
3. each tier is packed by best fit, longest first, into sequences of its size;
4. gaps are filled with documents of shorter tiers, the last bit of a gap with
   the front of one that is cut there;
5. what is left at the end of a load is cut into power-of-two sequences, which
   need no padding;
6. sequences are dealt out to step groups of equal token budget.

Nothing is shuffled: a sequence never crosses tasks, and a load is dropped
once it is packed.

Defined cases: a null or empty text is the end id alone; every row of the
table is packed, equal ids or texts or not, with null ids too; an empty table
gives no pieces; texts of any length are cut over many sequences; other
columns are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import rows_at_a_time, texts_of
from .tokens import encoder

END_ID = 2
WINDOW = 4096
TIERS = (512, 1024, 2048, 4096)
LOAD_IDS = 1 << 20
STEP_IDS = 8 * WINDOW

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, step_group long"
)

Piece = tuple[int, int, int]  # document of the load, start, length


class Rests:
    """Documents' rests by length: the longest that fits a gap, and any to cut."""

    def __init__(self, rests: list[Piece]):
        self.by_length = sorted(((n, doc, start) for doc, start, n in rests))

    def __bool__(self) -> bool:
        return bool(self.by_length)

    def longest(self) -> Piece:
        n, doc, start = self.by_length.pop()
        return doc, start, n

    def fitting(self, room: int) -> Piece | None:
        k = bisect_right(self.by_length, (room, 1 << 62, 1 << 62))
        if k == 0:
            return None
        n, doc, start = self.by_length.pop(k - 1)
        return doc, start, n

    def cut(self, room: int) -> Piece | None:
        """``room`` ids from the front of the shortest rest; the remainder goes back."""
        if not self.by_length:
            return None
        n, doc, start = self.by_length.pop(0)
        taken = min(n, room)
        if n > taken:
            insort(self.by_length, (n - taken, doc, start + taken))
        return doc, start, taken


def packed(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences, each a list of pieces; all are full, of a tier's size or a smaller power of two."""
    window = tiers[-1]
    full: list[list[Piece]] = []
    rests: list[list[Piece]] = [[] for _ in tiers]
    for doc, n in enumerate(lengths):
        whole = n // window
        full.extend([(doc, k * window, window)] for k in range(whole))
        if rest := n - whole * window:
            rests[next(t for t, size in enumerate(tiers) if rest <= size)].append((doc, whole * window, rest))
    shelves = [Rests(r) for r in rests]
    for t in range(len(tiers) - 1, -1, -1):
        while shelves[t]:
            sequence = [shelves[t].longest()]
            room = tiers[t] - sequence[0][2]
            for shelf in shelves[t::-1]:
                while room and (piece := shelf.fitting(room)):
                    sequence.append(piece)
                    room -= piece[2]
            for shelf in shelves[t::-1]:
                while room and (piece := shelf.cut(room)):
                    sequence.append(piece)
                    room -= piece[2]
            full.extend([sequence] if not room else _powers_of_two(sequence))
    return full


def _powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """The end of a load, cut into sequences whose lengths are powers of two."""
    left, out = list(reversed(pieces)), []
    total = sum(n for _, _, n in pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        if not total >> bit & 1:
            continue
        room, sequence = 1 << bit, []
        while room:
            doc, start, n = left.pop()
            taken = min(n, room)
            sequence.append((doc, start, taken))
            if n > taken:
                left.append((doc, start + taken, n - taken))
            room -= taken
        out.append(sequence)
    return out


def step_groups(sizes: list[int], budget: int = STEP_IDS) -> list[int]:
    """Group of each sequence: longest first into the emptiest group, so that groups hold about ``budget`` ids each."""
    n = max(1, round(sum(sizes) / budget))
    heap = [(0, g) for g in range(n)]
    import heapq

    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        held, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (held + sizes[k], g))
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, load_ids: int = LOAD_IDS) -> DataFrame:
    """One row per piece. ``sequence_id`` has the task in its upper bits; ``sequence_length`` is a tier or a smaller power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, base = encoder(vocabulary), TaskContext.get().partitionId() << 40
        names: list[int | None] = []
        held: list[np.ndarray] = []
        count = next_sequence = next_group = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_sequence, next_group
            sequences = packed([len(x) for x in held], tiers)
            sizes = [sum(p[2] for p in s) for s in sequences]
            groups = step_groups(sizes, 8 * tiers[-1])
            rows = []
            for k, (s, size, g) in enumerate(zip(sequences, sizes, groups, strict=True)):
                offset = 0
                for doc, start, n in s:
                    crc = zlib.crc32(held[doc][start : start + n].astype("<u4").tobytes())
                    rows.append((names[doc], start, n, crc, len(held[doc]), base + next_sequence + k, offset, size, base + next_group + g))
                    offset += n
            next_sequence, next_group = next_sequence + len(sequences), next_group + max(groups) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

        for rows in rows_at_a_time(batches):
            for name, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                names.append(name)
                held.append(np.append(coder.encode(text), np.uint32(end_id)))
                count += len(held[-1])
                if count >= load_ids:
                    yield flush()
                    names, held, count = [], [], 0
        if held:
            yield flush()

    return texts_of(docs).mapInArrow(run, PIECES)
