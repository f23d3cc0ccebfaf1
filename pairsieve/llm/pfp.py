"""Removal of repeated 50-byte strings by prefix-free parsing.

Parsing. A rolling hash of 20 bytes is computed at every position. The trigger
of a 50-byte window is its position of least hash (the leftmost of equals), so
every window has one and equal windows have it at the same place. The windows
that share a trigger make a phrase: the bytes they span. Neighbouring phrases
overlap by 49 bytes, so every window lies in exactly one phrase, and no phrase
is longer than 80 bytes. (A trigger modulus leaves gaps of any length, in which
short repeats would be lost; the least hash has the same expected density.)

Dictionary and parse. Tasks send, per load of texts, the distinct pairs
(trigger, phrase) with the least document that holds them, packed by ranges of
the trigger hash. For each pair that gives the first document:
- a document behind the first has all windows of the phrase removed;
- phrases that share a trigger but differ go into the dictionary with their
  bytes, once each, as a part of their windows may be equal.
Suffix order. The dictionary is dealt out by what stands right or left of the
trigger inside any window, and each share is put in suffix order to a depth of
50: windows in one place of that order are equal, and the least document among
them is the window's first. Where very many phrases have the same bytes around
the trigger (a passage that each document continues in another way), windows
are dealt instead: a bucket of documents sends each distinct window once with
its least document, and gets the least of all buckets back. Combined with the
parse that gives, for all windows of the corpus, whether a smaller document has
them.

Defined cases: null and empty texts have nothing removed, nor has anything
shorter than 50 bytes; equal ids never remove each other's text, and rows with
equal ids are judged each by its own text; a null id neither removes nor loses
anything; an empty table gives an empty result; texts are read whole, very
long ones in overlapping pieces; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import mixed, prefix_hashes, range_hashes, rows_at_a_time
from .idfilter import id_filter, id_slot, in_filter

LENGTH = 50
TRIGGER = 20
SPAN = LENGTH - TRIGGER + 1  # trigger positions of a window
NEAR = SPAN // 2  # bytes on one side of the trigger that windows of that half hold
POSITION_BITS = 18
PIECE = (1 << POSITION_BITS) - 1
LOAD = 3 << 20
PART_BYTES = 48 << 20  # text whose phrases make one part
SHARE_PHRASES = 20_000
HOT_PHRASES = 1_000  # dictionary rows around one trigger from which on its windows are dealt out one by one
PHRASE_BITS = 48
FILTER_BITS = 1 << 23


class Phrases:
    """Phrases of several texts, at most PIECE bytes in all."""

    def __init__(self, texts: list[bytes]):
        self.data = data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        bounds = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        n = len(data) - LENGTH + 1
        if n <= 0:
            self.owner = self.start = self.windows = self.at = np.zeros(0, dtype=np.int64)
            self.trigger = self.phrase = np.zeros(0, dtype=np.uint64)
            self.bounds = bounds
            return
        sums = prefix_hashes(data)
        place = np.arange(len(data) - TRIGGER + 1)
        hashes = range_hashes(sums, place, place + TRIGGER)
        low = np.uint64((1 << POSITION_BITS) - 1)
        least = (hashes & ~low) | place.astype(np.uint64)
        width = 1
        while width * 2 <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < SPAN:
            least = np.minimum(least[: width - SPAN], least[SPAN - width :])
        at = (least & low).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))[:n]
        good = np.arange(n) + LENGTH <= bounds[owner + 1]
        first = good.copy()
        first[1:] &= ~good[:-1] | (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        self.start = np.flatnonzero(first)
        runs = np.cumsum(first) - 1
        self.windows = np.bincount(runs[good], minlength=len(self.start))
        self.at = at[self.start]
        self.owner = owner[self.start]
        self.trigger = mixed(hashes[self.at])  # least hashes are small; mixed again they fill the range
        self.phrase = range_hashes(sums, self.start, self.start + self.windows + LENGTH - 1) & np.uint64((1 << PHRASE_BITS) - 1)
        self.bounds = bounds

    def __len__(self) -> int:
        return len(self.start)


def parsed(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], Phrases]]:
    """(rows, offset of each in its text, phrases) of groups of texts; longer texts in pieces that share LENGTH - 1 bytes."""
    rows: list[int] = []
    offsets: list[int] = []
    held: list[bytes] = []
    size = 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE - LENGTH + 1):
            piece = text[at : at + PIECE]
            if size + len(piece) > PIECE:
                yield rows, offsets, Phrases(held)
                rows, offsets, held, size = [], [], [], 0
            rows.append(row)
            offsets.append(at)
            held.append(piece)
            size += len(piece)
    if held:
        yield rows, offsets, Phrases(held)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string").cast("binary"), F.lit(b""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))


PACKED = "part int, docs binary, counts binary, triggers binary, phrases binary, known boolean"


def _packed_phrases(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : PHRASE_BITS // 8]).tobytes()


def _unpacked_phrases(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, PHRASE_BITS // 8)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, : PHRASE_BITS // 8] = raw
    return out.view("<u8").reshape(-1)


def _pack(part: int, doc: np.ndarray, trigger: np.ndarray, phrase: np.ndarray, known: bool) -> tuple:
    """One row for entries in the order of their documents."""
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    counts = np.diff(np.concatenate((first, [len(doc)])))
    return part, doc[first].astype("<i8").tobytes(), counts.astype("<u4").tobytes(), trigger.astype("<u4").tobytes(), _packed_phrases(phrase), known


def _bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def sent_phrases(texts: DataFrame, part_bits: int, buckets: int) -> DataFrame:
    """Packed distinct (trigger, phrase, least document) of each load of texts.

    What a load itself shows to be repeated is sent as known, to the buckets of
    its documents (negative parts). A trigger hash is its part number and 32
    lower bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rows_at_a_time(batches, LOAD):
            names = table.column("doc_id").to_numpy()
            kept = []
            for rows, _, p in parsed(table.column("text").to_pylist()):
                kept.append((names[np.asarray(rows, dtype=np.int64)][p.owner], p.trigger, p.phrase))
            doc, trigger, phrase = (np.concatenate(c) for c in zip(*kept, strict=True))
            if not len(doc):
                continue
            part = (trigger >> np.uint64(64 - part_bits)).astype(np.int64) if part_bits else np.zeros(len(doc), dtype=np.int64)
            short = trigger & np.uint64(0xFFFFFFFF)
            order = np.lexsort((doc, phrase, short, part))
            doc, short, phrase, part = doc[order], short[order], phrase[order], part[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (phrase[1:] != phrase[:-1]) | (short[1:] != short[:-1]) | (part[1:] != part[:-1])
            least = doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
            known = doc > least
            rows_out = []
            for chosen, flag in ((new, False), (known, True)):
                where = np.flatnonzero(chosen)
                if flag:
                    part = -1 - _bucket(doc, buckets)
                where = where[np.lexsort((doc[where], part[where]))]
                cuts = np.flatnonzero(np.diff(part[where])) + 1
                rows_out += [_pack(int(part[w[0]]), doc[w], short[w], phrase[w], flag) for w in np.split(where, cuts) if len(w)]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows_out, strict=True), kinds, strict=True)], [c.split()[0] for c in PACKED.split(", ")])

    return texts.mapInArrow(run, PACKED)


REPLY = "bucket long, is_whole boolean, docs binary, counts binary, phrases binary"


def _runs(doc: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted documents as distinct ones and how often each comes."""
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    return doc[first].astype("<i8").tobytes(), np.diff(np.concatenate((first, [len(doc)]))).astype("<u4").tobytes()


def _repeated(docs: bytes, counts: bytes) -> np.ndarray:
    return np.repeat(np.frombuffer(docs, dtype="<i8"), np.frombuffer(counts, dtype="<u4"))


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)})


def judged(sent: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, whole, dictionary): per document, packed phrases that a smaller document holds, and those to go into the dictionary.

    Replies of a part travel packed by buckets of documents, so their number
    doesn't grow with documents times parts.
    """

    def judge(group: pa.Table) -> pa.Table:
        whole_doc, whole_phrase, ask = [], [], []
        for docs, counts, triggers, phrases, known in zip(*[group.column(c).to_pylist() for c in ("docs", "counts", "triggers", "phrases", "known")], strict=True):
            doc = _repeated(docs, counts)
            if known:
                whole_doc.append(doc)
                whole_phrase.append(_unpacked_phrases(phrases))
            else:
                ask.append((doc, np.frombuffer(triggers, dtype="<u4"), _unpacked_phrases(phrases)))
        dict_doc = dict_phrase = None
        if ask:
            doc, trigger, phrase = (np.concatenate(c) for c in zip(*ask, strict=True))
            order = np.lexsort((doc, phrase, trigger))
            doc, trigger, phrase = doc[order], trigger[order], phrase[order]
            new_trigger = np.ones(len(doc), dtype=bool)
            new_trigger[1:] = trigger[1:] != trigger[:-1]
            new_phrase = new_trigger.copy()
            new_phrase[1:] |= phrase[1:] != phrase[:-1]
            first = doc[np.flatnonzero(new_phrase)[np.cumsum(new_phrase) - 1]]
            behind = doc > first
            whole_doc.append(doc[behind])
            whole_phrase.append(phrase[behind])
            at = np.flatnonzero(new_trigger)
            group_of = np.cumsum(new_trigger) - 1
            low, high = np.minimum.reduceat(first, at)[group_of], np.maximum.reduceat(first, at)[group_of]
            various = new_phrase & (high > low)  # other phrases of the trigger have other first documents
            dict_doc, dict_phrase = doc[various], phrase[various]
        out = []
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        wholes = (np.concatenate(whole_doc), np.concatenate(whole_phrase)) if whole_doc else none
        for is_whole, (d, p) in ((True, wholes), (False, none if dict_doc is None else (dict_doc, dict_phrase))):
            bucket = _bucket(d, buckets)
            order = np.lexsort((d, bucket))
            d, p, bucket = d[order], p[order], bucket[order]
            for w in np.split(np.arange(len(d)), np.flatnonzero(np.diff(bucket)) + 1):
                if len(w):
                    out.append((int(bucket[w[0]]), is_whole, *_runs(d[w]), _packed_phrases(p[w])))
        return _table(out, REPLY)

    def gather(group: pa.Table) -> pa.Table:
        held: dict[bool, tuple[np.ndarray, np.ndarray]] = {}
        for is_whole in (True, False):
            some = group.filter(pc.equal(group.column("is_whole"), is_whole))
            parts = [(_repeated(d, n), _unpacked_phrases(p)) for d, n, p in zip(*[some.column(c).to_pylist() for c in ("docs", "counts", "phrases")], strict=True)]
            doc, phrase = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            order = np.argsort(doc, kind="stable")
            held[is_whole] = doc[order], phrase[order]
        docs = np.unique(np.concatenate([held[True][0], held[False][0]]))
        columns = []
        for is_whole in (True, False):
            doc, phrase = held[is_whole]
            at, end = np.searchsorted(doc, docs), np.searchsorted(doc, docs, side="right")
            columns.append([_packed_phrases(phrase[x:y]) for x, y in zip(at, end, strict=True)])
        return pa.table({"doc_id": pa.array(docs), "whole": pa.array(columns[0], pa.binary()), "dictionary": pa.array(columns[1], pa.binary())})

    replies = sent.groupBy("part").applyInArrow(judge, REPLY)
    return replies.groupBy("bucket").applyInArrow(gather, "doc_id long, whole binary, dictionary binary")


def _some_texts(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts whose id may be among ``ids``: the others aren't moved."""
    bits = id_filter(ids, FILTER_BITS)
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.flatnonzero(in_filter(shared.value, b.column("slot").to_numpy()))
            if len(keep):
                yield b.select(["doc_id", "text"]).take(pa.array(keep))

    return texts.withColumn("slot", id_slot(F.col("doc_id"), bits)).mapInArrow(run, "doc_id long, text binary")


def _spans(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Union of spans as rows (start, stop), touching ones joined."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return np.column_stack((starts[at], reach[np.concatenate((at[1:], [len(starts)])) - 1]))


PARSE = "doc_id long, text_key binary, spans binary, share long, bytes binary, first int, last int, place binary"


def placed(texts: DataFrame, replies: DataFrame) -> DataFrame:
    """Per text its removed spans so far (share null), and its dictionary phrases, once for each half of their windows.

    ``first`` and ``last`` are the windows of a half relative to ``bytes``,
    ``place`` the positions in the text where those bytes begin.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rows_at_a_time(batches, LOAD):
            names, raw = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
            whole, asked = ([_unpacked_phrases(x) for x in table.column(c).to_pylist()] for c in ("whole", "dictionary"))
            keys = [sha256(t).digest() for t in raw]
            spans: list[list[np.ndarray]] = [[] for _ in raw]
            halves: dict[tuple[int, int, bytes, int, int], list[int]] = {}
            for rows, offsets, p in parsed(raw):
                offsets_ = np.asarray(offsets)
                ends = np.searchsorted(p.owner, np.arange(len(rows) + 1))
                for k in range(len(rows)):
                    row, mine = rows[k], slice(ends[k], ends[k + 1])
                    base = offsets_[k] - p.bounds[k]
                    start, n, at, phrase = p.start[mine], p.windows[mine], p.at[mine], p.phrase[mine]
                    gone = np.isin(phrase, whole[row])
                    if gone.any():
                        spans[row].append(_spans(start[gone] + base, start[gone] + n[gone] + LENGTH - 1 + base))
                    for j in np.flatnonzero(np.isin(phrase, asked[row])).tolist():
                        s, e, t = int(start[j]), int(start[j] + n[j]), int(at[j])  # windows s..e-1, trigger at t
                        turn = min(max(t - NEAR, s), e)  # windows from here on hold NEAR bytes or more behind the trigger
                        if turn < e:
                            lo, hi = turn, e + LENGTH - 1
                            share = xxhash.xxh64_intdigest(p.data[t : t + TRIGGER + NEAR].tobytes(), 1) >> 1
                            halves.setdefault((row, share, p.data[lo:hi].tobytes(), 0, e - turn), []).append(lo + int(base))
                        if s < turn:
                            lo, hi = s, turn + LENGTH - 1
                            share = xxhash.xxh64_intdigest(p.data[t - NEAR : t + TRIGGER].tobytes(), 0) >> 1
                            halves.setdefault((row, share, p.data[lo:hi].tobytes(), 0, turn - s), []).append(lo + int(base))
            out = []
            for row, parts in enumerate(spans):
                joined = np.concatenate(parts) if parts else np.zeros((0, 2), dtype=np.int64)
                out.append((names[row], keys[row], _spans(joined[:, 0], joined[:, 1]).astype("<i8").tobytes(), None, None, None, None, None))
            for (row, share, data, first, last), places in halves.items():
                out.append((names[row], keys[row], None, share, data, first, last, np.array(places, dtype="<i8").tobytes()))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in PARSE.split(", ")])

    return _some_texts(texts, replies.select("doc_id")).join(replies, "doc_id").dropDuplicates(["doc_id", "text"]).mapInArrow(run, PARSE)


def _windows(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows as fixed bytes, row of each, its place in the row's bytes) of dictionary rows."""
    data = group.column("bytes").to_pylist()
    counts = group.column("last").to_numpy().astype(np.int64)
    text = np.frombuffer(b"".join(data), dtype=np.uint8)
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    owner = np.repeat(np.arange(len(data)), counts)
    place = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
    suffixes = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[(np.cumsum(sizes) - sizes)[owner] + place]
    return np.ascontiguousarray(suffixes).view(f"V{LENGTH}").reshape(-1), owner, place


FOUND = "doc_id long, text_key binary, spans binary"


def _found(group: pa.Table, gone: np.ndarray, owner: np.ndarray, place: np.ndarray) -> pa.Table:
    """Spans of the windows ``gone`` of dictionary rows."""
    docs, keys = group.column("doc_id").to_numpy(), group.column("text_key").to_pylist()
    found: dict[tuple[int, bytes], list[np.ndarray]] = {}
    places = group.column("place").to_pylist()
    for w in np.split(gone, np.flatnonzero(np.diff(owner[gone])) + 1):
        if not len(w):
            continue
        k = int(owner[w[0]])
        runs = _spans(place[w], place[w] + LENGTH)
        for at in np.frombuffer(places[k], dtype="<i8").tolist():
            found.setdefault((int(docs[k]), keys[k]), []).append(runs + at)
    joined = {key: np.concatenate(v) for key, v in found.items()}
    return pa.table(
        {
            "doc_id": pa.array([d for d, _ in joined], pa.int64()),
            "text_key": pa.array([t for _, t in joined], pa.binary()),
            "spans": pa.array([_spans(v[:, 0], v[:, 1]).astype("<i8").tobytes() for v in joined.values()], pa.binary()),
        }
    )


def _least(ranks: np.ndarray, docs: np.ndarray) -> np.ndarray:
    first = np.full(int(ranks.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, ranks, docs)
    return first


def suffix_order(dictionary: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans): windows of dictionary phrases that a smaller document holds, as spans of the text."""
    hot = dictionary.groupBy("share").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_PHRASES)
    bits = id_filter(hot.select("share"), FILTER_BITS)
    if not bits.any():
        return _by_share(dictionary)
    shared = dictionary.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def is_hot(slots: pd.Series) -> pd.Series:
        return pd.Series(in_filter(shared.value, slots.to_numpy()))

    # a share goes one way as a whole, also one that the filter lets through besides
    marked = dictionary.withColumn("hot", is_hot(id_slot(F.col("share"), bits)))
    return _by_share(marked.where(~F.col("hot")).drop("hot")).unionByName(_by_window(written(marked.where("hot").drop("hot", "share"), "hot-phrases")))


def _by_share(dictionary: DataFrame) -> DataFrame:
    shares = max(1, -(-dictionary.count() // SHARE_PHRASES))

    def order(group: pa.Table) -> pa.Table:
        windows, owner, place = _windows(group)
        docs = group.column("doc_id").to_numpy()[owner]
        ranks = np.unique(windows, return_inverse=True)[1]
        return _found(group, np.flatnonzero(_least(ranks, docs)[ranks] < docs), owner, place)

    dealt = dictionary.withColumn("share", F.pmod(F.xxhash64("share"), F.lit(shares)))
    return dealt.groupBy("share").applyInArrow(order, FOUND)


def _by_window(dictionary: DataFrame) -> DataFrame:
    """The same with rows dealt by document: only a bucket's distinct windows meet those of other buckets."""
    buckets = max(1, -(-dictionary.count() // HOT_PHRASES))
    dealt = dictionary.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(buckets)))

    def distinct(group: pa.Table) -> pa.Table:
        windows, owner, _ = _windows(group)
        values, ranks = np.unique(windows, return_inverse=True)
        first = _least(ranks, group.column("doc_id").to_numpy()[owner])
        bucket = group.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket] * len(values), pa.int64()), "window": pa.array([v.tobytes() for v in values], pa.binary()), "least": pa.array(first)})

    def answer(rows: pa.Table, firsts: pa.Table) -> pa.Table:
        windows, owner, place = _windows(rows)
        docs = rows.column("doc_id").to_numpy()[owner]
        values, ranks = np.unique(windows, return_inverse=True)
        first = _least(ranks, docs)
        smaller = dict(zip(firsts.column("window").to_pylist(), firsts.column("first").to_pylist(), strict=True))
        if smaller:
            first = np.array([smaller.get(v.tobytes(), f) for v, f in zip(values, first.tolist(), strict=True)], dtype=np.int64)
        return _found(rows, np.flatnonzero(first[ranks] < docs), owner, place)

    sent = written(dealt.groupBy("bucket").applyInArrow(distinct, "bucket long, window binary, least long"), "hot-windows")
    least = sent.groupBy("window").agg(F.min("least").alias("first"))
    answers = sent.join(least, "window").where("first < least").select("bucket", "window", "first")
    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(answer, FOUND)


def removed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, texts): all removed spans as (doc_id, text_key, spans list), and the texts they are in."""
    texts = _texts(docs).where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part_bits = max(0, int(np.ceil(np.log2(max(1, size / PART_BYTES)))))
    buckets = 2 << part_bits
    replies = written(judged(sent_phrases(texts, part_bits, buckets), buckets), "replies")
    parse = written(placed(texts, replies), "parse")
    whole = parse.where("share IS NULL").select("doc_id", "text_key", "spans")
    rest = suffix_order(parse.where("share IS NOT NULL").select("doc_id", "text_key", "share", "bytes", "last", "place"))
    both = whole.unionByName(rest).where(F.octet_length("spans") > 0)
    spans = written(both.groupBy("doc_id", "text_key").agg(F.collect_list("spans").alias("spans")), "spans")
    return spans, texts


REPORT = "doc_id long, text_key binary, n_removed long, n_spans long, kept_sha256 string"


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    spans, texts = removed(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, key, text, lists in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text_key", "text", "spans")], strict=True):
                parts = np.concatenate([np.frombuffer(s, dtype="<i8").reshape(-1, 2) for s in lists])
                gone, kept, at = _spans(parts[:, 0], parts[:, 1]), sha256(), 0
                for start, stop in gone.tolist():
                    kept.update(text[at:start])
                    at = stop
                kept.update(text[at:])
                out.append((doc, key, int((gone[:, 1] - gone[:, 0]).sum()), len(gone), kept.hexdigest()))
            if out:
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in REPORT.split(", ")])

    touched = _some_texts(texts, spans.select("doc_id")).withColumn("text_key", F.unhex(F.sha2("text", 256)))
    results = touched.join(spans, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).mapInArrow(cut, REPORT)
    rows = _texts(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    rows = rows.withColumn("text_key", F.unhex("sha"))
    joined = rows.join(results, ["doc_id", "text_key"], "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )
