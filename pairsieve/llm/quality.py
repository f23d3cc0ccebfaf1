"""Quality score: a generalised additive model with pairwise interactions.

Text statistics are put into quantile bins. Cyclic boosting goes round the
features again and again; each turn fits a shallow tree over one feature's
bins to the current residuals and adds it to that feature's lookup table.
Then the feature pairs with the most residual gain get two-dimensional tables
in the same way. A score is the sum of table entries through the logistic
function, computed for whole batches by bin lookups.

The statistics of all documents are computed in one pass and written; the
model is fitted on the driver from at most ``SAMPLE_ROWS`` labelled rows, those
with the smallest hash of their id.

Defined cases: null and empty texts have all statistics 0 and are scored as
such; rows with equal ids are scored each by its own text; labels other than 0
and 1 and null ids take no part in learning; several labels of a document
count each; without labels of both kinds the score is the share of label 1
(0.5 without any); texts over 4 MB add up the statistics of their pieces;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import bucket_of_id, prefix_hashes, range_hashes, rows_at_a_time, texts_of

SAMPLE_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 6
RATE = 0.1
THRESHOLD = 0.3
PIECE_BYTES = 4 << 20

FEATURES = (
    "log_bytes", "words", "word_length", "upper", "digit", "mark", "symbol", "high", "bar", "newline",
    "repeated_word", "distinct_word", "short_word", "long_word", "symbol_word", "repeated_line",
)

# kinds of bytes: 0 lower, 1 upper, 2 digit, 3 blank, 4 line feed, 5 mark of a sentence, 6 bar, 7 other symbol, 8 part of a longer sign
_KINDS = np.full(256, 7, dtype=np.int64)
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[128:] = 0, 1, 2, 8
for _c in b" \t\r\x0b\x0c":
    _KINDS[_c] = 3
_KINDS[10], _KINDS[124] = 4, 6
for _c in b".,;:?!'\"()-":
    _KINDS[_c] = 5
N_KINDS = 9


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text."""
    pieces, owner = [], []
    for row, t in enumerate(texts):
        for at in range(0, max(1, len(t)), PIECE_BYTES):
            pieces.append(t[at : at + PIECE_BYTES])
            owner.append(row)
    sums = np.zeros((len(texts), N_KINDS + 9))
    held = start = 0
    for k, p in enumerate(pieces):  # groups of pieces of bounded size
        held += len(p)
        if held > PIECE_BYTES // 4 or k == len(pieces) - 1:
            np.add.at(sums, owner[start : k + 1], _sums(pieces[start : k + 1]))
            start, held = k + 1, 0
    return _features(sums)


def _sums(parts: list[bytes]) -> np.ndarray:
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    kinds = _KINDS[data]
    whose = np.repeat(np.arange(len(parts)), sizes + 1)
    out = np.zeros((len(parts), N_KINDS + 9))
    out[:, :N_KINDS] = np.bincount(whose * N_KINDS + kinds, minlength=len(parts) * N_KINDS).reshape(-1, N_KINDS)
    out[:, 4] -= 1
    hashes = prefix_hashes(data)
    blank = (kinds == 3) | (kinds == 4)
    edge = np.diff(np.concatenate(([1], blank.astype(np.int8))))
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    n = len(parts)
    if len(starts):
        w, of, length = range_hashes(hashes, starts, stops), whose[starts], stops - starts
        count = lambda mask: np.bincount(of[mask], minlength=n)
        out[:, N_KINDS] = np.bincount(of, minlength=n)
        out[:, N_KINDS + 1] = np.bincount(of, weights=length, minlength=n)
        again = np.zeros(len(w), dtype=bool)
        again[1:] = (w[1:] == w[:-1]) & (of[1:] == of[:-1])
        out[:, N_KINDS + 2] = count(again)
        out[:, N_KINDS + 3] = _distinct(of, w, n)
        out[:, N_KINDS + 4] = count(length <= 3)
        out[:, N_KINDS + 5] = count(length >= 14)
        odd = np.concatenate(([0], np.cumsum((kinds == 7) | (kinds == 6))))
        out[:, N_KINDS + 6] = count(odd[stops] > odd[starts])
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate(([0], ends[:-1] + 1))
    full = ends > begins
    lines, of = range_hashes(hashes, begins[full], ends[full]), whose[begins[full]]
    out[:, N_KINDS + 7] = np.bincount(of, minlength=n)
    out[:, N_KINDS + 8] = _distinct(of, lines, n)
    return out


def _distinct(of: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each owner."""
    if not len(h):
        return np.zeros(n)
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    return np.bincount(of[new], minlength=n)


def _features(s: np.ndarray) -> np.ndarray:
    size = s[:, :N_KINDS].sum(axis=1)
    per_byte = lambda k: s[:, k] / np.maximum(size, 1)
    words, lines = s[:, N_KINDS], s[:, N_KINDS + 7]
    per_word = lambda k: s[:, N_KINDS + k] / np.maximum(words, 1)
    return np.column_stack(
        (
            np.log1p(size), np.log1p(words), per_word(1), per_byte(1), per_byte(2), per_byte(5), per_byte(7), per_byte(8), per_byte(6), per_byte(4),
            per_word(2), per_word(3), per_word(4), per_word(5), per_word(6), (lines - s[:, N_KINDS + 8]) / np.maximum(lines, 1),
        )
    )


@dataclass
class Additive:
    """Lookup tables of single features and of pairs."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, f], side="right")]
        coarse = {}
        for a, b, table in self.pairs:
            for f in (a, b):
                if f not in coarse:
                    coarse[f] = np.searchsorted(self.pair_edges[f], x[:, f], side="right")
            out += table[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """Best place to cut bins lo..hi in two; gain 0 if none helps."""
    if hi - lo < 2:
        return 0.0, -1
    cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
    gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
    gain[(ch[:-1] < 1) | (ch[-1] - ch[:-1] < 1)] = 0
    k = int(gain.argmax())
    return float(gain[k]), lo + k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Values of a tree with at most ``leaves`` leaves, one value per bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_split(g, h, lo, hi), (lo, hi)) for lo, hi in parts), key=lambda s: s[0])
        if best[0] <= 0:
            break
        parts.remove(best[2])
        parts += [(best[2][0], best[1]), (best[1], best[2][1])]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut along either axis, then one along the other on both sides."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(gg)):
            out, gain = np.zeros_like(gg), 0.0
            for rows in (slice(0, cut), slice(cut, len(gg))):
                a, b = gg[rows].sum(axis=0), hh[rows].sum(axis=0)
                out[rows] = _tree(a, b, 2)
                gain += _split(a, b, 0, len(a))[0] + _gain(a.sum(), b.sum())
            gain -= _gain(gg.sum(), hh.sum())
            if gain > best[0]:
                best = (gain, out.T if turned else out)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting of single features, then of the best pairs."""
    share = y.mean() if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        p = min(max(float(share), 1e-6), 1 - 1e-6)
        return Additive(float(np.log(p / (1 - p))))
    model = Additive(float(np.log(share / (1 - share))))
    n_features = x.shape[1]
    model.edges = [_cuts(x[:, f], BINS) for f in range(n_features)]
    model.pair_edges = [_cuts(x[:, f], PAIR_BINS) for f in range(n_features)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.pair_edges)]
    raw = np.full(len(y), model.base)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(n_features):
            g, h = residuals()
            size = len(model.tables[f])
            step = RATE * _tree(np.bincount(bins[f], g, size), np.bincount(bins[f], h, size))
            model.tables[f] += step
            raw += step[bins[f]]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], v, shape[0] * shape[1]).reshape(shape)

    g, h = residuals()
    ranked = sorted(((_pair_tree(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(n_features) for b in range(a)), reverse=True)
    model.pairs = [(a, b, np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1))) for gain, a, b in ranked[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            g, h = residuals()
            step = RATE * _pair_tree(grid(a, b, g), grid(a, b, h))[1]
            table += step
            raw += step[coarse[a], coarse[b]]
    return model


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rows_at_a_time(batches):
            x = statistics([t or b"" for t in table.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), *[pa.array(c) for c in x.T]], ["doc_id", *FEATURES])

    raw = texts_of(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return raw.mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def learn(features: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, sample_rows: int = SAMPLE_ROWS) -> Additive:
    """Fit on labelled rows outside the held-out fold."""
    target = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    target = target.where(F.col("quality").isin(0, 1) & (bucket_of_id(F.col("doc_id"), modulus) != held))
    sample = features.join(target, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows).toArrow()
    x = np.column_stack([sample.column(f).to_numpy() for f in FEATURES]) if sample.num_rows else np.zeros((0, len(FEATURES)))
    return fit(x, sample.column("quality").to_numpy().astype(float))


def scored(features: DataFrame, model: Additive) -> DataFrame:
    """doc_id and score from written statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy() for f in FEATURES])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return features.select("doc_id", *FEATURES).mapInArrow(run, "doc_id long, score double")


def sample_statistics(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``with_statistics`` of those rows only that ``learn`` may take: ids up to the hash at which its sample is full."""
    target = labels.select(labels["doc_id"].cast("long").alias("doc_id")).where(labels["quality"].cast("int").isin(0, 1) & (bucket_of_id(labels["doc_id"].cast("long"), modulus) != held))
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id")).join(target, "doc_id").select(F.xxhash64("doc_id").alias("h"))
    last = known.orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    return with_statistics(docs.where(F.xxhash64(docs["doc_id"].cast("long")) <= F.lit(last)) if last is not None else docs.where("false"))


def good_rows(docs: DataFrame, model: Additive, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_at_a_time(batches):
            texts = rows.column("text").cast(pa.string()).cast(pa.binary()).to_pylist()
            keep = model.score(statistics([t or b"" for t in texts])) >= threshold
            yield from rows.filter(pa.array(keep)).to_batches()

    return docs.mapInArrow(run, docs.schema)


def score_held_out(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    features = written(with_statistics(docs), "statistics")
    found = scored(features, learn(features, labels, modulus, held))
    return found.select(
        "doc_id",
        F.coalesce(bucket_of_id(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
