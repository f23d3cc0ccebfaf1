"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

__all__ = ["read", "texts_of", "written", "text_chunks", "rows_at_a_time", "joined_bytes", "bucket_of_id", "word_shingles", "few_rows_a_batch"]

CHUNK_CHARS = 1 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (long) and ``text`` of a documents table, and ``more`` columns; all others are left behind."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *[docs[c] for c in more])


def few_rows_a_batch(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on the session sends at most ``rows`` rows at once to Python: a batch of whole texts is held in the JVM and in the worker."""
    if not 0 < int(spark.conf.get(BATCH_KEY)) <= rows:
        spark.conf.set(BATCH_KEY, str(rows))


def bucket_of_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the fold of a document (null for a null id)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def rows_at_a_time(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_CHARS, column: str = "text") -> Iterator[pa.Table]:
    """Arrow batches cut so that one piece holds about ``limit`` bytes of ``column``; a longer row stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        sizes = np.asarray(pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy(), dtype=np.int64)
        piece = (np.cumsum(sizes) - sizes) // limit
        cuts = np.flatnonzero(np.diff(piece)) + 1
        start = 0
        for stop in [*cuts.tolist(), len(sizes)]:
            if stop > start:
                yield table.slice(start, stop - start)
            start = stop


def text_chunks(texts: list[str], overlap: int, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int, str]]:
    """(row, start, piece): texts in pieces of at most ``limit`` characters that share ``overlap`` characters."""
    for row, text in enumerate(texts):
        if len(text) <= limit:
            yield row, 0, text
            continue
        for start in range(0, len(text) - overlap, limit - overlap):
            yield row, start, text[start : start + limit]


def joined_bytes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All parts behind each other as uint8, and their bounds (one more than there are parts)."""
    bounds = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), bounds


# -- word shingles ---------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15  # multiplier of the polynomial; odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1


def _byte_codes() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_CODES = _byte_codes()
KEPT_POWERS = 5 << 20  # above the pieces of all operators
_POWERS = {"n": 0}


def _powers_of(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, kept per process up to the largest n seen; those beyond KEPT_POWERS (a very long text) aren't kept."""
    if _POWERS["n"] < n:
        size = max(n, 1 << 16)
        up, down = _powers_of(_ODD, size), _powers_of(pow(_ODD, -1, 1 << 64), size)
        if size > KEPT_POWERS:
            return up, down
        _POWERS.update(up=up, down=down, n=size)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all input bits over all output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``range_hashes`` gets the hash of any byte range."""
    up, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODES[data] * up[: len(data)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:stop]; equal bytes give equal hashes wherever they stand."""
    _, down = _powers(len(sums))
    return mixed((sums[stops] - sums[starts]) * down[starts])


def word_shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the word shingles of several texts.

    Words are maximal runs without space and without bytes 9 to 13, letters
    A-Z in lower case. A text with fewer than ``width`` words gives its whole
    word sequence as one shingle, a text without words none. Returns hashes,
    and for each text the number of shingles and of words.
    """
    words = [t.lower().split() for t in texts]
    n_words = np.array([len(w) for w in words], dtype=np.int64)
    n_sh = np.where(n_words == 0, 0, np.maximum(n_words - width + 1, 1))
    flat = [w for ws in words for w in ws]
    if not flat:
        return np.zeros(0, dtype=np.uint64), n_sh, n_words
    data = np.frombuffer(b" ".join(flat) + b" ", dtype=np.uint8)
    stops = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], stops[:-1] + 1))
    sums = prefix_hashes(data)
    first_word = np.cumsum(n_words) - n_words
    owner = np.repeat(np.arange(len(texts)), n_sh)
    begin = first_word[owner] + np.arange(len(owner)) - (np.cumsum(n_sh) - n_sh)[owner]
    end = np.minimum(begin + width, first_word[owner] + n_words[owner]) - 1
    return range_hashes(sums, starts[begin], stops[end]), n_sh, n_words
