"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are dealt out by ranges of ``doc_id`` (and of text hashes where ids are equal) and sorted; each task encodes
its range and streams the ids into one file (16-bit ids where the vocabulary
fits, else 32-bit), beside an index file with document ids and offsets. The
manifest, a table with one row per file that Spark commits, says which files
count: what a lost or repeated attempt wrote has other names and is ignored.
Where a file starts in the whole stream is the prefix sum over the manifest.

Defined cases: a null text is empty and still gets the end id; null ids come
first; rows with equal ids stand in the order of a hash of their texts, each with its
own entry; an empty table has no files and reads back as an empty table; very
long texts are encoded whole; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows_at_a_time, texts_of
from .shared_files import NewFile, mapped, qualified
from .tokens import encoder

END_ID = 2
COPY_RANGES = 1 << 12  # parts into which equal rows may be cut
NO_ID = np.iinfo(np.int64).min  # stands for a null doc_id in an index file

MANIFEST = "part int, tokens_file string, index_file string, n_docs long, n_tokens long, id_bytes int"
FOUND = "doc_id long, start long, n_tokens long, ids_crc32 long, part int"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all documents under ``folder``; returns the manifest, read back from there."""
    folder = qualified(docs.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, out, index, at, n_docs = encoder(vocabulary), None, None, 0, 0
        width = 2 if max(coder.vocab_size, end_id + 1) <= 1 << 16 else 4
        part = TaskContext.get().partitionId()
        for rows in rows_at_a_time(batches):
            if out is None:
                out, index = NewFile(f"{folder}/data", f"tokens-{part:06d}"), NewFile(f"{folder}/data", f"index-{part:06d}")
            ids = [np.append(coder.encode(t), np.uint32(end_id)) for t in rows.column("text").to_pylist()]
            ends = at + np.cumsum([len(i) for i in ids])
            out.write(np.concatenate(ids).astype(f"<u{width}"))
            names = rows.column("doc_id").fill_null(NO_ID).to_numpy()
            index.write(np.column_stack((names, ends)).astype("<i8"))
            at, n_docs = int(ends[-1]), n_docs + len(ids)
        if out is not None:
            row = [[part], [out.close()], [index.close()], [n_docs], [at], [width]]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "tokens_file", "index_file", "n_docs", "n_tokens", "id_bytes"])

    # equal ids, and equal rows as well, may be dealt to several ranges
    keyed = texts_of(docs).withColumn("_text_key", F.xxhash64("text")).withColumn("_copy", F.monotonically_increasing_id() % COPY_RANGES)
    ordered = keyed.repartitionByRange("doc_id", "_text_key", "_copy").sortWithinPartitions("doc_id", "_text_key", "_copy")
    ordered.select("doc_id", "text").mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """Manifest rows with the number of ids in all files before (one small row per file)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: its place in the stream, its number of ids, and their crc32."""
    folder = qualified(spark, folder)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = mapped(f"{folder}/data", row["tokens_file"], f"<u{row['id_bytes']}")
                index = mapped(f"{folder}/data", row["index_file"], "<i8").reshape(-1, 2)
                ends = index[:, 1]
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                if len(ids) != row["n_tokens"] or len(index) != row["n_docs"]:
                    raise OSError(f"{row['tokens_file']} doesn't hold what the manifest says")
                for first in range(0, len(index), 10_000):
                    piece = slice(first, first + 10_000)
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts[piece], ends[piece], strict=True)]
                    names = index[piece, 0]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names, pa.int64(), mask=names == NO_ID),
                            pa.array(starts[piece] + row["base"], pa.int64()),
                            pa.array(ends[piece] - starts[piece], pa.int64()),
                            pa.array(crc, pa.int64()),
                            pa.array(np.full(len(names), row["part"]), pa.int32()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "part"],
                    )

    files = with_bases(manifest).repartition(max(1, spark.sparkContext.defaultParallelism * 4))
    return files.mapInArrow(scan, FOUND)
