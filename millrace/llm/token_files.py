"""Token-id files: Parquet with a list column of ids, read in parts.

Ids and lengths are delta-packed or dictionary-coded, row groups and pages have
set sizes, and every page has its index entry; so readers take the metadata
columns alone, or the pages that hold the documents they ask for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_bpe import Encoder
from .common import text_array

#: Files above this number are joined by shuffle, not broadcast (16 bytes a file).
BROADCAST_FILES = 500_000


def file_options(encoding: str = "dictionary", row_group_mb: int = 32, page_kb: int = 256) -> dict[str, str]:
    """Options of Spark's Parquet writer.  ``encoding``: ``dictionary`` (ids in
    at most 17 bits, good for text) or ``delta`` (DELTA_BINARY_PACKED)."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding!r}")
    return {
        "compression": "zstd",
        "parquet.block.size": str(row_group_mb << 20),
        "parquet.page.size": str(page_kb << 10),
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.page.row.count.limit": "2000",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
    }


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", **options
) -> None:
    """Encodes whole texts and writes them in ascending order of ``id_col``.

    Null texts count as empty, null ids come first, repeated ids are ordered by
    a hash of their text; other columns are left out.  Each row also holds the
    number of its file (``shard``) and the ids before it there.  An empty table
    gives a folder without rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            keys = batch.column(0)
            for a, ids, at in encoder.slices(text_array(batch.column(1))):
                n = len(at) - 1
                if end_id is not None:
                    ids, at = np.insert(ids, at[1:], end_id), at + np.arange(n + 1)
                lens = np.diff(at)
                starts = before + at[:-1]
                before += int(at[-1])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, n), pa.array(np.full(n, shard, np.int32)), pa.array(starts), pa.array(lens), lists],
                    names=["doc_id", "shard", "shard_start", "n_tokens", "ids"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(encode, "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>")
        .write.options(**file_options(**options))
        .parquet(path)
    )


def read_token_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens of every document; no page of ids is read."""
    return _with_starts(spark.read.parquet(path).select("doc_id", "shard", "shard_start", "n_tokens"), spark, path)


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents with low <= doc_id <= high
    (all by default); the bounds reach the row groups' and pages' statistics."""
    rows = spark.read.parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return _with_starts(rows, spark, path)


def _with_starts(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    sizes = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # one row a file: the only ordered sum runs over files, not documents
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("shard", before.alias("before"))
    if sizes.count() <= BROADCAST_FILES:
        firsts = F.broadcast(firsts)
    return rows.join(firsts, "shard").withColumn("start", F.col("before") + F.col("shard_start")).drop("shard", "shard_start", "before")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """Adds ids_crc32 (of little-endian unsigned 32-bit ids) and drops the ids."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at, flat = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4")
            crcs = np.array([zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
