"""Shared folder, written tables and Arrow helpers of the operators here."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only in a local session (as in tests) may it be unset; a temporary folder is
    taken there.  Elsewhere that would lose what executors write, and is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="millrace-"))
    return spark.conf.get("spark.checkpoint.dir")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later reads neither
    compute it again nor depend on an executor that may be lost."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_bytes(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) that hold about ``most`` bytes of text, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield a, b
        a = b


def text_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One array of texts with '' for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[starts[i] : starts[i] + lens[i]] for all i in a row, and their offsets."""
    offsets = np.zeros(len(lens) + 1, dtype=np.int64)
    np.cumsum(lens, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], lens) + np.arange(offsets[-1])
    return flat[at], offsets


class PieceCache:
    """Ids of pieces of text that a process has met, as Arrow and NumPy arrays.

    ``learn`` gives (ids in a row, number of each) for pieces that are new.  Beyond
    ``most`` pieces only those met in several batches stay, if they are few.
    """

    def __init__(self, learn, most: int = 500_000) -> None:
        self.learn, self.most = learn, most
        self._reset()

    def _reset(self) -> None:
        self.pieces = pa.array([], pa.string())
        self.flat, self.starts, self.lens, self.seen = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)

    def _add(self, pieces: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens, dtype=np.int64) - lens])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.lens = np.concatenate([self.lens, lens.astype(np.int32)])
        self.seen = np.concatenate([self.seen, np.zeros(len(lens), np.int32)])

    def trim(self) -> None:
        """To be called between batches, as indices change."""
        if len(self.pieces) > self.most or len(self.flat) > 8 * self.most:
            kept, old, flat, starts, lens = np.nonzero(self.seen > 1)[0], self.pieces, self.flat, self.starts, self.lens
            self._reset()
            if len(kept) < self.most // 2:
                self._add(old.take(pa.array(kept)), gather(flat, starts[kept], lens[kept])[0], lens[kept])

    def indices(self, pieces: pa.Array) -> np.ndarray:
        """The place of every piece among ``starts`` and ``lens``."""
        coded = pieces.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.pieces)
        places = np.asarray(pc.fill_null(found, -1)).astype(np.int64)
        new = np.nonzero(places < 0)[0]
        if len(new):
            places[new] = len(self.pieces) + np.arange(len(new))
            fresh = coded.dictionary.take(pa.array(new))
            self._add(fresh, *self.learn(fresh))
        self.seen[places] += 1
        return places[np.asarray(coded.indices)] if len(places) else places

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row, and their offsets."""
        return gather(self.flat, self.starts[places], self.lens[places])


def row_numbers(partition: int, first: int, n: int) -> np.ndarray:
    """Numbers of the rows ``first`` to ``first + n`` of a partition that no other
    partition gives, as long as the table they go to is written once."""
    return (partition << 33) + first + np.arange(n, dtype=np.int64)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (between ASCII white space) of all texts in a row, and offsets:
    those of text i are words[offsets[i] : offsets[i + 1]]."""
    lists = pc.ascii_split_whitespace(texts)
    offsets, words = np.asarray(lists.offsets, dtype=np.int64), lists.values
    full = np.asarray(pc.binary_length(words)) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    return words.filter(pa.array(full)), before[offsets]
