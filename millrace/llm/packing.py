"""Best-fit packing of documents into token sequences, in bulk sweeps.

Documents and gaps (the free ends of open sequences) are range-sorted together
by size, largest first and gaps before documents of the same size.  A sweep
gives each document its successor, the smallest gap before it: inside a
partition the gaps shrink as they are used, and what partitions leave over meets
by rank, in blocks worked out from runs of ranks and their sizes.  The next sweep
sorts the shrunken gaps in anew; sequences are opened for what the gaps can't hold.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_bpe import Encoder
from .common import text_array, written

_SWEPT = "part int, kind int, id long, size int, rank long, gap long, free int"
#: Rows of sizes in a partition of a sweep, about.
SWEEP_ROWS = 250_000
#: Runs of ranks that a sweep tells the driver of, about.
RUNS = 8192


def document_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0) -> DataFrame:
    """item, doc_id, piece, start, length, ids_crc32: each document's ids, its
    end id included, cut only if it has more than ``capacity``; all pieces but
    the first are full then.

    Null texts count as empty; repeated rows are separate documents; a document
    without ids (possible only without ``end_id``) has no piece.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = TaskContext.get().partitionId() << 40
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            keys = batch.column(0)
            for a, ids, at in encoder.slices(text_array(batch.column(1))):
                n = len(at) - 1
                if end_id is not None:
                    ids, at = np.insert(ids, at[1:], end_id), at + np.arange(n + 1)
                lens, flat = np.diff(at), ids.astype("<u4")
                count = -(-lens // capacity)
                row = np.repeat(np.arange(n), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                over = (lens - (count - 1) * capacity)[row]  # of the first piece
                start = np.where(piece == 0, 0, over + (piece - 1) * capacity)
                length = np.where(piece == 0, over, capacity)
                low = at[row] + start
                crcs = [zlib.crc32(flat[i : i + k].tobytes()) for i, k in zip(low, length)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item + np.arange(len(row))), keys.slice(a, n).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(np.array(crcs, dtype=np.int64))],
                    names=["item", "doc_id", "piece", "start", "length", "ids_crc32"],
                )
                item += len(row)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        cut, "item long, doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def _sweep_partition(runs: int):
    """Best fit inside a partition, a gap shrinking as it is used.  Rows out: a
    document with its gap (kind 2), a document without (1), a used gap with room
    (3), an unused one (0), 1 and 0 with their rank; last what the driver needs:
    runs of ranks of 1 and 0 (kinds 5 and 6: first rank, number as gap, and the
    largest document or smallest gap as size), ``runs`` of either at most, and the
    number of 2 (kind 4: free)."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        sizes: list[int] = []  # of the gaps at hand, ascending, each once
        at_hand: dict[int, list[int]] = {}
        used: dict[int, int] = {}
        lone: list[int] = []
        placed = 0

        def put(gap: int, size: int) -> None:
            if size not in at_hand:
                at_hand[size] = []
                insort(sizes, size)
            at_hand[size].append(gap)

        for batch in batches:
            out: list[tuple] = []
            for kind, i, size in zip(*(x.to_pylist() for x in batch.columns[:3])):
                if kind == 0:
                    put(i, size)
                    continue
                k = bisect_left(sizes, size)
                if k == len(sizes):
                    out.append((1, i, size, len(lone), 0, 0))
                    lone.append(size)
                    continue
                free = sizes[k]
                gap = at_hand[free].pop()
                if not at_hand[free]:
                    del at_hand[free], sizes[k]
                out.append((2, i, size, 0, gap, free))
                placed += 1
                used[gap] = free - size
                if free > size:
                    put(gap, free - size)
            if out:
                yield _rows(part, out)
        left = [(3, gap, free, 0, 0, 0) for gap, free in used.items() if free]
        unused = [(size, gap) for size in sizes for gap in reversed(at_hand[size]) if gap not in used]
        left += [(0, gap, size, rank, 0, 0) for rank, (size, gap) in enumerate(unused)]
        left.append((4, 0, 0, 0, 0, placed))
        left += [(5, 0, lone[a], a, b - a, 0) for a, b in rank_runs(lone, runs)]
        left += [(6, 0, unused[a][0], a, b - a, 0) for a, b in rank_runs([s for s, _ in unused], runs)]
        for k in range(0, len(left), 100_000):
            yield _rows(part, left[k : k + 100_000])

    return sweep


def rank_runs(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Sorted sizes cut into ``most`` runs at most, equal sizes in one run."""
    found, a = [], 0
    while a < len(sizes):
        b = min(len(sizes), a + -(-len(sizes) // most))
        while b < len(sizes) and sizes[b] == sizes[b - 1]:
            b += 1
        found.append((a, b))
        a = b
    return found


def _rows(part: int, out: list[tuple]) -> pa.RecordBatch:
    kind, i, size, rank, gap, free = (np.array(x) for x in zip(*out))
    return pa.RecordBatch.from_arrays(
        [pa.array(x.astype(t)) for x, t in ((np.full(len(out), part), "i4"), (kind, "i4"), (i, "i8"), (size, "i4"), (rank, "i8"), (gap, "i8"), (free, "i4"))],
        names=["part", "kind", "id", "size", "rank", "gap", "free"],
    )


def rank_blocks(docs: list[tuple[int, int, int, int]], gaps: list[tuple[int, int, int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(document partition, first rank, gap partition, first rank, documents,
    documents a gap) of what meets across partitions, from runs of ranks by
    ascending partition: (partition, first rank, number, largest document or
    smallest gap).

    Documents take the gaps whose sure size is the smallest that holds the largest
    of them (of equal ones the nearest partition's), as many a gap as fit for sure;
    a run of gaps stays at hand with the size that is still sure.  Where that holds
    a run no longer, the rest waits: after the sweep the sizes are exact again.
    """
    held: list[tuple[int, int, int, int]] = []  # gaps at hand: sure size, -partition, first rank, number
    blocks, later = [], iter(sorted(gaps))
    gap = next(later, None)
    for part, rank, n_docs, largest in sorted(docs):
        while gap and gap[0] < part:
            insort(held, (gap[3], -gap[0], gap[1], gap[2]))
            gap = next(later, None)
        while n_docs and (k := bisect_left(held, (max(1, largest),))) < len(held):
            size, near, low, n = held.pop(k)
            each = min(capacity, size // max(1, largest))
            met = min(n_docs, n * each)
            taken = -(-met // each)
            blocks.append((part, rank, -near, low, met, each))
            rank, n_docs = rank + met, n_docs - met
            if size > each * largest:
                insort(held, (size - each * largest, near, low, taken))
            if n > taken:
                insort(held, (size, near, low + taken, n - taken))
        if n_docs and held:
            break
    return blocks


def best_fit(items: DataFrame, capacity: int) -> DataFrame:
    """item, sequence, offset for items (item long, length int) no longer than
    ``capacity``.  Items of length 0 get a place as well; an empty table gives
    no rows.  Item numbers must differ; sequences are numbered from 0.

    Across partitions a gap takes as many documents at once as are sure to fit, so
    a few sweeps do.
    """
    spark = items.sparkSession
    placed: list[DataFrame] = []
    docs = items.select(F.col("item").alias("id"), F.col("length").cast("int").alias("size"))
    gaps = spark.createDataFrame([], "id long, size int")
    opened, ajar = 0, 0  # sequences opened, those with room
    left, tokens, large = docs.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.count_if(F.col("size") * 2 > capacity)).first()
    n = max(1, -(-tokens // capacity), large)  # as many as there must be
    while left:
        if n:
            new = spark.range(opened, opened + n).select("id", F.lit(capacity).cast("int").alias("size"))
            gaps, opened, ajar = gaps.unionByName(new), opened + n, ajar + n
        both = gaps.select(F.lit(0).alias("kind"), "id", "size").unionByName(docs.select(F.lit(1).alias("kind"), "id", "size"))
        order = [F.col("size").desc(), F.col("kind").asc(), F.xxhash64("id")]  # the hash splits a size that many share
        parts = max(1, -(-(left + ajar) // SWEEP_ROWS))
        ranged = both.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        swept = written(ranged.mapInArrow(_sweep_partition(max(1, min(32, RUNS // parts))), _SWEPT), "sweep")
        told = swept.where("kind >= 4").select("kind", "part", "rank", "gap", "size", "free").collect()  # RUNS rows, or three a partition
        runs = [[tuple(r)[1:5] for r in told if r["kind"] == kind] for kind in (5, 6)]
        blocks = rank_blocks(*runs, capacity)
        alone, holes = swept.where("kind = 1"), swept.where("kind = 0")
        met = swept.where("kind = 2").select("id", "size", "gap", "free")
        if blocks:
            table = F.broadcast(spark.createDataFrame(blocks, "part int, low long, gap_part int, gap_low long, n long, each long"))  # some rows a partition
            drawn = alone.join(table, "part").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("n")))
            to = F.floor(F.col("gap_low") + (F.col("rank") - F.col("low")) / F.col("each"))
            with_gap = drawn.select("id", "size", F.struct("part", "rank").alias("nth"), F.col("gap_part").alias("part"), to.alias("rank"))
            paired = with_gap.join(holes.select("part", "rank", F.col("id").alias("gap"), F.col("size").alias("free")), ["part", "rank"])
            earlier = F.sum("size").over(W.partitionBy("part", "rank").orderBy("nth").rowsBetween(W.unboundedPreceding, -1))  # what one gap takes
            across = written(paired.select("id", "size", "gap", (F.col("free") - F.coalesce(earlier, F.lit(0))).cast("int").alias("free")), "met")
            met = met.unionByName(across)
            taken: dict[int, int] = {}  # ranks below these are gone
            used: dict[int, int] = {}
            for part, low, gap_part, gap_low, n_met, each in blocks:
                taken[part] = max(taken.get(part, 0), low + n_met)
                used[gap_part] = max(used.get(gap_part, 0), gap_low - (-n_met // each))
            taken, used = (F.broadcast(spark.createDataFrame([*x.items()], "part int, to long")) for x in (taken, used))
            alone = alone.join(taken, "part", "left").where("to IS NULL OR rank >= to")
            holes = holes.join(used, "part", "left").where("to IS NULL OR rank >= to")
        placed.append(met.select(F.col("id").alias("item"), F.col("gap").alias("sequence"), (capacity - F.col("free")).cast("long").alias("offset")))
        gaps = holes.select("id", "size").unionByName(swept.where("kind = 3").select("id", "size"))
        if blocks:
            rest = across.groupBy(F.col("gap").alias("id")).agg(F.min(F.col("free") - F.col("size")).alias("size"))
            gaps = gaps.unionByName(rest.where("size > 0"))
        docs = alone.select("id", "size")
        before, left = left, left - sum(r["free"] for r in told if r["kind"] == 4) - sum(b[4] for b in blocks)
        if left:
            tokens, least, most = docs.agg(F.sum("size"), F.min("size"), F.max("size")).first()
            gaps = gaps.where(F.col("size") >= least)  # the others are closed
            ajar, room = gaps.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
            # what the gaps can't hold needs new sequences; where hardly any gap still fits, all
            # that is left gets room (what stays unused is no sequence)
            n = max(0, -(-(tokens - room) // capacity))
            if not ajar or before < 2 * left:
                n = max(n, -(-left // min(capacity, max(1, capacity // max(1, most)))))
    if not placed:
        return spark.createDataFrame([], "item long, sequence long, offset long")
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every
    piece of every document; other columns are left out.

    Full pieces fill a sequence each (odd numbers); the rest is packed by
    :func:`best_fit` (even numbers).  Null ids and repeated rows are packed like
    any other; an empty table gives no rows.
    """
    pieces = written(document_pieces(docs, tokenizer, capacity, end_id), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("item") * 2 + 1, "offset": F.lit(0).cast("long")})
    part = pieces.where(F.col("length") < capacity)
    places = best_fit(part.select("item", "length"), capacity)
    packed = part.join(places, "item").withColumn("sequence_id", F.col("sequence") * 2)
    return full.select(columns).unionByName(packed.select(columns))
