"""Periodic runs of words: maximal stretches that repeat with a smallest period.

A document becomes overlapping tiles, longer ones for each octave of periods; tiles
are solved apart from each other by how far the words agree with those a period on,
before and after boundaries (the values of the Z-functions of both sides there).  The
fragments that tiles find are shuffled by document and period and stitched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_bytes, row_numbers, split_words, text_array, written

#: A run has this many words at least, and two periods.
LEAST = 12
#: A run agrees with itself a period on over at least half of ``LEAST`` words, so
#: word sequences of this length repeat in it.
GRAM = LEAST // 2
#: The shortest tiles have 2 ** BASE words and take periods below a quarter of that.
BASE = 13
_SLICE, _BATCH = 2 << 20, 1 << 17
_EMPTY = hashlib.sha256(b"").hexdigest()


def tiles_of(n: int, base: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, lowest, highest octave) of the tiles of n words.

    Octave k are the periods from 2 ** k to 2 ** (k + 1) - 1.  Neighbouring tiles
    share half their words, which is at least twice the longest period they look
    for: where two tiles see a part of a run each, one of them sees enough of it,
    and the parts that are seen overlap by a period.  A tile as long as the document
    takes all octaves that are left.
    """
    k, size, top = 0, 1 << base, (n // 2).bit_length() - 1
    while k <= top:
        if size >= n:
            yield 0, n, k, top
            return
        high = size.bit_length() - 4  # two periods fit into half a tile
        for start in range(0, n - size // 2, size // 2):
            yield start, min(n, start + size), k, min(high, top)
        k, size = high + 1, 2 * size


def agreement(codes: np.ndarray, longest: int):
    """(ranks, forward, backward): ranks[j][i] is the same for equal stretches of
    2 ** j codes; forward(x, y) says over how many codes from x and from y > x on
    they are equal, backward(x, y) the same before x and y; both below ``longest``
    doubled."""
    ranks = [np.unique(codes, return_inverse=True)[1]]
    for j in range(max(1, longest).bit_length() - 1):
        last = ranks[-1]
        if len(last) <= 1 << j:
            break
        ranks.append(np.unique(last[: -(1 << j)] * (int(last.max()) + 1) + last[1 << j :], return_inverse=True)[1])

    def forward(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        got = np.zeros(len(x), np.int64)
        for j in range(len(ranks) - 1, -1, -1):
            fits = y + got < len(ranks[j])
            same = fits & (ranks[j][np.where(fits, x + got, 0)] == ranks[j][np.where(fits, y + got, 0)])
            got += same.astype(np.int64) << j
        return got

    def backward(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        got = np.zeros(len(x), np.int64)
        for j in range(len(ranks) - 1, -1, -1):
            to = x - got - (1 << j)
            fits = (to >= 0) & (to + y - x < len(ranks[j]))
            same = fits & (ranks[j][np.where(fits, to, 0)] == ranks[j][np.where(fits, to + y - x, 0)])
            got += same.astype(np.int64) << j
        return got

    return ranks, forward, backward


@lru_cache(maxsize=4)
def _least_factors(most: int) -> np.ndarray:
    least = np.arange(most + 1)
    for f in range(2, int(most**0.5) + 1):
        if least[f] == f:
            part = least[f * f :: f]
            part[part == np.arange(f * f, most + 1, f)] = f
    return least


def _needed(q: np.ndarray) -> np.ndarray:
    """Over how many words a run of period q agrees with itself a period on."""
    return np.maximum(q, LEAST - q)


def solve(codes: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows (tile, start in it, end, period) of what is periodic in tiles that lie in
    a row in ``codes``, each with its octaves; smallest periods only.

    A run of period q has a boundary, a multiple of 2 ** k, where both it and what
    lies q on are in the run.  From there the words agree with those q on as far as
    the run goes to both sides, so over half of what is needed to one of them; pairs
    of a boundary and a period that don't are left out before both are measured.
    """
    n = len(sizes)
    ends = np.cumsum(sizes + 1)  # a code that nothing equals closes each tile
    tile = np.repeat(np.arange(n), sizes + 1)
    closing = ends - 1
    whole = np.empty(len(tile), np.int64)
    inside = np.ones(len(tile), bool)
    inside[closing] = False
    whole[inside] = codes.astype(np.int64) * n + tile[inside]
    whole[closing] = -1 - np.arange(n)
    ranks, forward, backward = agreement(whole, int(sizes.max()))
    found = [np.empty((0, 3), np.int64)]
    for k in range(int(low.min()), int(high.max()) + 1):
        step = 1 << k
        bounds = np.arange(0, len(tile), step)
        owner = tile[bounds]
        bounds = bounds[(low[owner] <= k) & (k <= high[owner])]
        periods = np.arange(step, 2 * step)
        j = int((_needed(periods).min() + 1) // 2).bit_length() - 1
        if j >= len(ranks) or not len(bounds):
            continue
        rank, many = ranks[j], max(1, (1 << 20) // step)
        for part in (bounds[a : a + many] for a in range(0, len(bounds), many)):
            c, q = part[:, None], periods[None, :]
            on = np.minimum(c + q, len(rank) - 1)
            hit = (c + q < len(rank)) & (rank[np.minimum(c, len(rank) - 1)] == rank[on])
            back, on = np.maximum(c - (1 << j), 0), np.minimum(np.maximum(c + q - (1 << j), 0), len(rank) - 1)
            hit |= (c >= 1 << j) & (c + q - (1 << j) < len(rank)) & (rank[np.minimum(back, len(rank) - 1)] == rank[on])
            at, which = np.nonzero(hit)
            c, q = part[at], periods[which]
            after, before = forward(c, c + q), backward(c, c + q)
            good = after + before >= _needed(q)
            c, q, after, before = c[good], q[good], after[good], before[good]
            found.append(np.stack([c - before, c + q + after, q], axis=1))
    rows = np.concatenate(found)
    if not len(rows):
        return np.empty((0, 4), np.int64)
    rows = np.unique(rows, axis=0)
    start, end, q = rows.T
    smallest, rest, least = np.ones(len(rows), bool), q.copy(), _least_factors(1 << int(q.max()).bit_length())
    while (rest > 1).any():  # a smaller period divides q, so q over some prime is a period
        f = least[rest]
        shorter = q // np.maximum(f, 1)
        smallest &= (rest == 1) | (forward(start, start + shorter) < end - start - shorter)
        rest = np.where(rest > 1, rest // np.maximum(f, 1), rest)
    start, end, q = rows[smallest].T
    own = tile[start]
    first = ends[own] - sizes[own] - 1
    return np.stack([own, start - first, end - first, q], axis=1)


def _stretches(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of words in which each sequence of ``GRAM`` words
    occurs elsewhere in the document, too (or seems to, by its hash).  What of a run
    has its equal a period on lies in one."""
    if len(codes) < GRAM:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lens = np.diff(offsets)
    doc = np.repeat(np.arange(len(lens)), lens)
    h = doc[: len(codes) - GRAM + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(GRAM):
        h = (h ^ codes[k : len(codes) - GRAM + 1 + k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    whole = doc[: len(h)] == doc[GRAM - 1 :]
    order = np.argsort(h[whole])
    places = np.nonzero(whole)[0][order]
    same = h[places[1:]] == h[places[:-1]]
    flag = np.zeros(len(codes) + 1, bool)
    flag[places[1:][same]] = True
    flag[places[:-1][same]] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flag])))
    return edges[::2], edges[1::2] + GRAM - 1


def _planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(first word, period) where a document of this id is made periodic."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


_SCAN = "row long, doc_id long, n int, plain string, words string, start int, low int, high int, codes array<int>"


def _scan(base: int, plant: bool):
    """Documents to one row each, and to rows of the tiles that may hold a run.
    ``words`` is given where there are such tiles."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = text_array(batch.column(1))
            for a, b in by_bytes(texts, _SLICE):
                ids = batch.column(0).slice(a, b - a)
                words, offsets = split_words(texts.slice(a, b - a))
                if plant:
                    take = np.arange(len(words))
                    for i, doc_id in enumerate(ids.to_pylist()):
                        o, n = offsets[i], int(offsets[i + 1] - offsets[i])
                        if spot := _planted(doc_id, n):
                            at, p = spot
                            take[o + at : o + n] = o + at + np.arange(n - at) % p
                    words = words.take(pa.array(take))
                coded = words.dictionary_encode()
                codes = np.asarray(coded.indices).astype(np.int32)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words), " ")
                rows = row_numbers(part, seen, b - a)
                seen += b - a
                starts, ends = _stretches(codes, offsets)
                owner = np.searchsorted(offsets, starts, side="right") - 1
                out = []
                for i in np.unique(owner):
                    o, n, mine = offsets[i], int(offsets[i + 1] - offsets[i]), owner == i
                    for start, end, low, high in tiles_of(n, base):
                        shared = np.minimum(ends[mine], o + end) - np.maximum(starts[mine], o + start)
                        if (shared >= max(GRAM, 1 << low)).any():
                            out.append((rows[i], start, low, high, codes[o + start : o + end]))
                held = np.zeros(b - a, bool)
                held[np.unique(owner)] = True
                plain = [hashlib.sha256(t.as_buffer()).hexdigest() for t in joined]
                none = lambda t: pa.nulls(b - a, t)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows), ids, pa.array(np.diff(offsets).astype(np.int32)), pa.array(plain), pc.if_else(pa.array(held), joined, None),
                        none(pa.int32()), none(pa.int32()), none(pa.int32()), none(pa.list_(pa.int32())),
                    ],
                    names=_NAMES,
                )
                if out:
                    at = np.cumsum([0, *(len(x[4]) for x in out)]).astype(np.int32)
                    column = lambda k: pa.array([int(x[k]) for x in out], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(x[0]) for x in out], pa.int64()), pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.string()),
                            pa.nulls(len(out), pa.string()), column(1), column(2), column(3), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([x[4] for x in out]))),
                        ],
                        names=_NAMES,
                    )

    return scan


_NAMES = [c.split()[0] for c in _SCAN.split(", ")]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, start, end, period) of the fragments of tiles (row, start, low, high, codes)."""
    for batch in batches:
        row, base, low, high = (np.asarray(batch.column(k)).astype(np.int64) for k in range(4))
        at, codes = np.asarray(batch.column(4).offsets).astype(np.int64), np.asarray(batch.column(4).values)
        a = 0
        while a < len(row):
            b = max(a + 1, int(np.searchsorted(at, at[a] + _BATCH, side="right")) - 1)
            own, start, end, q = solve(codes[at[a] : at[b]], np.diff(at[a : b + 1]), low[a:b], high[a:b]).T
            own = own + a
            yield pa.RecordBatch.from_arrays([pa.array(row[own]), pa.array(base[own] + start), pa.array(base[own] + end), pa.array(q)], names=["row", "start", "end", "period"])
            a = b


def stitch(fragments: DataFrame) -> DataFrame:
    """(row, start, length, period) of whole runs from fragments (row, start, end,
    period): two of a document and a period that share a period are of one run, as
    two runs of one period never do."""
    order = W.partitionBy("row", "period").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    begins = F.coalesce(F.col("start") + F.col("period") > reach, F.lit(True)).cast("long")
    numbered = fragments.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order))
    return numbered.groupBy("row", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("row", "start", (F.col("end") - F.col("start")).alias("length"), "period")


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, collapsed, n_kept) of (row, words, runs): words without what repeats."""
    for batch in batches:
        digests, left = [], []
        runs = batch.column(2)
        at, flat = np.asarray(runs.offsets), runs.values
        start, period, length = (np.asarray(pc.struct_field(flat, k)) for k in ("start", "period", "length"))
        for i, text in enumerate(batch.column(1).to_pylist()):
            words = text.split(" ")
            turns = np.zeros(len(words) + 1, np.int64)
            mine = slice(at[i], at[i + 1])
            np.add.at(turns, start[mine] + period[mine], 1)
            np.add.at(turns, start[mine] + length[mine], -1)
            kept = [w for w, over in zip(words, np.cumsum(turns)) if not over]
            digests.append(hashlib.sha256(" ".join(kept).encode()).hexdigest())
            left.append(len(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(left, pa.int64())], names=["row", "collapsed", "n_kept"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: int = BASE, plant: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, n_runs, the longest run (start, length,
    period, exponent_milli; ties: smallest start, then period), runs_sha256 (lines
    ``start,length,period`` by start, then period), collapsed_sha256 (words that are
    kept, joined by a space) and n_kept.

    Words are what lies between ASCII white space.  A run is a stretch of at least
    12 words and two smallest periods that neither neighbouring word extends; of a
    run the first period is kept.  ``plant`` first makes every tenth document by a
    hash of its id periodic from some word on.

    Null and empty texts have no words and no run: nulls for the longest, digests
    of nothing.  A null id stays null and is never made periodic.  Repeated rows
    are documents of their own, other columns are left out, no rows give no rows.
    A long document is cut into tiles that are solved in different tasks, except
    for the octaves whose periods are longer than an eighth of it: their tile is
    the document, held as four bytes a word and the ranks of its stretches (about
    8 bytes a word for each doubling).  Tiles where no sequence of six words comes
    twice hold no run and aren't sent.  Joins merge at every size, so that what is
    shuffled grows with the documents.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = written(rows.mapInArrow(_scan(base, plant), _SCAN), "period-tiles")
    tiles = scanned.where("start IS NOT NULL").select("row", "start", "low", "high", "codes").repartition("row", "start", "low")
    fragments = tiles.mapInArrow(_solve, "row long, start long, end long, period long")
    runs = stitch(fragments)
    run = F.struct("start", "period", "length")
    found = written(runs.groupBy("row").agg(F.array_sort(F.collect_list(run)).alias("runs"), F.min(F.struct((-F.col("length")).alias("size"), "start", "period")).alias("best")), "period-runs")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.sha2(F.concat(F.array_join(lines, "\n"), F.lit("\n")), 256)
    heads = scanned.where("start IS NULL")
    cut = heads.where("words IS NOT NULL").select("row", "words").join(found.select("row", "runs").hint("merge"), "row").select("row", "words", "runs").mapInArrow(_collapse, "row long, collapsed string, n_kept long")
    summary = found.select("row", F.size("runs").cast("long").alias("n_runs"), "best", listed.alias("listed")).join(cut.hint("merge"), "row")
    length, period = -F.col("best.size"), F.col("best.period")
    return heads.select("row", "doc_id", F.col("n").cast("long").alias("n_words"), "plain").join(summary.hint("merge"), "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_runs", F.lit(0).cast("long")).alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(-1000 * best.size) div best.period").cast("long").alias("exponent_milli"), F.coalesce("listed", F.lit(_EMPTY)).alias("runs_sha256"), F.coalesce("collapsed", "plain").alias("collapsed_sha256"),
        F.coalesce("n_kept", "n_words").alias("n_kept"),
    )
