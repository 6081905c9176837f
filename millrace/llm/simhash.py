"""SimHash near-duplicates, compared around the words of covering codes.

Fingerprints that differ in at most ``bits`` places agree up to ``bits // m`` in
one of m blocks at least.  In each block the words of a covering code are the
anchors (the perfect Golay or Hamming code on some bits, all words on the rest).
A fingerprint goes to every anchor within the covering radius plus half the
block's threshold: the midpoint of a linked pair has an anchor within the
covering radius, and both ends reach it.  Only what meets at an anchor is
compared, on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, gather, text_array, written
from .components import components

#: Rows that meet in one comparison; anchors with more are cut into parts whose
#: pairs are compared apart.
MOST = 4096
#: Up to this size groups are compared by shifts of the whole batch.
_FEW = 24

#: Generator polynomial of the (23, 12) Golay code, from the lowest power.
_GOLAY = 0b101011100011


# -- fingerprints ---------------------------------------------------------------


#: Seed of the shingles' hash.
SEED = 42


def simhashes(texts: list[bytes], words: int, seeds: tuple[int, ...] = (SEED,)) -> np.ndarray:
    """64-bit fingerprints of UTF-8 texts, a column a seed: a bit is set if it is
    set in over half the XXH64 values of the shingles of ``words`` words, repeats
    included; without words it is 0."""
    out = np.zeros((len(texts), len(seeds)), dtype=np.uint64)
    digest = xxhash.xxh64_digest
    for row, text in enumerate(texts):
        tokens = text.lower().split()
        if not tokens:
            continue
        line, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
        lens = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        ends = np.cumsum(lens + 1) - 1
        starts = (ends - lens)[:n].tolist()
        ends = ends[min(words, len(tokens)) - 1 :].tolist()
        total = np.zeros((len(seeds), 64), dtype=np.int64)
        for k in range(0, n, 1 << 16):
            shingles = [line[i:j] for i, j in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)])]
            for own, seed in zip(total, seeds):
                hashes = b"".join([digest(x, seed) for x in shingles])
                own += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        out[row] = np.packbits(2 * total > n, axis=1).view(">u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, words: int = 4, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """doc_id, fp_0, fp_1, ... (the fingerprints by seed as signed longs) of every
    row of docs."""
    names = ["doc_id", *(f"fp_{k}" for k in range(len(seeds)))]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1)).cast(pa.binary())
            for a, b in by_bytes(texts, 8 << 20):
                found = simhashes(texts.slice(a, b - a).to_pylist(), words, seeds).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(hashed, ", ".join(f"{n} long" for n in names))


# -- anchors --------------------------------------------------------------------


@cache
def _code(kind: str, size: int, slack: int) -> tuple[np.ndarray, ...]:
    """For a code: syndromes of the bits, and all error patterns of weight up to
    the covering radius plus ``slack``, sorted by syndrome, with their weight
    above the radius."""
    if kind == "golay":
        radius, columns, x = 3, [], 1
        for _ in range(23):
            columns.append(x)
            x = x << 1 ^ (_GOLAY if x & 1 << 10 else 0)
    elif kind == "hamming":
        radius, columns = 1, list(range(1, 16))
    else:
        radius, columns = 0, [0] * size
    patterns, syndromes, extra = [], [], []
    for weight in range(radius + slack + 1):
        for places in combinations(range(size), weight):
            patterns.append(sum(1 << p for p in places))
            syndrome = 0
            for p in places:
                syndrome ^= columns[p]
            syndromes.append(syndrome)
            extra.append(max(0, weight - radius))
    order = np.argsort(syndromes, kind="stable")
    count = np.bincount(syndromes, minlength=max(columns, default=0) and 1 << max(columns).bit_length() or 1)
    return np.array(columns, dtype=np.int64), np.array(patterns, dtype=np.int64)[order], np.array(extra)[order], count, np.cumsum(count) - count


#: (kind, bits) of the parts of each block, 64 bits in all, by number of blocks.
LAYOUTS = {
    2: [[("golay", 23), ("all", 9)], [("golay", 23), ("all", 9)]],
    3: [[("hamming", 15), ("all", 7)], [("hamming", 15), ("all", 6)], [("hamming", 15), ("all", 6)]],
}


def anchors(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every anchor of every fingerprint; a key holds the block
    and the anchor's bits."""
    layout = LAYOUTS[2 if bits <= 5 else 3]
    slack = (bits // len(layout) + 1) // 2
    rows_out, keys_out, shift = [], [], 0
    for block, parts in enumerate(layout):
        rows, used = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64)
        key, low = np.full(len(fps), block, dtype=np.int64) << 58, 0
        for kind, size in parts:
            columns, patterns, extra, count, first = _code(kind, size, slack)
            value = ((fps >> np.uint64(shift + low)) & np.uint64((1 << size) - 1)).astype(np.int64)
            syndrome = np.zeros(len(fps), dtype=np.int64)
            for bit, column in enumerate(columns):
                syndrome ^= (value >> bit & 1) * column
            n = count[syndrome[rows]]
            at = np.repeat(np.arange(len(rows)), n)
            pick = np.repeat(first[syndrome[rows]] - (np.cumsum(n) - n), n) + np.arange(len(at))
            keep = used[at] + extra[pick] <= slack
            at, pick = at[keep], pick[keep]
            key = key[at] | (value[rows[at]] ^ patterns[pick]) << low
            used, rows = used[at] + extra[pick], rows[at]
            low += size
        rows_out.append(rows)
        keys_out.append(key)
        shift += low
    return np.concatenate(rows_out), np.concatenate(keys_out)


def _to_anchors(fps: DataFrame, bits: int) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for k in range(0, len(own), 4000):
                part = own[k : k + 4000]
                rows, keys = anchors(part, bits)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows].view(np.int64))], names=["anchor", "fp"])

    return fps.select("fp").mapInArrow(spread, "anchor long, fp long")


# -- comparison -----------------------------------------------------------------


def _forest(n: int, near: Callable[[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (rows) that span the components of one group, one fewer than
    members: each took its component's least label from the other.  ``near`` tells
    the links of rows a to b with all rows."""
    label, parent = np.arange(n), np.arange(n)
    while True:
        new = label.copy()
        for k in range(0, n, 512):
            seen = np.where(near(k, min(n, k + 512)), label[None, :], n)
            by = seen.argmin(axis=1)
            low = seen[np.arange(len(by)), by]
            rows = k + np.nonzero(low < label[k : k + 512])[0]
            new[rows], parent[rows] = low[rows - k], by[rows - k]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(parent != np.arange(n))[0]
    return moved, parent[moved]


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the linked rows (a, b) among n those by which rows take their component's
    least number: one fewer than members."""
    u, v = np.concatenate([a, b]), np.concatenate([b, a])
    label, parent = np.arange(n), np.arange(n)
    while len(u):
        new = label.copy()
        np.minimum.at(new, v, label[u])
        by = (new[v] < label[v]) & (label[u] == new[v])
        if not by.any():
            break
        parent[v[by]] = u[by]
        label = new
    moved = np.nonzero(parent != np.arange(n))[0]
    return moved, parent[moved]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (a, b) with the least node that it reaches, but for
    those least nodes themselves."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = codes[: len(a)], codes[len(a) :], np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


#: Links that a task holds before it thins them to stars.
_MOST_HELD = 1_000_000


def _linked(bits: int, far: int = 64):
    """Edges (a, b) that connect what rows (anchor, part, fp, and perhaps a second
    fingerprint that may differ in ``far`` places and the number to give for the row)
    link, sorted by anchor and part.  A task gives a node one edge, to the least node
    that it reaches there: groups that meet at many anchors make no edge for each."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def edges(anchor: np.ndarray, part: np.ndarray, *rest: np.ndarray) -> None:
            fp, names = rest[0], rest[-1]
            near = lambda x, y: np.bitwise_count(fp[x] ^ fp[y]) <= bits
            if len(rest) > 1:
                near = lambda x, y: (np.bitwise_count(fp[x] ^ fp[y]) <= bits) & (np.bitwise_count(rest[1][x] ^ rest[1][y]) <= far)
            starts = np.concatenate([[0], np.nonzero((np.diff(anchor) != 0) | (np.diff(part) != 0))[0] + 1, [len(fp)]])
            sizes = np.diff(starts)
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            group = np.repeat(np.arange(len(sizes)), sizes)
            few = (sizes <= _FEW)[group]
            for step in range(1, min(_FEW, int(sizes.max()))):
                at = np.nonzero((group[step:] == group[:-step]) & few[step:])[0]
                if not len(at):
                    break
                at = at[near(at, at + step)]
                a.append(at)
                b.append(at + step)
            a, b = ([x] for x in _spanning(len(fp), np.concatenate(a), np.concatenate(b)))
            for g in np.nonzero(sizes > _FEW)[0]:
                own = np.arange(starts[g], starts[g + 1])
                x, y = _forest(len(own), lambda i, j, own=own: near(own[i:j, None], own[None, :]))
                a.append(own[x])
                b.append(own[y])
            found.append(tuple(names[np.concatenate(z)].view(np.int64) for z in (a, b)))
            if sum(len(x) for x, _ in found) > _MOST_HELD:
                found[:] = [_stars(*map(np.concatenate, zip(*found)))]

        for batch in batches:
            new = [np.asarray(c) for c in batch.columns]
            new[2:] = [c.astype(np.int64).view(np.uint64) for c in new[2:]]
            if held is not None:
                new = [np.concatenate(x) for x in zip(held, new)]
            if not len(new[0]):
                continue
            whole = np.nonzero((new[0] != new[0][-1]) | (new[1] != new[1][-1]))[0]
            cut = int(whole[-1]) + 1 if len(whole) else 0
            held = [x[cut:] for x in new]
            if cut:
                edges(*(x[:cut] for x in new))
        if held is not None:
            edges(*held)
        if found:
            x, y = _stars(*map(np.concatenate, zip(*found)))
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(x)], names=["a", "b"])

    return compare


def _met(spread: DataFrame) -> DataFrame:
    """Rows (anchor, fp, ...) with ``part``, dealt and sorted by both: an anchor with
    more than ``MOST`` rows is cut into parts, and each pair of parts meets."""
    hot = spread.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > MOST)
    hot = written(hot.select("anchor", F.ceil(F.col("n") * 2 / MOST).cast("int").alias("parts")), "hot-anchors")
    own = F.pmod(F.xxhash64(*spread.columns[1:]), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(own, j) * F.col("parts") + F.greatest(own, j))
    if hot.isEmpty():
        dealt = spread.withColumn("part", F.lit(0).cast("long"))
    else:
        dealt = spread.join(hot, "anchor", "left").withColumn("part", F.explode(F.coalesce(pairs.cast("array<long>"), F.array(F.lit(0).cast("long")))))
    return dealt.select("anchor", "part", *spread.columns[1:]).repartition("anchor", "part").sortWithinPartitions("anchor", "part")


def links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (column fp) that connect all that can be
    reached by steps of at most ``bits`` differing bits (<= 8).

    Pairs are compared in place and not written out; a task gives a fingerprint one
    edge at most.
    """
    if not 0 <= bits <= 8:
        raise ValueError("bits is 0 to 8")
    fps = written(fps.select("fp").distinct(), "fingerprints")
    return _met(_to_anchors(fps, bits)).mapInArrow(_linked(bits), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for every row of docs.

    Fingerprints of texts (A-Z lower-cased, words between ASCII white space) link
    at ``bits`` or fewer differing bits; component_id is the smallest doc_id that
    can be reached.  Null and empty texts have fingerprint 0 and link like any
    other.  Repeated rows stay; null ids are linked but never smallest, unless a
    component has no other.  Equal fingerprints are collapsed before anything is
    compared, so a group of copies costs as much as one text.
    """
    rows = written(fingerprints(docs, words).withColumnRenamed("fp_0", "fp"), "simhash")
    unique = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(unique, bits))
    rooted = written(unique.join(roots, unique["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(firsts, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- similarity -----------------------------------------------------------------


#: Documents are near-duplicates if their shingle sets share at least this part of
#: their union (as a fraction).
LEAST = (4, 5)
#: Fingerprints of a set.  Two of sets at 0.8 differ in 9.7 bits on average and in 8
#: or fewer with a chance of about a third: all twelve miss a pair in 150.
FINGERPRINTS = 12
#: The next fingerprint of a pair may differ in so many bits: at 0.8 all but one in
#: 100,000 do, of two unrelated sets one in 120.
FAR = 22
#: Keys of a set, each from two least hashes: sets at 0.8 have one in common, all
#: but 5 in a million; a set that shares none with any other is compared to nothing.
KEYS = 12
#: Sets, and their shingles, that meet in one comparison, about.
MOST_SETS, MOST_SHINGLES = 2048, 4_000_000

_ODD = np.random.default_rng(SEED).integers(0, 2**63, FINGERPRINTS + 2 * KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """XXH64 values of the text's different shingles, sorted; none without words."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    line, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[i:j], SEED) for i, j in zip(starts, ends)), dtype=np.uint64, count=n))


def set_keys(own: np.ndarray) -> np.ndarray:
    """``KEYS`` keys of a set; one without shingles has none."""
    if not len(own):
        return np.empty(0, np.int64)
    low = np.full(2 * KEYS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(own), 4096):
        np.minimum(low, (own[k : k + 4096, None] * _ODD[FINGERPRINTS:]).min(axis=0), out=low)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x.tobytes(), k) for k, x in enumerate(low.reshape(KEYS, 2))], dtype=np.uint64).view(np.int64)


def set_fingerprints(own: np.ndarray) -> np.ndarray:
    """``FINGERPRINTS`` SimHash values of a set of hashes: each is taken from another
    mixture of them."""
    total = np.zeros((FINGERPRINTS, 64), dtype=np.int64)
    for k in range(0, len(own), 4096):
        mixed = own[k : k + 4096, None] * _ODD[:FINGERPRINTS]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        total += np.unpackbits(mixed.view(np.uint8).reshape(len(mixed), FINGERPRINTS, 8), axis=2).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * total > len(own), axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64)


def _of_texts(docs: DataFrame, schema: str, make) -> DataFrame:
    """Rows of ``schema``: doc_id, and what ``make`` gives for a list of texts, by column."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1)).cast(pa.binary())
            for a, b in by_bytes(texts, 8 << 20):
                found = make(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *found], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, schema)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, digest of the shingle set, its size, its keys."""

    def make(texts: list[bytes]) -> list[pa.Array]:
        sets = [shingle_set(x, words) for x in texts]
        digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
        return [digests, pa.array([len(x) for x in sets], pa.int64()), pa.array([set_keys(x) for x in sets], pa.list_(pa.int64()))]

    return _of_texts(docs, "doc_id long, digest binary, size long, keys array<long>", make)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, shingles (their hashes), fps (their fingerprints)."""

    def make(texts: list[bytes]) -> list[pa.Array]:
        sets = [shingle_set(x, words) for x in texts]
        return [pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([set_fingerprints(x) for x in sets], pa.list_(pa.int64()))]

    return _of_texts(docs, "doc_id long, shingles array<long>, fps array<long>", make)


def _sets_to_anchors(sets: DataFrame, bits: int) -> DataFrame:
    """(anchor, fp, other, node) for each fingerprint of each set; other is the next."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.asarray(batch.column(0))
            fps = np.asarray(batch.column(1).flatten()).astype(np.int64).view(np.uint64).reshape(len(nodes), FINGERPRINTS)
            for k in range(0, len(nodes), 4000):
                for seed in range(FINGERPRINTS):
                    own, other = fps[k : k + 4000, seed], fps[k : k + 4000, (seed + 1) % FINGERPRINTS]
                    rows, keys = anchors(own, bits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys | seed << 50), pa.array(own[rows].view(np.int64)), pa.array(other[rows].view(np.int64)), pa.array(nodes[k : k + 4000][rows])],
                        names=["anchor", "fp", "other", "node"],
                    )

    return sets.select("doc_id", "fps").mapInArrow(spread, "anchor long, fp long, other long, node long")


def alike(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at ``LEAST`` or more that span the components of the sets that lie in
    ``flat`` one after another.  What they share is counted exactly: hashes that
    many sets hold by matrix products, the others by their holders."""
    n, (part, whole) = len(sizes), LEAST
    codes = np.unique(flat, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    held = np.repeat(np.arange(n), sizes)[order]
    counts = np.bincount(codes)
    first = np.cumsum(counts) - counts
    shared = np.zeros((n, n), dtype=np.float32)  # whole numbers far below 2 ** 24
    many = np.nonzero(counts > max(8, n // 8))[0]
    for k in range(0, len(many), 1024):
        own = many[k : k + 1024]
        rows, at = gather(held, first[own], counts[own])
        holds = np.zeros((n, len(own)), dtype=np.float32)
        holds[rows, np.repeat(np.arange(len(own)), np.diff(at))] = 1
        shared += holds @ holds.T
    for count in np.unique(counts[(counts > 1) & (counts <= max(8, n // 8))]):
        own = np.nonzero(counts == count)[0]
        for k in range(0, len(own), max(1, 4_000_000 // int(count) ** 2)):
            holders = held[first[own[k : k + max(1, 4_000_000 // int(count) ** 2)], None] + np.arange(count)]
            np.add.at(shared.reshape(-1), (holders[:, :, None] * n + holders[:, None, :]).reshape(-1), np.float32(1))
    sizes = sizes.astype(np.float32)
    return _forest(n, lambda i, j: shared[i:j] * whole >= part * (sizes[i:j, None] + sizes[None, :] - shared[i:j]))


def _alike_in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (root, part, doc_id, shingles) that are sorted by group."""
    key, ids, sets = None, [], []

    def found() -> pa.RecordBatch:
        x, y = alike(np.concatenate(sets), np.array([len(s) for s in sets]))
        names = np.array(ids, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names[x]), pa.array(names[y])], names=["a", "b"])

    for batch in batches:
        shingles = batch.column(3)
        flat, ends = np.asarray(shingles.values), np.asarray(shingles.offsets)
        for k, row in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            if row[:2] != key:
                if len(ids) > 1:
                    yield found()
                key, ids, sets = row[:2], [], []
            ids.append(row[2])
            sets.append(flat[ends[k] : ends[k + 1]].copy())
    if len(ids) > 1:
        yield found()


def similar(sets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b): doc_ids of ``sets`` (doc_id, shingles) that connect all that steps of
    pairs at ``LEAST`` or more can reach within the components of ``candidates``.

    A component is compared as one group, in parts by rows and shingles if it is
    large (every pair of parts meets), and exact links only are thinned to those
    that span.
    """
    sized = sets.select("doc_id", F.size("shingles").alias("size"))
    rooted = written(components(candidates).withColumnRenamed("node", "doc_id").join(sized, "doc_id"), "clusters")
    share = F.greatest(F.count("*") * 2 / MOST_SETS, F.sum("size") * 2 / MOST_SHINGLES)
    parts = rooted.groupBy("root").agg(F.count("*").alias("n"), F.ceil(share).cast("int").alias("parts")).where("n > 1")
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(own, j).cast("long") * F.col("parts") + F.greatest(own, j))
    members = rooted.join(parts, "root").select("doc_id", "root", meets.alias("meets"))
    met = sets.join(members, "doc_id").select("root", F.explode("meets").alias("part"), "doc_id", "shingles")
    return met.repartition("root", "part").sortWithinPartitions("root", "part").mapInArrow(_alike_in_groups, "a long, b long")


def keep_one_each(docs: DataFrame, words: int = 5, bits: int = 8) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest
    doc_id stays, with all its columns; of rows that repeat a doc_id one stays.

    Documents are linked if their sets of shingles of ``words`` words (A-Z
    lower-cased) are alike by ``LEAST``.  Equal sets are collapsed first.  Those that
    could have a partner (they share a key with another) get fingerprints that meet
    at anchors; what links there, on one fingerprint by ``bits`` and on the next by
    ``FAR``, is held against the whole sets.  Null and empty texts, and texts of white
    space, have one (empty) set and count as copies of each other.  Rows without a
    doc_id can't be told from one another and stay.  An empty table gives no rows.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    sketched = written(sketches(named, words), "sketches")
    # equal ids with different texts: each set counts, all under that id
    firsts = written(sketched.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys")), "sets")
    copies = sketched.join(firsts.select("digest", "first"), "digest").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).where("a <> b")
    keyed = firsts.select("digest", "first", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("key")
    close = written(keyed.join(shared, "key", "left_semi").select(F.col("first").alias("doc_id")).distinct(), "close")
    sets = written(shingle_sets(named.join(close, "doc_id", "left_semi"), words), "shingles")
    candidates = _met(_sets_to_anchors(sets, bits)).mapInArrow(_linked(bits, FAR), "a long, b long")
    lost = components(copies.unionByName(similar(sets, candidates))).where("node <> root")
    lost = written(lost.select(F.col("node").alias("doc_id")), "copies")
    stay = docs.join(lost, "doc_id", "left_anti").select(columns)
    if sketched.groupBy("doc_id").count().where("count > 1").isEmpty():
        return stay
    return stay.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(stay.where("doc_id IS NULL"))
