"""Quality scores: ridge regression on random Fourier features, calibrated.

Statistics of each text are mapped to features whose inner products approach a
Gaussian kernel.  Tasks sum the normal equations of their labelled rows by fold;
from the sums follow width, ridge and weights, and scores of rows that their fold's
weights have not seen, on which isotonic regression makes probabilities of scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, split_words, text_array, written

#: Classes of ASCII characters whose share of a text is a statistic.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*", "|", "<>{}[]\\/=_~^@+", ".,;:", "!", "?", "'\"()-", " ", "\n")
STATISTICS = (
    "log_chars", "log_words", *(f"class_{k}" for k in range(len(CLASSES))), "beyond_ascii", "entropy", "word_chars", "word_spread", "long_words", "no_letter", "capital",
    "distinct_words", "top_word", "repeated_word", "distinct_pairs", "line_words", "repeated_lines", "sentence_ends",
)
#: Labelled rows that are learnt from, at most (about; chosen by a hash of the id).
MOST_LABELS = 200_000
FEATURES, SEED, FOLDS = 256, 42, 4
#: Widths of the kernel and ridges (a row) that are tried.
WIDTHS, RIDGES = (0.5, 1.0, 2.0), (1e-4, 1e-3, 1e-2, 1e-1)
#: Out-of-fold scores are counted in bins of this size before the isotonic fit.
BIN = 1e-3
_SLICE = 3 << 20


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    width: float
    weights: np.ndarray
    knots: np.ndarray
    heights: np.ndarray


def _share(flags: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The mean of flags by owner, 0 where there are none."""
    return np.bincount(owner, weights=flags, minlength=n) / np.maximum(np.bincount(owner, minlength=n), 1)


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """By owner: the share of distinct keys below ``span``, and of the most frequent."""
    both, counts = np.unique(owner * span + keys, return_counts=True)
    total, most = np.maximum(np.bincount(owner, minlength=n), 1), np.zeros(n)
    np.maximum.at(most, both // span, counts)
    return np.bincount(both // span, minlength=n) / total, most / total


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; all are 0 for an empty text."""
    n = len(texts)
    sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
    data = np.frombuffer(b"".join(t.as_buffer() for t in texts), np.uint8)
    counts = np.bincount(np.repeat(np.arange(n), sizes) * 256 + data, minlength=n * 256).reshape(n, 256)
    per_char = np.maximum(sizes, 1)[:, None]
    share = counts / per_char
    classes = np.zeros((256, len(CLASSES) + 1))
    for k, chars in enumerate(CLASSES):
        classes[[ord(c) for c in chars], k] = 1
    classes[128:, -1] = 1
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    words, at = split_words(texts)
    owner = np.repeat(np.arange(n), np.diff(at))
    coded = words.dictionary_encode()
    codes, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary
    length = np.asarray(pc.utf8_length(names)).astype(float)[codes]
    letter, capital = (np.asarray(pc.match_substring_regex(names, p)).astype(float)[codes] for p in (r"\pL", r"^\PL*\p{Lu}"))
    ends = np.asarray(pc.match_substring_regex(names, r"[.!?][^\pL]*$")).astype(float)[codes]
    mean = _share(length, owner, n)
    spread = np.sqrt(np.maximum(_share(length**2, owner, n) - mean**2, 0))
    distinct, top = _distinct(codes, owner, n, len(names) + 1)
    same = owner[1:] == owner[:-1]
    repeated = _share((codes[1:] == codes[:-1])[same].astype(float), owner[1:][same], n)
    pairs = np.unique(codes[1:] * (len(names) + 1) + codes[:-1], return_inverse=True)[1][same]
    distinct_pairs, _ = _distinct(pairs, owner[1:][same], n, len(codes) + 1)
    lines = pc.split_pattern(texts, "\n")
    line_owner = np.repeat(np.arange(n), np.diff(np.asarray(lines.offsets, dtype=np.int64)))
    full = np.asarray(pc.match_substring_regex(lines.values, r"\S"))
    line_codes = np.asarray(lines.values.dictionary_encode().indices).astype(np.int64)[full]
    line_owner = line_owner[full]
    distinct_lines, _ = _distinct(line_codes, line_owner, n, len(lines.values) + 1)
    n_lines = np.bincount(line_owner, minlength=n)
    n_words = np.diff(at)
    out = np.column_stack([
        np.log1p(sizes), np.log1p(n_words), share @ classes, entropy, mean, spread, _share((length > 15).astype(float), owner, n), _share(1 - letter, owner, n), _share(capital, owner, n),
        distinct, top, repeated, distinct_pairs, np.log1p(n_words / np.maximum(n_lines, 1)), np.where(n_lines > 0, 1 - distinct_lines, 0), _share(ends, owner, n),
    ])
    return out


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the statistics of each whole text (null: empty)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1))
            for a, b in by_bytes(texts, _SLICE):
                x = statistics(texts.slice(a, b - a))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(measure, "doc_id long, x array<double>")


def fourier(x: np.ndarray, width: float) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a column of ones;
    directions are drawn anew from SEED wherever they are needed."""
    drawn = np.random.default_rng(SEED)
    directions, phases = drawn.standard_normal((x.shape[1], FEATURES)), drawn.uniform(0, 2 * np.pi, FEATURES)
    z = np.cos(x @ directions / (width * np.sqrt(x.shape[1])) + phases) * np.sqrt(2 / FEATURES)
    return np.column_stack([z, np.ones(len(x))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.empty((0, len(STATISTICS)))


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def _sums(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> dict[tuple[int, int], list[np.ndarray]]:
    """By (width, fold): the sums of z'z, z'y and y'y over rows (fold, y, x).  Each
    partition sends one set; the rows, and with them the partitions, are bounded."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            fold, y, x = np.asarray(batch.column(0)), np.asarray(batch.column(1)), _standard(_matrix(batch.column(2)), mean, scale)
            for w, width in enumerate(WIDTHS):
                z = np.column_stack([fourier(x, width), y])
                for k in range(FOLDS):
                    own = z[fold == k]
                    total[w, k] = total.get((w, k), 0) + own.T @ own
        for (w, k), m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([w]), pa.array([k]), pa.array([m.astype("<f8").tobytes()])], names=["width", "fold", "sums"])

    out: dict[tuple[int, int], np.ndarray] = {}
    for r in rows.select("fold", "y", "x").mapInArrow(add, "width long, fold long, sums binary").toLocalIterator():
        m = np.frombuffer(r.sums, "<f8").reshape(FEATURES + 2, FEATURES + 2)
        out[r.width, r.fold] = out.get((r.width, r.fold), 0) + m
    return out


def _solved(m: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights of summed normal equations; the constant isn't shrunk."""
    rows = max(float(m[-2, -2]), 1.0)
    shrink = np.full(FEATURES + 1, ridge * rows)
    shrink[-1] = 1e-9 * rows
    return np.linalg.solve(m[:-1, :-1] + np.diag(shrink), m[:-1, -1])


def isotonic(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to the values under the counts, by
    pooling neighbours that are out of order."""
    pools: list[list[float]] = []
    for v, c in zip(values.tolist(), counts.tolist()):
        pools.append([v * c, c, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, c, k = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + c, pools[-1][2] + k]
    return np.concatenate([np.full(k, s / c) for s, c, k in pools]) if pools else np.empty(0)


def _knots(centres: np.ndarray, good: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between the middles of the pools the calibrated score rises in a line."""
    heights = isotonic(good / counts, counts)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(heights) > 0]))
    weight, place = np.add.reduceat(counts, starts), np.add.reduceat(centres * counts, starts)
    return place / weight, heights[starts]


def fit(rows: DataFrame) -> Model:
    """A model from labelled rows (fold from 0, y 0 or 1, x).

    ``rows`` is read several times and should be a bounded table.  Without rows, or
    with one label alone, scores are the share of label 1 (0.5 without rows).
    """
    dims = len(STATISTICS)
    moments = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *(f(F.col("x")[k]).alias(f"{f.__name__}_{k}") for f in (F.avg, F.stddev_pop) for k in range(dims))).first()
    if not moments["n"] or moments["y"] in (0.0, 1.0):
        level = 0.5 if not moments["n"] else moments["y"]
        return Model(np.zeros(dims), np.ones(dims), 1.0, np.zeros(FEATURES + 1), np.array([0.0]), np.array([level]))
    mean = np.array([moments[f"avg_{k}"] for k in range(dims)])
    scale = np.array([moments[f"stddev_pop_{k}"] for k in range(dims)])
    scale = np.where(scale > 1e-9, scale, 1.0)
    sums = _sums(rows, mean, scale)
    best = None
    for w in range(len(WIDTHS)):
        parts = [sums.get((w, k), np.zeros((FEATURES + 2, FEATURES + 2))) for k in range(FOLDS)]
        whole = sum(parts)
        for ridge in RIDGES:
            folds = [_solved(whole - p, ridge) for p in parts]
            missed = sum(float(p[-1, -1] - 2 * v @ p[:-1, -1] + v @ p[:-1, :-1] @ v) for p, v in zip(parts, folds))
            if best is None or missed < best[0]:
                best = missed, WIDTHS[w], folds, _solved(whole, ridge)
    _, width, folds, weights = best

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_fold = np.stack(folds)
        for batch in batches:
            z = fourier(_standard(_matrix(batch.column(2)), mean, scale), width)
            raw = (z * by_fold[np.asarray(batch.column(0))]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(raw / BIN).astype(np.int64)), batch.column(1)], names=["bin", "y"])

    bins = rows.select("fold", "y", "x").mapInArrow(unseen, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("good"), F.count("*").alias("n")).orderBy("bin").toPandas()
    knots, heights = _knots(bins["bin"].to_numpy() * BIN, bins["good"].to_numpy(), bins["n"].to_numpy().astype(float))
    return Model(mean, scale, width, weights, knots, heights)


def score(measured: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of rows (doc_id, x)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = fourier(_standard(_matrix(batch.column(1)), model.mean, model.scale), model.width) @ model.weights
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.interp(raw, model.knots, model.heights))], names=["doc_id", "score"])

    return measured.select("doc_id", "x").mapInArrow(apply, "doc_id long, score double")


def labelled(measured: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELS) -> DataFrame:
    """fold, y, x of the rows that may be learnt from: those with a label whose
    crc32(doc_id as text) mod 5 isn't 0; about ``most`` of them, chosen by a hash of
    the id.  A fold is that remainder less 1, so copies of an id share one.  An id with several
    labels has their mean, rounded."""
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.where(F.col(label).isin(0, 1) & (remainder != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg(label)).alias("y"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    return measured.join(known, "doc_id").select((F.crc32(F.col("doc_id").cast("string")) % 5 - 1).cast("long").alias("fold"), "y", "x")


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3, most: int = MOST_LABELS) -> DataFrame:
    """doc_id, held_out (never learnt from: crc32(doc_id as text) mod 5 is 0), score
    (0 to 1, higher: label 1 likelier) and predicted (1 if the score is ``cut`` or more).

    Scores come from statistics of the whole text alone.  Null and empty texts have
    statistics of 0 and a score; a null id has no label, and counts as held out;
    repeated rows have a row each; labels that are neither 0 nor 1 are left out;
    other columns are ignored; without labels all scores are 0.5.  The statistics
    are written once (34 numbers a document) and shuffled to the labels by id.
    """
    measured = written(with_statistics(docs), "statistics")
    model = fit(written(labelled(measured, labels, label, most), "labelled"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return score(measured, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
