"""Alignment of two tokenizers' tokens over the same bytes.

Tokens of both are intervals of bytes.  Sorted by start, they fall into groups
where a start reaches the running maximum of the ends; inside a group the pairs of
tokens that overlap are expanded.  How often a pair of ids is linked in the whole
corpus then weighs the links of each document.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import Encoder
from .common import PieceCache, by_bytes, gather, row_numbers, text_array, written

MARK = "▁"
#: Counted pairs are broadcast up to this number (16 bytes each), else joined by
#: shuffle.  Pairs that end together stay below it for any corpus: one token is the
#: other's last bytes, which :func:`most_end_pairs` counts over the vocabularies.
BROADCAST_PAIRS = 1_000_000
#: A packed pair is a's id times this, plus b's id.
SHIFT = 1 << 20
_SLICE = 1 << 19
#: Words whose pieces a process holds.
MOST_WORDS = 200_000

_pieces: dict[str, "PieceEncoder"] = {}


def byte_level_bytes(encoder: Encoder) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, where a byte that prints
    stands for itself and the others for code points from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    back = {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}
    out = [b""] * len(encoder.width)
    for token, i in encoder.tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


class PieceEncoder:
    """Ids of whole texts by the sentencepiece library; ``of(path)`` keeps one a process.

    No piece goes on after a mark that follows another character (else nothing is
    cut), so a text may be cut before single spaces: each distinct word is encoded
    once.  Texts with spaces in a row or at an end, and with marks, are encoded whole.
    """

    @staticmethod
    def of(path: str) -> "PieceEncoder":
        if path not in _pieces:
            _pieces[path] = PieceEncoder(path)
        return _pieces[path]

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(names[i][3:5], 16)]) if self.library.is_byte(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.uncut = "" if any(MARK in name.lstrip(MARK) for name in names) else f"^ |  | $|{MARK}|^$"
        self.words = PieceCache(lambda words: self._each(words.to_pylist()), MOST_WORDS)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self.library.encode(texts, num_threads=1) if texts else []
        return np.array([i for x in lists for i in x], dtype=np.int32), np.array([len(x) for x in lists], dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, offsets); the library puts a space before each text."""
        self.words.trim()
        whole = np.asarray(pc.match_substring_regex(texts, self.uncut))
        lists = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
        cut, counts = self.words.ids(self.words.indices(lists.values))
        cut_lens = np.diff(counts[np.asarray(lists.offsets, dtype=np.int64)])
        rest, rest_lens = self._each(texts.filter(pa.array(whole)).to_pylist())
        lens = np.empty(len(texts), np.int64)
        lens[~whole], lens[whole] = cut_lens, rest_lens
        starts = np.empty(len(texts), np.int64)
        starts[~whole], starts[whole] = np.cumsum(cut_lens) - cut_lens, len(cut) + np.cumsum(rest_lens) - rest_lens
        return gather(np.concatenate([cut, rest]), starts, lens)


class Lookup:
    """Byte strings by number, as one array."""

    def __init__(self, items: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(items), np.uint8)
        self.lens = np.array([len(x) for x in items], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens

    def join(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(self.flat, self.starts[numbers], self.lens[numbers])


def most_end_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of ids of two vocabularies can end together: those where one
    token is the other's last bytes."""
    na, nb = ({} for _ in range(2))
    for vocabulary, counts in ((a, na), (b, nb)):
        for token in vocabulary:
            counts[token] = counts.get(token, 0) + 1
    tails = lambda tokens, held: sum(n * held.get(t[k:], 0) for t, n in tokens.items() for k in range(len(t)))
    return tails(na, nb) + tails(nb, na) - sum(n * nb.get(t, 0) for t, n in na.items() if t)


def coalesce(a_lens: np.ndarray, b_lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of two sequences of tokens (by their lengths) over the same bytes:
    (group of each a, group of each b, a and b of all pairs that overlap)."""
    a_ends, b_ends = np.cumsum(a_lens), np.cumsum(b_lens)
    a_starts, b_starts = a_ends - a_lens, b_ends - b_lens
    starts, ends = np.concatenate([a_starts, b_starts]), np.concatenate([a_ends, b_ends])
    order = np.lexsort((np.arange(len(starts)) >= len(a_lens), starts))
    running = np.maximum.accumulate(ends[order])
    breaks = np.concatenate([[False], starts[order][1:] >= running[:-1]]) if len(order) else np.empty(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    first = np.searchsorted(b_ends, a_starts, side="right")
    n = np.searchsorted(b_starts, a_ends, side="left") - first
    left = np.repeat(np.arange(len(a_lens)), n)
    right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return group[: len(a_lens)], group[len(a_lens) :], left, right


def _digits(ids: np.ndarray, separators: np.ndarray, table: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """The decimal ids, each with its separator, as bytes, and offsets."""
    flat, at = table.join(ids)
    flat[at[1:] - 1] = separators
    return flat, at


_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, n_links long, groups_sha256 string, pairs array<long>"


def _align(a_path: str, b_path: str, links: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        a_coder, b_coder = Encoder.of(a_path), PieceEncoder.of(b_path)
        a_coder.first.most = a_coder.later.most = MOST_WORDS  # two vocabularies share the memory
        a_bytes, b_bytes = Lookup(byte_level_bytes(a_coder)), Lookup(b_coder.bytes)
        numbers = Lookup([b"%d," % i for i in range(max(len(a_bytes.lens), len(b_bytes.lens)))])
        for batch in batches:
            texts = text_array(batch.column(1))
            for first, last in by_bytes(texts, _SLICE):
                own, n = texts.slice(first, last - first), last - first
                spaced = pc.binary_join_element_wise(" ", own, "")
                a_parts = list(a_coder.slices(spaced))
                a_ids = np.concatenate([ids for _, ids, _ in a_parts])
                a_n = np.concatenate([np.diff(at) for _, _, at in a_parts]).astype(np.int64)
                b_ids, b_at = b_coder.encode(own)
                b_n = np.diff(b_at)
                a_ids, b_ids, a_n, b_n = _same_bytes(spaced, own, a_ids, a_n, b_ids, b_n, a_bytes, b_bytes)
                yield _aligned(batch.column(0).slice(first, n), row_numbers(part, seen, n), a_ids, a_n, b_ids, b_n, a_bytes.lens, b_bytes.lens, numbers, links)
                seen += n

    return align


def _same_bytes(spaced, own, a_ids, a_n, b_ids, b_n, a_bytes, b_bytes):
    """The ids without those of texts that are empty or whose bytes are others than
    both tokenizers'."""
    n = len(a_n)
    size = np.asarray(pc.binary_length(spaced)).astype(np.int64)
    text = np.frombuffer(b"".join(x.as_buffer() for x in spaced), np.uint8)
    good = np.asarray(pc.binary_length(own)) > 0
    for ids, counts, table in ((a_ids, a_n, a_bytes), (b_ids, b_n, b_bytes)):
        flat, at = table.join(ids)
        ends = at[np.concatenate([[0], np.cumsum(counts)])]
        if np.array_equal(flat, text):
            good &= np.diff(ends) == size
            continue
        starts = np.cumsum(size) - size
        good &= np.diff(ends) == size
        for i in np.flatnonzero(good):
            good[i] = np.array_equal(flat[ends[i] : ends[i + 1]], text[starts[i] : starts[i] + size[i]])
    if good.all():
        return a_ids, b_ids, a_n, b_n
    return a_ids[np.repeat(good, a_n)], b_ids[np.repeat(good, b_n)], np.where(good, a_n, 0), np.where(good, b_n, 0)


def _aligned(doc_ids, rows, a_ids, a_n, b_ids, b_n, a_lens, b_lens, numbers, links) -> pa.RecordBatch:
    n = len(rows)
    a_doc = np.repeat(np.arange(n), a_n)
    a_len, b_len = a_lens[a_ids], b_lens[b_ids]
    ga, gb, left, right = coalesce(a_len, b_len)
    n_groups = int(ga[-1]) + 1 if len(ga) else 0
    a_first, b_first = np.searchsorted(ga, np.arange(n_groups + 1)), np.searchsorted(gb, np.arange(n_groups + 1))
    group_doc = a_doc[a_first[:-1]]
    per_doc = lambda docs: np.bincount(docs, minlength=n)
    # all tokens in the order of the digest: a group's a tokens, then its b tokens
    text_ids, separators = np.empty(len(ga) + len(gb), np.int64), np.full(len(ga) + len(gb), ord(","), np.uint8)
    a_place, b_place = np.arange(len(ga)) + b_first[ga], np.arange(len(gb)) + a_first[gb + 1]
    text_ids[a_place], text_ids[b_place] = a_ids, b_ids
    separators[a_place[a_first[1:] - 1]], separators[b_place[b_first[1:] - 1]] = ord("|"), ord(";")
    flat, at = _digits(text_ids, separators, numbers)
    ends = at[np.concatenate([[0], np.cumsum(a_n + b_n)])]
    view = memoryview(flat)
    digests = [hashlib.sha256(view[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
    overlaps = per_doc(a_doc[left])
    if links == "end":
        together = np.cumsum(a_len)[left] == np.cumsum(b_len)[right]
        left, right = left[together], right[together]
    n_links = per_doc(a_doc[left])
    pairs = a_ids[left].astype(np.int64) * SHIFT + b_ids[right]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32)), pa.array(pairs))
    return pa.RecordBatch.from_arrays(
        [pa.array(rows), doc_ids, *(pa.array(x.astype(np.int64)) for x in (a_n, b_n, per_doc(group_doc), overlaps, n_links)), pa.array(digests, pa.string()), lists],
        names=[c.split()[0] for c in _ALIGNED.split(", ")],
    )


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, links: str = "end", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256 (of ``a1,a2|b1;a3|b2,b3``) and n_overlaps.

    ``a_path`` is a byte-level vocabulary of the tokenizers library, which encodes
    a space and the text; ``b_path`` a model of the sentencepiece library, which puts
    the space before itself.  Special tokens in texts are plain text.  Links are the
    pairs of tokens whose bytes end at the same place (``end``) or that share bytes
    (``overlap``).  A pair of ids counts as often as it is linked in all documents;
    ``count_sum`` adds that up over a document's links, and ``n_best`` are those whose
    b has no pair that counts more.

    Null and empty texts, and those whose tokens' bytes aren't a space and the text,
    have zeros and an empty digest.  A null id stays null; repeated rows are documents
    of their own; other columns are left out; no rows give no rows.  Very long
    texts are held whole in one task, some hundred bytes a token.
    """
    if links not in ("end", "overlap"):
        raise ValueError(f"links are end or overlap, not {links!r}")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    aligned = written(rows.mapInArrow(_align(a_path, b_path, links), _ALIGNED), "aligned")
    linked = aligned.select("row", F.explode("pairs").alias("pair"))
    counts = written(linked.groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    b = F.col("pair") % SHIFT
    best = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    scored = counts.withColumn("b", b).join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    if counts.count() <= BROADCAST_PAIRS:
        scored = F.broadcast(scored)
    weighed = linked.join(scored, "pair").groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return aligned.drop("pairs").join(weighed, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", "n_overlaps")
