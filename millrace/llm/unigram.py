"""SentencePiece encoding and decoding with a unigram model.

Pieces with their log scores stand in a double-array trie; the best split of a
text is the Viterbi path over it.  White space is written as a marker that can
only begin a piece, so a text falls apart before each marker and every distinct
word is split once.  The path search runs over all new words of a batch at a
time, position by position.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PieceCache, by_bytes, gather, text_array

MARK = "▁"
#: An unknown character costs this more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Words above this many bytes are split one by one.
_LONG = 128


class DoubleArray:
    """A trie over bytes: from state s the byte c leads to base[s] + c if
    check[base[s] + c] == s.  ``value`` has the piece that ends in a state, or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]) -> None:
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, value in keys:
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = value
        size = 8 * len(children) + 2048
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken, state = bytearray(size), {0: 0}
        taken[0], begin = 1, 1
        for node, below in enumerate(children):  # parents come before their children
            s = state.pop(node)
            self.value[s] = ends[node]
            if not below:
                continue
            codes = sorted(below)
            lead = codes[0]
            if len(codes) == 1:
                base = taken.find(0, lead + 1) - lead
            else:
                free = taken.find(0, max(begin, lead + 1))
                tries = 0
                while any(taken[free - lead + c] for c in codes):
                    free, tries = taken.find(0, free + 1), tries + 1
                base = free - lead
                if tries > 100:  # the front is all but full
                    begin = free
            self.base[s] = base
            for c in codes:
                taken[base + c], self.check[base + c] = 1, s
                state[below[c]] = base + c
        used = int(np.nonzero(self.check >= 0)[0].max(initial=0)) + 257
        self.base, self.check, self.value = self.base[:used], self.check[:used], self.value[:used]


class Unigram:
    """Pieces of a SentencePiece model file, as a unigram model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(n)]
        self.byte_ids = np.zeros(256, dtype=np.int32)
        keys = []
        self.surface: list[bytes] = []
        for i, piece in enumerate(pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.surface.append(bytes([int(piece[1:-1], 16)]))
            elif special[i]:
                self.surface.append(" ⁇ ".encode() if model.is_unknown(i) else b"")
            else:
                keys.append((piece.encode(), i))
                self.surface.append(piece.replace(MARK, " ").encode())
        self.trie = DoubleArray(keys)
        self.score = np.array([model.get_score(i) for i in range(n)])
        self.unknown = min(self.score[i] for _, i in keys) - UNKNOWN_PENALTY
        self.longest = max(len(k) for k, _ in keys)
        if any(MARK in pieces[i].lstrip(MARK) for _, i in keys):
            raise ValueError("a piece holds white space after its first character; words can't be split apart")
        self.words = PieceCache(self._learn)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "words"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.words = PieceCache(self._learn)

    def viterbi(self, text: bytes) -> list[int]:
        """Ids of one marked text; of equal scores the path whose last piece
        starts first wins, here and at every earlier end."""
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        n = len(text)
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for p in range(n):
            if text[p] & 0xC0 == 0x80:
                continue
            size = 1
            while p + size < n and text[p + size] & 0xC0 == 0x80:
                size += 1
            state, single, own = 0, False, best[p]
            for q in range(p, n):
                to = base[state] + text[q]
                if check[to] != state:
                    break
                state = to
                if value[state] >= 0:
                    single |= q + 1 - p == size
                    if own + score[value[state]] > best[q + 1]:
                        best[q + 1], back[q + 1], piece[q + 1] = own + score[value[state]], p, value[state]
            if not single and own + self.unknown > best[p + size]:
                best[p + size], back[p + size], piece[p + size] = own + self.unknown, p, -1
        out, end = [], n
        while end:
            out += [int(piece[end])] if piece[end] >= 0 else [int(self.byte_ids[c]) for c in reversed(text[back[end] : end])]
            end = back[end]
        return out[::-1]

    def _viterbi_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of up to _LONG bytes in a row, and the number of each."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lens, kind="stable")
        lens = lens[order]
        n, most = len(words), int(lens[0])
        text = np.zeros((most + 1, n), dtype=np.int32)  # position by word, longest words first
        flat = np.frombuffer(b"".join(words[i] for i in order), dtype=np.uint8)
        column = np.repeat(np.arange(n), lens)
        text[np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens), column] = flat
        first = (text & 0xC0) != 0x80
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        best = np.full((most + 1, n), -np.inf)
        back, piece = np.zeros((most + 1, n), np.int16), np.full((most + 1, n), -1, np.int32)
        best[0] = 0.0
        for p in range(most):
            live = int(np.searchsorted(-lens, -p, side="left"))  # words longer than p
            at = np.nonzero(first[p, :live])[0]
            size = np.ones(len(at), np.int64)
            for k in range(1, 4):
                if p + k <= most:
                    size += (size == k) & ~first[p + k, at] & (p + k < lens[at])
            single = np.zeros(len(at), bool)
            walk, state = np.arange(len(at)), np.zeros(len(at), np.int32)
            for q in range(p, min(most, p + self.longest)):
                inside = lens[at[walk]] > q
                walk, state = walk[inside], state[inside]
                to = base[state] + text[q, at[walk]]
                ok = check[to] == state
                walk, state = walk[ok], to[ok]
                if not len(walk):
                    break
                end = np.nonzero(value[state] >= 0)[0]
                if len(end):
                    w, v = walk[end], value[state[end]]
                    single[w] |= size[w] == q + 1 - p
                    c = at[w]
                    new = best[p, c] + self.score[v]
                    better = new > best[q + 1, c]
                    c = c[better]
                    best[q + 1, c], back[q + 1, c], piece[q + 1, c] = new[better], p, v[better]
            lone = np.nonzero(~single)[0]
            if len(lone):
                c, to = at[lone], p + size[lone]
                new = best[p, c] + self.unknown
                better = new > best[to, c]
                c, to = c[better], to[better]
                best[to, c], back[to, c], piece[to, c] = new[better], p, -1
        # walk back over all words at once; parts come from the last to the first
        end, who = lens.copy(), np.arange(n)
        found_word, found_id, found_place = [], [], []
        who = who[end > 0]
        while len(who):
            e = end[who]
            b, v = back[e, who].astype(np.int64), piece[e, who]
            known = v >= 0
            found_word.append(who[known])
            found_id.append(v[known])
            found_place.append(b[known])
            for k in range(4):  # the bytes of unknown characters
                u = np.nonzero(~known & (b + k < e))[0]
                found_word.append(who[u])
                found_id.append(self.byte_ids[text[b[u] + k, who[u]]])
                found_place.append(b[u] + k)
            end[who] = b
            who = who[b > 0]
        word, ids, place = (np.concatenate(x) for x in (found_word, found_id, found_place))
        inverse = order[word]
        sort = np.lexsort((place, inverse))
        return ids[sort].astype(np.int32), np.bincount(inverse, minlength=n)

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = words.cast(pa.binary()).to_pylist()
        long = [i for i, w in enumerate(raw) if len(w) > _LONG]
        short = [i for i, w in enumerate(raw) if len(w) <= _LONG]
        flats, lens = [np.empty(0, np.int32)], np.zeros(len(raw), np.int64)
        for k in range(0, len(short), 40_000):
            part = short[k : k + 40_000]
            ids, lens[part] = self._viterbi_many([raw[i] for i in part])
            flats.append(ids)
        if not long:
            return np.concatenate(flats), lens
        lists = [self.viterbi(raw[i]) for i in long]
        lens[long] = [len(x) for x in lists]
        single = np.zeros(len(raw), bool)
        single[long] = True
        owner = np.repeat(single, lens)
        ids = np.empty(len(owner), np.int32)
        ids[~owner], ids[owner] = np.concatenate(flats), [i for x in lists for i in x]
        return ids, lens

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and their offsets."""
        self.words.trim()
        texts = pc.replace_substring(texts, MARK, " ")
        spaced = np.asarray(pc.match_substring_regex(texts, "^ |  | $|^$"))
        plain, odd = np.nonzero(~spaced)[0], np.nonzero(spaced)[0]
        words = pc.split_pattern(texts.take(pa.array(plain)), " ")
        at = np.asarray(words.offsets, np.int64)
        index = self.words.indices(pc.binary_join_element_wise(MARK, words.values, ""))
        if len(odd):  # runs of white space, or none: the marker of each space stays with the word after
            runs = [re.findall(f"{MARK}+[^{MARK}]*", (MARK + t).replace(" ", MARK)) if t else [] for t in texts.take(pa.array(odd)).to_pylist()]
            own = self.words.indices(pa.array([w for r in runs for w in r], pa.string()))
            n = np.zeros(len(texts), np.int64)
            n[plain], n[odd] = np.diff(at), [len(r) for r in runs]
            both = np.concatenate([index, own])
            begin = np.zeros(len(texts), np.int64)
            begin[plain], begin[odd] = at[:-1], len(index) + np.cumsum(n[odd]) - n[odd]
            index, at = gather(both, begin, n)
        ids, offsets = self.words.ids(index)
        return ids, offsets[at]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: markers become spaces, byte pieces join to characters
        (invalid ones to U+FFFD), and the space put before the text goes."""
        text = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids of every row of docs (doc_id, text).

    Null and empty texts have no ids; repeated rows stay; other columns are left
    out.  The marker character itself reads as a space.  Texts are encoded whole,
    however long: word by word, a long text in a slice of its own; one without
    spaces is a single word, which is held whole.  The pieces travel with
    the tasks (their number bounds the trie); nothing is shuffled.
    """
    unigram = Unigram(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1))
            for a, b in by_bytes(texts, 3 << 20):
                ids, at = unigram.encode(texts.slice(a, b - a))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    at, flat = np.asarray(column.offsets), np.asarray(column.values)
    return (flat[i:j] for i, j in zip(at[:-1], at[1:]))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, text of every row of encoded (doc_id, ids); null ids read as
    none and give ''.  A row is decoded whole, however many ids it has; repeated
    rows stay, other columns are left out."""
    unigram = Unigram(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [unigram.decode(x.tolist()) for x in _lists(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>")).alias("ids")
    return encoded.select("doc_id", ids).mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit), decoded_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in _lists(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.list_value_length(batch.column(1)).cast(pa.int64()), crcs, batch.column(2)], names=["doc_id", "n_tokens", "ids_crc32", "decoded_crc32"])

    return decoded.select("doc_id", "ids", F.crc32(F.col("text").cast("binary")).alias("decoded_crc32")).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long")
