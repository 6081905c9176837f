"""Token ids of whole texts by the tokenizers library, for tasks.

The byte-level BPE vocabulary splits a text into words before it merges, and a
word takes the one space before it along.  Thus a text may be cut before every
space that follows a non-space, and each distinct piece is encoded once and
looked up from then on.  Texts with a space after other white space are encoded
uncut.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import PieceCache, by_bytes, gather

_WHITE = r"[\t-\r\x1c- \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space of Unicode before a space: there the cut could change the words.
_UNSAFE = f"{_WHITE} "
_SLICE = 3 << 20

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Encodes Arrow arrays of texts; ``of(path)`` keeps one a process."""

    @staticmethod
    def of(path: str) -> "Encoder":
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int32)
        for token, i in vocab.items():
            self.width[i] = len(token)  # a character of a byte-level token is a byte
        self.first = PieceCache(lambda pieces: self._each(pieces.to_pylist()))
        self.later = PieceCache(self._joined)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self._whole(texts)
        return np.array([i for x in lists for i in x], dtype=np.int32), np.array([len(x) for x in lists], dtype=np.int64)

    def _joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that follow a space.  Those that end with a non-space
        are encoded in joined runs; the widths of the tokens show their ends."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        alone = np.asarray(pc.match_substring_regex(pieces, f"^$|{_WHITE}$"))
        plain = pieces.take(pa.array(np.nonzero(~alone)[0]))
        for k in range(0, len(plain), 40_000):
            part = plain.slice(k, 40_000)
            at = np.append(np.arange(0, len(part), 1000), len(part)).astype(np.int32)
            runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), pa.concat_arrays([part])), " ")
            ids, _ = self._each([" " + run for run in runs.to_pylist()])
            ends = np.cumsum(np.asarray(pc.binary_length(part)).astype(np.int64) + 1)
            reach = np.cumsum(self.width[ids], dtype=np.int64)
            cut = np.searchsorted(reach, ends)
            if len(reach) and cut[-1] < len(reach) and (reach[cut] == ends).all():
                out.append((ids, np.diff(cut + 1, prepend=0)))
            else:
                out.append(self._each([" " + p for p in part.to_pylist()]))
        if not alone.any():
            return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])
        rest = np.nonzero(alone)[0]
        lists = self._whole([" " + p for p in pieces.take(pa.array(rest)).to_pylist()])
        lens = np.zeros(len(pieces), np.int64)
        lens[~alone] = np.concatenate([n for _, n in out]) if out else []
        lens[rest] = [len(x) for x in lists]
        owner = np.repeat(np.arange(len(pieces)), lens)
        ids = np.empty(len(owner), np.int32)
        ids[~alone[owner]] = np.concatenate([x for x, _ in out]) if out else []
        ids[alone[owner]] = [i for x in lists for i in x]
        return ids, lens

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        self.first.trim()
        self.later.trim()
        unsafe = np.asarray(pc.match_substring_regex(texts, _UNSAFE))
        if not unsafe.any():
            words = pc.split_pattern(texts, " ")
            offsets = np.asarray(words.offsets, dtype=np.int64)
            places = self.later.indices(words.values)
            head = np.zeros(len(places), dtype=bool)
            head[offsets[:-1]] = True
            own = self.first.indices(words.values.take(pa.array(offsets[:-1])))
            starts, lens = self.later.starts[places], self.later.lens[places].astype(np.int64)
            starts[head], lens[head] = len(self.later.flat) + self.first.starts[own], self.first.lens[own]
            ids, at = gather(np.concatenate([self.later.flat, self.first.flat]), starts, lens)
            return ids, at[offsets]
        parts: list[np.ndarray] = [None] * len(texts)
        safe = np.nonzero(~unsafe)[0]
        if len(safe):
            ids, at = self._slice(texts.take(pa.array(safe)))
            for j, row in enumerate(safe):
                parts[row] = ids[at[j] : at[j + 1]]
        odd = np.nonzero(unsafe)[0]
        for row, x in zip(odd, self._whole(texts.take(pa.array(odd)).to_pylist())):
            parts[row] = np.array(x, dtype=np.int32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def slices(self, texts: pa.Array):
        """(first row, ids, offsets) over ranges of rows of some MB of text:
        the ids of row ``first + j`` are ids[offsets[j] : offsets[j + 1]]."""
        for a, b in by_bytes(texts, _SLICE):
            yield (a, *self._slice(texts.slice(a, b - a)))
