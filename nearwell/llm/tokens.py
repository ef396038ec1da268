"""Token ids of Arrow text batches by a byte-level BPE file, each distinct word encoded once.

A byte-level BPE never merges across the pieces its pattern cuts a text into. For plain texts (ASCII,
and Latin letters up to U+027F) numpy cuts whole batches at those places, and the tokenizer sees only
pieces it hasn't met; any other text, and any that holds a special token or an apostrophe
contraction, goes to the tokenizer whole.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from nearwell.llm.hashing import text_bytes

#: Pieces remembered by one Python worker; only memory and time depend on it.
REMEMBERED = 500_000

_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 13, 32]] = _SPACE
# lead bytes outside U+00C0 to U+027F, and control characters, leave the simple rules
_UNPLAIN = np.zeros(256, bool)
_UNPLAIN[[*range(9), 11, 12, *range(14, 32), *range(0xC0, 0xC3), *range(0xCA, 0x100)]] = True
_CONTRACTED = np.zeros(256, bool)
_CONTRACTED[[*b"strvmld"]] = True


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a file, kept over the tasks of one Python worker."""
    return Encoder(path)


class Encoder:
    """Encodes text columns with a ``tokenizers`` file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _indices(self, pieces: list[str]) -> np.ndarray:
        """Where each distinct piece stands among the remembered ones."""
        if len(self.known) > REMEMBERED:
            self._forget()
        new = [p for p in pieces if p not in self.known]
        if new:
            ids = self._whole(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
            self.flat = np.concatenate((self.flat, flat))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
        return np.fromiter((self.known[p] for p in pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and the n + 1 offsets; a null text has none."""
        data, offsets = text_bytes(texts)
        n = len(data)
        if not n:
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        following = np.append(data[1:], 0)
        bad = (_UNPLAIN[data] | ((data == 0xC3) & ((following == 0x97) | (following == 0xB7)))
               | ((data == 39) & _CONTRACTED[following]) | ((data == 60) & (following == 124)))
        odd = np.diff(np.searchsorted(np.flatnonzero(bad), offsets)) > 0

        kind = _CLASS[data]
        begin = np.zeros(n + 1, bool)
        begin[offsets] = True
        text_start, text_end = begin[:n], begin[1:]
        change = np.append(True, kind[1:] != kind[:-1]) | text_start
        blank = kind == _SPACE
        last_blank = np.append(blank[:-1] & ~blank[1:], False) & ~text_end
        after_space = np.append(False, data[:-1] == 32) & ~text_start
        start = np.flatnonzero((change & (blank | ~after_space)) | last_blank)
        pieces = pa.StringArray.from_buffers(
            len(start), pa.py_buffer(np.append(start, n).astype(np.int32)),
            pa.py_buffer(np.ascontiguousarray(data)))
        owner = np.searchsorted(offsets, start, "right") - 1
        plain = ~odd[owner]
        if not plain.all():
            pieces, owner = pieces.filter(pa.array(plain)), owner[plain]
        coded = pc.dictionary_encode(pieces)
        at = self._indices(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sizes = self.starts[at + 1] - self.starts[at]
        counts = np.bincount(owner, sizes, len(texts)).astype(np.int64)
        whole = self._whole([texts[int(i)].as_py() for i in np.flatnonzero(odd)])
        counts[odd] = [len(x) for x in whole]
        bounds = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(bounds[-1], np.int32)
        steps = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = self.flat[np.repeat(self.starts[at], sizes) + steps]
        out[np.repeat(~odd, counts)] = ids
        for i, x in zip(np.flatnonzero(odd), whole):
            out[bounds[i]:bounds[i + 1]] = x
        return out, bounds
