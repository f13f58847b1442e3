"""Token ids of whole texts by the tokenizers library, with each distinct piece encoded once.

A text is cut only where every pre-tokenizer in use ends a pre-token whatever stands on
either side: before a single space, around a single line feed, and between a letter and a
punctuation mark. Pieces are then encoded by the library; repeated pieces are looked up by their bytes.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

#: Ids and bytes of pieces that the lookup holds before it starts anew.
CACHE_IDS, CACHE_BYTES = 6_000_000, 24_000_000

_PRINTS = np.zeros(256, bool)
_PRINTS[0x21:0x7F] = True
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_HIGH = np.arange(256) >= 0x80
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
#: White space beyond ASCII, in UTF-8.
_ODD_WHITE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def cut_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces start; every non-empty row starts one. Rows with white space beyond ASCII stay whole."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    prev, cur = raw[:-1], raw[1:]
    following = np.empty(n - 1, np.uint8)
    following[:-1] = raw[2:]
    following[-1:] = 0
    solid = _PRINTS[prev]
    cut[1:n] = (cur == 32) & (solid | _HIGH[prev]) & ~_WHITE[following]
    letter = _LETTER[prev]
    letter[1:] |= (raw[:-2] == 0xC3) & (prev[1:] >= 0x80) & (prev[1:] != 0x97) & (prev[1:] != 0xB7)
    cut[1:n] |= letter & _MARK[cur]
    cut[1:n] |= (cur == 10) & solid
    cut[2:n] |= (prev[1:] == 10) & _PRINTS[cur[1:]] & solid[:-1]
    odd = {int(np.searchsorted(off, m.start(), side="right")) - 1 for m in _ODD_WHITE.finditer(raw.tobytes())}
    for row in odd:
        cut[off[row] : off[row + 1]] = False
    cut[off] = True
    return np.flatnonzero(cut[:n])


class PieceEncoder:
    """Encodes rows of UTF-8 bytes; holds at most CACHE_IDS ids and CACHE_BYTES bytes of known pieces and those of one block."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.starts, self.held = np.zeros(0, np.uint32), np.zeros(1, np.int64), 0

    def _learn(self, pieces: list[str]) -> None:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((i for x in encoded for i in x), np.uint32, int(sizes.sum()))
        self.slots.update(zip(pieces, range(len(self.starts) - 1, len(self.starts) - 1 + len(pieces)), strict=True))
        self.held += sum(map(len, pieces))
        self.ids = np.concatenate([self.ids, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def _slots(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The slot of each piece; Arrow's dictionary finds the distinct ones by their bytes."""
        if not len(starts):
            return np.zeros(0, np.int64)
        bounds = np.append(starts, len(raw)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        new = [x for x in pieces if x not in self.slots]
        if new:
            self._learn(new)
        return np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))[coded.indices.to_numpy()]

    def encode(self, raw: np.ndarray, off: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the n+1 offsets of each row's ids; end_id is added to every row."""
        rows = len(off) - 1
        if len(self.ids) > CACHE_IDS or self.held > CACHE_BYTES:
            self._clear()
        starts = cut_starts(raw, off)
        slot = self._slots(raw, starts)
        sizes = self.starts[slot + 1] - self.starts[slot]
        row = np.searchsorted(starts, off)
        total = np.concatenate([[0], np.cumsum(sizes)])
        extra = end_id is not None
        out_off = total[row] + (np.arange(rows + 1) if extra else 0)
        out = np.empty(int(out_off[-1]), np.uint32)
        take = np.arange(int(total[-1])) + np.repeat(self.starts[slot] - total[:-1], sizes)
        if extra:
            body = np.ones(len(out), bool)
            body[out_off[1:] - 1] = False
            out[body] = self.ids[take]
            out[~body] = end_id
        else:
            out[:] = self.ids[take]
        return out, out_off


_encoders: dict[str, PieceEncoder] = {}


def encoder(tokenizer_file: str) -> PieceEncoder:
    """One encoder for each file in a Python worker."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = PieceEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; the installed package tells where it is on each machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
