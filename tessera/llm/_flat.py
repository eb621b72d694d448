"""Words of a whole Arrow column as flat numpy arrays: one pass over its bytes, no Python per word."""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Byte classes: part of a word, a gap between words, a gap that also ends a piece.
WORD, GAP, BREAK = 0, 1, 2
#: Words of more bytes than this are hashed one by one.
LONG = 32


class Words(NamedTuple):
    """Bytes of a column, which of them are in words, and of every word its start and length there and the row it is in; ``piece`` numbers the pieces between breaks."""

    data: np.ndarray
    inside: np.ndarray
    start: np.ndarray
    length: np.ndarray
    row: np.ndarray
    piece: np.ndarray

    def array(self) -> pa.LargeStringArray:
        """The words as an Arrow array."""
        ends = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(self.start), pa.py_buffer(ends), pa.py_buffer(self.data[self.inside]))


def classes(gaps: str, breaks: str = "", kept: bytes | None = None) -> np.ndarray:
    """Class of every byte: ``gaps`` and ``breaks`` hold ASCII characters; with ``kept`` all ASCII characters but those are gaps. Bytes of other characters are parts of words."""
    out = np.zeros(256, np.uint8)
    if kept is not None:
        out[:128] = GAP
        out[list(kept)] = WORD
    out[list(gaps.encode())] = GAP
    out[list(breaks.encode())] = BREAK
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def split(texts: pa.Array, kinds: np.ndarray) -> Words:
    """The words of every row of ``texts`` (strings without nulls), A to Z lowered."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2] if len(texts) else None
    data = np.empty(0, np.uint8) if held is None else _LOWER[np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    kind = kinds[data]
    inside = kind == WORD
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]  # where one row ends and the next begins
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    cut = kind == BREAK
    cut[edge] = True
    piece = np.cumsum(cut, dtype=np.int32)[start]
    return Words(data, inside, start, end - start, row, piece)


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _table()


def crc32(words: Words, at: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of the words at those places, or of what ``state`` is the CRC-32 of, a space and the word."""
    if state is None:
        crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    else:
        crc = state ^ np.uint32(0xFFFFFFFF)
        crc = _CRC[(crc ^ np.uint32(32)) & np.uint32(255)] ^ (crc >> np.uint32(8))
    start, length = words.start[at], words.length[at]
    for i in np.flatnonzero(length > LONG):
        crc[i] = zlib.crc32(words.data[start[i] : start[i] + length[i]].tobytes(), int(crc[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    active = np.flatnonzero(length <= LONG)
    for k in range(LONG):
        active = active[length[active] > k] if k else active
        if not len(active):
            break
        now = crc[active]
        crc[active] = _CRC[(now ^ words.data[start[active] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)
