"""Hashes of the words of many texts at once, in numpy.

A word is a run of ASCII letters and digits, in lower case; every other byte separates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_VALUE = np.zeros(256, np.uint64)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _VALUE[_c] = _c * 0x9E3779B97F4A7C15 % (1 << 64)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _VALUE[_c] = _VALUE[_c + 32]
_IS_WORD = _VALUE > 0
_LOW = np.multiply.accumulate(np.full(1 << 16, 0xD1342543DE82EF95, np.uint64))
PIECE = 1 << 20


def _high(top: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(top + 1, 0xA24BAED4963EE407, np.uint64))


def _piece(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte starts of the words of one piece; ``breaks`` are positions where a word begins anew."""
    inside = _IS_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    if len(breaks):
        begins[breaks] = inside[breaks]
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(begins)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), starts
    first = np.flatnonzero(begins[at])
    offset = at - np.repeat(starts, np.diff(np.append(first, len(at))))
    values = _VALUE[data[at]] * _LOW[offset & 0xFFFF]
    top = int(offset.max()) >> 16
    if top:
        values *= _high(top)[offset >> 16]
    return np.add.reduceat(values, first), starts


def word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first byte of every word of ``data`` (UTF-8 bytes), in order.

    Works through pieces of about ``PIECE`` bytes, cut between words, so that memory stays
    small however long the text is.
    """
    hashes, starts, begin, n = [], [], 0, len(data)
    while begin < n:
        end = min(begin + PIECE, n)
        while end < n:
            ahead = _IS_WORD[data[end : end + PIECE]]
            if not ahead.all():
                end += int(np.argmin(ahead))
                break
            end += len(ahead)
        lo, hi = np.searchsorted(breaks, (begin, end))
        h, s = _piece(data[begin:end], breaks[lo:hi] - begin)
        hashes.append(h)
        starts.append(s + begin)
        begin = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n + 1 offsets of its texts; null texts have no bytes."""
    if pa.types.is_string(texts.type):
        width = np.int32
    else:
        texts, width = texts.cast(pa.large_string()), np.int64
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, width, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, n + 1 bounds of the words of each text)."""
    _, hashes, _, bounds = located_words(texts)
    return hashes, bounds


def located_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, hashes, first byte of each word, n + 1 bounds of the words of each text)."""
    data, bounds = text_bytes(texts)
    breaks = np.unique(bounds[:-1])
    hashes, starts = word_hashes(data, breaks[breaks < len(data)])
    return data, hashes, starts, np.searchsorted(starts, bounds)


def slices(texts: pa.Array, most: int = 4 << 20) -> list[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer text is a range of its own."""
    _, bounds = text_bytes(texts)
    out, begin, n = [], 0, len(bounds) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + most, "right")) - 1)
        out.append((begin, end))
        begin = end
    return out
