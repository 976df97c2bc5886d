"""Texts of an Arrow batch as byte arrays: words, shingles and lines of many texts at once, without a loop over rows.

A batch is cut into runs of whole texts of about `CHUNK_BYTES`, so the arrays in use stay small; a longer text is
a run of its own and takes memory in proportion to itself. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 20
LONG_WORD = 4096
SPACE = 0x20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Chunk(NamedTuple):
    """A run of texts: one byte of space stands after each, and eight more at the end."""

    rows: slice
    data: np.ndarray
    begin: np.ndarray

    @property
    def n(self) -> int:
        return len(self.begin) - 1


def chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    texts = pc.fill_null(texts, "")
    n = len(texts)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1
        last = min(max(last, first + 1), n)
        own = offsets[first : last + 1]
        data = np.insert(raw[own[0] : own[-1]], own[1:] - own[0], SPACE)
        begin = own - own[0] + np.arange(len(own))
        yield Chunk(slice(first, last), np.concatenate([data, np.full(8, SPACE, np.uint8)]), begin)
        first = last


class Words(NamedTuple):
    """Words of a chunk: start and end in its data, and the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, begin: np.ndarray) -> Words:
    """Runs of bytes other than blanks: `[^\\x20\\x09-\\x0D]+`."""
    other = ~_IS_SPACE[data]
    change = np.flatnonzero(other[1:] != other[:-1]) + 1
    if len(other) and other[0]:
        change = np.concatenate([[0], change])
    start, end = change[0::2], change[1::2]
    return Words(start, end, np.searchsorted(start, begin))


def single_spaced(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with one space after each word and none before the first."""
    blank = _IS_SPACE[data]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    place = np.concatenate([[0], np.cumsum(keep)])
    return np.concatenate([np.where(blank, np.uint8(SPACE), data)[keep], np.full(8, SPACE, np.uint8)]), place[begin]


def mix(h: np.ndarray) -> np.ndarray:
    """Scatters the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step; `data` must end in eight spare bytes."""
    eight = np.ndarray(shape=(max(len(data) - 7, 0),), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    length = (end - start).astype(np.int64)
    h = mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live = np.flatnonzero((length > 0) & (length <= LONG_WORD))
    at = 0
    while len(live):
        left = length[live] - at
        value = eight[start[live] + at]
        short = np.flatnonzero(left < 8)
        value[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        h[live] = mix(h[live] ^ value) + np.uint64(0x9E3779B97F4A7C15)
        live = live[left > 8]
        at += 8
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), 7)
    return h


def shingle_hashes(word_hash: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a text, and the text of each."""
    count = np.diff(first)
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = word_hash[:n].copy()
    for k in range(1, size):
        h = mix(h * np.uint64(0x9DDFEA08EB382D69) + word_hash[k : k + n])
    text = np.repeat(np.arange(len(count)), count)[:n]
    inside = np.arange(n) + size <= first[text + 1]
    return h[inside], text[inside]
