"""Hashes of words and of word windows, in independent lanes of 64 bits, for whole Arrow buffers at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A slab is what is hashed in one go; longer texts make longer slabs.
SLAB = 1 << 20


def _spread(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Places within a word whose byte values are tabulated; beyond them the same values are computed.
_NEAR = 64
_LANES = (np.uint64(0xD1342543DE82EF95), np.uint64(0xA0761D6478BD642F))


def _byte_value(lane: int, at: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Pseudo-random 64 bits of a byte at a place of its word: no arithmetic relation between them."""
    return _spread(_spread((at.astype(np.uint64) << np.uint64(8)) + byte + _LANES[lane]) * _LANES[lane])


_TABLES = [_byte_value(k, np.repeat(np.arange(_NEAR), 256), np.tile(np.arange(256, dtype=np.uint64), _NEAR)) for k in range(len(_LANES))]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array, fold: bool = False, lanes: int = 1) -> tuple[np.ndarray, ...]:
    """Hashes of all words of all texts, one array a lane, and the offsets of the texts among them.

    A word's hash sums the values of its bytes at their places, as tabulation hashing does, so
    that no rearrangement of bytes collides by its structure; lanes are independent of each
    other. ``fold`` treats A-Z as a-z.
    """
    raw, offsets = text_buffer(texts)
    found, counts, at = [[np.zeros(0, np.uint64)] for _ in range(lanes)], [np.zeros(1, np.int64)], 0
    while at < len(offsets) - 1:
        to = int(np.searchsorted(offsets, offsets[at] + SLAB, "right")) - 1
        to = min(max(to, at + 1), len(offsets) - 1)
        *h, c = _slab(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], fold, lanes)
        for lane, x in zip(found, h, strict=True):
            lane.append(x)
        counts.append(c)
        at = to
    return *(np.concatenate(x) for x in found), np.cumsum(np.concatenate(counts))


def _slab(raw: np.ndarray, offsets: np.ndarray, fold: bool, lanes: int) -> list[np.ndarray]:
    n = len(raw)
    if not n:
        return [np.zeros(0, np.uint64)] * lanes + [np.zeros(len(offsets) - 1, np.int64)]
    gap = _WHITE[raw]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = True
    after[inner - 1] = True
    word = ~gap
    starts = np.flatnonzero(word & before)
    sizes = np.flatnonzero(word & after) + 1 - starts
    ends = np.cumsum(sizes)
    firsts = ends - sizes
    place = np.arange(word.sum(), dtype=np.int32) - np.repeat(firsts.astype(np.int32), sizes)
    byte = raw[word]
    if fold:
        byte = _FOLD[byte]
    far = np.flatnonzero(place >= _NEAR)
    key = (place << 8) + byte
    out = []
    for lane in range(lanes):
        values = _TABLES[lane].take(key, mode="clip")
        if len(far):
            values[far] = _byte_value(lane, place[far], byte[far].astype(np.uint64))
        sums = np.zeros(len(byte) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        out.append(_spread(sums[ends] - sums[firsts]))
    return [*out, np.diff(np.searchsorted(starts, offsets))]


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two adjacent windows from their hashes."""
    return _spread(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F))


def grow(h: np.ndarray, have: int, want: int) -> np.ndarray:
    """Hashes of windows of ``want`` words from those of ``have`` (want <= 2 * have), by overlap."""
    step = want - have
    return pair(h[:-step], h[step:]) if step and len(h) > step else h[: max(0, len(h) - step)]


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` words, doubled up from single words."""
    have = 1
    while have < length:
        want = min(2 * have, length)
        h = grow(h, have, want)
        have = want
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        want = min(2 * have, width)
        step = want - have
        h = np.minimum(h[:-step], h[step:])
        have = want
    return h
