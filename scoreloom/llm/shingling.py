"""Sets of word shingles as 64-bit numbers, computed for many texts at once from their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORDS = 5
#: Bytes that are worked on at once; a longer text is still one piece, its words are taken in such portions.
PORTION = 1 << 18
#: Words of more bytes are hashed by xxhash, shorter ones by a sum over their bytes.
LONG = 64
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20_240_601)
_BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_PLACE = _RANDOM.integers(0, 1 << 63, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts that lie end to end begin and end."""
    solid = ~_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(solid & (~np.append(False, solid[:-1]) | edge[:-1]))
    return starts, np.flatnonzero(solid & (~np.append(solid[1:], False) | edge[1:])) + 1


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    length = ends - starts
    short = np.minimum(length, LONG)
    upto = np.append(0, np.cumsum(short))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + PORTION, "right")) - 1)
        n, first = short[at:to], upto[at:to] - upto[at]
        place = np.arange(int(upto[to] - upto[at])) - np.repeat(first, n)
        out[at:to] = np.add.reduceat(_BYTE[data[place + np.repeat(starts[at:to], n)]] * _PLACE[place], first)
        at = to
    for k in np.flatnonzero(length > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes().translate(_LOWER))
    return _mixed(out + length.astype(np.uint64))


def _sets(data: np.ndarray, bounds: np.ndarray, words: int) -> list[np.ndarray]:
    if not len(data):
        return [np.zeros(0, np.uint64)] * (len(bounds) - 1)
    starts, ends = _words(data, bounds)
    own = _hashed(data, starts, ends)
    rolled = own[: max(0, len(own) - words + 1)]
    for k in range(1, words):
        rolled = _mixed(rolled) * _ODD + own[k : k + len(rolled)]
    rolled = _mixed(rolled)
    found, first = [], np.searchsorted(starts, bounds)
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a >= words:
            found.append(np.unique(rolled[a : z - words + 1]))
        else:  # shorter sequences are kept apart from shingles by their own seed
            found.append(np.array([xxhash.xxh3_64_intdigest(own[a:z].tobytes(), seed=z - a)] if z > a else [], np.uint64))
    return found


def _portions(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of some texts, end to end, and where each begins."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, raw = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PORTION, "right")) - 1)
        yield data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def texts_hashed(column: pa.Array, letters: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For portions of the texts: how many, and for each word its text's place in the portion and the 64-bit hash of its first letters."""
    for data, bounds in _portions(column):
        if not len(data):
            yield len(bounds) - 1, np.zeros(0, np.int64), np.zeros(0, np.uint64)
            continue
        starts, ends = _words(data, bounds)
        letter = (data & 0xC0) != 0x80  # all bytes but those that go on with a letter
        places = np.append(np.flatnonzero(letter), [len(data)] * letters)
        cut = places[np.cumsum(letter)[starts] - 1 + letters]
        yield len(bounds) - 1, np.searchsorted(bounds, starts, "right") - 1, _hashed(data, starts, np.minimum(ends, cut))


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the ascending distinct 64-bit hashes of its shingles: runs of so many words, or the whole of a shorter text.

    Words are parted by space and the controls 9 to 13; A-Z count as a-z. Null, empty and blank texts have none.
    """
    for data, bounds in _portions(column):
        yield from _sets(data, bounds, words)
