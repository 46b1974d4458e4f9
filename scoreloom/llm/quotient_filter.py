"""A counting quotient filter over 64-bit fingerprints, as numpy arrays.

The high bits of a fingerprint (its quotient) name a home slot, the low bits (its remainder) are
stored. Remainders of one quotient form a sorted run; runs are shifted right by linear probing.
`occupied` marks quotients that have a run, `runend` the last slot of each run, `counter` the slots
that hold a digit of the count of the remainder before them. Remainders are kept whole, so the
filter of a segment gives back its fingerprints and counts without loss, and two filters merge by
walking their sorted remainders.
"""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<BBBxqq")


def _width(bits: int) -> int:
    return next(w for w in (8, 16, 32, 64) if bits <= w)


def build(prints: np.ndarray, counts: np.ndarray, segment_bits: int) -> bytes:
    """prints: ascending distinct uint64 of one segment (equal top segment_bits); counts: their positive counts."""
    n = len(prints)
    q = min(max(1, int(n * 20 // 19).bit_length()), 64 - segment_bits)
    r = 64 - segment_bits - q
    width = _width(r)
    kind = np.dtype(f"<u{width // 8}")
    home = ((prints >> np.uint64(r)) & np.uint64((1 << q) - 1)).astype(np.int64) if r < 64 else np.zeros(n, np.int64)
    rest = prints & np.uint64((1 << r) - 1)
    more = counts.astype(np.uint64) - np.uint64(1)
    digits = np.zeros(n, np.int64)
    left = more.copy()
    while left.any():
        digits += left > 0
        left = left >> np.uint64(width) if width < 64 else np.zeros_like(left)
    of = np.repeat(np.arange(n), digits + 1)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(digits + 1) - digits - 1, digits + 1)
    step = np.arange(len(of))
    at = np.maximum.accumulate(home[of] - step) + step if n else step
    size = max(1 << q, int(at[-1]) + 1 if n else 0)
    slots, counter, runend = np.zeros(size, kind), np.zeros(size, bool), np.zeros(size, bool)
    shift = (np.maximum(nth - 1, 0) * width).astype(np.uint64)
    digit = np.where(shift < 64, more[of] >> np.minimum(shift, np.uint64(63)), np.uint64(0))
    slots[at] = np.where(nth == 0, rest[of], digit & np.uint64((1 << width) - 1)).astype(kind)
    counter[at] = nth > 0
    if n:
        runend[at[np.append(home[of][1:] != home[of][:-1], True)]] = True
    occupied = np.zeros(1 << q, bool)
    occupied[home] = True
    return HEAD.pack(segment_bits, q, width, size, n) + b"".join(np.packbits(x).tobytes() for x in (occupied, runend, counter)) + slots.tobytes()


def read(blob: bytes, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """The ascending fingerprints and their counts."""
    segment_bits, q, width, size, n = HEAD.unpack_from(blob)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = HEAD.size

    def bits(count: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(blob, np.uint8, (count + 7) // 8, at)
        at += len(part)
        return np.unpackbits(part, count=count).astype(bool)

    occupied, runend, counter = bits(1 << q), bits(size), bits(size)
    slots = np.frombuffer(blob, np.dtype(f"<u{width // 8}"), size, at)
    quotient, end = np.flatnonzero(occupied), np.flatnonzero(runend)
    start = np.maximum(quotient, np.append(-1, end[:-1]) + 1)
    length = end - start + 1
    run = np.repeat(np.arange(len(end)), length)
    where = start[run] + np.arange(len(run)) - np.repeat(np.cumsum(length) - length, length)
    first = ~counter[where]
    item = np.cumsum(first) - 1
    r = 64 - segment_bits - q
    prints = (np.uint64(segment) << np.uint64(64 - segment_bits) if segment_bits else np.uint64(0)) | (quotient[run[first]].astype(np.uint64) << np.uint64(r)) | slots[where[first]].astype(np.uint64)
    counts = np.ones(len(prints), np.int64)
    nth = np.arange(len(where)) - np.flatnonzero(first)[item] - 1
    low = counter[where]
    np.add.at(counts, item[low], slots[where[low]].astype(np.int64) << (nth[low] * width))
    return prints, counts


def count(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(prints, return_counts=True)


def merge(blobs: list[bytes], segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and summed counts of filters of one segment, pair by pair in sorted order."""
    parts = [read(x, segment) for x in blobs]
    while len(parts) > 1:
        parts = [_merged(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else read(HEAD.pack(0, 1, 8, 0, 0), 0)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    prints = np.concatenate([a[0], b[0]])
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], np.concatenate([a[1], b[1]])[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.zeros(0, np.int64)
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts
