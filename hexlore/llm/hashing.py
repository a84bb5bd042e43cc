"""64-bit hashes of many runs of bytes at once, by rounds of eight bytes over all runs that are left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Runs of more bytes are hashed one by one.
LONG_RUN = 64
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(octets: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as numbers; zeros follow the last byte."""
    padded = octets.tobytes() + bytes(8)
    return np.ndarray((len(octets),), np.dtype("<u8"), padded, 0, (1,))


def cut_mask(rest: np.ndarray) -> np.ndarray:
    """Masks of the bytes that count of eight where rest are left (all of them from eight on)."""
    return _MASKS[np.minimum(rest, 8)]


_MASKS = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)


def hash_runs(octets: np.ndarray, first: np.ndarray, last: np.ndarray, view: np.ndarray | None = None) -> np.ndarray:
    """The hash of octets[first:last] for each run, a function of the run's bytes and their number alone.

    Eight bytes at a time are mixed into the state by steps that can be undone, so runs of up to eight bytes and of one
    length never collide, and longer ones do as random numbers would: no sums that patterns could cancel. view is
    windows(octets), where the caller has it.
    """
    size = last - first
    state = mix64(size.astype(np.uint64) * ODD + np.uint64(1))
    view = windows(octets) if view is None else view
    left = np.flatnonzero((size > 0) & (size <= LONG_RUN))
    at = 0
    while len(left):
        rest = size[left] - at
        part = view[first[left] + at] & cut_mask(rest)
        state[left] = mix64((state[left] ^ part) * ODD)
        left, at = left[rest > 8], at + 8
    for k in np.flatnonzero(size > LONG_RUN).tolist():
        state[k] = xxhash.xxh3_64_intdigest(octets[first[k] : last[k]].tobytes())
    return state


def slices(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of a column of texts, each of most bytes or one longer text, with their places.

    Only slices are turned into Python objects by callers, so what these take follows most and the longest text.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, done = 0, 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, column.slice(at, upto - at)
        at, done = upto, int(ends[upto - 1])
