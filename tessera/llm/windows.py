"""Content-chosen routing of fixed-length byte strings: every string of a given length goes to the group of its least k-gram."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .shingles import _power, blocks, mixed

#: Bytes of the k-gram that names a group.
GRAM = 32
#: Bytes of a long text that are looked at together; ranges overlap by a string less a byte. Positions in a range fit into POSITION bits.
RANGE, POSITION = 1 << 20, 24
_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOW = np.uint64((1 << POSITION) - 1)


class Hashed:
    """Hashes of any range of a block of bytes from two running sums."""

    def __init__(self, raw: np.ndarray) -> None:
        power, self.inverse = _power(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUE[raw] * power[: len(raw)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.total) - k
        return mixed((self.total[k:] - self.total[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def least_positions(grams: np.ndarray, width: int) -> np.ndarray:
    """For each i the position of the least of grams[i : i + width], the leftmost of equal ones (by their upper 40 bits)."""
    n = len(grams) - width + 1
    key = np.full(-(-len(grams) // width) * width, np.uint64(2**64 - 1))
    key[: len(grams)] = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    tiles = key.reshape(-1, width)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _LOW).astype(np.int64)


def ranges(offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, its range's bounds in the data): some whole texts, or a range of one long text. Each string of the given length lies
    in one of them whole, and its start in one only."""
    for a, b in blocks(offsets):
        if b - a > 1 or offsets[b] - offsets[a] <= RANGE + length - 1:
            yield a, offsets[a : b + 1]
            continue
        for at in range(int(offsets[a]), int(offsets[b]) - length + 1, RANGE):
            yield a, np.array([at, min(at + RANGE + length - 1, int(offsets[b]))])


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start, end, anchor, key, hash) arrays, a block at a time: the maximal ranges whose strings of the given length share
    their anchor. Each start of such a string lies in one segment; equal strings have the same key and lie alike around it."""
    for a, bounds in ranges(offsets, length):
        base, ends = bounds[0], bounds - bounds[0]
        raw = data[base : bounds[-1]]
        before = base - offsets[a]  # bytes of a long text before its range
        if len(raw) < length:
            continue
        hashed = Hashed(raw)
        grams = hashed.grams(GRAM)
        least = least_positions(grams, length - GRAM + 1)
        fits = np.zeros(len(raw) + 1, np.int8)
        long_ = np.flatnonzero(np.diff(ends) >= length)
        np.add.at(fits, ends[long_], 1)
        np.add.at(fits, ends[long_ + 1] - length + 1, -1)
        valid = np.cumsum(fits[: len(least)], dtype=np.int8).astype(bool)
        first = np.flatnonzero(valid & np.concatenate([[True], (least[1:] != least[:-1]) | ~valid[:-1]]))
        if not len(first):
            continue
        # A text may start right where the one before ends its last string: cut there too.
        starts = np.union1d(first, ends[long_])
        stop = np.flatnonzero(valid & ~np.concatenate([valid[1:], [False]])) + 1
        bound = np.union1d(starts, stop)
        last = bound[np.searchsorted(bound, starts, "right")]
        text = np.searchsorted(ends, starts, "right") - 1
        anchor = least[starts]
        yield text + a, before + starts - ends[text], before + last - 1 + length - ends[text], anchor - starts, grams[anchor].view(np.int64), hashed.of(starts, last - 1 + length).view(np.int64)
