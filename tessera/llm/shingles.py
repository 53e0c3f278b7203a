"""Distinct word shingles of whole texts as 64-bit hashes, computed on Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # not loaded by pyarrow itself: pa.compute fails in a fresh worker

#: Bytes of text hashed at once; a longer text is a block of its own.
BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_rng = np.random.default_rng(20240117)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15
_STEP = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(21, (n - 1).bit_length())
    if size in _powers:
        return _powers[size]
    steps = [np.full(size, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    for s in steps:
        s[0] = 1
        np.cumprod(s, out=s)
    if size == 1 << 21:  # tables for longer blocks are rare and not kept
        _powers[size] = tuple(steps)
    return tuple(steps)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) ^ (h >> np.uint64(32))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; a null text is empty."""
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        yield at, end
        at = end


def stretches(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of a long text that end at white space, of BLOCK bytes or so; a longer word is in one range."""
    at, n = 0, len(raw)
    while at < n:
        end = min(at + BLOCK, n)
        while end < n:
            spaces = np.flatnonzero(_SPACE[raw[max(at, end - 4096) : end]])
            if len(spaces):
                end = max(at, end - 4096) + int(spaces[-1]) + 1
                break
            end = min(end + 4096, n)
        yield at, end
        at = end


def hashed_words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of texts that lie between ends."""
    n = len(raw)
    space = np.ones(n + 1, bool)
    space[:n] = _SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    before = np.concatenate([[True], space[:-1]]) | edge
    starts = np.flatnonzero(~space & before)
    after = space[1:] | edge[1:]
    stops = np.flatnonzero(~space[:n] & after) + 1
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[raw] * power[:n], out=total[1:])
    return starts, mixed((total[stops] - total[starts]) * inverse[starts])


def shingle_sets(column: pa.Array, words: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles: A-Z as a-z, words are runs without ASCII white space.
    A text of fewer words has one hash, its whole sequence; one without words has none."""
    data, offsets = text_buffers(column)
    for a, b in blocks(offsets):
        raw, ends = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if b - a == 1 and len(raw) > BLOCK:
            word = np.concatenate([hashed_words(raw[i:j], np.array([0, j - i]))[1] for i, j in stretches(raw)])
            bound = np.array([0, len(word)])
        else:
            starts, word = hashed_words(raw, ends)
            bound = np.searchsorted(starts, ends)
        run = np.zeros(max(0, len(word) - words + 1), np.uint64)
        for k in range(words):
            run += word[k : k + len(run)] * _STEP[k]
        run = mixed(run)
        for i, j in zip(bound[:-1].tolist(), bound[1:].tolist()):
            if j - i >= words:
                found = np.sort(run[i : j - words + 1])
                yield found[np.concatenate([[True], found[1:] != found[:-1]])]
            elif j > i:
                yield mixed((word[i:j] * _STEP[: j - i]).sum(dtype=np.uint64, keepdims=True) + np.uint64(j - i))
            else:
                yield run[:0]
