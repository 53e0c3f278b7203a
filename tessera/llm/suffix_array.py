"""Suffix arrays by grouping suffixes on their Lyndon prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """The suffix array of a sequence of integers; time is linear in its length but for ranking symbols and ordering groups by place.

    Phase one holds the suffixes in groups that share a known prefix and takes the groups from the highest down. Each suffix
    of the group at hand looks, over pointers to smaller ones before it, for the nearest earlier suffix of a lower group:
    that one's prefix goes on with the group's, so it moves to a new group right above its old one - above by as many
    places as suffixes found it. When all groups are done each holds the suffixes with one Lyndon prefix.
    Phase two reads the final order from its start: a suffix in place puts the ones whose Lyndon prefix ends where it starts at the
    head of their groups, again along the pointers. Nothing is renamed and nothing recurses.
    """
    n = len(symbols)
    if not n:
        return []
    _, rank = np.unique(symbols, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    count = np.bincount(rank)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    member, start = order.tolist(), begin[rank].tolist()  # suffixes by group; the first place of a suffix's group
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    size = [0] * n
    for b, c in zip(begin.tolist(), count.tolist()):
        size[b] = c
    before = [-1] * n
    high = n - 1
    while high >= 0:
        low = start[member[high]]
        group = member[low : high + 1]
        times: dict[int, int] = {}
        if len(group) == 1:
            s = group[0]
            p = s - 1
            while p >= 0 and start[p] > low:
                p = before[p]
            before[s] = p
            if p >= 0:
                times[p] = 1
        else:
            group.sort()
            for s in group:
                p = s - 1
                while p >= 0 and start[p] > low:
                    p = before[p]
                if p >= 0 and start[p] == low:
                    p = before[p]
                before[s] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
        if times:
            if len(times) == 1:
                levels = [list(times)]
            else:
                by: dict[int, list[int]] = {}
                for p, t in times.items():
                    by.setdefault(t, []).append(p)
                levels = [by[t] for t in sorted(by, reverse=True)]
            for moved in levels:
                for p in moved:
                    g = start[p]
                    size[g] = k = size[g] - 1
                    last, at = g + k, place[p]
                    other = member[last]
                    member[at], member[last] = other, p
                    place[other], place[p] = at, last
                above = [start[p] + size[start[p]] for p in moved]
                for p, new in zip(moved, above):
                    start[p] = new
                    size[new] += 1
        high = low - 1

    head = {}
    sa = [-1] * n
    done = [False] * n

    def put(j: int) -> None:
        while j >= 0 and not done[j]:
            g = start[j]
            at = head.get(g, g)
            sa[at] = j
            head[g] = at + 1
            done[j] = True
            j = before[j]

    put(n - 1)
    for i in range(n):
        put(sa[i] - 1)
    return sa


#: Bytes of a word when whole strings are compared.
WORD = 32


def equal_groups(raws: list[bytes], most: int = 60_000) -> np.ndarray:
    """A number for each string, alike for equal ones only: strings of one length are compared by suffix arrays over their words of
    WORD bytes, about most words at a time. Equal strings start next to each other in an array, so two neighbours are the same if
    all their words are.

    Strings of one length and one hash of their ends and middle meet in an array; the rest of them is never looked at.
    """
    out = np.arange(len(raws))
    alike: dict[tuple[int, int], list[int]] = {}
    for k, raw in enumerate(raws):
        middle = len(raw) // 2
        alike.setdefault((len(raw), hash((raw[:WORD], raw[middle : middle + WORD], raw[-WORD:]))), []).append(k)
    held, n = [], 0
    for members in alike.values():
        if len(members) < 2:
            continue
        held.append(members)
        n += len(members) * (len(raws[members[0]]) // WORD + 2)
        if n > most:
            _equal_groups(raws, held, out)
            held, n = [], 0
    if held:
        _equal_groups(raws, held, out)
    return out


def _equal_groups(raws: list[bytes], held: list[list[int]], out: np.ndarray) -> None:
    ids = [k for members in held for k in members]
    words = np.array([-(-max(1, len(raws[k])) // WORD) for k in ids])
    block = np.frombuffer(b"".join(raws[k].ljust(w * WORD, b"\0") for k, w in zip(ids, words.tolist())), np.uint64).reshape(-1, WORD // 8)
    order = np.lexsort(block.T)
    rank = np.empty(len(block), np.int64)
    rank[order] = np.cumsum(np.concatenate([[True], (block[order[1:]] != block[order[:-1]]).any(1)]))
    # Each string ends with a symbol of its own below all words.
    start = np.cumsum(words + 1) - words - 1
    symbols = np.empty(int(words.sum()) + len(ids), np.int64)
    ends = start + words
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = rank
    symbols[ends] = -1 - np.arange(len(ids))
    of = np.full(len(symbols), -1)
    of[start] = np.arange(len(ids))
    first = of[np.array(suffix_array(symbols))]
    first = first[first >= 0].tolist()
    leader = first[0]
    for a, b in zip(first, first[1:]):
        w = words[a]
        if w == words[b] and len(raws[ids[a]]) == len(raws[ids[b]]) and (symbols[start[a] : start[a] + w] == symbols[start[b] : start[b] + w]).all():
            out[ids[b]] = out[ids[leader]]
        else:
            leader = b
