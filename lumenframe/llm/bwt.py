"""Common prefixes of all suffixes of some short contents, derived from their Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

#: Bytes of a suffix that are compared as one number, where the expansion of intervals begins.
PACKED = 8


def joined(contents: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contents with a 0 after each (bytes are raised by one; UTF-8 has none above 0xF4), and where each 0 is."""
    stops = ends + np.arange(len(ends))
    text = np.zeros(len(contents) + len(ends), np.uint8)
    real = np.ones(len(text), bool)
    real[stops] = False
    text[real] = np.frombuffer(contents, np.uint8) + 1
    return text, stops


def suffix_order(text: np.ndarray, stops: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in the order of their first ``depth`` bytes; a suffix ends with its content. Also their first bytes as numbers, in that order."""
    n = len(text)
    stop = np.repeat(stops, np.diff(stops, prepend=-1))
    here, left = np.arange(n), stop - np.arange(n)
    padded = np.concatenate([text, np.zeros(PACKED, np.uint8)])
    packed = np.zeros(n, np.uint64)
    for k in range(PACKED):
        packed |= padded[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
    short = left < PACKED
    gone = (8 * (PACKED - left[short])).clip(0, 63).astype(np.uint64)
    packed[short] = np.where(left[short] == 0, np.uint64(0), packed[short] >> gone << gone)
    order = np.argsort(packed)
    key = packed[order]
    opens = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    width = PACKED
    while width < depth:
        group = np.maximum.accumulate(np.where(opens, here, 0))
        rank[order] = group
        shift = min(width, depth - width)
        # only suffixes that are equal so far are ordered again, by what follows
        tied = np.flatnonzero(~(opens & np.concatenate([opens[1:], [True]])))
        some = order[tied]
        after = rank[np.minimum(some + shift, stop[some])]
        pair = group[tied] * n + after
        again = np.argsort(pair)
        order[tied], pair = some[again], pair[again]
        opens[tied[1:]] |= (pair[1:] != pair[:-1]) & (np.diff(tied) == 1)
        width += shift
    return order, packed[order]


def common_prefixes(text: np.ndarray, order: np.ndarray, packed: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in order, what it shares with the one before, if that is ``PACKED`` to ``depth - 1`` bytes; less where it is less, ``depth`` where it is as much or more.

    Breadth first: an interval of suffixes that start with w is extended backward to those that start
    with cw, for every c before it. The ends of an interval of length l that no shorter one had are where
    l - 1 bytes are shared; only intervals that find such an end are extended further, and none beyond
    ``depth``.
    """
    n = len(text)
    before = text[order - 1]  # the transform; a content's first byte has a 0 before it
    to = np.empty(n, np.int64)
    to[np.argsort(before, kind="stable")] = np.arange(n)
    shared = np.full(n + 1, depth, np.int16)
    shared[0] = shared[n] = 0
    opens = np.flatnonzero(packed[1:] != packed[:-1]) + 1
    shared[opens] = 0
    low = np.concatenate([[0], opens])
    high = np.concatenate([opens, [n]])
    whole = (packed[low] & np.uint64(0xFF)) > 0  # of PACKED real bytes
    low, high = low[whole], high[whole]
    for length in range(PACKED + 1, depth + 1):
        size = high - low
        one = low[size == 1]
        one = to[one[before[one] > 0]]
        many, size = low[size > 1], size[size > 1]
        row = np.repeat(many - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        owner = np.repeat(np.arange(len(many)), size)
        real = before[row] > 0
        row, owner = row[real], owner[real]
        place = to[row]
        by = np.argsort(place)
        place, owner, char = place[by], owner[by], before[row[by]]
        new = np.ones(len(place), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (char[1:] != char[:-1])
        first = np.flatnonzero(new)
        low = np.concatenate([one, place[first]])
        high = np.concatenate([one + 1, place[np.append(first[1:], len(place)) - 1] + 1 if len(first) else first])
        fresh = (shared[low] == depth) | (shared[high] == depth)
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
        for ends in (low, high):
            shared[ends[shared[ends] == depth]] = length - 1
    return shared[:n]


def classes(contents: bytes, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the start of each class that shares ``depth`` bytes; suffixes as byte offsets in the contents, -1 for those of fewer bytes."""
    text, stops = joined(contents, ends)
    order, packed = suffix_order(text, stops, depth)
    shared = common_prefixes(text, order, packed, depth)
    stop = np.repeat(stops, np.diff(stops, prepend=-1))
    number = np.repeat(np.arange(len(stops)), np.diff(stops, prepend=-1))
    offset = np.where(stop - np.arange(len(text)) >= depth, np.arange(len(text)) - number, -1)
    return offset[order], np.flatnonzero(shared < depth)
