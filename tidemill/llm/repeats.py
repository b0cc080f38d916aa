"""Suffixes and repeats of byte strings, in numpy: two-stage sorting, common prefixes, anchors."""

from __future__ import annotations

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-byte gram, by doubling; k a sum of powers of two."""
    level, size, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    power = _B
    n = len(data) - k + 1
    while True:
        if k & size:
            part = level[done : done + n]
            out = part.copy() if out is None else out * power + part
            done += size
        if size << 1 > k:
            break
        level = level[:-size] * power + level[size:]
        power = np.uint64(int(power) ** 2 % (1 << 64))
        size <<= 1
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


#: Low bits of a packed (hash, place) number; texts are cut into blocks of fewer places.
_PLACE = 22


def window_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """The place of the least of every w consecutive values, by doubling.

    Values count by their upper bits; of equal ones the first place wins.
    """
    low = np.uint64((1 << _PLACE) - 1)
    packed, size = (values & ~low) | np.arange(len(values), dtype=np.uint64), 1
    while size * 2 <= w:
        packed = np.minimum(packed[:-size], packed[size:])
        size *= 2
    if size < w:
        packed = np.minimum(packed[: len(packed) - (w - size)], packed[w - size :])
    return (packed & low).astype(np.int64)


def segments(data: np.ndarray, length: int, k: int, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, start, count, offset): runs of window starts whose windows have the same least gram.

    data holds texts one after another, which end at `ends`; windows do not cross them.
    Equal windows of `length` bytes have equal anchors (the hash of that gram) wherever they
    stand, and two equal windows are never in one run, for each has the gram at the same
    place within. Every start of a whole window is in exactly one run; offset is the gram's
    place from the run's start.
    """
    if len(data) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = gram_hashes(data, k)
    at = window_argmin(hashes, length - k + 1)
    n = len(at)
    new = np.append(True, at[1:] != at[:-1])
    # starts too near the end of their text are in no run
    for e in ends.tolist():
        lo = max(0, e - length + 1)
        if lo < n:
            at[lo : min(e, n)] = -1
            new[lo] = True
        if e < n:
            new[e] = True
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, n))
    whole = at[start] >= 0
    start, count = start[whole], count[whole]
    return hashes[at[start]], start, count, at[start] - start


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the one that begins a place later.

    Runs of one symbol take the answer of the place where the run ends; the last suffix is
    larger than the empty one that follows it.
    """
    n = len(text)
    up = np.zeros(n, bool)
    if n > 1:
        up[:-1] = text[:-1] < text[1:]
        ends = np.append(np.flatnonzero(text[:-1] != text[1:]), n - 1)
        up = up[ends[np.searchsorted(ends, np.arange(n))]]
    return up


def _words(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number in byte order."""
    out = padded.astype(np.uint64)
    for size in (1, 2, 4):
        out[:-size] = out[:-size] << np.uint64(8 * size) | out[size:]
    return out


#: Symbols that a group of ties steps over at once while it stays whole.
_STRIDE = 64


def _sort_directly(padded: np.ndarray, words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes `at` in order of their first `depth` symbols; equal ones in text order.

    Suffixes equal to the depth (by hash; the prefix comparison that follows is exact) are
    sorted as one. Groups of ties each keep their own depth: a group whose next symbols are
    all equal steps over them, 64 or 8 at once, and only groups that part are sorted, by
    their next 8 symbols.
    """
    if not len(at):
        return at
    _, one, same = np.unique(gram_hashes(padded, depth)[at], return_index=True, return_inverse=True)
    strides = gram_hashes(padded, _STRIDE)
    key = words[at[one]]
    order = np.argsort(key, kind="stable")
    todo, group, deep = _ties(np.arange(len(one)), key[order], np.zeros(len(one), np.int64), np.full(len(one), 8))
    while len(todo):
        place = at[one[order[todo]]] + deep
        whole = _whole(strides[place], group)
        deep = deep + np.where(whole, _STRIDE, 0)
        rest = np.flatnonzero(~whole)
        key = words[place[rest]]
        apart = rest[~_whole(key, group[rest])]
        if len(apart):
            slots = todo[apart]
            by = np.lexsort((words[place[apart]], group[apart]))
            order[slots] = order[slots[by]]
            key = words[place[apart]][by]
            new = np.append(True, (key[1:] != key[:-1]) | (np.diff(group[apart]) != 0))
            # a parted group's ties are groups of their own, numbered within it
            split = np.zeros(len(todo), np.int64)
            split[apart] = np.cumsum(new)
        else:
            split = np.zeros(len(todo), np.int64)
        deep[rest] += 8
        todo, group, deep = _ties(todo, split, group, deep)
    rank = np.empty(len(one), np.int64)
    rank[order] = np.arange(len(one))
    return at[np.argsort(rank[same], kind="stable")]


def _ties(slots: np.ndarray, key: np.ndarray, group: np.ndarray, deep: np.ndarray) -> tuple[np.ndarray, ...]:
    """What is not alone of rows sorted by (group, key), with its new group numbers."""
    new = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
    more = ~(new & np.append(new[1:], True))
    return slots[more], np.cumsum(new)[more], deep[more]


def _whole(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each row, whether its (contiguous) group has only one key."""
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(group)))
    return np.repeat(np.logical_and.reduceat(key == np.repeat(key[start], size), start), size) if len(group) else np.empty(0, bool)


def two_stage_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of uint8 text, exact to `depth` symbols (deeper ties in any order).

    Stage one sorts only suffixes smaller than their successors. Stage two scans the buckets
    of first symbols upwards: a bucket's front holds the larger-than-next suffixes that
    earlier buckets, and then the bucket itself, have induced; its rear holds the sorted
    ones; and the whole bucket induces the suffixes before its own into later buckets. Each
    suffix is moved once, in numpy, bucket by bucket.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(2 * depth + 2 * _STRIDE, np.uint8)])
    up = smaller_than_next(text)
    direct = _sort_directly(padded, _words(padded), np.flatnonzero(up), depth)
    first = text[direct]
    cut = np.searchsorted(first, np.arange(257))
    fronts: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:  # the empty suffix comes first of all and induces the last one
        fronts[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        grown = fronts[c]
        now = np.concatenate(grown) if grown else np.empty(0, np.int64)
        front = [now]
        while len(now):  # runs of c: each step goes one place to the left
            before = now[now > 0] - 1
            now = before[(text[before] == c) & ~up[before]]
            front.append(now)
        bucket = np.concatenate([*front, direct[cut[c] : cut[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        symbol = text[before]
        later = (symbol > c) & ~up[before]
        before, symbol = before[later], symbol[later]
        by = np.argsort(symbol, kind="stable")
        before, symbol = before[by], symbol[by]
        for s, e in zip(*_runs(symbol)):
            fronts[symbol[s]].append(before[s:e])
        fronts[c] = []
    return np.concatenate(out)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return start, np.append(start[1:], len(x)) if len(x) else start


def common_prefix_at_least(text: np.ndarray, suffixes: np.ndarray, length: int) -> np.ndarray:
    """For each adjacent pair of sorted suffixes, whether their common prefix is `length` or more.

    Pairs whose hashes differ leave at once; the others are compared in full, eight bytes at
    a time, for all pairs together.
    """
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)])
    words, hashes = _words(padded), gram_hashes(padded, length)
    a, b = suffixes[:-1], suffixes[1:]
    same = (hashes[a] == hashes[b]) & (np.maximum(a, b) + length <= len(text))
    left = np.flatnonzero(same)
    for d in range(0, length, 8):
        unused = np.uint64(64 - 8 * min(8, length - d))
        differ = ((words[a[left] + d] ^ words[b[left] + d]) >> unused) != 0
        same[left[differ]] = False
        left = left[~differ]
    return same
