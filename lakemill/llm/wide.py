"""Wide SimHashes of sets of hashes, and their bit-sliced comparison.

A fingerprint has PLANES bits. Each is set where over half of the set's members
have it set in their own PLANES bits, eight words mixed from the member's hash.
Two sets with a Jaccard similarity of 0.8 differ in each bit by itself, with a
chance of at most 0.1875 (four members and the same with a fifth; some 0.15 for
large sets). Over RADIUS bits differ in such a pair with a chance below 1e-15,
below 1e-21 from 20 members on: less than equal 64-bit hashes of different
members have. The bits of unrelated sets differ in 256 places, give or take 11.

Fingerprints of a bucket are held as vertical bit planes. A plane of many pairs
at once, eight to a byte, is one XOR, and carry-save counters add the planes up.
A block of pairs is left as soon as all its distances exceed the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from lakemill.llm.textops import mix

WORDS = 8
PLANES = 64 * WORDS
RADIUS = 178
#: Pairs of a block are left to check from this plane on, at each of so many.
CHECK = 64
#: Rows of a group up to which its pairs are taken by their lag.
BY_LAG = 64
#: Pairs that are compared at once.
TILE = 1 << 16

#: For a byte, its bits as the bytes of a word; sums of up to 255 do not carry.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
_SEEDS = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprints(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For sets of n[k] members each, whose hashes follow one another, rows of
    PLANES / 8 bytes. An empty set has none of the bits."""
    out = np.zeros((len(n), PLANES // 8), dtype=np.uint8)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    size = n[full]
    begin = np.cumsum(size) - size
    cuts = -(-size // 255)  # each row in runs of 255 members
    first = np.cumsum(cuts) - cuts
    run = np.repeat(begin, cuts) + 255 * (np.arange(cuts.sum()) - np.repeat(first, cuts))
    for k in range(WORDS):
        lanes = _LANES[mix(hashes ^ _SEEDS[k]).view(np.uint8).reshape(-1, 8)]
        ones = np.add.reduceat(lanes, run, axis=0).view(np.uint8)
        ones = np.add.reduceat(ones, first, axis=0, dtype=np.int64)
        out[full, 8 * k : 8 * k + 8] = np.packbits(2 * ones > size[:, None], axis=1)
    return out


def _add(levels: list[list[np.ndarray]], x: np.ndarray, at: int = 0) -> None:
    """Adds a plane of weight 2 ** at; a level holds a sum and one more plane at most."""
    while True:
        if at == len(levels):
            levels.append([x])
            return
        if len(levels[at]) == 1:
            levels[at].append(x)
            return
        a, b = levels[at]
        both = a ^ b
        levels[at] = [both ^ x]
        x = (a & b) | (both & x)
        at += 1


def _sums(levels: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The planes of the sums, that of weight 1 first."""
    levels = [list(own) for own in levels]
    at = 0
    while at < len(levels):
        if len(levels[at]) == 2:
            a, b = levels[at]
            levels[at] = [a ^ b]
            _add(levels, a & b, at + 1)
        at += 1
    return [own[0] for own in levels]


def _over(sums: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the sums exceed the radius."""
    over = np.zeros_like(sums[0])
    if radius >> len(sums):
        return over
    equal = ~over
    for at in range(len(sums) - 1, -1, -1):
        if radius >> at & 1:
            equal = equal & sums[at]
        else:
            over |= equal & sums[at]
            equal = equal & ~sums[at]
    return over


def within(plane: Callable[[int], np.ndarray], alive: np.ndarray, count: int, n_planes: int = PLANES, radius: int = RADIUS) -> tuple[np.ndarray, ...]:
    """Of the pairs in `alive`, packed along the last axis of `count`, the places
    of those that differ in at most `radius` of the planes, by axis, and at last
    in how many they do; plane(p) has the pairs that differ in p."""
    levels: list[list[np.ndarray]] = []
    left = alive
    for p in range(n_planes):
        _add(levels, plane(p))
        if p + 1 == n_planes or p >= radius and (p + 1) % CHECK == 0:
            sums = _sums(levels)
            left = alive & ~_over(sums, radius)
            if not left.any():
                break
    at = np.nonzero(np.unpackbits(left, axis=-1, count=count))
    far = np.zeros(len(at[0]), dtype=np.int64)
    for k, own in enumerate(sums if len(far) else ()):
        far += np.unpackbits(own, axis=-1, count=count)[at].astype(np.int64) << k
    return *at, far


def _pairs_by_lag(bits: np.ndarray, group: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, ...]]:
    rows = np.arange(len(group))
    lag = 1
    while True:
        size = np.bincount(group[rows])[group[rows]] if len(rows) else np.zeros(0)
        rows = rows[size > lag]  # groups of fewer have no pair from here on
        if not len(rows):
            return
        own, of, kept = group[rows], root[rows], bits[:, rows]
        for step in range(lag, 2 * lag):
            for lo in range(0, len(rows) - step, TILE):
                hi = min(len(rows), lo + TILE + step)
                valid = (own[lo + step : hi] == own[lo : hi - step]) & (of[lo + step : hi] != of[lo : hi - step])
                if valid.any():
                    i, far = within(lambda p: np.packbits(kept[p, lo + step : hi] ^ kept[p, lo : hi - step]), np.packbits(valid), len(valid), len(bits), radius)  # noqa: B023
                    yield rows[lo + i], rows[lo + i + step], far
        lag *= 2


def _pairs_of_one(bits: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of one group: its largest component is compared with the others only."""
    m = len(root)
    _, of, size = np.unique(root, return_inverse=True, return_counts=True)
    others = np.flatnonzero(of != size.argmax())
    place = np.full(m, -1)
    place[others] = np.arange(len(others))
    packed = np.packbits(bits, axis=1)
    step = max(1, TILE // m)
    for lo in range(0, len(others), step):
        rows = others[lo : lo + step]
        mask = (bits[:, rows] * np.uint8(255))[:, :, None]
        valid = (of[rows][:, None] != of[None, :]) & (place[None, :] < place[rows][:, None])
        i, j, far = within(lambda p: packed[p][None, :] ^ mask[p], np.packbits(valid, axis=1), m, len(bits), radius)  # noqa: B023
        yield rows[i], j, far


def pairs(prints: np.ndarray, group: np.ndarray, root: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, far): indices of the pairs of a group whose roots differ and whose
    fingerprints are within the radius, each pair once, and in how many bits they
    differ. Rows come by group, numbered from 0 on."""
    size = np.bincount(group)[group] if len(group) else np.zeros(0, dtype=np.int64)
    small = np.flatnonzero(size <= BY_LAG)
    for lo in range(0, len(small), 1 << 15):
        # A block ends with a group.
        end = np.searchsorted(group[small], group[small[min(len(small), lo + (1 << 15)) - 1]], side="right")
        begin = np.searchsorted(group[small], group[small[lo]], side="left") if lo == 0 else np.searchsorted(group[small], group[small[lo - 1]], side="right")
        own = small[begin:end]
        if len(own):
            bits = np.unpackbits(prints[own], axis=1).T.copy()
            for i, j, far in _pairs_by_lag(bits, group[own] - group[own[0]], root[own], radius):
                yield own[i], own[j], far
    large = np.flatnonzero(size > BY_LAG)
    for g in np.unique(group[large]):
        own = np.arange(*np.searchsorted(group, [g, g + 1]))
        bits = np.unpackbits(prints[own], axis=1).T.copy()
        for i, j, far in _pairs_of_one(bits, root[own], radius):
            yield own[i], own[j], far


def parities(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sets as above, bytes of all and where each set's begin and the last's
    end. A set of n has the least power of two of bits from n on, 64 at least: a
    bit is the parity of the members that hash to it. So two sets differ in as
    many members as their bits do, at least, also after the longer's halves have
    been put upon each other until lengths are equal."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    begin = np.r_[0, np.cumsum(bits)]
    at = np.repeat(begin[:-1], n) + (mix(hashes ^ np.uint64(0xD6E8FEB86659FD93)) & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=begin[-1]) & 1
    return np.packbits(odd.astype(np.uint8)), begin // 8


def differ(u: tuple[np.ndarray, ...], v: tuple[np.ndarray, ...]) -> np.ndarray:
    """For pairs of such sets in how many members they differ at least; u and v:
    bytes, and where in them each pair's own begin and how many there are."""
    (ub, u_at, u_size), (vb, v_at, v_size) = u, v
    out = np.zeros(len(u_at), dtype=np.int64)
    kind = u_size << 32 | v_size
    for x in np.unique(kind):
        own = np.flatnonzero(kind == x)
        least = min(x >> 32, x & 0xFFFFFFFF)
        a, b = (bits[at[own][:, None] + np.arange(size)].reshape(len(own), -1, least) for bits, at, size in ((ub, u_at, x >> 32), (vb, v_at, x & 0xFFFFFFFF)))
        both = np.bitwise_xor.reduce(a, axis=1) ^ np.bitwise_xor.reduce(b, axis=1)
        out[own] = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
    return out
