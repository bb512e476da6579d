"""Wide SimHashes and parity bits, alone and in the near-duplicate stage."""

import math

import numpy as np

from lakemill.llm import wide


def test_fingerprints_are_majorities():
    rnd = np.random.default_rng(1)
    n = np.array([0, 1, 2, 255, 256, 1000, 0])
    hashes = rnd.integers(0, 2**63, n.sum(), dtype=np.uint64)
    got = wide.fingerprints(hashes, n)
    for k, own in enumerate(np.split(hashes, np.cumsum(n)[:-1])):
        bits = np.concatenate([np.unpackbits(wide.mix(own ^ seed).view(np.uint8).reshape(-1, 8), axis=1) for seed in wide._SEEDS], axis=1)
        assert (np.packbits(2 * bits.sum(axis=0) > len(own)) == got[k]).all()


def test_pairs_against_brute_force():
    rnd = np.random.default_rng(2)
    for most in (1, 5, 40, 1500):
        group = np.unique(np.sort(rnd.integers(0, 3000 // most, 3000)), return_inverse=True)[1]
        some = rnd.integers(0, 256, (20, 64), dtype=np.uint8)
        prints = some[rnd.integers(0, 20, 3000)] ^ np.where(rnd.random((3000, 64)) < 0.3, rnd.integers(0, 256, (3000, 64)), 0).astype(np.uint8)
        root = np.where(rnd.random(3000) < 0.8, 0, rnd.integers(0, 30, 3000))
        got = {(max(p), min(p)): d for i, j, far in wide.pairs(prints, group, root, 120) for *p, d in zip(i.tolist(), j.tolist(), far.tolist())}
        want = {}
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            far = np.bitwise_count(prints[own][:, None] ^ prints[own]).sum(axis=2)
            i, j = np.nonzero(np.tril((far <= 120) & (root[own][:, None] != root[own]), -1))
            want |= dict(zip(zip(own[i].tolist(), own[j].tolist()), far[i, j].tolist()))
        assert got == want


def test_radius_loses_no_pair():
    """The chance that a bit differs, from binomials, for all sets of up to 40
    members that are 0.8 alike, and the chance of over RADIUS such bits."""
    ones = lambda n, k: math.comb(n, k) / 2**n
    chance = 0.0
    for both in range(1, 41):
        for a in range(both // 4 + 1):
            for b in range(a, both // 4 - a + 1):
                p = 0.0
                for k in range(both + 1):
                    x, y = (sum(ones(m, j) for j in range(m + 1) if 2 * (k + j) > both + m) for m in (a, b))
                    p += ones(both, k) * (x * (1 - y) + y * (1 - x))
                chance = max(chance, p)
    assert chance <= 0.1875
    log = lambda k: math.lgamma(wide.PLANES + 1) - math.lgamma(k + 1) - math.lgamma(wide.PLANES - k + 1) + k * math.log(0.1875) + (wide.PLANES - k) * math.log(0.8125)
    assert sum(math.exp(log(k)) for k in range(wide.RADIUS + 1, wide.PLANES + 1)) < 1e-15


def test_parities_tell_long_sets_apart():
    """A fixed number of bits let unrelated sets of 5000 pass as 0.8 alike."""
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**63, 20_000, dtype=np.uint64)
    sets = [base[:5000], base[2000:7000], base[100:5000], base[9000:13_500], base[:300], base[:0], base[:2]]
    n = np.array([len(s) for s in sets])
    data, at = wide.parities(np.concatenate(sets), n)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            far = wide.differ(*((data, at[[k]], np.diff(at)[[k]]) for k in (i, j)))[0]
            both = len(np.intersect1d(x, y))
            assert far <= n[i] + n[j] - 2 * both
            alike = 9 * both >= 4 * (n[i] + n[j])
            assert alike or min(n[i], n[j]) < 4000 or 9 * far > n[i] + n[j]
