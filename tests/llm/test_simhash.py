import random

import numpy as np
import pytest
import xxhash

from lakemill.llm import simhash as S
from tests.llm.corpus import SCHEMA, documents, lower, space_words


def fingerprint(text):
    w = space_words(lower(text))
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(ids, fps, radius=2):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in zip(ids, fps):
        for b, y in zip(ids, fps):
            if a < b and bin(x ^ y).count("1") <= radius:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_against_brute_force(spark):
    docs = documents()
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in S.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()}
    fps = {d[0]: fingerprint(d[1]) for d in docs}
    want = classes(list(fps), list(fps.values()))
    assert got == {d: (fps[d], want[d]) for d in fps}


@pytest.mark.parametrize("chunk", [4096, 40, 8])
def test_links_of_dense_fingerprints(spark, chunk):
    """Random walks of bit flips: long chains and hot buckets."""
    rnd = random.Random(chunk)
    fps = {0, 2**64 - 1}
    for _ in range(6):
        x = rnd.getrandbits(64)
        for _ in range(60):
            x ^= 1 << rnd.randrange(64) if rnd.random() < 0.5 else 1 << rnd.randrange(12)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = S.stage(S.links(df, chunk=chunk), "test")
    got = {r.node: r.root for r in S.components(links).collect()}
    assert got == {r.node: r.root for r in S.components(links, one_task=0).collect()}
    want = classes(list(range(len(fps))), fps)
    group = {}
    for i, x in enumerate(signed):
        group.setdefault(want[i], set()).add(x)
    have = {}
    for x in signed:
        have.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, group.values())) == sorted(map(sorted, have.values()))
    assert all(root == min(g) for root, g in have.items())


def test_bit_sliced_distance():
    rnd = np.random.default_rng(1)
    fps = np.sort(rnd.integers(0, 40, 300).astype(np.uint64))
    root = S.unit_links(fps, np.zeros(300, dtype=int), list(range(64)), tile=64)
    while not (root[root] == root).all():
        root = root[root]
    want = classes(list(range(300)), [int(x) for x in fps])
    assert root.tolist() == [want[i] for i in range(300)]


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
