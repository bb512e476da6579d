import hashlib

import pytest

from lakemill.llm import mix as M
from tests.llm.corpus import SCHEMA, documents, space_words


def water(sizes):
    """source -> target by repeated resharing."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: M.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), {}, list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            open_.remove(s)
        left = sum(sizes.values()) - sum(target.values())
    return target


def draw(doc_id, k):
    digest = hashlib.sha256(f"{'null' if doc_id is None else doc_id}:{k // 8}".encode()).hexdigest()
    return int(digest[8 * (k % 8) : 8 * (k % 8) + 8], 16) / 2**32


def brute(rows):
    """(doc_id, source, size) to doc_id -> copies."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    target = water(sizes)
    out = {}
    for s, total in sizes.items():
        own = [(i, n) for i, x, n in rows if x == s]
        rate = target[s] / total if total else 0.0
        part = rate - int(rate)
        off = [abs(sum(n for i, n in own if draw(i, k) < part) - part * total) for k in range(M.SEEDS)]
        k = off.index(min(off))
        out |= {i: int(rate) + (draw(i, k) < part) for i, _ in own}
    return out


def test_against_brute_force(spark):
    docs = documents()
    rows = M.mix(spark.createDataFrame(docs, SCHEMA)).collect()
    sized = [(d[0], d[3], len(space_words(d[1]))) for d in docs]
    want = brute(sized)
    assert {r.doc_id: r.copies for r in rows} == want
    totals = {}
    for _, s, n in sized:
        totals[s] = totals.get(s, 0) + n
    target = water(totals)
    for r in rows:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 3
    assert sum(target.values()) == pytest.approx(sum(totals.values()))


def test_caps(spark):
    """One tiny source with the largest weight, one without words."""
    rows = [(k, "a b c", "a") for k in range(2)] + [(10 + k, "x " * 50, "b") for k in range(20)] + [(99, "", "c"), (100, None, None)]
    clash = [(*r, "long", 7) for r in rows]
    got = M.mix(spark.createDataFrame(clash, "doc_id long, text string, source string, size string, target int")).collect()
    by = {r.source: r.target for r in got}
    assert by["a"] == 18.0 and by["b"] == 1006 - 18 and by["c"] == 0 and by[None] == 0
    assert {r.copies for r in got if r.source == "a"} == {3}


def test_empty(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA)).collect() == []
