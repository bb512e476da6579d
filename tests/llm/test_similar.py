"""The near-duplicate stage against brute-force Jaccard."""

import random

import corpus_pipeline as P
from tests.conftest import MID, SMALL
from tests.llm.corpus import lower, prose, space_words


def shingles(text):
    w = space_words(lower(text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def survivors(rows):
    """Of (id, text) rows the ids that stay: the least of each component."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values())


def test_stage_against_brute_force_jaccard(spark):
    for folder in (SMALL, MID):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        want = survivors([(r.doc_id, r.text) for r in docs.collect()])
        assert sorted(r.doc_id for r in P.near_duplicate_removal(spark, docs, folder).collect()) == want


def test_edits_around_the_bound(spark):
    """Copies with a few words changed, chains of them, short texts and case."""
    rnd = random.Random(3)
    texts = [None, "", " \n", "One two", "one TWO", "one two three four", "one two three four five"]
    for n in (12, 30, 90, 200):
        for _ in range(4):
            words = prose(rnd, n).split()
            for _ in range(8):
                words = [f"x{rnd.randrange(999)}" if rnd.random() < 2 / n else w for w in words]
                texts.append(" ".join(words))
    rows = [(k, t) for k, t in enumerate(texts)]
    rnd.shuffle(rows)
    want = survivors(rows)
    assert len(want) < len(rows) - 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in P.near_duplicate_removal(spark, docs, SMALL).collect()) == want


def test_one_row_of_each_group(spark):
    """Repeated ids and null ids: one row of each group, null ids last."""
    rnd = random.Random(5)
    a, b, c, d = (prose(rnd, 60) for _ in range(4))
    rows = [(1, a), (1, a), (1, b), (2, b), (3, b), (None, a), (None, c), (None, c), (None, d), (9, d), (9, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in P.near_duplicate_removal(spark, docs, SMALL).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (None, c), (9, d)], key=str)
