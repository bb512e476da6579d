import re

import pytest

from lakemill.llm import decontaminate as D
from tests.llm.corpus import SCHEMA, documents, lower, sha


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = {}
    for doc_id, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out[doc_id] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def run(spark, docs, items, **kw):
    df = D.decontaminate(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), **kw)
    return {r.doc_id: (r.n_words, sum(r.hit_words), len(r.hit_items), D.digest(r.hit_items), r.contaminated) for r in df.collect()}


ITEMS = [(k, documents()[k][1]) for k in (0, 3, 60, 61, 84, 97)] + [(100, "w1 W2"), (101, "the"), (102, None), (103, "..."), (9, "one two three"), (9, "one two three")]


@pytest.mark.parametrize("chars", [8_000_000, 700])
def test_against_brute_force(spark, chars):
    docs = documents()
    assert run(spark, docs, ITEMS, shard_chars=chars) == brute(docs, ITEMS)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == {}
    docs = documents()[:3]
    assert run(spark, docs, []) == brute(docs, [])


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, n_words long, hit_items string")
    got = D.decontaminate(df, spark.createDataFrame([(1, "a b", 3)], "item_id long, text string, n_words int")).collect()
    assert [(r.n_words, r.hit_items) for r in got] == [(2, ["1"])]


def test_shards_stage_places_only(spark, monkeypatch):
    """Beyond one shard only documents that the sieve passes are staged, once;
    what each pass stages are rows, places and items."""
    staged = []
    monkeypatch.setattr(D, "stage", lambda df, label, own=D.stage: staged.append((label, df.columns, own(df, label))) or staged[-1][2])
    monkeypatch.setattr(D, "discard", lambda *dfs: None)
    docs, items = documents(), ITEMS[:6]
    df = spark.createDataFrame([(*d, "own", "own too") for d in docs], SCHEMA + ", places string, items string")
    out = D.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), shard_chars=sum(len(t) for _, t in items) // 5 + 1)
    got = {r.doc_id: (r.n_words, sum(r.hit_words), len(r.hit_items), D.digest(r.hit_items), r.contaminated) for r in out.collect()}
    assert got == brute(docs, items)
    assert out.where("places = 'own' AND items = 'own too'").count() == len(docs)
    hits = [x for x in staged if x[0] == "hits"]
    assert len(hits) == 5 and all(x[1] == ["row", "places", "items"] for x in hits)
    suspects = next(x[2] for x in staged if x[0] == "suspects").count()
    assert sum(g[-1] for g in got.values()) <= suspects < len(docs) / 2


def test_very_long_text(spark):
    import random

    rnd = random.Random(4)
    long = " ".join(f"w{rnd.randrange(900)}" for _ in range(200_000))
    item = " ".join(long.split()[150_000:150_012])
    assert run(spark, [(1, long, "en", "a", 0), (1, long, "en", "a", 0)], [(7, item)])[1][:3] == (200_000, 12, 1)
