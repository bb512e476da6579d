import pytest

from lakemill.llm import substring_dedup as D
from tests.llm.corpus import SCHEMA, documents, space_words


def brute(docs, width=13):
    owner = {}
    for d in docs:
        w = space_words(d[1])
        for k in range(len(w) - width + 1):
            t = tuple(w[k : k + width])
            owner[t] = min(owner.get(t, d[0]), d[0])
    out = {}
    for d in docs:
        w = space_words(d[1])
        gone = set()
        for k in range(len(w) - width + 1):
            if owner[tuple(w[k : k + width])] < d[0]:
                gone |= set(range(k, k + width))
        out[d[0]] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def run(df, **kw):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in D.dedup(df, **kw).collect()}


@pytest.mark.parametrize("signs", [500_000, 20])
def test_against_brute_force(spark, signs):
    docs = documents()
    want = brute(docs)
    assert sum(v[1] for v in want.values()) > 500
    assert run(spark.createDataFrame(docs, SCHEMA).repartition(3), automaton_signs=signs) == want


def test_on_table(spark):
    from tests.conftest import MID

    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string, gram int, owner int, doc string"
    assert run(spark.createDataFrame([], schema)) == {}
    text = " ".join(f"v{k}" for k in range(13))
    got = D.dedup(spark.createDataFrame([(None, text, 1, 1, "x"), (4, text, 1, 1, "x"), (4, text, 1, 1, "x")], schema)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 13), (4, 0), (4, 0)]


def test_the_automata_locate(spark, monkeypatch):
    """Without occurrences from the automata nothing is removed; copies of a
    shard's automata change nothing."""
    docs = documents()
    df = spark.createDataFrame(docs, SCHEMA)
    monkeypatch.setattr(D, "STREAMED", 3)
    assert run(df.repartition(2), automaton_signs=2_000) == brute(docs)
    owned = [(4, "a b c\nb c d e"), (2, "x y"), (9, "x y")]
    for limit in (1, 100):
        held = D.Automata(owned, limit)
        words = next(D.pieces(__import__("pyarrow").array(["q a b c d e x y"]))).word_hashes()
        assert set(held.locate(words)) >= {(1, 4, 4), (2, 6, 4), (6, 8, 2)}


def test_very_long_text(spark):
    """A text of some MB that shares one passage, and one that is its copy."""
    import random

    rnd = random.Random(2)
    long = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(150_000))
    part = " ".join(long.split()[70_000:70_040])
    docs = [(1, long), (2, f"before {part} after"), (3, long)]
    got = run(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got[1][1] == 0 and got[2] == (42, 40, "before after") and got[3] == (150_000, 150_000, "")
