"""What leaves the units of the near-duplicate stage, and units of chunks."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline as P
from lakemill.llm import similar as S
from tests.conftest import SMALL
from tests.llm.corpus import prose
from tests.llm.test_similar import survivors


def edited(seed, n, edits, words=300):
    """Texts with a few words of one passage changed: some pairs are 0.8 alike,
    most a little less."""
    rnd = random.Random(seed)
    base = prose(rnd, words).split()
    out = []
    for k in range(n):
        own = list(base)
        for at in rnd.sample(range(words), rnd.choice(edits)):
            own[at] = f"e{k}x{at}"
        out.append(" ".join(own))
    return out


def arrow_rows(spark, after):
    """Rows that each MapInArrow of (u, v, ...) made, by execution, and the last execution."""
    store = spark._jsparkSession.sharedState().statusStore()
    every, made, last = store.executionsList(), [], after
    for k in range(every.size()):
        number = every.apply(k).executionId()
        last = max(last, number)
        if number <= after:
            continue
        nodes, values = store.planGraph(number).allNodes(), store.executionMetrics(number)
        for i in range(nodes.size()):
            node = nodes.apply(i)
            if node.name() == "MapInArrow" and "[u#" in node.desc():
                for j in range(node.metrics().size()):
                    metric = node.metrics().apply(j)
                    value = values.get(metric.accumulatorId())
                    if metric.name() == "number of output rows" and value.isDefined():
                        made.append(int(value.get().replace(",", "")))
    return made, last


def test_rows_do_not_grow_with_the_square_of_a_group(spark):
    """Five times the rows of a group whose pairs are nearly alike."""
    _, last = arrow_rows(spark, -1)
    most = []
    for n in (40, 200):
        texts = edited(11, n, [4])
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = sorted(r.doc_id for r in P.near_duplicate_removal(spark, docs, SMALL).collect())
        assert got == survivors(list(enumerate(texts)))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        made, last = arrow_rows(spark, last)
        most.append(max(made))
    assert most[1] <= 10 * most[0]


def test_chunks_of_keys_and_clusters(spark, monkeypatch):
    """Keys and clusters of several chunks lose no link between chunks."""
    texts = edited(5, 60, [1, 3, 4]) + edited(6, 25, [0, 3], 200) + edited(7, 9, [5], 900)
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    want = survivors(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk, held in ((8, S.HELD), (S.CHUNK, 3000), (4, 500)):
        monkeypatch.setattr(S, "CHUNK", chunk)
        monkeypatch.setattr(S, "HELD", held)
        monkeypatch.setattr(S, "AT_ONCE", held)
        assert sorted(r.doc_id for r in P.near_duplicate_removal(spark, docs, SMALL).collect()) == want


def test_units_over_batches():
    """Units that begin and end anywhere in batches come whole, each once."""
    rnd = np.random.default_rng(1)
    key = np.sort(rnd.integers(0, 30, 500))
    part = np.concatenate([np.sort(rnd.integers(0, 3, n)) for n in np.bincount(key)])
    t = pa.table({"key": key, "part": part, "row": np.arange(500)})
    for size in (1, 7, 100, 500):
        seen = []

        def work(own, unit):
            assert (np.diff(unit) >= 0).all() and unit[0] == 0 and len(unit) == len(own)
            seen.extend(tuple(own.column("row").to_numpy()[unit == x].tolist()) for x in np.unique(unit))  # noqa: B023
            return own.to_batches()[0]

        batches = [pa.RecordBatch.from_arrays([c.chunk(0) for c in t.slice(lo, size).combine_chunks().columns], names=t.column_names) for lo in range(0, 500, size)]
        list(S._by_unit(iter([batches[0].slice(0, 0), *batches]), ("key", "part"), work))
        code = key * 3 + part
        assert seen == [tuple(np.flatnonzero(code == x).tolist()) for x in np.unique(code)]
