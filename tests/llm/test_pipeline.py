"""The pipeline against brute-force versions of its stages."""

from collections import Counter

import corpus_pipeline as P
from lakemill.llm import quality_lines as Q
from tests.conftest import SMALL
from tests.llm import test_decontaminate, test_mix, test_quality_lines, test_similar
from tests.llm.corpus import space_words


def test_stages_against_brute_force(spark):
    read = lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet")
    docs = {r.doc_id: r for r in read("documents").collect()}
    field = Q.train(read("documents"), read("labels"))

    def good(text):
        _, x, n, _ = Q.lines_of((text or "").encode())
        return not test_quality_lines.brute(text)[-1] and Q.share(field, x, n) >= field.least

    kept = {i for i, r in docs.items() if good(r.text)}
    kept = set(test_similar.survivors([(i, docs[i].text) for i in sorted(kept)]))
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    hit = test_decontaminate.brute([(i, docs[i].text) for i in kept], items)
    kept = {i for i in kept if not hit[i][-1]}
    assert 0 < len(kept) < len(docs)
    copies = test_mix.brute([(i, docs[i].source, len(space_words(docs[i].text))) for i in kept])

    rows = P.run(spark, SMALL).collect()
    want = Counter({i: n for i, n in copies.items() if n})
    assert Counter(r.doc_id for r in rows) == want
    for r in rows:
        assert r["size"] == len(docs[r.doc_id].text.encode()) + 8
    by_text = {}
    for r in rows:
        assert by_text.setdefault(docs[r.doc_id].text, r.shard) == r.shard


def test_columns_between_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, step in P.STAGES[:-1]:
        out = step(spark, docs, SMALL)
        assert out.schema.simpleString() == docs.schema.simpleString()


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1")
    kept = {r.doc_id for r in P.quality_rules(spark, docs, SMALL).collect()}
    long = {r.doc_id for r in docs.join(labels, "doc_id").collect() if not test_quality_lines.brute(r.text)[-1]}
    assert len(long & kept) >= 0.98 * len(long)


def test_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, step in P.STAGES:
        assert step(spark, docs, SMALL).collect() == []


def test_awkward_rows_and_clashing_columns(spark):
    """Nulls in every column, repeated rows, and columns that operators use
    themselves: all stages work, and the extra columns come through unchanged."""
    import random

    from tests.llm.corpus import documents, prose

    rnd = random.Random(1)
    rows = [(*d, f"e{d[0]}", d[0], float(d[0]), "x", d[0] % 2 == 0) for d in documents()]
    rows += [(500 + k, prose(rnd, 90) + ".", "en", "b", 5, None, None, None, None, None) for k in range(30)]
    rows += [rows[-1], rows[-1], (None, None, None, None, None, None, None, None, None, None), (None, prose(rnd, 70), None, None, None, "n", 1, 1.0, "y", True)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, Size long, target double, copies string, kept boolean"
    docs = spark.createDataFrame(rows, schema)
    extra = {r[0]: r[5:] for r in rows if r[0] is not None}
    for name, step in P.STAGES[:-1]:
        before = docs
        docs = P.stage(step(spark, docs, SMALL), "test")
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        got = docs.collect()
        assert got and all(tuple(r)[5:] == extra[r.doc_id] for r in got if r.doc_id is not None)
        no_id = sum(r.doc_id is None for r in got)
        if name == "source mixing":  # a draw decides, so the row comes as often as mix() says
            drawn = P.mix(before.drop("n_words", "Size", "target", "copies", "kept")).where("doc_id IS NULL").agg({"copies": "sum"}).first()[0]
            assert no_id == drawn
        else:
            assert no_id > 0
    assert len({r.doc_id for r in got}) > 20
    final = P.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len(final) == len(got)

