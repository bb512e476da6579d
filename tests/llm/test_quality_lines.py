import re
from itertools import product

import numpy as np

from lakemill.llm import quality_lines as Q
from tests.llm.corpus import SCHEMA, documents, prose, space_words


def brute(text):
    w = space_words(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    cover = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if space_words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover), failed


def extra():
    import random

    rnd = random.Random(3)
    junk = [" ".join(x + "***" for x in prose(rnd, 60).split()) for _ in range(12)] + ["Der Der Der " * 30, "a\nb c\na\n\n \nb c\na", "x y z " * 20 + prose(rnd, 200)]
    return [(1000 + k, t, "en", "a", len(t)) for k, t in enumerate(junk)]


def test_counts_against_brute_force(spark):
    docs = documents()[:90] + documents()[-12:-2] + extra()
    labels = spark.createDataFrame([(d[0], int(d[0] < 1000)) for d in docs], "doc_id long, quality int")
    rows = {r.doc_id: r for r in Q.judge(spark.createDataFrame(docs, SCHEMA), labels).collect()}
    for d in docs:
        r = rows[d[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(d[1]), d
        assert not (r.kept and r.base_failed)
        assert len(r.line_marks) == sum(bool(space_words(x)) for x in (d[1] or "").split("\n"))


def test_viterbi_is_best():
    rnd = np.random.default_rng(4)
    f = Q.Field(rnd.normal(size=len(Q.FEATURES)), rnd.normal(size=(2, 2)), rnd.normal(size=2))
    sizes = [0, 1, 5, 3, 0, 7]
    first = np.r_[0, np.cumsum(sizes)]
    x = rnd.normal(size=(first[-1], len(Q.FEATURES)))
    marks = f.viterbi(x, first)
    for k, n in enumerate(sizes):
        e = (x @ f.weight)[first[k] : first[k + 1]]

        def value(s):
            return sum(e[t] * s[t] for t in range(n)) + (f.start[s[0]] if n else 0) + sum(f.step[a, b] for a, b in zip(s, s[1:]))

        if n:
            assert tuple(marks[first[k] : first[k + 1]]) == max(product((0, 1), repeat=n), key=value)


def test_held_out_accuracy(spark):
    """Fitted on the labels of one table, judged on another's."""
    from tests.conftest import MID, SMALL

    small = [spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels")]
    field = Q.train(spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet"))
    truth = {r.doc_id: r.quality for r in small[1].collect()}
    right = total = 0
    for r in small[0].collect():
        if r.doc_id in truth and not brute(r.text)[-1]:
            _, x, n, _ = Q.lines_of(r.text.encode())
            right += (Q.share(field, x, n) >= field.least) == bool(truth[r.doc_id])
            total += 1
    assert total > 50 and right / total > 0.95


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = documents()[:40]
    rows = Q.judge(spark.createDataFrame(docs, SCHEMA), none).collect()
    assert all(r.kept != r.base_failed for r in rows)
    assert Q.judge(spark.createDataFrame([], SCHEMA + ", kept string, n_words int"), none).collect() == []


def labelled(folder):
    import duckdb

    return [(q, t.encode()) for q, t in duckdb.sql(f"SELECT quality, text FROM '{folder}/documents.parquet' JOIN '{folder}/labels.parquet' USING (doc_id) WHERE text IS NOT NULL ORDER BY doc_id").fetchall()]


def test_lines_of_mixed_documents():
    """Held-out documents of mixed content and junk lines: the marks tell them
    apart, line by line."""
    import random

    from tests.conftest import MID, SMALL

    field = Q.fitted(labelled(MID))
    held = [(q, Q.weak_labels(t, q == 1)) for q, t in labelled(SMALL)]
    good, bad = [x for q, x in held if q], [x for q, x in held if not q]
    rnd, right, total, switches = random.Random(8), 0, 0, 0
    for k in range(60):
        doc = Q.mixed(good[k % len(good)], bad[k % len(bad)], rnd)
        x = Q.lines_of(b"\n".join(line for line, _ in doc))[1]
        marks = field.viterbi(x, np.array([0, len(x)]))
        y = np.array([v for _, v in doc])
        right, total, switches = right + (marks == y).sum(), total + len(y), switches + (np.diff(marks) != 0).sum()
    assert total > 500 and switches > 60
    assert right / total >= 0.9


def test_marks_on_a_table(spark):
    """Some documents of the table hold both kinds of lines, repeated lines among them."""
    from tests.conftest import MID

    rows = Q.judge(spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")).select("line_marks").collect()
    assert sum(len(set(r.line_marks)) == 2 for r in rows) > 10


def test_fit_uses_whole_texts():
    """What stands at the end of a long text changes the fit."""
    good = [(1, ("\n".join(f"The day number {j} was as good as any other of that year, or so they said." for j in range(600))).encode())] * 8
    junk = b"\n".join([b"plain words of no kind at all"] * 500 + [b"### %%% &&& $$$"] * 40)
    less = b"\n".join([b"plain words of no kind at all"] * 500)
    a, b = (Q.fitted([r for g in good for r in (g, (0, x))]) for x in (junk, less))
    assert not np.allclose(a.weight, b.weight)


def test_a_very_long_text(spark):
    """A text of some MB is judged whole."""
    from tests.llm.corpus import prose as made

    text = "\n".join(f"{k} " + made(__import__("random").Random(k % 50), 30) for k in range(12_000))
    none = spark.createDataFrame([], "doc_id long, quality int")
    r = Q.judge(spark.createDataFrame([(1, text)], "doc_id long, text string"), none).first()
    assert r.n_words == len(text.split()) and len(r.line_marks) == 12_000
