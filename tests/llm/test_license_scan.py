import random
import re

from lakemill.llm import license_scan as L
from tests.llm.corpus import SCHEMA, documents, lower, prose


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute(text):
    w = words(text)
    places, labels = [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        for k in range(len(w)):
            if w[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def texts():
    rnd = random.Random(8)
    out = [d[1] for d in documents()]
    bits = ["Apache License", "GNU General Public License,", "CC-BY", "cc by", "MIT\nLicense", "mit licenses", "emit license", "gnu general public", "cc", "by", "MIT MIT license license", "\x00"]
    out += [" ".join(rnd.choice([*bits, prose(rnd, 3)]) for _ in range(rnd.randint(1, 12))) for _ in range(100)]
    return out


def test_base_against_brute_force(spark):
    docs = [(k, t, "en", "a", 0) for k, t in enumerate(texts())]
    for r in L.scan(spark.createDataFrame(docs, SCHEMA)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id][1])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.n_base)


def distance(a, b):
    """Least edits that turn a into some part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_notices_against_edit_distance():
    rnd = random.Random(12)
    for k in range(300):
        text, label, _ = L.NOTICES[k % len(L.NOTICES)]
        only = (text, label, "")
        n = L.Notice(*only)
        t = list(text)
        for _ in range(rnd.randint(0, n.errors + 3)):
            at = rnd.randrange(len(t))
            t[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "q", " "])
        hay = " ".join(words("zz " * rnd.randint(0, 3) + "".join(t) + " yy"))
        found = [(lo, hi, e) for lo, hi, e, _ in L.occurrences(f" {hay} ".encode(), (only,))]
        near = distance(text, f" {hay} ")
        assert bool(found) == (near <= n.errors), (hay, near)
        if found:
            assert min(e for *_, e in found) == near


def test_spans_and_score():
    got = L.scan_text(b"ab cd. Licensd under the Apache Licence, version 2.0! ef")
    assert got["base_labels"] == "" and got["labels"] == "apache" and 0.9 < got["score"] < 1
    assert [(n["first_word"], n["last_word"], n["errors"]) for n in got["notices"]] == [(2, 9, 2)]


def test_empty(spark):
    assert L.scan(spark.createDataFrame([], SCHEMA + ", score string, labels int")).collect() == []


def test_words_that_tell_licenses_apart():
    for text, base, labels in (
        ("is licensed under CC BY-NC 4.0 by its makers", "cc-by", "cc-by,cc-by-nc"),
        ("is licensed under CC BY-SA 4.0 by its makers", "cc-by", "cc-by,cc-by-sa"),
        ("released under the MPL license", "", "mpl"),
        ("released under the MIT license", "mit", "mit"),
        ("relased under the MIT licence", "", "mit"),
        ("relased under the BSD licence", "", ""),
        ("licensed under the GNU Lesser General Public License version 3", "", "lgpl"),
        ("licenced under the GNU General Public Licence version 3", "", "gpl"),
        ("licensed under the GNU special public license version 3", "", ""),
    ):
        got = L.scan_text(text.encode())
        assert (got["base_labels"], got["labels"]) == (base, labels), text


def test_labels_against_brute_force():
    """Every notice at every place by edit distance, the best of those that overlap."""
    from tests.conftest import SMALL

    import duckdb

    for (raw,) in duckdb.sql(f"SELECT text FROM '{SMALL}/documents.parquet' WHERE text IS NOT NULL").fetchall():
        hay = " " + " ".join(words(raw)) + " "
        got = L.scan_text(raw.encode())["labels"].split(",")
        want = set(brute(raw)[4].split(","))
        for n in L.NOTICES:
            # A seed of few signs must be there for any place; the rest is the plain distance.
            if any(n[0][len(n[0]) * k // 4 : len(n[0]) * k // 4 + 6] in hay for k in range(4)) and distance(n[0], hay) <= L.Notice(*n).errors and all(f" {x} " in hay for x in n[2].split()):
                want.add(n[1])
        assert set(got) - {""} == want - {""}, (got, want)


def test_many_places_in_linear_time():
    import time

    took = []
    for n in (20_000, 40_000):
        began = time.perf_counter()
        got = L.scan_text(b"cc by xx " * n + b"licensed under cc by nc 4 0 " * (n // 10))
        took.append(time.perf_counter() - began)
        assert got["n_base"] == n + n // 10 and len(got["notices"]) == n // 10
    assert took[1] < 4 * took[0] + 0.5
