"""License scan by fuzzy short-notice search.

Base: places where a license phrase's words stand consecutively. The method:
a notice of n signs may occur with at most k errors (edits). Cut into k + 1
seeds, one of them must occur unchanged (pigeonhole), so one exact search for
the seeds of all notices gives all candidate places; the regex library's
bounded-error matching verifies the edits there and reports the span.

Some words tell licenses apart that are few edits from each other (nc and sa,
mit and mpl): these must stand in the span unedited. Where spans of different
notices overlap, the one with the least errors holds.

Texts are compared as lower-cased words joined by single spaces.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import in_batches

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices, the labels that the method gives, and the words that
#: must be unedited.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache", ""),
    ("released under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", ""),
    ("licensed under the gnu general public license version", "gpl", "general"),
    ("licensed under the gnu lesser general public license", "lgpl", "lesser"),
    ("licensed under the gnu affero general public license", "agpl", "affero"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ""),
    ("subject to the terms of the mozilla public license", "mpl", ""),
    ("released under the mpl license", "mpl", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "sa"),
    ("creative commons attribution 4 0 international license", "cc-by", ""),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa", ""),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc", ""),
    ("this is free and unencumbered software released into the public domain", "unlicense", ""),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", ""),
)
SIGNS_PER_ERROR = 12


class Notice:
    def __init__(self, text: str, label: str, needs: str):
        self.text, self.label = text.encode(), label
        self.needs = [b" %s " % w.encode() for w in needs.split()]
        self.errors = max(1, len(text) // SIGNS_PER_ERROR)
        cuts = [len(text) * k // (self.errors + 1) for k in range(self.errors + 2)]
        self.seeds = [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.fuzzy = regex.compile(rb"(?b)(?:%s){e<=%d}" % (regex.escape(self.text, special_only=True), self.errors))

    def verify(self, text: bytes, near: list[int]) -> Iterator[tuple[int, int, int]]:
        """(start, end, errors) of occurrences at places where a seed stands."""
        done = -1
        for at in sorted(set(near)):
            # The seed lies at most `errors` signs from its place.
            lo, hi = max(0, at - self.errors), at + len(self.text) + self.errors
            if hi <= done:
                continue
            if m := self.fuzzy.search(text, max(lo, done), hi):
                done = m.end()
                if all(w in text[max(0, m.start() - 1) : m.end() + 1] for w in self.needs):
                    yield m.start(), m.end(), sum(m.fuzzy_counts)


@lru_cache(maxsize=4)
def _notices(notices: tuple) -> tuple[list[Notice], ahocorasick.Automaton]:
    """The notices, and one automaton over all their seeds, byte for sign."""
    made = [Notice(*n) for n in notices]
    of: dict[str, list[tuple[int, int]]] = {}
    for k, n in enumerate(made):
        for offset, seed in n.seeds:
            of.setdefault(seed.decode("latin-1"), []).append((k, offset + len(seed) - 1))
    seeds = ahocorasick.Automaton()
    for seed, places in of.items():
        seeds.add_word(seed, places)
    seeds.make_automaton()
    return made, seeds


def occurrences(text: bytes, notices: tuple) -> list[tuple[int, int, int, int]]:
    """(start, end, errors, notice) of each notice's places."""
    made, seeds = _notices(notices)
    near: dict[int, list[int]] = {}
    for end, of in seeds.iter(text.decode("latin-1")):
        for k, behind in of:
            near.setdefault(k, []).append(end - behind)
    return [(*m, k) for k, at in near.items() for m in made[k].verify(text, at)]


def best(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (start, end, errors, notice), those that no better one overlaps: less
    errors, then longer, then listed earlier. In order of start."""
    held: list[tuple[int, int, int, int]] = []  # apart and in order
    for f in sorted(found, key=lambda f: (f[2], f[0] - f[1], f[3], f[0])):
        k = bisect(held, f)
        if (k == 0 or held[k - 1][1] <= f[0]) and (k == len(held) or f[1] <= held[k][0]):
            held.insert(k, f)
    return held


def scan_text(raw: bytes, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> dict:
    words = _WORD.findall(raw.lower())
    text = b" " + b" ".join(words) + b" "
    at_space: np.ndarray | None = None  # word k starts behind space k

    def word_at(at: int) -> int:
        nonlocal at_space
        if at_space is None:
            at_space = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 0x20)
        return max(0, int(np.searchsorted(at_space, at, side="right")) - 1)

    places, base = [], set()
    for phrase, label in phrases:
        sought = b" " + phrase.encode() + b" "
        at = text.find(sought)
        while at >= 0:
            places.append(word_at(at))
            base.add(label)
            at = text.find(sought, at + 1)
    made, _ = _notices(notices)
    found, score = [], 1.0 if base else 0.0
    for lo, hi, errors, k in best(occurrences(text, notices)):
        found.append({"label": made[k].label, "first_word": word_at(lo), "last_word": word_at(max(lo, hi - 2)), "errors": errors})
        score = max(score, 1 - errors / len(made[k].text))
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {f["label"] for f in found})), "score": score, "notices": found,
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label:string,first_word:long,last_word:long,errors:long>>"
_ARROW = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("notices", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int64())]))),
])


def _scan(batches: Iterator[pa.RecordBatch], phrases: tuple, notices: tuple) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pc.fill_null(batch.column(1).cast(pa.large_string()), "").cast(pa.large_binary())
        found = pa.RecordBatch.from_pylist([scan_text(t.as_py(), phrases, notices) for t in text], schema=_ARROW)
        yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], names=["doc_id", *_ARROW.names])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """For each row doc_id, the counts and labels, score (1 for an exact
    phrase, else the best notice's share of unedited signs) and notices: label,
    first and last word, errors of each.

    Null and empty texts have no places, empty labels, score 0. Texts of any
    length are searched whole, in time that grows with their length and places.
    Of notices that tie at a place the longer holds, then the one listed first.
    Repeated rows are reported alike, also under a null id, which stays null.
    Empty table: no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_batches(rows).mapInArrow(lambda it: _scan(it, phrases, notices), f"doc_id long, {SCHEMA}")
