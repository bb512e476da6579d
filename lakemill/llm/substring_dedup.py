"""Substring dedup with repeated-phrase automata.

A window is `width` = 13 consecutive words of one document. A word goes if a
window over it has the same words as a window of a document with a smaller id.

1. Anchors. Each window selects its least-hashed run of `gram` words; equal
   windows select equal grams. Consecutive windows mostly select the same place,
   so the corpus gives one anchor for about five words: (gram hash, hash of the
   extent of windows that selected it, document).
2. Recurring passages are confirmed by partial sums over grams. If all extents
   of a gram are equal, the extent is one passage, and the smallest of the
   documents that have it owns it. Where extents differ (at the ends of shared
   text, and for short common phrases), the windows themselves are hashed and
   summed in the same way: each window of two documents is a passage.
3. Owners emit the words of their passages. Passages are dealt to shards by
   owner, so that the passages of one source text are together, and each shard's
   are compiled into Aho-Corasick automata of about `automaton_signs` words.
4. All documents that share a passage with a smaller one are streamed through
   the automata of those owners' shards, which locate every occurrence; nothing
   else tells where a passage stands. What an occurrence of a smaller owner's
   passage covers is removed.

No step gathers rows by a key that a document may share with others: sums are
partial, joins on grams and windows are plain joins whose hot keys adaptive
execution splits, lists are per document, bounded by its length, and a shard
that very many documents need is dealt to several tasks, each with its automata.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import discard, in_batches, stage
from lakemill.llm.textops import Piece, mix, pieces, window_hashes, window_ok

WIDTH = 13
GRAM = 5
AUTOMATON_SIGNS = 500_000
#: Documents that one task streams through the automata of a shard.
STREAMED = 20_000
_NO_ID = (1 << 63) - 1  # a null id: larger than any other, so it owns nothing


class Anchors:
    """Of one piece: the anchors, each with the windows that selected it."""

    def __init__(self, piece: Piece, width: int, gram: int):
        h = piece.word_hashes()
        grams = window_hashes(h, gram, 0x2545F4914F6CDD1D)
        self.windows = window_hashes(h, width)
        self.words = h
        n = len(self.windows)
        self.ok = ok = window_ok(piece, width)
        here = np.arange(n)
        best, at = grams[:n].copy(), here.copy()
        for k in range(1, width - gram + 1):
            less = grams[k : k + n] < best
            best[less] = grams[k : k + n][less]
            at[less] = here[less] + k
        new, end = ok.copy(), ok.copy()
        if n:
            same = (at[1:] == at[:-1]) & ok[1:] & ok[:-1]
            new[1:] &= ~same
            end[:-1] &= ~same
        self.first, self.last = np.flatnonzero(new), np.flatnonzero(end)
        self.gram = grams[at[self.first]] if n else np.zeros(0, np.uint64)
        ends = mix(self.windows[self.first] * np.uint64(3) + self.windows[self.last] * np.uint64(0x9E3779B97F4A7C15))
        place = (at[self.first] - self.first) * 64 + (self.last - self.first) if n else np.zeros(0, int)
        self.extent = mix(ends + place.astype(np.uint64))
        self.row = piece.row_of_word()[self.first] if n else np.zeros(0, int)


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), _NO_ID).to_numpy(zero_copy_only=False)


def _anchors(batches: Iterator[pa.RecordBatch], width: int, gram: int, extents: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = _ids(batch.column(0))
        for piece in pieces(batch.column(1)):
            a = Anchors(piece, width, gram)
            out = {"gram": a.gram.view(np.int64), "doc": ids[piece.lo : piece.hi][a.row]}
            if extents:
                out["extent"] = a.extent.view(np.int64)
            yield pa.RecordBatch.from_pydict(out)


def _listed(column: pa.Array, lo: int, hi: int, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """Rows lo..hi of a list<struct> column: row numbers and the fields."""
    part = column.slice(lo, hi - lo)
    n = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
    flat = part.flatten()
    return (np.repeat(np.arange(hi - lo), n), *(flat.field(k) for k in names))


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted key is among keys, and its value."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def _in_row(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    return key ^ mix(row.astype(np.uint64) + np.uint64(1))


def _open_windows(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The windows of anchors whose extents differ between documents."""
    for batch in batches:
        ids = _ids(batch.column("doc_id"))
        for piece in pieces(batch.column("text")):
            a = Anchors(piece, width, gram)
            row, key = _listed(batch.column("open"), piece.lo, piece.hi, ("gram",))
            found, _ = _lookup(_in_row(row, key.to_numpy().view(np.uint64)), row, _in_row(a.row, a.gram))
            n = (a.last - a.first + 1)[found]
            at = np.repeat(a.first[found] - np.r_[0, np.cumsum(n)[:-1]] if len(n) else a.first[found], n) + np.arange(n.sum())
            yield pa.RecordBatch.from_pydict({"gram": np.repeat(a.gram[found], n).view(np.int64), "window": a.windows[at].view(np.int64), "doc": ids[piece.lo : piece.hi][np.repeat(a.row[found], n)]})


def _phrases(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Of each row (doc, hash, text, grams, windows, routes, shard, copies): the
    passages that it owns, parted by line feeds, to each copy of its shard
    (part 0), and its text to each of its routes (part 1)."""
    for batch in batches:
        docs = batch.column("doc").to_numpy()
        out: dict[str, list] = {c: [] for c in DEALT}
        copies, shards = batch.column("copies").to_numpy(), batch.column("shard").to_numpy()
        for piece in pieces(batch.column("text")):
            row_g, key_g = _listed(batch.column("grams"), piece.lo, piece.hi, ("gram",))
            row_w, gram_w, key_w = _listed(batch.column("windows"), piece.lo, piece.hi, ("gram", "window"))
            if not len(row_g) and not len(row_w):
                continue
            a = Anchors(piece, width, gram)
            none = np.zeros(len(row_g), dtype=np.int64)
            whole, _ = _lookup(_in_row(row_g, key_g.to_numpy().view(np.uint64)), none, _in_row(a.row, a.gram))
            n = a.last - a.first + 1
            of = np.repeat(np.arange(len(n)), n)
            at = np.flatnonzero(a.ok)  # of[k] is the anchor that window at[k] selected
            single = lambda g, w: mix(g * np.uint64(5) + w)
            wanted = _in_row(a.row[of], single(a.gram[of], a.windows[at]))
            alone, _ = _lookup(_in_row(row_w, single(gram_w.to_numpy().view(np.uint64), key_w.to_numpy().view(np.uint64))), np.zeros(len(row_w), dtype=np.int64), wanted)
            # One of each passage: places of equal keys in a row hold equal words.
            _, once = np.unique(_in_row(a.row, a.gram)[whole], return_index=True)
            _, once_alone = np.unique(wanted[alone], return_index=True)
            first = np.r_[a.first[whole][once], at[alone][once_alone]]
            last = np.r_[a.last[whole][once], at[alone][once_alone]] + width - 1
            order = np.argsort(first, kind="stable")
            first, last = first[order], last[order]
            row = piece.row_of_word()[first]
            raw = piece.data.tobytes().translate(_NO_FEED)
            cut = [raw[x:y] for x, y in zip(piece.starts[first].tolist(), piece.ends[last].tolist())]
            bound = np.searchsorted(row, np.arange(piece.hi - piece.lo + 1)).tolist()
            for k in range(piece.hi - piece.lo):
                if bound[k] < bound[k + 1]:
                    held = b"\n".join(cut[bound[k] : bound[k + 1]])
                    for copy in range(int(copies[piece.lo + k])):
                        for c, v in zip(DEALT, (int(shards[piece.lo + k]), copy, 0, int(docs[piece.lo + k]), 0, held)):
                            out[c].append(v)
        if out["doc"]:
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in DEALT.items()], names=list(DEALT)).set_column(5, "text", pa.array(out["text"], pa.large_binary()).cast(pa.string()))
        row, shard, copy = _listed(batch.column("routes"), 0, batch.num_rows, ("shard", "copy"))
        if len(row):
            which = pa.array(row)
            own = [shard, copy, pa.array(np.ones(len(row), dtype=np.int64)), *(batch.column(c).take(which) for c in ("doc", "hash", "text"))]
            yield pa.RecordBatch.from_arrays([x.cast(pa.int64()) if c != "text" else x.cast(pa.string()) for c, x in zip(DEALT, own)], names=list(DEALT))


#: Columns of what is dealt to shards, and what Arrow builds them of.
DEALT = {"shard": pa.int64(), "copy": pa.int64(), "part": pa.int64(), "doc": pa.int64(), "hash": pa.int64(), "text": pa.large_binary()}
_NO_FEED = bytes(0x20 if k == 0x0A else k for k in range(256))


class Automata:
    """The passages of one shard, about `limit` signs to an automaton."""

    def __init__(self, owned: list[tuple[int, str]], limit: int):
        texts = [t for _, held in owned for t in held.split("\n")]
        owner = [who for who, held in owned for _ in range(held.count("\n") + 1)]
        self.parts = []
        lo, size = 0, 0
        for k, t in enumerate(texts):
            size += t.count(" ") + 1
            if size >= limit or k + 1 == len(texts):
                self.parts.append(self._compile(texts[lo : k + 1], owner[lo : k + 1]))
                lo, size = k + 1, 0

    @staticmethod
    def _compile(texts: list[str], owner: list[int]) -> tuple[np.ndarray, ahocorasick.Automaton]:
        hashes, first = [], [0]
        for piece in pieces(pa.array(texts, pa.large_string())):
            hashes.append(piece.word_hashes())
            first += (first[-1] + piece.first[1:]).tolist()
        words = np.concatenate(hashes)
        known = np.unique(words)
        signs = _signs(known, words)
        least: dict[str, int] = {}
        for k, who in enumerate(owner):
            passage = signs[2 * first[k] : 2 * first[k + 1]]
            least[passage] = min(who, least.get(passage, who))
        automaton = ahocorasick.Automaton()
        for passage, who in least.items():
            automaton.add_word(passage, (len(passage) // 2, who))
        automaton.make_automaton()
        return known, automaton

    def locate(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, end, owner) of every occurrence in a run of word hashes."""
        for known, automaton in self.parts:
            for last, (n, who) in automaton.iter(_signs(known, words)):
                yield last // 2 - n + 1, last // 2 + 1, who


def _signs(known: np.ndarray, words: np.ndarray) -> str:
    """Two characters a word, the digits of its place among the known ones, or
    two zeros. A node's children are searched one by one, so a sign for each
    word would make the root slow; first and second digits differ, so that an
    occurrence begins with a word."""
    base = isqrt(len(known)) + 1
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    found = known[at] == words
    out = np.zeros((len(words), 2), dtype="<u4")
    out[found, 0] = 1 + at[found] // base
    out[found, 1] = 1 + base + at[found] % base
    return out.tobytes().decode("utf-32-le")


def _locate(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, copy, part, doc, hash, text), sorted by the first three, to
    (doc, hash, start, end): the runs of words that go, by the occurrences."""
    at: tuple[int, int] | None = None
    owned: list[tuple[int, str]] = []
    automata: Automata | None = None
    for batch in batches:
        shard, copy, part, docs = (batch.column(c).to_numpy() for c in ("shard", "copy", "part", "doc"))
        edge = np.flatnonzero((shard[1:] != shard[:-1]) | (copy[1:] != copy[:-1]) | (part[1:] != part[:-1])) + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows]):
            if lo == hi:
                continue
            if (here := (int(shard[lo]), int(copy[lo]))) != at:
                at, owned, automata = here, [], None
            if part[lo] == 0:
                owned += zip(docs[lo:hi].tolist(), batch.column("text").slice(lo, hi - lo).to_pylist())
                continue
            if automata is None:
                automata, owned = Automata(owned, limit), []
            out: dict[str, list] = {"row": [], "start": [], "end": []}
            for piece in pieces(batch.column("text").slice(lo, hi - lo)):
                words, own = piece.word_hashes(), docs[lo + piece.lo : lo + piece.hi]
                # Rows are parted by a sign of no passage, so no occurrence crosses them.
                of_word = piece.row_of_word()
                apart = np.zeros(len(words) + len(own), dtype=np.uint64)
                apart[np.arange(len(words)) + of_word] = words
                starts = piece.first[:-1] + np.arange(len(own))
                hits = np.array(list(automata.locate(apart)), dtype=np.int64).reshape(-1, 3)
                row = np.searchsorted(starts, hits[:, 0], side="right") - 1
                later = hits[:, 2] < own[row]
                row, start, end = row[later], hits[later, 0] - starts[row[later]], hits[later, 1] - starts[row[later]]
                # Occurrences that touch are one run.
                order = np.lexsort((start, row))
                row, start, end = row[order], start[order], end[order]
                if len(row):
                    base = row * (int(end.max()) + 1)  # reach within a row only
                    reach = np.maximum.accumulate(base + end)
                    new = np.r_[True, base[1:] + start[1:] > reach[:-1]]
                    begin = np.flatnonzero(new)
                    out["row"].append(row[begin] + lo + piece.lo)
                    out["start"].append(start[begin])
                    out["end"].append(np.maximum.reduceat(end, begin))
            if out["row"]:
                row = np.concatenate(out["row"])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in ("doc", "hash")), *(pa.array(np.concatenate(out[c])) for c in ("start", "end"))], names=["doc", "hash", "start", "end"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, runs) to the words that no run holds."""
    for batch in batches:
        for piece in pieces(batch.column("text")):
            row, start, end = _listed(batch.column("runs"), piece.lo, piece.hi, ("start", "end"))
            cover = np.zeros(len(piece.starts) + 1, dtype=np.int64)
            np.add.at(cover, piece.first[row] + start.to_numpy(), 1)
            np.add.at(cover, piece.first[row] + end.to_numpy(), -1)
            cover = np.cumsum(cover)[:-1] > 0
            lost = np.diff(np.r_[0, np.cumsum(cover)][piece.first])
            kept = []
            raw = piece.data.tobytes()
            for k in range(len(piece.rows) - 1):
                words = raw[piece.rows[k] : piece.rows[k + 1]].split()
                if lost[k]:
                    words = [w for w, gone in zip(words, cover[piece.first[k] : piece.first[k + 1]].tolist()) if not gone]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(piece.lo, piece.hi - piece.lo), pa.array(piece.n_words), pa.array(lost), pa.array(kept, pa.large_binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )


def _plan(grams: DataFrame, mine: DataFrame, width: int, signs: int) -> DataFrame:
    """Of each document that owns or needs a passage: its passages, its shard
    and the shard's copies, and the (shard, copy) that its text goes to."""
    none = "array()"
    both = grams.join(mine, "doc", "full").select("doc", *[F.coalesce(c, F.expr(none)).alias(c) for c in ("own", "from", "windows", "from_windows")])
    both = stage(both.select("doc", F.col("own").alias("grams"), "windows", F.array_union("from", "from_windows").alias("owners")), "passages")
    words = both.agg(F.sum(F.size("grams") * (width + 4) + F.size("windows") * width)).first()[0] or 0
    shards = max(1, -(-words // signs))
    shard_of = lambda c: F.pmod(F.xxhash64(c), F.lit(shards))
    needs = both.select("doc", F.explode(F.array_distinct(F.transform("owners", shard_of))).alias("shard"))
    copies = stage(needs.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / STREAMED).cast("long").alias("copies")), "copies")
    routes = needs.join(copies, "shard").groupBy("doc").agg(F.collect_list(F.struct("shard", F.pmod(F.xxhash64("doc", F.lit(3)), F.col("copies")).alias("copy"))).alias("routes"))
    out = both.select("doc", "grams", "windows", shard_of("doc").alias("shard")).join(copies, "shard", "left").join(routes, "doc", "left")
    out = stage(out.withColumn("copies", F.coalesce("copies", F.lit(0).cast("long"))), "plan")
    discard(both, copies)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, automaton_signs: int = AUTOMATON_SIGNS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of each row.

    Null and empty texts have no words and keep the empty text. Texts of any
    length are taken whole; a task holds one text and what it shares. Of rows
    with one id none is smaller, so they do not remove each other's words. A
    null id is larger than any other. Repeated rows are reported alike. Empty
    table: no rows. Other columns are not looked at.
    """
    rows = in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    anchors = rows.mapInArrow(lambda it: _anchors(it, width, gram, True), "gram long, doc long, extent long")
    recurring = (
        anchors.groupBy("gram")
        .agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.min("extent").alias("e0"), F.max("extent").alias("e1"))
        .where("least < most")
        .select("gram", F.when(F.col("e0") == F.col("e1"), F.col("least")).alias("owner"))
    )
    # As a table it is joined like any other, so that adaptive execution can split a hot gram.
    recurring = stage(recurring, "recurring")
    # Null owner: the gram is open.
    seen = rows.mapInArrow(lambda it: _anchors(it, width, gram, False), "gram long, doc long")
    owner, is_open = F.col("owner"), F.col("owner").isNull()
    needed = seen.join(recurring, "gram").groupBy("doc")
    grams = needed.agg(
        F.collect_set(F.when(is_open, F.struct("gram"))).alias("open"), F.collect_set(F.when(owner == F.col("doc"), F.struct("gram"))).alias("own"),
        F.collect_set(F.when(owner < F.col("doc"), owner)).alias("from"),
    )
    grams = stage(grams, "grams")
    key = F.coalesce("doc_id", F.lit(_NO_ID))
    some_open = rows.join(grams.where(F.size("open") > 0).select("doc", "open"), key == F.col("doc")).select("doc_id", "text", "open")
    windows = stage(some_open.mapInArrow(lambda it: _open_windows(it, width, gram), "gram long, window long, doc long"), "windows")
    owned = stage(windows.groupBy("gram", "window").agg(F.min("doc").alias("owner"), F.max("doc").alias("most")).where("owner < most").drop("most"), "owned")
    mine = windows.join(owned, ["gram", "window"]).groupBy("doc").agg(
        F.collect_set(F.when(owner == F.col("doc"), F.struct("gram", "window"))).alias("windows"), F.collect_set(F.when(owner < F.col("doc"), owner)).alias("from_windows")
    )
    plan = _plan(grams.select("doc", "own", "from"), mine, width, automaton_signs)
    discard(recurring, grams, windows, owned)
    # A row is known by its id and its text: repeated rows have the same runs.
    ready = rows.select(key.alias("doc"), F.xxhash64("text").alias("hash"), "text").join(plan.where((F.col("copies") > 0) | F.col("routes").isNotNull()), "doc")
    dealt = ready.select("doc", "hash", "text", "grams", "windows", "routes", "shard", "copies").mapInArrow(lambda it: _phrases(it, width, gram), "shard long, copy long, part long, doc long, hash long, text string")
    runs = dealt.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "part").mapInArrow(lambda it: _locate(it, automaton_signs), "doc long, hash long, start long, end long")
    runs = stage(runs.groupBy("doc", "hash").agg(F.collect_set(F.struct("start", "end")).alias("runs")), "runs")
    discard(plan)
    cut = rows.join(runs, (key == F.col("doc")) & (F.xxhash64("text") == F.col("hash")), "left").select("doc_id", "text", "runs")
    return cut.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_text string")
