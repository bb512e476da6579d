"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items (runs of `width` words, or the
whole item if it is shorter). The alphabet is words, a block is two words
(one for one-word patterns). A shift table gives, for the block that ends at
the current word, how far the search may jump without passing an occurrence;
where the shift is zero, the block's bucket holds the patterns that end in it,
and direct comparison confirms them. Patterns of different lengths have tables
of their own, since the shortest pattern bounds every jump.

The benchmark's size is measured first. Up to `shard_chars` characters (whose
tables take some 90 MB) its tables are sent to the executors once. A larger
benchmark is split by item into shards of that size. A sieve of fixed size, the
bits of all windows' hashes, is sent first: documents without a window whose
bits are set are done, and only the others, which are staged once, pass each
shard's tables; what is staged of a pass are rows and places, no texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import discard, in_batches, stage
from lakemill.llm.textops import pieces, window_hashes, window_ok

WIDTH = 10
SHARD_CHARS = 1_000_000
#: Bits of the sieve, a power of two: 32 MB.
SIEVE_BITS = 1 << 28
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in lower-cased UTF-8.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class WuManber:
    """The tables for patterns of one length."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}

    def add(self, pattern: tuple[bytes, ...], item: str) -> None:
        for end in range(self.block, self.length + 1):
            block = pattern[end - self.block : end]
            self.shift[block] = min(self.shift.get(block, self.jump), self.length - end)
        self.bucket.setdefault(pattern[-self.block :], {}).setdefault(pattern, set()).add(item)

    def find(self, text: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(start, items) of each place where a pattern occurs."""
        length, jump, shift, bucket = self.length, self.jump, self.shift.get, self.bucket
        at, n = length, len(text)
        if self.block == 2:
            while at <= n:
                step = shift((text[at - 2], text[at - 1]), jump)
                if step:
                    at += step
                    continue
                own = bucket.get((text[at - 2], text[at - 1]))
                if own and (items := own.get(tuple(text[at - length : at]))):
                    yield at - length, items
                at += 1
        else:
            for k, w in enumerate(text):
                if items := bucket.get((w,), {}).get((w,)):
                    yield k, items


def compile_items(items: list[tuple[str, bytes]], width: int = WIDTH) -> list[WuManber]:
    out: dict[int, WuManber] = {}
    for item, text in items:
        own = words(text)
        length = min(width, len(own))
        if length:
            tables = out.setdefault(length, WuManber(length))
            for k in range(len(own) - length + 1):
                tables.add(tuple(own[k : k + length]), item)
    return list(out.values())


def _places(own: list[bytes], tables: list[WuManber]) -> tuple[bytearray, set[str]]:
    """One byte a word, 1 = hit (empty if none is), and the items found."""
    cover, items = bytearray(), set()
    for t in tables:
        for at, names in t.find(own):
            if not cover:
                cover = bytearray(len(own))
            cover[at : at + t.length] = b"\x01" * t.length
            items |= names
    return cover, items


def _texts(batch: pa.RecordBatch, text_col: str) -> Iterator[bytes]:
    for raw in pc.fill_null(batch.column(text_col).cast(pa.large_string()), "").cast(pa.large_binary()):
        yield raw.as_py()


def _with(batch: pa.RecordBatch, counts: list[int], hits: list[bytes], found: list[list[str]]) -> pa.RecordBatch:
    new = {"n_words": pa.array(counts, pa.int64()), "hit_words": pa.array(hits, pa.binary()), "hit_items": pa.array(found, pa.list_(pa.string()))}
    return pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)


def _scan(batches: Iterator[pa.RecordBatch], tables: list[WuManber], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, hits, found = [], [], []
        for raw in _texts(batch, text_col):
            own = words(raw)
            cover, items = _places(own, tables)
            counts.append(len(own))
            hits.append(bytes(cover))
            found.append(sorted(items))
        yield _with(batch, counts, hits, found)


#: Bytes that part words, after A-Z have become a-z.
_PARTS = np.array([not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80) for b in range(256)])


class Sieve:
    """Bits of the hashes of all windows, three a window."""

    def __init__(self, width: int, bits: int = SIEVE_BITS):
        self.width, self.lengths = width, set()
        self.bits = np.zeros(bits // 8, dtype=np.uint8)

    def _spots(self, windows: np.ndarray) -> Iterator[np.ndarray]:
        size = np.uint64(len(self.bits) * 8)
        for k in range(3):
            yield ((windows >> np.uint64(20 * k)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) % size

    def add(self, texts: list[str]) -> None:
        for piece in pieces(pa.array(texts, pa.large_string()), _PARTS, lower=True):
            h = piece.word_hashes()
            n = np.minimum(piece.n_words, self.width)[piece.row_of_word()]
            for length in np.unique(n).tolist():
                ok = window_ok(piece, length)
                ok &= n[: len(ok)] == length
                self.lengths.add(length)
                for at in self._spots(window_hashes(h, length, 2 * length + 1)[ok]):
                    np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))

    def passes(self, column: pa.Array) -> np.ndarray:
        """Whether a row may hold a window."""
        out = np.zeros(len(column), dtype=bool)
        for piece in pieces(column, _PARTS, lower=True):
            h, row = piece.word_hashes(), piece.row_of_word()
            for length in self.lengths:
                ok = window_ok(piece, length)
                found = ok.copy()
                for at in self._spots(window_hashes(h, length, 2 * length + 1)):
                    found &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                out[piece.lo + row[: len(ok)][found]] = True
        return out


def _sift(batches: Iterator[pa.RecordBatch], sieve: Sieve, text_col: str, wanted: bool) -> Iterator[pa.RecordBatch]:
    """The rows that the sieve passes, as they are, or those that it does not,
    which have no hits."""
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.filter(pa.array(sieve.passes(batch.column(text_col)) == wanted))
        if wanted:
            yield own
        elif own.num_rows:
            yield _with(own, [len(words(raw)) for raw in _texts(own, text_col)], [b""] * own.num_rows, [[]] * own.num_rows)


def _hits(batches: Iterator[pa.RecordBatch], tables: list[WuManber], row: str, text_col: str) -> Iterator[pa.RecordBatch]:
    """Of rows with hits, the row and the places and items."""
    for batch in batches:
        rows, at, found = [], [], []
        for k, raw in zip(batch.column(row).to_pylist(), _texts(batch, text_col)):
            cover, items = _places(words(raw), tables)
            if cover:
                rows.append(k)
                at.append(np.flatnonzero(np.frombuffer(cover, dtype=np.uint8)).tolist())
                found.append(sorted(items))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))], names=["row", "places", "items"])


def _mark(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """Rows with the places and items of all shards, as their last columns, to
    those with hit_words and hit_items."""
    for batch in batches:
        counts, hits = [], []
        at, items = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))  # docs may have such names
        for raw, places in zip(_texts(batch, text_col), at):
            counts.append(len(words(raw)))
            cover = np.zeros(counts[-1] if places else 0, dtype=np.uint8)
            cover[places or []] = 1
            hits.append(cover.tobytes())
        own = pa.RecordBatch.from_arrays(batch.columns[:-2], names=batch.schema.names[:-2])
        yield _with(own, counts, hits, [sorted(x or ()) for x in items])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """docs with n_words, hit_words (one byte a word, 1 = hit; empty if none
    is), hit_items (sorted item ids as strings) and contaminated.

    Null or empty text has no words. Texts of any length are searched whole, in
    time that grows with their words. Rows are searched each by itself, so
    repeated rows are reported alike and ids, null or not, play no part. Items
    without words match nothing, a null item id counts as the empty string,
    repeated items count once. Columns of docs with these four names are
    replaced. Empty tables: no rows, no hits.
    """
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("words")).where("words <> ''")
    chars = items.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    of = lambda k: items if shards == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == k)
    held = lambda k: [(r[0], r[1]) for r in of(k).collect()]  # noqa: E731  about shard_chars characters
    out = in_batches(docs.drop("n_words", "hit_words", "hit_items", "contaminated").withColumns({"n_words": F.lit(None).cast("long"), "hit_words": F.lit(None).cast("binary"), "hit_items": F.lit(None).cast("array<string>")}))
    tables = lambda k: sc.broadcast(compile_items([(i, t.encode()) for i, t in held(k)], width))
    if shards == 1:
        sent = tables(0)
        out = out.mapInArrow(lambda it: _scan(it, sent.value, text_col), out.schema)
        return out.withColumn("contaminated", F.size("hit_items") > 0)
    sieve = Sieve(width)
    for k in range(shards):
        sieve.add([t for _, t in held(k)])
    sifted = sc.broadcast(sieve)
    row = "_row" + "_" * max(map(len, out.columns))  # no column's name
    plain = out.mapInArrow(lambda it: _sift(it, sifted.value, text_col, False), out.schema)
    suspects = out.mapInArrow(lambda it: _sift(it, sifted.value, text_col, True), out.schema)
    suspects = stage(suspects.withColumn(row, F.monotonically_increasing_id()), "suspects")
    found = []
    for k in range(shards):
        sent = tables(k)
        found.append(stage(suspects.select(row, text_col).mapInArrow(lambda it, sent=sent: _hits(it, sent.value, row, text_col), "row long, places array<int>, items array<string>"), "hits"))
        sent.unpersist()
    every = found[0]
    for f in found[1:]:
        every = every.unionAll(f)
    merged = stage(every.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")), "places")
    discard(*found)
    merged = merged.withColumnsRenamed({"row": "own" + row, "places": "places" + row, "items": "items" + row})
    marked = suspects.join(merged, F.col(row) == F.col("own" + row), "left").select(*[F.col(f"`{c}`") for c in out.columns], "places" + row, "items" + row)
    return plain.unionAll(marked.mapInArrow(lambda it: _mark(it, text_col), out.schema)).withColumn("contaminated", F.size("hit_items") > 0)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
