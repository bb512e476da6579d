"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has a bit set where over half of the document's word shingles
have it set in their XXH64. Fingerprints that differ in at most `radius` = 2
bits are linked.

Candidates are exact: the 64 bits are cut into 4 blocks of 16; two fingerprints
within 2 bits agree on at least two whole blocks, so they share one of 6 tables'
32-bit keys. Inside a bucket, fingerprints are held as vertical bit planes. For
each lag, one XOR of a plane with its shifted self updates the distances of all
pairs at that lag, 64 to a word, in carry-save counters (ones, twos, over); a
block of pairs is left as soon as all its distances exceed the radius. Planes of
the bucket's own key are equal by construction and are skipped.

Exact copies collapse to one fingerprint before any comparison. A bucket of
over `chunk` distinct fingerprints is dealt again by the same argument: its
pairs differ in at most two of the four half blocks outside its key, so they
share one of six longer keys. If a longer key's bucket is still that large, it
is cut into chunks and each pair of chunks is one unit of work, so no task holds
a whole hot bucket. A unit emits at most
one link a fingerprint, to the least member of its component in the unit, never
all pairs. Components are then joined across units: by one task as long as its
memory is bounded, beyond that by alternating large-star and small-star rounds
over stage tables.

`near_groups` is the operator for a similarity of 0.8 over five words, where no
radius of a fingerprint holds all pairs: see `similar`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import in_batches, stage
from lakemill.llm.components import components, join
from lakemill.llm.similar import groups

SEED = 42
SHINGLE = 3
RADIUS = 2
CHUNK = 4096
BLOCKS = [list(range(16 * b, 16 * b + 16)) for b in range(4)]
#: Of each table, the bits of its key: two blocks. After these six, for each of
#: them six more for its hot keys, which add two of the four half blocks outside.
TABLES = [sorted(BLOCKS[a] + BLOCKS[b]) for a, b in combinations(range(4), 2)]
FIRST = len(TABLES)
for _key in TABLES[:FIRST]:
    _rest = [b for b in range(64) if b not in _key]
    _halves = [_rest[8 * h : 8 * h + 8] for h in range(4)]
    TABLES += [sorted(_key + _halves[a] + _halves[b]) for a, b in combinations(range(4), 2)]


def shingle_hashes(text: bytes) -> list[bytes]:
    w = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space bytes
    h = xxhash.xxh64_digest
    if len(w) < SHINGLE:
        return [h(b" ".join(w), SEED)] if w else []
    return [h(b" ".join(t), SEED) for t in zip(w, w[1:], w[2:])]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """uint64 for each text; zero for a text without words."""
    out = np.zeros(len(texts), dtype=np.uint64)
    held: list[list[bytes]] = []
    rows: list[int] = []

    def flush() -> None:
        if held:
            n = np.array([len(x) for x in held])
            raw = np.frombuffer(b"".join(b"".join(x) for x in held), dtype=np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1)
            ones = np.add.reduceat(bits, np.r_[0, np.cumsum(n)[:-1]], axis=0, dtype=np.uint32)
            out[rows] = np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel()
            held.clear()
            rows.clear()

    size = 0
    for k, t in enumerate(texts):
        if h := shingle_hashes(t):
            held.append(h)
            rows.append(k)
            size += len(h)
        if size > 200_000:
            flush()
            size = 0
    flush()
    return out


def _with_fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pc.fill_null(batch.column(1).cast(pa.large_string()), "").cast(pa.large_binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(text.to_pylist()).view(np.int64))], names=["doc_id", "fp"])


def _within(bits: np.ndarray, group: np.ndarray, lag: int, planes: list[int], radius: int) -> np.ndarray:
    """The i for which i and i + lag are of one group and within radius."""
    valid = group[lag:] == group[:-lag]
    alive = np.packbits(valid)
    ones, twos, over = np.zeros_like(alive), np.zeros_like(alive), np.zeros_like(alive)
    for k, p in enumerate(planes):
        x = np.packbits(bits[p, lag:] ^ bits[p, :-lag])
        carry = ones & x
        ones ^= x
        over |= twos & carry
        twos ^= carry
        if k % 4 == 3 or k + 1 == len(planes):
            far = over | (ones & twos if radius == 2 else twos if radius == 1 else ones | twos)
            if not (alive & ~far).any():
                return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.unpackbits(alive & ~far, count=len(valid)))


def unit_links(fps: np.ndarray, group: np.ndarray, planes: list[int], radius: int = RADIUS, tile: int = 8192) -> np.ndarray:
    """For rows sorted by group, the index of the least row of each row's
    component; links are pairs of a group within radius on the given planes."""
    n = len(fps)
    root = np.arange(n)
    rows = np.arange(n)
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T.copy()[::-1]  # plane p is bit p
    lag, own, kept = 1, group, bits
    while True:
        _, at, size = np.unique(own, return_index=True, return_counts=True)
        most = int(size.max(initial=0))
        if most <= lag:
            return root
        rest = np.repeat(size > lag, size)  # rows of smaller groups have no pair from here on
        rows, own, kept = rows[rest], own[rest], kept[:, rest]
        for step in range(lag, min(2 * lag, most)):
            for lo in range(0, len(rows) - step, tile):
                hi = min(len(rows), lo + tile + step)
                i = lo + _within(kept[:, lo:hi], own[lo:hi], step, planes, radius)
                join(root, rows[i], rows[i + step])
        lag *= 2


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (tab, key, part, fp) to links (fp, least fp)."""
    rest: pa.Table | None = None

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        tab, key, part, fp = (t.column(c).to_numpy() for c in ("tab", "key", "part", "fp"))
        new = np.r_[False, (tab[1:] != tab[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
        group = np.cumsum(new)
        for x in np.unique(tab):
            own = tab == x
            f, g = fp[own], group[own]
            planes = [p for p in range(64) if p not in TABLES[x]]
            root = unit_links(f.view(np.uint64), g, planes, radius)
            while not (root[root] == root).all():
                root = root[root]
            at = np.flatnonzero(root != np.arange(len(f)))
            yield pa.RecordBatch.from_arrays([pa.array(f[at]), pa.array(f[root[at]])], names=["u", "v"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        if not len(t):
            continue
        tab, key, part = (t.column(c).to_numpy() for c in ("tab", "key", "part"))
        last = np.flatnonzero((tab != tab[-1]) | (key != key[-1]) | (part != part[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from work(t.slice(0, cut))
        rest = t.slice(cut)
    if rest is not None and len(rest):
        yield from work(rest)


def links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(u, v) links between the fingerprints in column fp, v the lesser row of
    its unit, enough of them that their components are the true ones."""
    if radius not in (0, 1, 2):
        raise ValueError("the four blocks prove candidates for a radius of at most 2")
    masks = [sum(1 << b for b in bits) for bits in TABLES]
    key = [F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks]
    crowded = lambda rows: stage(rows.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk), "hot")
    rows = distinct.select("fp", F.posexplode(F.array(*key[:FIRST])).alias("tab", "key"))
    hot = crowded(rows)
    units = rows.withColumn("part", F.lit(0).cast("long"))
    if not hot.isEmpty():
        is_hot = hot.select("tab", "key")
        longer = F.array(*[F.array(*[F.struct(F.lit(t).alias("tab"), key[t].alias("key")) for t in range(FIRST + 6 * k, FIRST + 6 * k + 6)]) for k in range(FIRST)])
        again = rows.join(is_hot, ["tab", "key"], "left_semi").select("fp", F.explode(longer[F.col("tab")]).alias("x")).select("x.tab", "x.key", "fp")
        own = F.pmod(F.xxhash64("fp", F.lit(11)), F.col("chunks"))
        # Unit (i, j) has number i * chunks + j, i < j; a chunk is in each unit with another one.
        other = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: j != own), lambda j: F.least(own, j) * F.col("chunks") + F.greatest(own, j))
        parts = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(other)
        cut = crowded(again).withColumn("chunks", F.ceil(F.col("n") / (chunk // 2)).cast("long")).drop("n")
        again = again.join(cut, ["tab", "key"], "left").select("tab", "key", "fp", F.explode(parts).alias("part"))
        units = units.join(is_hot, ["tab", "key"], "left_anti").unionByName(again)
    units = units.repartition("tab", "key", "part").sortWithinPartitions("tab", "key", "part", "fp")
    return units.mapInArrow(lambda it: _links(it, radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fp (signed 64 bits) and component_id of each row.

    Null, empty and blank texts have fingerprint zero and are linked like any
    other. Fewer than three words are one shingle. Texts of any length are
    hashed whole, in memory that their number of words bounds. Repeated rows
    share a component; of ids that tie for the least there is one. A null id is
    never the least while another id is in the component. Empty table: no rows.
    Other columns are not looked at.
    """
    fps = stage(in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_with_fingerprint, "doc_id long, fp long"), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct, radius, chunk))
    of = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(of.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_groups(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups by a five-word similarity of at least 0.8: see `similar.groups`."""
    return groups(docs, row_col, id_col, text_col)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
