"""Groups of documents by exact Jaccard similarity of their word shingles.

A document is the set of its runs of SHINGLE = 5 lower-cased words (fewer words
are one shingle). Two documents are linked if their sets have a Jaccard
similarity of at least 0.8; groups are the components of the links.

Equal sets collapse first. Candidates are exact, by prefixes: in any one order
of all shingles, two sets of n and m shingles with a similarity of 0.8 share a
shingle among the first n - ceil(0.8 n) + 1 and the first m - ceil(0.8 m) + 1.
So a fifth of the shingles are shuffled. The order puts what is frequent in a
bounded sample of documents last; the sample decides how much is compared,
never the result.

A large group of copies must not cost all its pairs. First every document is
compared with one other, the one that is the least of most of its keys, and
keys whose documents are then all in one component are left; of keys that have
the very same documents one stays. The keys that remain are buckets: in each,
the wide SimHashes of its documents are compared as bit planes (see `wide`),
across components only. Pairs within the radius are candidates if the places of
their shared shingle allow a similarity of 0.8 and short parity bits of their
sets do so too. No candidate pair leaves a bucket: a document leaves it with one
link at most, to the least of those that candidates tie it to. The components of
these links are clusters, and every pair that is alike lies within one. A
cluster's texts come together once and are compared there, nearest pairs first,
and pairs of documents that are joined by then no more; what leaves it is one
link at most for each component that it joins. A bucket of over CHUNK documents,
or a cluster of over CHUNK documents or 2 * HELD shingles, is cut into chunks,
and each pair of chunks is one unit of work.
Documents are compared in full, text with text: texts compress, and lists of
hashes do not, so the texts are what is shuffled.
Shingles are compared by 64-bit hashes, equal sets by 128 bits. A SimHash loses
a pair with a chance below 1e-15 (see `wide`); all other steps are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm import wide
from lakemill.llm.common import discard, in_batches, stage
from lakemill.llm.components import components, join
from lakemill.llm.textops import Piece, mix, pieces, window_hashes, window_ok

SHINGLE = 5
#: Of the documents that tell which shingles are frequent.
SAMPLE = 10_000
FREQUENT = 2
MOST_FREQUENT = 500_000
#: Documents of a key or a cluster that one task may hold.
CHUNK = 4096
#: Shingles of a chunk of a cluster, and of pairs that are compared at once.
HELD = 1_000_000
AT_ONCE = 250_000
#: Bytes of parity bits up to which they are at hand where SimHashes are compared.
SHORT = 64
#: Bytes of texts that a Python worker gets at once, and that it cuts into words
#: at once: a hash takes 128 bytes while it is made a SimHash.
BATCH = 4 << 20
PIECE = 512 << 10
#: Rows of 8 bytes that every executor may hold.
BROADCAST = 2_000_000


def _pieces(column: pa.Array) -> Iterator[Piece]:
    return pieces(column, limit=PIECE, lower=True)


def _shingles(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row: (row, hash), sorted by both."""
    words, n_words = piece.word_hashes(), piece.n_words
    ok = window_ok(piece, SHINGLE)
    row, hashes = [piece.row_of_word()[: len(ok)][ok]], [window_hashes(words, SHINGLE)[ok]]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(n_words == k)
        row.append(short)
        hashes.append(window_hashes(words, k, 0x5851F42D4C957F2D + 2 * k)[piece.first[short]])
    row, hashes = np.concatenate(row), np.concatenate(hashes)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(values.view(np.int64)))


def _blobs(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Byte strings, the k-th from at[k] to at[k + 1]."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of byte strings, none null, and where each begins and the last ends."""
    _, at, data = column.buffers()
    at = np.frombuffer(at, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) to (row, key), one row for each distinct shingle."""
    for batch in batches:
        rows = batch.column(0).to_numpy()
        for piece in _pieces(batch.column(1)):
            row, hashes = _shingles(piece)
            yield pa.RecordBatch.from_arrays([pa.array(rows[piece.lo + row]), pa.array(hashes.view(np.int64))], names=["row", "key"])


def _prefixes(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(row, id, text) to (row, id, n, set, print, bits, keys); frequent: most frequent last."""
    by_hash = np.argsort(frequent)
    known = frequent[by_hash]
    for batch in batches:
        for piece in _pieces(batch.column(2)):
            row, hashes = _shingles(piece)
            n = np.bincount(row, minlength=piece.hi - piece.lo)
            total = np.zeros((2, len(n)), dtype=np.uint64)
            begin = (np.cumsum(n) - n)[n > 0]
            for t, h in enumerate((hashes, hashes * np.uint64(3) + np.uint64(0x9E3779B97F4A7C15))):
                if len(begin):
                    total[t, n > 0] = np.add.reduceat(mix(h), begin)
            prints = wide.fingerprints(hashes, n)
            bits = wide.parities(hashes, n)
            rank = np.zeros(len(hashes), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                rank = np.where(known[at] == hashes, by_hash[at] + 1, 0)
            order = np.lexsort((hashes, rank, row))
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            length = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
            keys = hashes[order][place < length[row]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(piece.lo, piece.hi - piece.lo) for c in (0, 1)), pa.array(n, pa.int64()), *(pa.array(t.view(np.int64)) for t in total), _blobs(prints.ravel(), np.arange(len(n) + 1) * prints.shape[1]), _blobs(*bits), _lists(keys, length)],
                names=["row", "id", "n", "set0", "set1", "print", "bits", "keys"],
            )


def _frequent(texts: DataFrame) -> np.ndarray:
    """Shingles of several documents of a sample, the most frequent last."""
    total = texts.count()
    part = texts.where(F.pmod(F.xxhash64("row"), F.lit(max(1, total // SAMPLE))) == 0)
    each = part.select("row", "text").mapInArrow(_keys, "row long, key long")
    most = each.groupBy("key").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "key").limit(MOST_FREQUENT)
    return np.array([r.key for r in most.select("key").collect()][::-1], dtype=np.int64).view(np.uint64)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, row, size), sorted by key and row: those of keys that several
    rows have, with row and size of the key's first."""
    names = ("key", "row", "size")
    held = np.zeros((3, 0), dtype=np.int64)  # the last row, whose key may go on
    start = np.zeros((3, 1), dtype=np.int64)  # the first row of that key
    goes_on = False  # the last row's key has a row before it

    def out(rows: np.ndarray, of: np.ndarray, several: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (*rows, *of[1:])], names=[*names, "least", "least_size"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([held, [batch.column(c).to_numpy() for c in names]], axis=1)
        first = np.r_[True, rows[0, 1:] != rows[0, :-1]]
        of = rows[:, np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
        if held.size:
            of[:, rows[0] == start[0]] = start
        several = ~first
        several[0] = held.size > 0 and goes_on
        goes_on = bool(several[-1])
        several[:-1] |= ~first[1:]
        held, start = rows[:, -1:], of[:, -1:]
        yield out(rows[:, :-1], of[:, :-1], several[:-1])
    if held.size and goes_on:
        yield out(held, start, np.ones(1, dtype=bool))


def _size(n: Column, place: Column) -> Column:
    """The size of a set and the place of a shingle in its order, in one long."""
    return F.shiftleft(n, 32) + place


def semi(rows: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """The rows whose number is wanted; a stage table of few is sent to all."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted, on, "left_semi")


def _may(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether sets that share a key, of these sizes and places, can have a
    similarity of 0.8: of the smaller places and rests all may be common."""
    (n, place), (m, other) = ((x >> 32, x & 0xFFFFFFFF) for x in (u, v))
    most = np.minimum(place, other) + 1 + np.minimum(n - 1 - place, m - 1 - other)
    return 9 * most >= 4 * (n + m)


def _close(u: np.ndarray, v: np.ndarray, u_bits: tuple[np.ndarray, ...], v_bits: tuple[np.ndarray, ...], data: np.ndarray) -> np.ndarray:
    """Whether parity bits allow a similarity of 0.8, that is, that at most a
    ninth of sets of these sizes differs, or one of them has no bits."""
    out = np.ones(len(u), dtype=bool)
    known = np.flatnonzero((u_bits[1] > 0) & (v_bits[1] > 0))
    far = wide.differ((data, *(x[known] for x in u_bits)), (data, *(x[known] for x in v_bits)))
    out[known] = 9 * far <= (u[known] >> 32) + (v[known] >> 32)
    return out


def _by_unit(batches: Iterator[pa.RecordBatch], names: tuple[str, str], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """work(rows, unit) for whole units of batches sorted by the named columns;
    unit numbers the rows' units from 0 on."""
    rest: pa.Table | None = None

    def new(t: pa.Table) -> np.ndarray:
        a, b = (t.column(c).to_numpy() for c in names)
        return np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        first = new(t)
        cut = int(np.flatnonzero(first)[-1])
        if cut:
            yield work(t.slice(0, cut).combine_chunks(), np.cumsum(first[:cut]) - 1)
        rest = t.slice(cut)
    if rest is not None:
        yield work(rest.combine_chunks(), np.zeros(len(rest), dtype=np.int64))


def _tops(tree: np.ndarray, at: np.ndarray) -> np.ndarray:
    while True:
        up = tree[at]
        if (up == at).all():
            return at
        at = up


def _links(rows: np.ndarray, tree: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    """(u, v): for each of the nodes that is not the top of its tree, both rows."""
    top = _tops(tree, nodes)
    low = top != nodes
    return pa.RecordBatch.from_arrays([pa.array(rows[nodes[low]]), pa.array(rows[top[low]])], names=["u", "v"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (key, part, row, size, root, print, bits) sorted by key and part to
    (u, v): for each row of a unit one link at most, to the least that candidates
    tie it to. Candidates have different roots, SimHashes within the radius, and
    sizes, places and parity bits, where both have any here, that allow a
    similarity of 0.8."""

    def work(t: pa.Table, unit: np.ndarray) -> pa.RecordBatch:
        row, size, root = (t.column(c).to_numpy() for c in ("row", "size", "root"))
        prints = _bytes(t.column("print").chunk(0))[0].reshape(len(t), -1)
        data, at = _bytes(t.column("bits").chunk(0))
        bits = at[:-1], np.diff(at)
        tree = np.arange(len(t))
        for i, j, _ in wide.pairs(prints, unit, root):
            may = _may(size[i], size[j])
            may[may] = _close(size[i[may]], size[j[may]], tuple(x[i[may]] for x in bits), tuple(x[j[may]] for x in bits), data)
            join(tree, i[may], j[may])
        return _links(row, tree, np.arange(len(t)))

    return _by_unit(batches, ("key", "part"), work)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (u, v, u_n, v_n, u_bits, v_bits) those (u, v) whose parity bits
    allow a similarity of 0.8: at most a ninth of both sets differs."""
    for batch in batches:
        if batch.num_rows:
            n, m = (batch.column(c).to_numpy() for c in (2, 3))
            close = np.flatnonzero(4 * np.maximum(n, m) <= 5 * np.minimum(n, m))
            part = batch.take(pa.array(close))
            bits = [(data, at[:-1], np.diff(at)) for data, at in (_bytes(part.column(c)) for c in (4, 5))]
            far = wide.differ(*bits)
            near = pa.array(np.flatnonzero(9 * far <= (n + m)[close]))
            yield pa.RecordBatch.from_arrays([part.column(c).take(near) for c in (0, 1)], names=["u", "v"])


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (u, v) those whose parity bits allow a similarity of 0.8."""
    pairs = stage(pairs, "met")
    wanted = stage(pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct(), "wanted")
    own = semi(sets, wanted, "row")
    side = lambda c: own.select(F.col("row").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_n", "v_n", "u_bits", "v_bits")
    out = stage(both.mapInArrow(_alike, "u long, v long"), "pairs")
    discard(pairs, wanted)
    return out


def _common(sets: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """For each of n pairs of sets how many members both have; sets: of the first
    and of the second sets (pair, member)."""
    both = np.concatenate([hashes ^ mix(pair.astype(np.uint64) + np.uint64(1)) for pair, hashes in sets])
    pair = np.concatenate([pair for pair, _ in sets])
    order = np.argsort(both, kind="stable")
    twice = order[1:][both[order][1:] == both[order][:-1]]
    return np.bincount(pair[twice], minlength=n)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (u, v, s, t), s and t the texts of u and v, those (u, v) with a
    similarity of at least 0.8."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            # The same rows of both columns: as many as a piece of either holds.
            rest = batch.slice(at)
            first = [next(_pieces(rest.column(c))) for c in (2, 3)]
            n = min(p.hi for p in first)
            part = rest.slice(0, n)
            sets = [_shingles(p if p.hi == n else next(_pieces(part.column(c)))) for c, p in zip((2, 3), first)]
            size = [np.bincount(row, minlength=n) for row, _ in sets]
            near = np.flatnonzero(9 * _common(sets, n) >= 4 * (size[0] + size[1]))
            yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(near)) for c in (0, 1)], names=["u", "v"])
            at += n


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the staged pairs (u, v) of rows those with a similarity of at least 0.8."""
    wanted = stage(pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct(), "wanted")
    own = semi(texts, wanted, "row")
    side = lambda c, s: own.select(F.col("row").alias(c), F.col("text").alias(s))
    both = pairs.join(side("u", "s"), "u").join(side("v", "t"), "v").select("u", "v", "s", "t")
    out = stage(both.mapInArrow(_compare, "u long, v long"), "similar")
    discard(pairs, wanted)
    return out


def _similar(i: np.ndarray, j: np.ndarray, hashes: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether sets i[k] and j[k] have a similarity of at least 0.8; set x has
    the n[x] hashes from begin[x] on."""
    out = np.zeros(len(i), dtype=bool)
    each = np.cumsum(n[i] + n[j])
    lo = 0
    while lo < len(i):
        hi = max(lo + 1, int(np.searchsorted(each, (each[lo - 1] if lo else 0) + AT_ONCE, side="right")))
        sets = []
        for x in (i[lo:hi], j[lo:hi]):
            pair = np.repeat(np.arange(hi - lo), n[x])
            sets.append((pair, hashes[np.arange(len(pair)) + np.repeat(begin[x] - np.cumsum(n[x]) + n[x], n[x])]))
        out[lo:hi] = 9 * _common(sets, hi - lo) >= 4 * (n[i[lo:hi]] + n[j[lo:hi]])
        lo = hi
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (cluster, part, row, root, text) sorted by cluster and part to
    (u, v): links that join the components of a unit's rows that have a similarity
    of at least 0.8, one at most for each root in a unit."""

    def work(t: pa.Table, unit: np.ndarray) -> pa.RecordBatch:
        row, root = (t.column(c).to_numpy() for c in ("row", "root"))
        parts = []
        for piece in _pieces(t.column("text").chunk(0)):
            own, hashes = _shingles(piece)
            n = np.bincount(own, minlength=piece.hi - piece.lo)
            parts.append((hashes, n, wide.fingerprints(hashes, n), *wide.parities(hashes, n)))
        hashes, n, prints, data = (np.concatenate([p[k] for p in parts]) for k in range(4))
        begin = np.cumsum(n) - n
        length = np.concatenate([np.diff(p[4]) for p in parts])
        at = np.cumsum(length) - length
        _, first, own = np.unique(np.stack([unit, root]), axis=1, return_index=True, return_inverse=True)
        tree = first[own.ravel()]
        for i, j, far in wide.pairs(prints, unit, tree.copy()):
            may = 4 * np.maximum(n[i], n[j]) <= 5 * np.minimum(n[i], n[j])
            i, j, far = i[may], j[may], far[may]
            may = 9 * wide.differ((data, at[i], length[i]), (data, at[j], length[j])) <= n[i] + n[j]
            i, j, far = i[may], j[may], far[may]
            order = np.lexsort((far, i))
            i, j, most = i[order], j[order], 1
            while True:  # of each row the nearest ones, twice as many each time
                apart = _tops(tree, i) != _tops(tree, j)
                i, j = i[apart], j[apart]
                if not len(i):
                    break
                new = np.r_[True, i[1:] != i[:-1]]
                now = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0)) < most
                same = _similar(i[now], j[now], hashes, begin, n)
                join(tree, i[now][same], j[now][same])
                i, j, most = i[~now], j[~now], 2 * most
        return _links(row, tree, first)

    return _by_unit(batches, ("cluster", "part"), work)


def _clusters(links: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """(cluster, row, root, chunks): the rows of the components of links that
    have several of the roots; chunks: into how many a cluster is cut."""
    ties = components(links)
    rows = ties.select(F.col("node").alias("row"), F.col("root").alias("cluster")).unionAll(ties.select(F.col("root").alias("row"), F.col("root").alias("cluster")).distinct())
    rows = stage(rows.join(roots, F.col("row") == F.col("node"), "left").select("cluster", "row", F.coalesce("root", "row").alias("root")), "tied")
    of = rows.join(semi(sets.select("row", "n"), rows.select("row"), "row"), "row")
    most = of.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    chunks = F.greatest(_chunks(F.col("rows")), F.when(F.col("n") <= 2 * HELD, 1).otherwise(F.ceil(F.col("n") / HELD)).cast("long"))
    out = stage(rows.join(most.select("cluster", chunks.alias("chunks")), "cluster"), "clusters")
    discard(ties, rows)
    return out


def groups(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct set of shingles: row (of the document with the
    least id that has it, null ids last, then the least row), id, and root, the
    same for all of a group. row_col numbers the rows.

    All texts without words are of one set. Empty table: no rows. Other columns
    are not looked at.
    """
    texts = in_batches(docs, BATCH).select(F.col(row_col).cast("long").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(texts))  # at most MOST_FREQUENT longs
    marked = stage(texts.mapInArrow(lambda it: _prefixes(it, frequent.value), "row long, id long, n long, set0 long, set1 long, print binary, bits binary, keys array<long>"), "prefixes")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("x")
    distinct = stage(marked.groupBy("n", "set0", "set1").agg(least).select("x.row", "x.id"), "distinct")
    each = semi(marked, distinct.select("row"), "row").select("row", "n", F.posexplode("keys").alias("place", "key"))
    each = each.select("key", "row", _size(F.col("n"), F.col("place")).alias("size")).repartition("key").sortWithinPartitions("key", "row")
    hits = stage(each.mapInArrow(_shared, "key long, row long, size long, least long, least_size long"), "hits")
    sets = marked.select("row", "n", "bits")
    prints = marked.select("row", "print", F.when(F.length("bits") <= SHORT, F.col("bits")).otherwise(F.lit(b"")).alias("bits"))

    # The first round: the least row of a key is that of its least component.
    near = [_linked(_near(_favourite(hits.where("least < row").select("row", F.col("least").alias("v"))), sets), texts)]
    roots = components(near[0])
    of = _apart(hits.select("key", "row", "size"), roots)
    discard(hits)
    units = _units(of.join(prints, "row").withColumn("chunks", _chunks(F.col("rows"))), "key", "size", "root", "print", "bits")
    clusters = _clusters(units.mapInArrow(_met, "u long, v long"), roots, sets)
    rows = semi(texts, clusters.select("row"), "row").join(clusters, "row")
    near.append(stage(_units(rows, "cluster", "root", "text").mapInArrow(_joined, "u long, v long"), "joined"))
    discard(roots)
    roots = components(near[0].unionAll(near[1]))
    discard(marked, of, clusters, *near)
    return distinct.join(roots, F.col("row") == F.col("node"), "left").select("row", "id", F.coalesce("root", "row").alias("root"))


def _favourite(met: DataFrame) -> DataFrame:
    """Of (row, v), one for each key of a row, to (u, v): the v of most keys."""
    votes = met.groupBy("row", "v").agg(F.count(F.lit(1)).alias("keys"))
    return votes.groupBy("row").agg(F.max(F.struct("keys", (-F.col("v")).alias("less"))).alias("x")).select(F.col("row").alias("u"), (-F.col("x.less")).alias("v"))


def _apart(hits: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, row, size, root, rows) of the keys whose rows are of several
    components, of those that have the very same rows only the least; rows: how
    many the key has."""
    of = hits.join(roots, F.col("row") == F.col("node"), "left").select("key", "row", "size", F.coalesce("root", "row").alias("root"))
    same = [F.bit_xor(F.xxhash64("row", F.lit(seed))).alias(f"same{seed}") for seed in (1, 2)]
    apart = of.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("rows"), *same).where("r0 < r1")
    apart = apart.groupBy("rows", "same1", "same2").agg(F.min("key").alias("key")).select("key", "rows")
    return stage(of.join(apart, "key"), "apart")


def _chunks(rows: Column) -> Column:
    return F.when(rows <= CHUNK, 1).otherwise(F.ceil(rows / (CHUNK // 2))).cast("long")


def _units(of: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, part, row, columns) dealt and sorted by key and part: a key of one
    chunk is one part. One of more is cut into them; part (i, j) is i * chunks + j,
    i < j, and a chunk is in each part with another one."""
    chunks = F.col("chunks")
    own = F.pmod(F.xxhash64("row", F.lit(11)), chunks)
    other = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda j: j != own), lambda j: F.least(own, j) * chunks + F.greatest(own, j))
    parts = F.when(chunks == 1, F.array(F.lit(0).cast("long"))).otherwise(other)
    return of.select(key, F.explode(parts).alias("part"), "row", *columns).repartition(key, "part").sortWithinPartitions(key, "part")
