import zlib

from lakemill.llm import shard as H
from tests.llm.corpus import SCHEMA, documents


def check(rows, docs, shards, **kw):
    assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in docs)
    text = {d[0]: d[1] or "" for d in docs}
    home = {}
    for r in rows:
        assert r["size"] == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        assert home.setdefault(text[r.doc_id], r.shard) == r.shard
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_groups_slots_and_schedule(spark):
    docs = documents()
    df = spark.createDataFrame(docs, SCHEMA)
    rows = H.shard(df, shards=5).collect()
    check(rows, docs, 5)
    sizes = {}
    for d in docs:
        sizes[d[1] or ""] = sizes.get(d[1] or "", 0) + len((d[1] or "").encode()) + 8
    loads = sorted(sum(r["size"] for r in rows if r.shard == s) for s in range(5))
    plain = [0] * 5  # the heap's schedule by a plain minimum
    for n in sorted(sizes.values(), reverse=True):
        plain[plain.index(min(plain))] += n
    assert loads == sorted(plain)


def test_bundles_and_blocks(spark):
    """Few groups of their own, small blocks: the paths of a large corpus."""
    docs = [(k, f"text {k % 900}", "en", "a", 0) for k in range(3000)]
    rows = H.shard(spark.createDataFrame(docs, SCHEMA), shards=4, heavy_per_shard=10, bundles_per_shard=50, rows_per_block=40).collect()
    check(rows, docs, 4)
    loads = [sum(r["size"] for r in rows if r.shard == s) for s in range(4)]
    assert max(loads) < 1.02 * min(loads)


def test_empty_and_repeated(spark):
    assert H.shard(spark.createDataFrame([], SCHEMA + ", shard string, size int")).collect() == []
    rows = H.shard(spark.createDataFrame([(1, None), (1, None), (None, "x")], "doc_id long, text string"), shards=2).collect()
    assert sorted((r.shard, r.slot) for r in rows) in ([(0, 0), (0, 1), (1, 0)], [(0, 0), (1, 0), (1, 1)])
