"""Zone maps, layouts, encodings, sources and verification."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lakemill import cli, verify
from lakemill.functions import text
from lakemill.functions.fixed import bits
from lakemill.operators import encoding, layout, relational, zonemap
from lakemill.operators.zonemap import Between, point
from lakemill.plans import ssb, tpch
from lakemill.sources import files, fixture
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def t(spark):
    return fixture.tpch(spark, SMALL)


def ids(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_pruning_never_changes_a_result(t):
    rnd = random.Random(1)
    orders = t["orders"].cache()
    zones = zonemap.build(orders, "o_orderkey", 16, "o_orderdate", "o_custkey").cache()
    for _ in range(12):
        lo = date(1992, 1, 1) + timedelta(days=rnd.randrange(2500))
        a = rnd.randrange(150)
        preds = [Between("o_orderdate", rnd.choice([None, lo]), rnd.choice([None, lo + timedelta(days=rnd.randrange(300))]), rnd.random() < 0.5), Between("o_custkey", a, a + rnd.randrange(40))][: rnd.randint(1, 2)]
        want = orders
        for p in preds:
            want = want.where(p.rows())
        few = zonemap.active_ranges(zones, *preds, most=1)
        assert few is None or len(few) <= 1
        got = zonemap.scan(orders, "o_orderkey", 16, zones, *preds)
        assert ids(got, "o_orderkey") == ids(want, "o_orderkey")


def test_scan_by_join_beyond_the_range_limit(t, monkeypatch):
    zones = zonemap.build(t["orders"], "o_orderkey", 4, "o_custkey")
    p = point("o_custkey", 7)
    want = ids(t["orders"].where("o_custkey = 7"), "o_orderkey")
    monkeypatch.setattr(zonemap, "active_ranges", lambda *a, **k: None)
    assert ids(zonemap.scan(t["orders"], "o_orderkey", 4, zones, p), "o_orderkey") == want != []


def test_unknown_chunks_are_kept(spark):
    df = spark.createDataFrame([(0, None), (1, None), (8, 5)], "k long, x int")
    zones = zonemap.build(df, "k", 4, "x")
    assert ids(zonemap.active_chunks(zones, point("x", 9)), "chunk_id") == [(0,)]
    assert ids(zonemap.active_chunks(zones, point("x", 5)), "chunk_id") == [(0,), (2,)]


def test_sorted_files_prune(spark, t, tmp_path):
    wide = layout.wide_orders(t)
    layout.write_sorted(wide, str(tmp_path / "o"), 6, *layout.ORDERS_KEYS)
    back = spark.read.parquet(str(tmp_path / "o"))
    assert back.count() == wide.count()
    per_file = back.groupBy(F.input_file_name()).agg(F.min("r_name").alias("a"), F.max("r_name").alias("b")).collect()
    assert len(per_file) > 1 and sum(r.a <= "ASIA" <= r.b for r in per_file) < len(per_file)
    plan = back.where("r_name = 'ASIA'").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(r_name), EqualTo(r_name,ASIA)]" in plan


def test_even_split(t):
    sizes = [r.n for r in layout.split_evenly(t["lineitem"], 7, "l_shipdate", "l_orderkey").groupBy("file_no").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) < 30


def test_selectivity_families(t, spark):
    keys = {p: set(ids(tpch.q3sel(t, p), "l_orderkey")) for p in (20, 40, 60, 80, 100)}
    assert keys[20] < keys[40] < keys[60] < keys[80] < keys[100]
    sweep = [r.revenue for r in tpch.revenue_sweep(t).orderBy("sd_hi").collect()]
    assert sweep == sorted(sweep) and sweep[-1] > 0
    s = [r.revenue or 0 for r in ssb.revenue_sweep(fixture.ssb(spark, SMALL)).orderBy("lo_hi").collect()]
    assert s == sorted(s)
    assert tpch.revenue(t, quantity=0, other_filters=False).first()[0] >= tpch.revenue(t, quantity=30, other_filters=False).first()[0]
    assert tpch.q3(t, limit=10).collect() == tpch.q3(t).collect()[:10]


def test_tbl_round_trip(spark, tmp_path):
    rows = [(1, 10, "O", "12.30", "1994-01-02", "1-URGENT", "Clerk#1  ", 0, 'quoted "x", y'), (2, 11, "F", "0.05", "1995-03-04", "2", "c", 1, ""), (3, 12, "P", "7.00", "1996-05-06", "3", "d", 0, "é")]
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "orders.tbl.1").write_text("\n".join("|".join(map(str, r)) + "|" for r in rows[:2]) + "\nbad|line|\n")
    (folder / "orders.tbl.2").write_text("|".join(map(str, rows[2])) + "\n")  # no closing delimiter
    files.tbl_to_parquet(spark, str(folder), str(tmp_path / "p"), names=("orders",))
    read = spark.read.parquet(str(tmp_path / "p/orders.parquet")).orderBy("o_orderkey")
    back = read.collect()
    assert [r.o_orderkey for r in back] == [1, 2, 3] and back[2].o_comment == "é"
    first = back[0]
    assert str(first.o_totalprice) == "12.30" and first.o_orderdate == date(1994, 1, 2) and first.o_clerk == "Clerk#1" and first.o_comment == 'quoted "x", y'
    files.write_result(read.select("o_orderkey", "o_totalprice"), str(tmp_path / "r"))
    out = next((tmp_path / "r").glob("part-*")).read_text().split("\n")
    assert out[0] == "o_orderkey|o_totalprice" and "1|12.30" in out


def test_plans_over_declared_tables(spark, t, tmp_path):
    """The same plan over .tbl files with decimals gives the fixture's result."""
    line = t["lineitem"]
    money = [(F.col(c) / 100).cast("decimal(15,2)").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    none = [F.lit(None).cast("date").alias(c) for c in ("l_commitdate", "l_receiptdate")] + [F.lit("").alias(c) for c in ("l_shipinstruct", "l_shipmode", "l_comment")]
    files.write_tbl(line.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *money, "l_returnflag", "l_linestatus", "l_shipdate", *none), str(tmp_path / "lineitem.tbl"))
    read = files.plan_tables({"lineitem": files.read_tbl(spark, str(tmp_path / "lineitem.tbl"), files.TPCH["lineitem"])})
    for plan in (tpch.q1, tpch.q6):
        assert plan(read).collect() == plan(t).collect()


def test_bits_and_codecs(spark):
    xs = [0, 1, 2, 3, 4, 127, 128, 2**40, 2**62]
    got = spark.createDataFrame([(x,) for x in xs], "x long").select(bits(F.col("x"))).collect()
    assert [r[0] for r in got] == [x.bit_length() for x in xs]
    assert [encoding.static_codec(*a) for a in (("int",), ("bigint",), ("string",), ("string", 1), ("date",))] == ["pfor", "pfor64", "lz4", "pfor", "pfor"]
    assert encoding.choose_codec({"snappy": 1.8, "lz4": 1.8, "deflate": 2.2}, storage=10) == "deflate"
    assert encoding.choose_codec({"snappy": 1.8, "lz4": 1.8, "deflate": 2.2}, storage=1000) == "snappy"


def test_packing_round_trip(t):
    orders = t["orders"]
    assert ids(encoding.unpacked(orders, "o_orderkey", "o_custkey"), "o_orderkey", "value") == ids(orders, "o_orderkey", "o_custkey")


def test_text(spark):
    rows = [("a%b_c",), ("ab",), (None,), ("é😀",), ("",)]
    df = spark.createDataFrame(rows, "s string")
    assert [r[0] for r in df.select(text.like_ordered(F.col("s"), "%", "_")).collect()] == [True, False, None, False, False]
    one = text.scan_checksum(df.repartition(3), "s").first()
    raw = [s.encode() for (s,) in rows if s is not None]
    assert (one.records, one.sum_length, one.sum_bytes) == (len(raw), sum(map(len, raw)), sum(map(sum, raw)))
    assert text.scan_checksum(df.limit(0), "s").count() in (0, 1)
    assert [tuple(r) for r in text.length_histogram(df, "s").collect()] == [(0, 1), (2, 1), (5, 1), (6, 1)]


def test_not_in_and_outer_count(spark):
    a, b = spark.createDataFrame([(1,), (2,), (3,)], "k long"), spark.createDataFrame([(2,), (None,), (2,)], "j long")
    assert ids(relational.anti_join(a, b, "k", "j"), "k") == [(1,), (3,)]
    assert ids(relational.outer_count(a, "k", b, "j"), "k", "n") == [(1, 0), (2, 2), (3, 0)]
    assert "ShuffledHashJoin" in relational.partitioned_hash_join(a.repartition(2), b, "k", "j")._jdf.queryExecution().executedPlan().toString()
    drawn = relational.sampled_ids(a, 5, 9, 100, seed=3)
    assert {r.id for r in drawn.collect()} == {5, 6, 7, 8} and drawn.collect() == drawn.collect()


def test_plans_push_down_and_prune(t):
    plan = tpch.q6(t)._jdf.queryExecution().explainString(t["lineitem"].sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    read = plan.split("ReadSchema: ")[1]
    assert "l_comment" not in read and "l_tax" not in read and "l_extendedprice" in read
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert all(f"{c}(l_{x}" in pushed for c, x in (("GreaterThanOrEqual", "discount,0.044"), ("LessThanOrEqual", "discount,0.076"), ("LessThanOrEqual", "quantity,23.996"))), pushed


def test_verify():
    a = [(1, "x ", 2.0), (2, None, 3.5)]
    assert verify.same_rows(a, [(2, None, 3.5), (1, "x", 2.0)]) == []
    assert verify.same_rows(a, a[:1]) and verify.same_rows(a, [(1, "x", 2.1), (2, None, 3.5)])
    assert verify.same_rows([(100.0,)], [(100.9,)], relative=0.01) == []


def test_places_in_order(spark):
    """Ranges of keys, one hot prefix, nulls and ties against a plain sort."""
    rows = [(f"Customer#{k % 700:06d}", k % 3 or None) for k in range(5000)] + [(None, 1), (None, None)]
    df = spark.createDataFrame(rows, "a string, b int")
    codes = {r.value: (r.n_rows, r.code) for r in encoding.dictionary(df, "a").collect()}
    values = sorted({a for a, _ in rows if a})
    assert codes == {v: (sum(a == v for a, _ in rows), k) for k, v in enumerate(values)}
    got = [(r.a, r.b, r.file_no) for r in layout.split_evenly(df, 7, "a", "b").collect()]
    order = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)
    rank, plain = {}, sorted(rows, key=order)
    for k, r in enumerate(plain):
        rank.setdefault(r, k)
    assert sorted(got, key=lambda r: order(r[:2])) == [(*r, rank[r] * 7 // len(rows)) for r in plain]


def test_hot_key_of_a_hash_join(spark):
    """Keys of many rows are joined by a sort, the rest by tables in memory."""
    left = spark.range(40).select((F.col("id") % 10).alias("k"), F.col("id").alias("x"))
    right = spark.createDataFrame([(3, y) for y in range(50)] + [(k, k) for k in range(10)] + [(None, 1)], "j long, y long")
    plain = left.join(right, F.col("k") == F.col("j"))
    for most in (1_000, 20):
        split = relational.partitioned_hash_join(left, right, "k", "j", hot_rows=most)
        assert sorted(split.collect()) == sorted(plain.collect())
        text = split._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in text and ("SortMergeJoin" in text) == (most == 20)


def test_zones_are_written_once_and_skip_files(spark, t):
    from datetime import date

    from lakemill.operators.zonemap import Between
    from lakemill.plans import slices

    a, b = slices._zoned_lines(spark, SMALL), slices._zoned_lines(spark, SMALL)
    assert sorted(a.data.inputFiles()) == sorted(b.data.inputFiles()) and a.zonemap.count() == slices.FILES
    days = Between("l_shipdate", date(1994, 1, 1), date(1995, 1, 1), True)
    got = a.scan(days)
    rows = got.collect()
    assert sorted(map(str, rows)) == sorted(map(str, t["lineitem"].where(days.rows()).select(*got.columns).collect()))
    read = cli.scan_metrics(got)
    assert 0 < read["files"] < slices.FILES / 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "zone" in plan and "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    report = slices.zonemap_sorted_report(spark, SMALL).first()
    assert report.chunks_pruned > 0 and report.rows_scanned < report.all_rows / 4
    assert a.scan(Between("l_shipdate", date(2090, 1, 1))).collect() == []
