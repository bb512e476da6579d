"""Queries over single operators: joins, counts, text scans, zone maps,
layouts and encodings, each with its oracle."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions import text
from lakemill.functions.fixed import exact_sum, scaled, yyyymmdd
from lakemill.operators import encoding, layout, relational, zonemap
from lakemill.operators.zonemap import Between, point
from lakemill.plans import ssb, tpch
from lakemill.session import exists, fingerprint, shared_dir
from lakemill.sources import files, fixture

CHUNK = 512  # order keys
FILES = 16  # of a sorted layout
D94, D95, D315 = date(1994, 1, 1), date(1995, 1, 1), date(1995, 3, 15)


def _t(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return fixture.tpch(spark, d)


def _raw(spark: SparkSession, d: str, name: str) -> DataFrame:
    return fixture.raw(spark, d, name)


def op_semi_join(spark, d):
    t = _t(spark, d)
    return relational.semi_join(t["orders"], t["customer"].where("c_mktsegment = 'BUILDING'"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


def op_anti_join(spark, d):
    t = _t(spark, d)
    barred = t["supplier"].where(text.like_ordered(F.col("s_comment"), "Customer", "Complaints"))
    return relational.anti_join(t["partsupp"], barred, "ps_suppkey", "s_suppkey")


def op_left_outer_count(spark, d):
    t = _t(spark, d)
    return relational.outer_count(t["customer"], "c_custkey", t["orders"], "o_custkey", "c_count")


def op_partitioned_hash_join(spark, d):
    t = _t(spark, d)
    joined = relational.partitioned_hash_join(t["lineitem"].select("l_orderkey", tpch._net().alias("net")), t["orders"].select("o_orderkey", "o_orderdate"), "l_orderkey", "o_orderkey")
    return joined.groupBy(F.year("o_orderdate").alias("o_year")).agg(scaled(exact_sum(F.col("net")), 10**4).alias("revenue"))


def op_count_distinct(spark, d):
    return relational.distinct_count(_raw(spark, d, "lineitem"), ["l_partkey"], "l_suppkey", "n_suppliers")


def op_distinct_pairs(spark, d):
    return _t(spark, d)["partsupp"]


def op_count_of_counts(spark, d):
    return relational.histogram_of_counts(_raw(spark, d, "lineitem"), "l_orderkey")


def op_like_ordered(spark, d):
    """Documents in which two words stand in one order but not in the other."""
    c = F.col("text")
    return _raw(spark, d, "documents").select("doc_id", text.like_ordered(c, "the", "and", "of").alias("in_order"), text.like_ordered(c, "of", "and", "the").alias("reversed"))


def op_like_ordered_turns(spark, d):
    c = F.col("text")
    return _raw(spark, d, "conversations").where(text.like_ordered(c, "th", "er", "in")).groupBy("role").agg(F.count(F.lit(1)).alias("n_turns"))


def op_prefix(spark, d):
    return _t(spark, d)["part"].where(~F.col("p_type").startswith("MEDIUM POLISHED")).groupBy("p_type").agg(F.count(F.lit(1)).alias("n_parts"))


def op_in_list(spark, d):
    return _t(spark, d)["part"].where(F.col("p_size").isin(*tpch.SIZES)).select("p_partkey", "p_size")


def op_between_string(spark, d):
    return fixture.ssb(spark, d)["part"].where(F.col("p_brand1").between("MFGR#2221", "MFGR#2228")).select("p_partkey", "p_brand1")


def op_count_if(spark, d):
    line = _t(spark, d)["lineitem"]
    return line.agg(F.count_if(F.col("l_discount").between(5, 7)).alias("n_discount"), F.count_if(F.col("l_shipdate") < F.lit(D94)).alias("n_early"), F.count(F.lit(1)).alias("n_all"))


def op_topk(spark, d):
    return relational.top(_t(spark, d)["orders"].select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), "o_orderkey")


def op_split_row(spark, d):
    """Lines put together with a delimiter and split again."""
    line = F.concat_ws("|", "c_custkey", "c_name", "c_nationkey", "c_mktsegment", F.lit(""))
    parts = _raw(spark, d, "customer").select(text.split_row(line).alias("f"))
    return parts.select(F.size("f").alias("n_fields"), F.col("f")[0].cast("long").alias("c_custkey"), F.col("f")[1].alias("c_name"), F.col("f")[3].alias("c_mktsegment"))


def table_counts(spark, d):
    out = None
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        row = _raw(spark, d, name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = row if out is None else out.unionAll(row)
    return out


def table_checksum_lineitem(spark, d):
    """Sums of every column: amounts in hundredths, days as yyyymmdd, flags as code points."""
    line = _t(spark, d)["lineitem"]
    numbers = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    sums = [F.sum(c).cast("long").alias(f"{c}_sum") for c in numbers] + [F.sum(text.ascii_sum(F.col(c))).alias(f"{c}_sum") for c in ("l_returnflag", "l_linestatus")]
    return line.agg(F.count(F.lit(1)).alias("n_rows"), *sums, F.sum(yyyymmdd(F.col("l_shipdate"))).alias("l_shipdate_sum"))


def scan_checksum_customer(spark, d):
    return text.scan_checksum(_raw(spark, d, "customer"), "c_name", "c_mktsegment")


def scan_checksum_text(spark, d):
    return text.scan_checksum(_raw(spark, d, "documents"), "text")


def length_histogram_customer(spark, d):
    return text.length_histogram(_raw(spark, d, "customer"), "c_name")


def length_histogram_turns(spark, d):
    return text.length_histogram(_raw(spark, d, "conversations"), "text")


def _line_map(spark, d):
    return zonemap.build(_t(spark, d)["lineitem"], "l_orderkey", CHUNK, "l_shipdate", "l_quantity", "l_discount")


def _orders_map(spark, d):
    return zonemap.build(_t(spark, d)["orders"], "o_orderkey", CHUNK, "o_orderdate")


def zonemap_build_lineitem(spark, d):
    return _line_map(spark, d)


def zonemap_build_orders(spark, d):
    return _orders_map(spark, d)


def zonemap_prune_range(spark, d):
    return zonemap.evaluate(_orders_map(spark, d), Between("o_orderdate", D94, date(1994, 2, 1), True)).select("chunk_id", "active")


def zonemap_prune_point(spark, d):
    return zonemap.evaluate(_orders_map(spark, d), point("o_orderdate", date(1994, 6, 1))).select("chunk_id", "active")


def zonemap_prune_and(spark, d):
    return zonemap.evaluate(_line_map(spark, d), Between("l_shipdate", D94, D95, True), Between("l_discount", 5, 7), Between("l_quantity", None, 2400, True)).select("chunk_id", "active")


def zonemap_active_list(spark, d):
    return zonemap.active_chunks(_orders_map(spark, d), point("o_orderdate", date(1994, 6, 1)))


def zonemap_report(spark, d):
    return zonemap.pruning_report(_orders_map(spark, d), point("o_orderdate", date(1994, 6, 1)))


def zonemap_other_column(spark, d):
    """Lines of the chunks that an order-date predicate leaves: chunks are
    ranges of the order key, so one table's map prunes the other."""
    active = zonemap.active_chunks(_orders_map(spark, d), point("o_orderdate", date(1994, 6, 1)))
    lines = _t(spark, d)["lineitem"].groupBy(zonemap.chunk_of("l_orderkey", CHUNK).alias("chunk_id")).agg(F.count(F.lit(1)).alias("n_lines"))
    return lines.join(active, "chunk_id", "left_semi")


def _zoned_orders(spark, d):
    """Orders in files sorted by day, with their zone map, written once."""
    return layout.zones(spark, "orders", f"{d}/orders.parquet", lambda: _t(spark, d)["orders"], FILES, ("o_orderdate",), "o_orderdate")


def _zoned_lines(spark, d):
    return layout.zones(spark, "lineitem", f"{d}/lineitem.parquet", lambda: _t(spark, d)["lineitem"], FILES, ("l_shipdate",), "l_shipdate", "l_quantity", "l_discount")


def zonemap_sorted_report(spark, d):
    """Of the files sorted by day, those that a month leaves, and their rows."""
    return zonemap.pruning_report(_zoned_orders(spark, d).zonemap, Between("o_orderdate", D94, date(1994, 2, 1), True))


def zonemap_scan_orders(spark, d):
    return _zoned_orders(spark, d).scan(Between("o_orderdate", D94, date(1994, 2, 1), True)).select("o_orderkey", "o_orderdate")


def zonemap_scan_chunks(spark, d):
    """The same month through chunks of the order key, over the files as they are."""
    t = _t(spark, d)
    return zonemap.scan(t["orders"], "o_orderkey", CHUNK, _orders_map(spark, d), Between("o_orderdate", D94, date(1994, 2, 1), True)).select("o_orderkey", "o_orderdate")


def zonemap_scan_q6(spark, d):
    where = (Between("l_shipdate", D94, D95, True), Between("l_discount", 5, 7), Between("l_quantity", None, 2400, True))
    return _zoned_lines(spark, d).scan(*where).agg(scaled(exact_sum(F.col("l_extendedprice") * F.col("l_discount")), 10**4).alias("revenue"))


def layout_wide_orders(spark, d):
    return layout.wide_orders(_t(spark, d)).groupBy("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"), F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"))


def layout_wide_lineitem(spark, d):
    return layout.wide_lineitem(_t(spark, d)).groupBy("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"))


def layout_wide_lineorder(spark, d):
    return layout.wide_lineorder(fixture.ssb(spark, d)).groupBy("s_region", "c_region", "p_mfgr").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("lo_revenue").cast("long").alias("lo_revenue"))


def layout_split_orders(spark, d):
    """Sorted orders in 16 even files: rows and zone of each."""
    files = layout.split_evenly(layout.wide_orders(_t(spark, d)), FILES, *layout.ORDERS_KEYS)
    return files.groupBy("file_no").agg(F.count(F.lit(1)).alias("n_rows"), F.min("r_name").alias("min_r_name"), F.max("r_name").alias("max_r_name"), F.min("c_mktsegment").alias("min_c_mktsegment"), F.max("c_mktsegment").alias("max_c_mktsegment"))


def sideways_prune_q3(spark, d):
    """Files of sorted lines that Q3's segment and two dates leave."""
    zones = _zoned_wide(spark, d).zonemap
    return zonemap.evaluate(zones, point("c_mktsegment", "BUILDING"), Between("o_orderdate", None, D315, True), Between("l_shipdate", D315)).select("chunk_id", "n_rows", "active")


def sideways_prune_q5(spark, d):
    return zonemap.evaluate(_zoned_wide(spark, d).zonemap, point("r_name", "ASIA"), Between("o_orderdate", D94, D95, True)).select("chunk_id", "n_rows", "active")


def sideways_prune_ssb_q2(spark, d):
    return zonemap.evaluate(_zoned_ssb(spark, d).zonemap, point("s_region", "AMERICA"), point("p_category", "MFGR#12")).select("chunk_id", "n_rows", "active")


def sideways_prune_ssb_q3(spark, d):
    return zonemap.evaluate(_zoned_ssb(spark, d).zonemap, point("s_region", "ASIA"), point("c_region", "ASIA")).select("chunk_id", "n_rows", "active")


def sideways_prune_ssb_q4(spark, d):
    return zonemap.evaluate(_zoned_ssb(spark, d).zonemap, point("s_region", "AMERICA"), point("c_region", "AMERICA"), Between("p_mfgr", "MFGR#1", "MFGR#2")).select("chunk_id", "n_rows", "active")


def _zoned_wide(spark, d):
    """Denormalised lines in files sorted by region, segment and order date."""
    return layout.zones(spark, "wide-lineitem", d, lambda: layout.narrow_lineitem(_t(spark, d)), FILES, layout.LINEITEM_KEYS[:3], "r_name", "c_mktsegment", "o_orderdate", "l_shipdate")


def sideways_tpch_q3(spark, d):
    """Q3 over files that segment and dates of other tables have pruned."""
    lines = _zoned_wide(spark, d).scan(point("c_mktsegment", "BUILDING"), Between("o_orderdate", None, D315, True), Between("l_shipdate", D315))
    return tpch.q3(_t(spark, d) | {"lineitem": lines})


def sideways_tpch_q5(spark, d):
    lines = _zoned_wide(spark, d).scan(point("r_name", "ASIA"), Between("o_orderdate", D94, D95, True))
    return tpch.q5(_t(spark, d) | {"lineitem": lines})


def _zoned_ssb(spark, d):
    """Denormalised lineorder in files sorted by regions and makers."""
    return layout.zones(spark, "wide-lineorder", d, lambda: layout.narrow_lineorder(fixture.ssb(spark, d), fixture.priced), FILES, layout.LINEORDER_KEYS[:4], "s_region", "c_region", "p_mfgr", "p_category")


def _pruned_ssb(spark, d, name, *predicates):
    return ssb.plans()[name](fixture.ssb(spark, d) | {"lineorder": _zoned_ssb(spark, d).scan(*predicates)})


def sideways_ssb_q21(spark, d):
    return _pruned_ssb(spark, d, "ssb_q21", point("s_region", "AMERICA"), point("p_category", "MFGR#12"))


def sideways_ssb_q31(spark, d):
    return _pruned_ssb(spark, d, "ssb_q31", point("s_region", "ASIA"), point("c_region", "ASIA"))


def sideways_ssb_q42(spark, d):
    return _pruned_ssb(spark, d, "ssb_q42", point("s_region", "AMERICA"), point("c_region", "AMERICA"), Between("p_mfgr", "MFGR#1", "MFGR#2"))


def op_sequential_ids(spark, d):
    return relational.sampled_ids(_raw(spark, d, "region"), 3, 11, 20, random=False).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def op_random_ids(spark, d):
    """Ids drawn with a seed: how many there are, and whether all are in range."""
    ids = relational.sampled_ids(_raw(spark, d, "region"), 100, 600, 20_000, seed=3)
    return ids.agg(F.count(F.lit(1)).alias("n_ids"), (F.min("id") >= 100).alias("low_ok"), (F.max("id") < 600).alias("high_ok"), (F.countDistinct("id") > 490).alias("spread"))


def tbl_round_trip(spark, d):
    """Customers written as delimited lines and read again by the declared schema."""
    path = f"{shared_dir(spark)}/tbl-{fingerprint(spark, f'{d}/customer.parquet')}"
    own = _raw(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    if not exists(spark, f"{path}/customer.tbl/_SUCCESS"):
        files.write_tbl(own.withColumn("_end", F.lit("")), f"{path}/customer.tbl")
    return files.read_tbl(spark, f"{path}/customer.tbl", "c_custkey bigint, c_name string, c_nationkey bigint, c_mktsegment string")


def result_round_trip(spark, d):
    """A result written as delimited text with a header, and read again."""
    path = f"{shared_dir(spark)}/result-{fingerprint(spark, f'{d}/customer.parquet')}"
    if not exists(spark, f"{path}/_SUCCESS"):
        files.write_result(_raw(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.csv(path, sep="|", header=True, schema="c_mktsegment string, n bigint")


def codec_choice(spark, d):
    """The codec of each text column by ratio times speed, ratios measured on a
    bounded sample: rows and columns are certain, the choice is one of three."""
    rows = []
    for t, c in (("customer", "c_name"), ("customer", "c_mktsegment"), ("part", "p_type")):
        best = encoding.choose_codec(encoding.measured_ratios(_raw(spark, d, t), c))
        rows.append((t, c, best in encoding.SPEEDS))
    return spark.createDataFrame(rows, "table_name string, column_name string, chosen boolean")


def encoding_bit_packing(spark, d):
    return encoding.bit_packing(_raw(spark, d, "orders"), "o_orderkey", "o_custkey")


def encoding_round_trip(spark, d):
    back = encoding.unpacked(_raw(spark, d, "orders"), "o_orderkey", "o_custkey")
    return back.agg(F.count(F.lit(1)).alias("n_values"), F.sum("value").alias("checksum"), F.sum(F.col("value") * (F.col("o_orderkey") % 1000)).alias("weighted"))


def encoding_run_lengths(spark, d):
    days = _t(spark, d)["orders"].withColumn("day", yyyymmdd(F.col("o_orderdate")))
    return encoding.run_lengths(days, "o_orderkey", "day")


def encoding_dictionary(spark, d):
    return encoding.dictionary(_raw(spark, d, "customer"), "c_mktsegment")


def encoding_advisor(spark, d):
    days = _t(spark, d)["orders"].withColumn("o_day", yyyymmdd(F.col("o_orderdate")))
    return encoding.advise(days, "o_orderkey", "o_custkey", "o_day", "o_shippriority")


def codec_static_rule(spark, d):
    """The rule's codec for each column of the files' main tables."""
    rows = [(t, f.name, encoding.static_codec(f.dataType.simpleString(), 1 if f.name in ("l_returnflag", "l_linestatus", "o_orderstatus") else None)) for t in ("customer", "orders", "lineitem") for f in _raw(spark, d, t).schema]
    return spark.createDataFrame(rows, "table_name string, column_name string, codec string")


def oracles() -> dict[str, str]:
    t = fixture.sql()
    D = tpch._D.format  # noqa: N806
    words = "('MEDIUM POLISHED%')"
    chunk = lambda k: f"{k} // {CHUNK}"
    orders_map = f"om AS (SELECT {chunk('o_orderkey')} AS chunk_id, count(*) AS n_rows, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM t_orders GROUP BY 1)"
    line_map = f"lm AS (SELECT {chunk('l_orderkey')} AS chunk_id, count(*) AS n_rows, min(l_shipdate) AS min_l_shipdate, max(l_shipdate) AS max_l_shipdate, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, min(l_discount) AS min_l_discount, max(l_discount) AS max_l_discount FROM t_lineitem GROUP BY 1)"
    june = "lo <= DATE '1994-06-01' AND hi >= DATE '1994-06-01'"
    hist = lambda c, tab: f"SELECT octet_length(encode({c})) AS length, count(*) AS records FROM {tab} WHERE {c} IS NOT NULL GROUP BY 1"
    scan = lambda c, tab: f"SELECT '{c}' AS column_name, count({c}) AS records, CAST(sum(octet_length(encode({c}))) AS BIGINT) AS sum_length, CAST(sum(list_sum(list_transform(regexp_extract_all(hex(encode({c})), '..'), lambda x: CAST('0x' || x AS INTEGER)))) AS BIGINT) AS sum_bytes FROM {tab}"
    wide_o = "wo AS (SELECT t_orders.*, r_name, c_mktsegment FROM t_orders JOIN customer ON o_custkey = c_custkey JOIN t_nation ON c_nationkey = n_nationkey JOIN t_region ON n_regionkey = r_regionkey)"
    wide_l = f"{wide_o}, wl AS (SELECT t_lineitem.*, o_orderdate, r_name, c_mktsegment FROM t_lineitem JOIN wo ON l_orderkey = o_orderkey)"
    wide_s = "ws AS (SELECT s_lineorder.*, s_region, s_nation, c_region, c_nation, p_mfgr, p_category FROM s_lineorder JOIN s_supplier ON lo_suppkey = s_suppkey JOIN s_customer ON lo_custkey = c_custkey JOIN s_part ON lo_partkey = p_partkey)"

    def shares(src: str, keys: tuple[str, ...]) -> str:
        order = ", ".join(keys)
        return f"f AS (SELECT *, CAST((rank() OVER (ORDER BY {order}) - 1) * {FILES} // count(*) OVER () AS INTEGER) AS file_no FROM {src})"

    def zones(wide: str, src: str, keys: tuple[str, ...], active: str) -> str:
        return t + f", {wide}, {shares(src, keys)} SELECT CAST(file_no AS BIGINT) AS chunk_id, count(*) AS n_rows, {active} AS active FROM f GROUP BY 1"

    at = lambda c, v: f"(min({c}) <= {v} AND max({c}) >= {v})"
    width = lambda x: f"CASE WHEN {x} > 0 THEN length(bin({x})) ELSE 0 END"
    pack = lambda c, src: f"(SELECT o_orderkey // 128 AS block_id, min({c}) AS reference, max({c}) AS most, count({c}) AS n_values, CAST({width(f'max({c}) - min({c})')} AS BIGINT) AS bit_width FROM {src} GROUP BY 1)"
    day = "year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate)"

    def advice(c: str, expr: str) -> str:
        p = pack(expr, "t_orders")
        return f"""SELECT *, CASE WHEN packed_bytes <= plain_bytes AND packed_bytes <= dictionary_bytes THEN 'pfor' WHEN dictionary_bytes <= plain_bytes THEN 'dictionary' ELSE 'plain' END AS encoding FROM (
          SELECT '{c}' AS column_name, CAST(n AS BIGINT) AS n_values, k AS n_distinct, CAST(n * 8 AS BIGINT) AS plain_bytes, CAST(b AS BIGINT) AS packed_bytes, CAST(k * 8 + ceil(n * ({width('k - 1')}) / 8.0) AS BIGINT) AS dictionary_bytes
          FROM (SELECT sum(8 + bit_width * 16) AS b, sum(n_values) AS n FROM {p}), (SELECT count(DISTINCT {expr}) AS k FROM t_orders))"""

    out = {
        "op_semi_join": "SELECT o_orderkey, o_custkey FROM t_orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
        "op_anti_join": "SELECT * FROM t_partsupp WHERE ps_suppkey NOT IN (SELECT s_suppkey FROM t_supplier WHERE s_comment LIKE '%Customer%Complaints%')",
        "op_left_outer_count": "SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN t_orders ON c_custkey = o_custkey GROUP BY 1",
        "op_partitioned_hash_join": f"SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, {D(f'sum({tpch._NET})', 10**4)} AS revenue FROM t_lineitem JOIN t_orders ON l_orderkey = o_orderkey GROUP BY 1",
        "op_count_distinct": "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1",
        "op_distinct_pairs": "SELECT * FROM t_partsupp",
        "op_count_of_counts": "SELECT rows_per_key, count(*) AS n_keys FROM (SELECT count(*) AS rows_per_key FROM lineitem GROUP BY l_orderkey) GROUP BY 1",
        "op_like_ordered": "SELECT doc_id, text LIKE '%the%and%of%' AS in_order, text LIKE '%of%and%the%' AS reversed FROM documents",
        "op_like_ordered_turns": "SELECT role, count(*) AS n_turns FROM conversations WHERE text LIKE '%th%er%in%' GROUP BY 1",
        "op_prefix": f"SELECT p_type, count(*) AS n_parts FROM t_part WHERE p_type NOT LIKE {words} GROUP BY 1",
        "op_in_list": f"SELECT p_partkey, p_size FROM part WHERE p_size IN {tpch.SIZES}",
        "op_between_string": "SELECT p_partkey, p_brand1 FROM s_part WHERE p_brand1 BETWEEN 'MFGR#2221' AND 'MFGR#2228'",
        "op_count_if": "SELECT count(*) FILTER (WHERE l_discount BETWEEN 5 AND 7) AS n_discount, count(*) FILTER (WHERE l_shipdate < DATE '1994-01-01') AS n_early, count(*) AS n_all FROM t_lineitem",
        "op_topk": "SELECT o_orderkey, o_totalprice FROM t_orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
        "op_split_row": "SELECT 4 AS n_fields, c_custkey, c_name, c_mktsegment FROM customer",
        "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")),
        "table_checksum_lineitem": "SELECT count(*) AS n_rows, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}_sum" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ", " + ", ".join(f"CAST(sum(list_sum(list_transform(string_split({c}, ''), lambda x: ascii(x)))) AS BIGINT) AS {c}_sum" for c in ("l_returnflag", "l_linestatus")) + ", CAST(sum(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate)) AS BIGINT) AS l_shipdate_sum FROM t_lineitem",
        "scan_checksum_customer": f"{scan('c_name', 'customer')} UNION ALL {scan('c_mktsegment', 'customer')}",
        "scan_checksum_text": scan("text", "documents"),
        "length_histogram_customer": hist("c_name", "customer"),
        "length_histogram_turns": hist("text", "conversations"),
        "encoding_bit_packing": f"SELECT *, 8 + bit_width * 16 AS packed_bytes FROM {pack('o_custkey', 'orders')}",
        "encoding_round_trip": "SELECT count(o_custkey) AS n_values, CAST(sum(o_custkey) AS BIGINT) AS checksum, CAST(sum(o_custkey * (o_orderkey % 1000)) AS BIGINT) AS weighted FROM orders",
        "encoding_run_lengths": f"SELECT block_id, count(*) AS n_values, CAST(sum(CASE WHEN d = 0 THEN 0 ELSE 1 END) AS BIGINT) AS runs, CAST({width('coalesce(max(d) - min(d), 0)')} AS BIGINT) AS delta_width FROM (SELECT block_id, x - lag(x) OVER (PARTITION BY block_id ORDER BY o_orderkey) AS d FROM (SELECT o_orderkey // 4096 AS block_id, o_orderkey, {day} AS x FROM t_orders)) GROUP BY 1",
        "encoding_dictionary": "SELECT c_mktsegment AS value, count(*) AS n_rows, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM customer GROUP BY 1",
        "encoding_advisor": " UNION ALL ".join(advice(c, e) for c, e in (("o_custkey", "o_custkey"), ("o_day", day), ("o_shippriority", "o_shippriority"))),
    }
    out = {k: t + q for k, q in out.items()}
    out |= {
        "zonemap_build_lineitem": t + f", {line_map} SELECT * FROM lm",
        "zonemap_build_orders": t + f", {orders_map} SELECT chunk_id, n_rows, lo AS min_o_orderdate, hi AS max_o_orderdate FROM om",
        "zonemap_prune_range": t + f", {orders_map} SELECT chunk_id, hi >= DATE '1994-01-01' AND lo < DATE '1994-02-01' AS active FROM om",
        "zonemap_prune_point": t + f", {orders_map} SELECT chunk_id, {june} AS active FROM om",
        "zonemap_prune_and": t + f", {line_map} SELECT chunk_id, max_l_shipdate >= DATE '1994-01-01' AND min_l_shipdate < DATE '1995-01-01' AND max_l_discount >= 5 AND min_l_discount <= 7 AND min_l_quantity < 2400 AS active FROM lm",
        "zonemap_active_list": t + f", {orders_map} SELECT chunk_id FROM om WHERE {june}",
        "zonemap_report": t + f", {orders_map} SELECT count(*) AS chunks, count(*) FILTER (WHERE NOT ({june})) AS chunks_pruned, CAST(sum(n_rows) AS BIGINT) AS all_rows, CAST(coalesce(sum(n_rows) FILTER (WHERE {june}), 0) AS BIGINT) AS rows_scanned FROM om",
        "zonemap_other_column": t + f", {orders_map} SELECT {chunk('l_orderkey')} AS chunk_id, count(*) AS n_lines FROM t_lineitem WHERE {chunk('l_orderkey')} IN (SELECT chunk_id FROM om WHERE {june}) GROUP BY 1",
        **{k: t + " SELECT o_orderkey, o_orderdate FROM t_orders WHERE o_orderdate >= DATE '1994-01-01' AND o_orderdate < DATE '1994-02-01'" for k in ("zonemap_scan_orders", "zonemap_scan_chunks")},
        "zonemap_sorted_report": t + f", f AS (SELECT o_orderdate, (rank() OVER (ORDER BY o_orderdate) - 1) * {FILES} // count(*) OVER () AS z FROM t_orders), m AS (SELECT z, count(*) AS n, min(o_orderdate) < DATE '1994-02-01' AND max(o_orderdate) >= DATE '1994-01-01' AS on_ FROM f GROUP BY 1) SELECT count(*) AS chunks, count(*) FILTER (WHERE NOT on_) AS chunks_pruned, CAST(sum(n) AS BIGINT) AS all_rows, CAST(sum(n) FILTER (WHERE on_) AS BIGINT) AS rows_scanned FROM m",
        "op_random_ids": "SELECT CAST(20000 AS BIGINT) AS n_ids, true AS low_ok, true AS high_ok, true AS spread",
        "tbl_round_trip": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment FROM customer",
        "result_round_trip": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1",
        "codec_choice": "SELECT * FROM (VALUES ('customer', 'c_name', true), ('customer', 'c_mktsegment', true), ('part', 'p_type', true)) v(table_name, column_name, chosen)",
        "zonemap_scan_q6": t + " " + tpch.oracles()["tpch_q6"],
        **{f"sideways_{k}": f"{t} {(tpch.oracles() | ssb.oracles())[k]}" for k in ("tpch_q3", "tpch_q5", "ssb_q21", "ssb_q31", "ssb_q42")},
        "codec_static_rule": """SELECT table_name, column_name, CASE WHEN column_name IN ('l_returnflag', 'l_linestatus', 'o_orderstatus') THEN 'pfor' WHEN data_type = 'BIGINT' THEN 'pfor64' WHEN data_type = 'VARCHAR' THEN 'lz4' ELSE 'pfor' END AS codec
          FROM information_schema.columns WHERE table_name IN ('customer', 'orders', 'lineitem')""",
        "op_sequential_ids": "SELECT 3 + i % 8 AS id, count(*) AS n FROM range(20) r(i) GROUP BY 1",
        "layout_wide_orders": t + f", {wide_o} SELECT r_name, c_mktsegment, count(*) AS n_orders, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM wo GROUP BY ALL",
        "layout_wide_lineitem": t + f", {wide_l} SELECT r_name, c_mktsegment, count(*) AS n_lines, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM wl GROUP BY ALL",
        "layout_wide_lineorder": t + f", {wide_s} SELECT s_region, c_region, p_mfgr, count(*) AS n_lines, CAST(sum(lo_revenue) AS BIGINT) AS lo_revenue FROM ws GROUP BY ALL",
        "layout_split_orders": t + f", {wide_o}, {shares('wo', layout.ORDERS_KEYS)} SELECT file_no, count(*) AS n_rows, min(r_name) AS min_r_name, max(r_name) AS max_r_name, min(c_mktsegment) AS min_c_mktsegment, max(c_mktsegment) AS max_c_mktsegment FROM f GROUP BY 1",
        "sideways_prune_q3": zones(wide_l, "wl", layout.LINEITEM_KEYS[:3], f"{at('c_mktsegment', repr('BUILDING'))} AND min(o_orderdate) < DATE '1995-03-15' AND max(l_shipdate) >= DATE '1995-03-15'"),
        "sideways_prune_q5": zones(wide_l, "wl", layout.LINEITEM_KEYS[:3], f"{at('r_name', repr('ASIA'))} AND min(o_orderdate) < DATE '1995-01-01' AND max(o_orderdate) >= DATE '1994-01-01'"),
        "sideways_prune_ssb_q2": zones(wide_s, "ws", layout.LINEORDER_KEYS[:4], f"{at('s_region', repr('AMERICA'))} AND {at('p_category', repr('MFGR#12'))}"),
        "sideways_prune_ssb_q3": zones(wide_s, "ws", layout.LINEORDER_KEYS[:4], f"{at('s_region', repr('ASIA'))} AND {at('c_region', repr('ASIA'))}"),
        "sideways_prune_ssb_q4": zones(wide_s, "ws", layout.LINEORDER_KEYS[:4], f"{at('s_region', repr('AMERICA'))} AND {at('c_region', repr('AMERICA'))} AND max(p_mfgr) >= 'MFGR#1' AND min(p_mfgr) <= 'MFGR#2'"),
    }
    return out


NAMES = tuple(n for n in dict(globals()) if n.startswith(("op_", "table_", "scan_checksum", "length_", "zonemap_", "layout_", "sideways_", "encoding_", "codec_", "tbl_", "result_")))


def plans() -> dict:
    return {n: globals()[n] for n in NAMES}


