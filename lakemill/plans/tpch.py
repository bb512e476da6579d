"""Parameterised TPC-H plans over plan tables (amounts in hundredths).

Dimensions are filtered and cut to keys and group columns before each join;
whether a side is broadcast is left to its measured size.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.functions.fixed import exact_sum, scaled, within
from lakemill.functions.text import like_ordered
from lakemill.operators.layout import prune_sideways

Tables = dict[str, DataFrame]
#: Market segments in the order in which selectivity adds them.
SEGMENTS = ("BUILDING", "AUTOMOBILE", "FURNITURE", "MACHINERY", "HOUSEHOLD")
SIZES = (49, 14, 23, 45, 19, 3, 36, 9)


def _net() -> Column:
    """Price after discount, scale 10^4."""
    return F.col("l_extendedprice") * (100 - F.col("l_discount"))



def q1(t: Tables, until: date = date(1998, 9, 2)) -> DataFrame:
    """Pricing summary. until: last ship date."""
    n = F.count(F.lit(1))
    mean = lambda c: scaled(exact_sum(F.col(c)), 100) / n
    return (
        t["lineitem"]
        .where(F.col("l_shipdate") <= F.lit(until))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            scaled(exact_sum(F.col("l_quantity")), 100).alias("sum_qty"),
            scaled(exact_sum(F.col("l_extendedprice")), 100).alias("sum_base_price"),
            scaled(exact_sum(_net()), 10**4).alias("sum_disc_price"),
            scaled(exact_sum(_net() * (100 + F.col("l_tax"))), 10**6).alias("sum_charge"),
            mean("l_quantity").alias("avg_qty"), mean("l_extendedprice").alias("avg_price"), mean("l_discount").alias("avg_disc"), n.alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


def q3(t: Tables, segments: tuple[str, ...] | None = ("BUILDING",), day: date | None = date(1995, 3, 15), limit: int | None = None) -> DataFrame:
    """Shipping priority. segments: None for all; day: None drops both date filters."""
    customer, orders, line = t["customer"], t["orders"], t["lineitem"]
    if day is not None:
        orders, line = orders.where(F.col("o_orderdate") < F.lit(day)), line.where(F.col("l_shipdate") > F.lit(day))
        line = prune_sideways(line, f"o_orderdate < DATE '{day}'")
    if segments is not None:
        customer = customer.where(F.col("c_mktsegment").isin(*segments))
        chosen = f"c_mktsegment IN ({', '.join(repr(x) for x in segments)})"
        orders, line = prune_sideways(orders, chosen), prune_sideways(line, chosen)
    orders = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_shippriority").join(customer.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    # Rows are dealt by order key for the join, and the groups contain it: the sums need no further exchange.
    revenue = line.select("l_orderkey", _net().alias("net")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "o_orderdate", "o_shippriority").agg(scaled(F.sum("net"), 10**4).alias("revenue"))
    out = revenue.select("l_orderkey", "revenue", "o_orderdate", "o_shippriority").orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey")
    return out.limit(limit) if limit else out


def q3sel(t: Tables, percent: int = 20, other_filters: bool = True) -> DataFrame:
    """Q3 with one segment per 20 %, at least one; 100 or more: all customers."""
    segments = None if percent >= 100 else SEGMENTS[: max(1, percent // 20)]
    return q3(t, segments, date(1995, 3, 15) if other_filters else None)


def q5(t: Tables, region: str = "ASIA", since: date = date(1994, 1, 1), until: date = date(1995, 1, 1)) -> DataFrame:
    """Local supplier volume."""
    near = (f"r_name = '{region}'", f"o_orderdate >= DATE '{since}' AND o_orderdate < DATE '{until}'")
    nations = t["nation"].join(t["region"].where(F.col("r_name") == region).select("r_regionkey"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select("n_nationkey", "n_name")
    suppliers = t["supplier"].select("s_suppkey", "s_nationkey").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    customers = t["customer"].select("c_custkey", "c_nationkey").join(nations.select("n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    orders = prune_sideways(t["orders"], near[0]).where((F.col("o_orderdate") >= F.lit(since)) & (F.col("o_orderdate") < F.lit(until))).select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    joined = prune_sideways(t["lineitem"], *near).select("l_orderkey", "l_suppkey", _net().alias("net")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return joined.groupBy("n_name").agg(scaled(exact_sum(F.col("net")), 10**4).alias("revenue")).orderBy(F.desc("revenue"), "n_name")


def _q6_filters(df: DataFrame, since: date, until: date, discount: tuple[int, int] | None, below: int | None) -> DataFrame:
    df = df.where((F.col("l_shipdate") >= F.lit(since)) & (F.col("l_shipdate") < F.lit(until)))
    if discount:
        df = within(df, "l_discount", *discount)
    return within(df, "l_quantity", None, below * 100 - 1) if below else df


def _yield() -> Column:
    """Price times discount, scale 10^4."""
    return F.col("l_extendedprice") * F.col("l_discount")




def revenue(t: Tables, since: date = date(1994, 1, 1), until: date = date(1995, 1, 1), quantity: int | None = None, other_filters: bool = True) -> DataFrame:
    """Q6 and its family. With other_filters: discount 5 to 7 and quantity below
    24. Without: only quantity below `quantity`, 0 or None for any."""
    df = _q6_filters(t["lineitem"], since, until, (5, 7), 24) if other_filters else _q6_filters(t["lineitem"], since, until, None, quantity)
    return df.agg(scaled(exact_sum(_yield()), 10**4).alias("revenue"))


q6 = revenue
#: Upper ends of the sweep, 5 % to 100 % of all ship dates.
SWEEP = (date(1992, 7, 1), *(date(y, 1, 1) for y in range(1993, 2000)))


def revenue_sweep(t: Tables, ends: tuple[date, ...] = SWEEP, quantity: int = 51) -> DataFrame:
    """Revenue from 1992 to each end, without other filters, in one scan."""
    sums = [exact_sum(F.when(F.col("l_shipdate") < F.lit(e), _yield())).alias(f"r{k}") for k, e in enumerate(ends)]
    one = _q6_filters(t["lineitem"], date(1992, 1, 1), max(ends), None, quantity).agg(*sums)
    return one.select(F.explode(F.array(*[F.struct(F.lit(str(e)).alias("sd_hi"), scaled(F.col(f"r{k}"), 10**4).alias("revenue")) for k, e in enumerate(ends)])).alias("x")).select("x.*")


def q13(t: Tables, words: tuple[str, ...] = ("special", "requests")) -> DataFrame:
    """Customer distribution: the comment filter belongs to the join, so it is
    applied to orders before it, and orders are counted before they are joined."""
    orders = t["orders"].where(~like_ordered(F.col("o_comment"), *words)).groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    counts = t["customer"].select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.coalesce("n", F.lit(0)).alias("c_count"))
    return counts.groupBy("c_count").agg(F.count(F.lit(1)).alias("custdist")).orderBy(F.desc("custdist"), F.desc("c_count"))


def q16(t: Tables, brand: str = "Brand#45", prefix: str = "MEDIUM POLISHED", sizes: tuple[int, ...] = SIZES, words: tuple[str, ...] = ("Customer", "Complaints")) -> DataFrame:
    """Parts and suppliers. NOT IN over keys that are never null is an anti join."""
    parts = t["part"].where((F.col("p_brand") != brand) & ~F.col("p_type").startswith(prefix) & F.col("p_size").isin(*sizes)).select("p_partkey", "p_brand", "p_type", "p_size")
    barred = t["supplier"].where(like_ordered(F.col("s_comment"), *words)).select("s_suppkey")
    joined = t["partsupp"].select("ps_partkey", "ps_suppkey").join(barred, F.col("ps_suppkey") == F.col("s_suppkey"), "left_anti").join(parts, F.col("ps_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand", "p_type", "p_size").agg(F.countDistinct("ps_suppkey").alias("supplier_cnt")).orderBy(F.desc("supplier_cnt"), "p_brand", "p_type", "p_size")


_D = "CAST({} AS DOUBLE) / CAST({} AS DOUBLE)"
_NET = "l_extendedprice * (100 - l_discount)"


def _q3_sql(segments: tuple[str, ...] | None, dates: bool, limit: int | None = None) -> str:
    where = ["c_custkey = o_custkey", "l_orderkey = o_orderkey"]
    where += [f"c_mktsegment IN ({', '.join(repr(s) for s in segments)})"] if segments else []
    where += ["o_orderdate < DATE '1995-03-15'", "l_shipdate > DATE '1995-03-15'"] if dates else []
    tail = f" ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT {limit}" if limit else ""
    return f"SELECT l_orderkey, {_D.format(f'sum({_NET})', 10**4)} AS revenue, o_orderdate, o_shippriority FROM customer, t_orders, t_lineitem WHERE {' AND '.join(where)} GROUP BY l_orderkey, o_orderdate, o_shippriority{tail}"


def oracles() -> dict[str, str]:
    mean = lambda c: f"{_D.format(f'sum({c})', 100)} / count(*)"
    q6_sql = lambda where: f"SELECT {_D.format('sum(l_extendedprice * l_discount)', 10**4)} AS revenue FROM t_lineitem WHERE {where}"
    year = "l_shipdate >= DATE '1994-01-01' AND l_shipdate < DATE '1995-01-01'"
    return {
        "tpch_q1": f"SELECT l_returnflag, l_linestatus, {_D.format('sum(l_quantity)', 100)} AS sum_qty, {_D.format('sum(l_extendedprice)', 100)} AS sum_base_price, {_D.format(f'sum({_NET})', 10**4)} AS sum_disc_price, {_D.format(f'sum({_NET} * (100 + l_tax))', 10**6)} AS sum_charge, {mean('l_quantity')} AS avg_qty, {mean('l_extendedprice')} AS avg_price, {mean('l_discount')} AS avg_disc, count(*) AS count_order FROM t_lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL",
        "tpch_q3": _q3_sql(("BUILDING",), True),
        "tpch_q3_top10": _q3_sql(("BUILDING",), True, 10),
        **{f"tpch_q3sel_{p}": _q3_sql(SEGMENTS[: p // 20] if p < 100 else None, True) for p in (20, 40, 60, 80, 100)},
        "tpch_q3sel_40_all_dates": _q3_sql(SEGMENTS[:2], False),
        "tpch_q5": f"SELECT n_name, {_D.format(f'sum({_NET})', 10**4)} AS revenue FROM customer, t_orders, t_lineitem, supplier, t_nation, t_region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1994-01-01' AND o_orderdate < DATE '1995-01-01' GROUP BY n_name",
        "tpch_q6": q6_sql(f"{year} AND l_discount BETWEEN 5 AND 7 AND l_quantity < 2400"),
        "tpch_revenue": q6_sql("l_shipdate >= DATE '1992-01-01' AND l_shipdate < DATE '1996-01-01' AND l_discount BETWEEN 5 AND 7 AND l_quantity < 2400"),
        "tpch_revenue_all_discounts": q6_sql(f"{year} AND l_quantity < 3000"),
        "tpch_revenue_any_quantity": q6_sql(year),
        "tpch_revenue_sweep": " UNION ALL ".join(f"SELECT '{e}' AS sd_hi, {_D.format('sum(l_extendedprice * l_discount)', 10**4)} AS revenue FROM t_lineitem WHERE l_shipdate >= DATE '1992-01-01' AND l_shipdate < DATE '{e}' AND l_quantity < 5100" for e in SWEEP),
        "tpch_q13": "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN t_orders ON c_custkey = o_custkey AND o_comment NOT LIKE '%special%requests%' GROUP BY c_custkey) GROUP BY c_count",
        "tpch_q16": f"SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM t_partsupp, t_part WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#45' AND p_type NOT LIKE 'MEDIUM POLISHED%' AND p_size IN {SIZES} AND ps_suppkey NOT IN (SELECT s_suppkey FROM t_supplier WHERE s_comment LIKE '%Customer%Complaints%') GROUP BY ALL",
    }


def plans() -> dict:
    y94 = {"since": date(1994, 1, 1), "until": date(1995, 1, 1), "other_filters": False}
    return {
        "tpch_q1": q1, "tpch_q3": q3, "tpch_q3_top10": lambda t: q3(t, limit=10),
        **{f"tpch_q3sel_{p}": lambda t, p=p: q3sel(t, p) for p in (20, 40, 60, 80, 100)},
        "tpch_q3sel_40_all_dates": lambda t: q3sel(t, 40, other_filters=False),
        "tpch_q5": q5, "tpch_q6": q6, "tpch_revenue": lambda t: revenue(t, date(1992, 1, 1), date(1996, 1, 1)),
        "tpch_revenue_all_discounts": lambda t: revenue(t, quantity=30, **y94), "tpch_revenue_any_quantity": lambda t: revenue(t, quantity=0, **y94),
        "tpch_revenue_sweep": revenue_sweep, "tpch_q13": q13, "tpch_q16": q16,
    }
