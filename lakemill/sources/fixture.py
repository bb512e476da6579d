"""Plan tables over the driver's TPC-H-like files.

These are surrogates, not TPC-H or SSB data: columns that the files lack are
made from the ones they have, so that every plan's constants select rows.
Order and ship dates are shifted by -1096 days onto 1992..1998. Amounts are
whole hundredths. `sql` makes the same tables in DuckDB, for oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions.fixed import hundredths, in_hundredths, yyyymmdd

SHIFT_DAYS = 1096
#: TPC-H regions and their nations, type words.
NATIONS = {
    "AFRICA": ("ALGERIA", "ETHIOPIA", "KENYA", "MOROCCO", "MOZAMBIQUE"),
    "AMERICA": ("ARGENTINA", "BRAZIL", "CANADA", "PERU", "UNITED STATES"),
    "ASIA": ("CHINA", "INDIA", "INDONESIA", "JAPAN", "VIETNAM"),
    "EUROPE": ("FRANCE", "GERMANY", "ROMANIA", "RUSSIA", "UNITED KINGDOM"),
    "MIDDLE EAST": ("EGYPT", "IRAN", "IRAQ", "JORDAN", "SAUDI ARABIA"),
}
FINISHES = ("ANODIZED", "BURNISHED", "PLATED", "POLISHED", "BRUSHED")
METALS = ("TIN", "NICKEL", "BRASS", "STEEL", "COPPER")
REGIONS = tuple(NATIONS)


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _nation(key: Column) -> Column:
    flat = tuple(NATIONS[r][j] for j in range(5) for r in REGIONS)  # key k: region k % 5, its nation k // 5
    return _pick(flat, key)


def _div(x: Column, n: int) -> Column:
    return F.floor(x / n)


def _shift(day: Column) -> Column:
    return F.date_sub(F.to_date(day), SHIFT_DAYS)


def _brand_number(brand: Column) -> Column:
    return F.substring(brand, 7, 4).cast("int")


class Tables(dict):
    """Tables that are opened when a plan asks for them; values are functions
    without arguments, or tables."""

    def __getitem__(self, name: str) -> DataFrame:
        made = super().__getitem__(name)
        if callable(made) and not isinstance(made, DataFrame):
            self[name] = made = made()
        return made

    def __or__(self, other: dict) -> Tables:
        return Tables(dict(self.items()) | dict(other.items()))


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tpch(spark: SparkSession, sf_dir: str, idle_customers: bool = False) -> Tables:
    """lineitem, orders, customer, part, supplier, partsupp, nation, region.

    idle_customers: as in TPC-H, every third customer has no orders, which Q13
    counts; only the TPC-H plans ask for it."""
    read = lambda name: raw(spark, sf_dir, name)
    b = lambda: _brand_number(F.col("p_brand"))
    return Tables({
        "lineitem": lambda: read("lineitem").withColumns(in_hundredths(("l_quantity", "l_extendedprice", "l_discount", "l_tax")) | {"l_shipdate": _shift(F.col("l_shipdate"))}),
        "orders": lambda: (read("orders").where(F.col("o_custkey") % 3 != 0) if idle_customers else read("orders")).withColumns({
            "o_orderdate": _shift(F.col("o_orderdate")),
            "o_shippriority": F.lit(0),
            "o_comment": F.when(F.col("o_orderkey") % 50 == 7, "the special big requests").otherwise("requests special"),
        }),
        "customer": lambda: read("customer"),
        "part": lambda: read("part").withColumns({
            "p_brand": F.concat(F.lit("Brand#"), (_div(b() - 1, 5) + 1).cast("string"), ((b() - 1) % 5 + 1).cast("string")),
            "p_type": F.concat_ws(" ", "p_type", _pick(FINISHES, _div(F.col("p_partkey"), 6) % 5), _pick(METALS, _div(F.col("p_partkey"), 30) % 5)),
        }),
        "supplier": lambda: read("supplier").withColumn("s_comment", F.when(F.col("s_suppkey") % 10 == 7, "x Customer y Complaints z").otherwise("x Complaints Customer")),
        "partsupp": lambda: read("lineitem").select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).distinct(),
        "nation": lambda: read("nation").withColumn("n_name", _nation(F.col("n_nationkey"))),
        "region": lambda: read("region").withColumn("r_name", _pick(REGIONS, F.col("r_regionkey"))),
    })


LINEORDER = ("lo_orderkey", "lo_custkey", "lo_partkey", "lo_suppkey", "lo_orderdate", "lo_quantity", "lo_extendedprice", "lo_discount", "lo_revenue", "lo_supplycost")


def priced(df: DataFrame) -> DataFrame:
    """lineorder's columns that are made from its others."""
    price, qty, disc = F.col("lo_extendedprice"), F.col("lo_quantity"), F.col("lo_discount")
    return df.withColumns({"lo_revenue": F.floor(price * (100 - disc) / 100), "lo_supplycost": F.floor(price * 6 / (qty * 10))})


def ssb(spark: SparkSession, sf_dir: str) -> Tables:
    """lineorder, customer, supplier, part, date; lines and sales, which
    lineorder is a join of."""

    def place(df: DataFrame, p: str, key: str) -> DataFrame:
        nation = _nation(F.col(f"{p}_nationkey"))
        digit = F.when(F.col(key) % 3 == 0, "1").when(F.col(key) % 3 == 1, "5").otherwise((F.col(key) % 10).cast("string"))
        return df.select(key, nation.alias(f"{p}_nation"), _pick(REGIONS, F.col(f"{p}_nationkey") % 5).alias(f"{p}_region"), F.concat(F.rpad(F.substring(nation, 1, 9), 9, " "), digit).alias(f"{p}_city"))

    read = lambda name: raw(spark, sf_dir, name)

    def part() -> DataFrame:
        b = _brand_number(F.col("p_brand"))
        mfgr = F.concat(F.lit("MFGR#"), (_div(b - 1, 5) + 1).cast("string"))
        category = F.concat(mfgr, ((b - 1) % 5 + 1).cast("string"))
        return read("part").select("p_partkey", mfgr.alias("p_mfgr"), category.alias("p_category"), F.concat(category, (_div(F.col("p_partkey"), 25) % 40 + 1).cast("string")).alias("p_brand1"))

    def dates() -> DataFrame:
        days = spark.range(2557).select(F.date_add(F.lit("1992-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
        return days.select(
            yyyymmdd(F.col("day")).alias("d_datekey"), F.year("day").alias("d_year"), (F.year("day") * 100 + F.month("day")).alias("d_yearmonthnum"),
            F.date_format("day", "MMMyyyy").alias("d_yearmonth"), (_div(F.dayofyear("day") - 1, 7) + 1).cast("int").alias("d_weeknuminyear"),
        )

    def lines() -> DataFrame:
        return read("lineitem").select(
            F.col("l_orderkey").alias("lo_orderkey"), F.col("l_partkey").alias("lo_partkey"), F.col("l_suppkey").alias("lo_suppkey"), F.round("l_quantity").cast("long").alias("lo_quantity"),
            hundredths(F.col("l_extendedprice")).alias("lo_extendedprice"), hundredths(F.col("l_discount")).alias("lo_discount"),
        )

    def sales() -> DataFrame:
        return read("orders").select("o_orderkey", F.col("o_custkey").alias("lo_custkey"), yyyymmdd(_shift(F.col("o_orderdate"))).alias("lo_orderdate"))

    return Tables({
        "lines": lines,
        "sales": sales,
        "lineorder": lambda: priced(lines().join(sales(), F.col("lo_orderkey") == F.col("o_orderkey"))).select(*LINEORDER),
        "customer": lambda: place(read("customer"), "c", "c_custkey"),
        "supplier": lambda: place(read("supplier"), "s", "s_suppkey"),
        "part": part,
        "date": dates,
    })


def sql(idle_customers: bool = False) -> str:
    """The same tables as DuckDB CTEs, named t_* (TPC-H) and s_* (SSB)."""
    flat = [NATIONS[r][j] for j in range(5) for r in REGIONS]
    lst = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    bn = "CAST(substr(p_brand, 7) AS INTEGER)"
    day = lambda c: f"(CAST({c} AS DATE) - {SHIFT_DAYS})"
    cents = lambda c: f"CAST(round({c} * 100) AS BIGINT)"
    place = lambda t, p, key: f"""SELECT {key}, {lst(flat)}[{p}_nationkey + 1] AS {p}_nation, {lst(REGIONS)}[{p}_nationkey % 5 + 1] AS {p}_region,
      rpad(substr({lst(flat)}[{p}_nationkey + 1], 1, 9), 9, ' ') || CASE WHEN {key} % 3 = 0 THEN '1' WHEN {key} % 3 = 1 THEN '5' ELSE CAST({key} % 10 AS VARCHAR) END AS {p}_city FROM {t}"""  # noqa: E731
    return f"""WITH t_lineitem AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {cents('l_quantity')} AS l_quantity, {cents('l_extendedprice')} AS l_extendedprice, {cents('l_discount')} AS l_discount, {cents('l_tax')} AS l_tax,
      l_returnflag, l_linestatus, {day('l_shipdate')} AS l_shipdate FROM lineitem),
    t_orders AS (SELECT * REPLACE ({day('o_orderdate')} AS o_orderdate), 0 AS o_shippriority, CASE WHEN o_orderkey % 50 = 7 THEN 'the special big requests' ELSE 'requests special' END AS o_comment FROM orders{' WHERE o_custkey % 3 <> 0' if idle_customers else ''}),
    t_part AS (SELECT * REPLACE ('Brand#' || ((({bn}) - 1) // 5 + 1) || ((({bn}) - 1) % 5 + 1) AS p_brand, p_type || ' ' || {lst(FINISHES)}[(p_partkey // 6) % 5 + 1] || ' ' || {lst(METALS)}[(p_partkey // 30) % 5 + 1] AS p_type) FROM part),
    t_supplier AS (SELECT *, CASE WHEN s_suppkey % 10 = 7 THEN 'x Customer y Complaints z' ELSE 'x Complaints Customer' END AS s_comment FROM supplier),
    t_partsupp AS (SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem),
    t_nation AS (SELECT * REPLACE ({lst(flat)}[n_nationkey + 1] AS n_name) FROM nation),
    t_region AS (SELECT * REPLACE ({lst(REGIONS)}[r_regionkey + 1] AS r_name) FROM region),
    s_customer AS ({place('customer', 'c', 'c_custkey')}),
    s_supplier AS ({place('supplier', 's', 's_suppkey')}),
    s_part AS (SELECT p_partkey, 'MFGR#' || (({bn} - 1) // 5 + 1) AS p_mfgr, 'MFGR#' || (({bn} - 1) // 5 + 1) || (({bn} - 1) % 5 + 1) AS p_category,
      'MFGR#' || (({bn} - 1) // 5 + 1) || (({bn} - 1) % 5 + 1) || ((p_partkey // 25) % 40 + 1) AS p_brand1 FROM part),
    s_date AS (SELECT year(d) * 10000 + month(d) * 100 + day(d) AS d_datekey, year(d) AS d_year, year(d) * 100 + month(d) AS d_yearmonthnum, strftime(d, '%b%Y') AS d_yearmonth, (dayofyear(d) - 1) // 7 + 1 AS d_weeknuminyear
      FROM (SELECT CAST(x AS DATE) AS d FROM range(DATE '1992-01-01', DATE '1999-01-01', INTERVAL 1 DAY) r(x))),
    s_lineorder AS (SELECT l_orderkey AS lo_orderkey, o_custkey AS lo_custkey, l_partkey AS lo_partkey, l_suppkey AS lo_suppkey,
      year({day('o_orderdate')}) * 10000 + month({day('o_orderdate')}) * 100 + day({day('o_orderdate')}) AS lo_orderdate, CAST(round(l_quantity) AS BIGINT) AS lo_quantity, {cents('l_extendedprice')} AS lo_extendedprice, {cents('l_discount')} AS lo_discount,
      {cents('l_extendedprice')} * (100 - {cents('l_discount')}) // 100 AS lo_revenue, {cents('l_extendedprice')} * 6 // (10 * CAST(round(l_quantity) AS BIGINT)) AS lo_supplycost
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    """
