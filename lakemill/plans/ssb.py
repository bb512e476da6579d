"""The thirteen Star Schema Benchmark plans and the revenue sweep.

Each is one star join: dimensions are filtered and cut to key and group
columns, the fact table to what is used, and the sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.functions.fixed import exact_sum
from lakemill.operators.layout import prune_sideways

Tables = dict[str, DataFrame]
KEYS = {"customer": ("lo_custkey", "c_custkey"), "supplier": ("lo_suppkey", "s_suppkey"), "part": ("lo_partkey", "p_partkey"), "date": ("lo_orderdate", "d_datekey")}


def star(t: Tables, filters: dict[str, str | None], group: tuple[str, ...], total: str, name: str, fact: str | None = None, order: tuple[str, ...] | None = None) -> DataFrame:
    """Joins lineorder with each named dimension, filtered, and sums by group.
    Filters and the total are SQL expressions.

    A dimension without group columns only has to have the key: a semi join.
    A denormalised lineorder is pruned by the filters before any join.
    Dimensions join in the order given: the most selective first."""
    out = t["lineorder"] if fact is None else t["lineorder"].where(fact)
    out = prune_sideways(out, *filters.values())
    out = out.select(*[c for c in out.columns if c.startswith("lo_")])
    for dim, where in filters.items():
        own, key = KEYS[dim]
        d = t[dim] if where is None else t[dim].where(where)
        used = [c for c in group if c in d.columns]
        out = out.join(d.select(key, *used), F.col(own) == F.col(key), "inner" if used else "left_semi")
    sums = exact_sum(F.expr(total)).cast("long").alias(name)
    if not group:
        return out.agg(sums)
    return out.groupBy(*group).agg(sums).orderBy(*[F.desc(c[1:]) if c[0] == "-" else c for c in order or group])


_q1 = "lo_extendedprice * lo_discount"
_profit = "lo_revenue - lo_supplycost"
_years = "d_year BETWEEN 1992 AND 1997"
_late = "d_year IN (1997, 1998)"
_cities = "('UNITED KI1', 'UNITED KI5')"


def _q1x(day: str, fact: str):
    return lambda t: star(t, {"date": day}, (), _q1, "revenue", fact)


def _q2x(part: str, region: str):
    return lambda t: star(t, {"part": part, "supplier": f"s_region = '{region}'", "date": None}, ("d_year", "p_brand1"), "lo_revenue", "lo_revenue")


def _q3x(places: str, day: str, level: str):
    """places: a filter on both sides' places, with {} for c or s."""
    group = (f"c_{level}", f"s_{level}", "d_year")
    return lambda t: star(t, {"supplier": places.format("s"), "customer": places.format("c"), "date": day}, group, "lo_revenue", "revenue", order=("d_year", "-revenue", *group[:2]))


def _q4x(filters: dict, group: tuple[str, ...]):
    return lambda t: star(t, filters, group, _profit, "profit")


#: The sweep's last order dates.
SWEEP = (19920701, *(y * 10000 + 1231 for y in range(1992, 1999)))


def revenue(t: Tables, since: int = 19930101, until: int = 19931231, quantity: int = 0, other_filters: bool = True) -> DataFrame:
    """Sum of price times discount over order dates since..until, both ends in.
    With other_filters: discount 1 to 3, quantity below 25. Without: quantity
    below `quantity`, 0 for 100."""
    more = "lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25" if other_filters else f"lo_quantity < {quantity or 100}"
    return t["lineorder"].where(f"lo_orderdate BETWEEN {since} AND {until} AND {more}").agg(exact_sum(F.expr(_q1)).cast("long").alias("revenue"))


def revenue_sweep(t: Tables, ends: tuple[int, ...] = SWEEP, quantity: int = 51) -> DataFrame:
    """revenue from 1992 to each end, without other filters, in one scan."""
    df = t["lineorder"].where(f"lo_orderdate BETWEEN 19920101 AND {max(ends)} AND lo_quantity < {quantity}")
    one = df.agg(*[exact_sum(F.when(F.col("lo_orderdate") <= e, F.expr(_q1))).cast("long").alias(f"r{e}") for e in ends])
    return one.select(F.explode(F.array(*[F.struct(F.lit(e).alias("lo_hi"), F.col(f"r{e}").alias("revenue")) for e in ends])).alias("x")).select("x.*")


def plans() -> dict:
    both = {"customer": "c_region = 'AMERICA'", "supplier": "s_region = 'AMERICA'"}
    mfgr, ki = "p_mfgr IN ('MFGR#1', 'MFGR#2')", f"{{}}_city IN {_cities}"
    return {
        "ssb_q11": _q1x("d_year = 1993", "lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25"),
        "ssb_q12": _q1x("d_yearmonthnum = 199401", "lo_discount BETWEEN 4 AND 6 AND lo_quantity BETWEEN 26 AND 35"),
        "ssb_q13": _q1x("d_weeknuminyear = 6 AND d_year = 1994", "lo_discount BETWEEN 5 AND 7 AND lo_quantity BETWEEN 26 AND 35"),
        "ssb_q21": _q2x("p_category = 'MFGR#12'", "AMERICA"),
        "ssb_q22": _q2x("p_brand1 BETWEEN 'MFGR#2221' AND 'MFGR#2228'", "ASIA"),
        "ssb_q23": _q2x("p_brand1 = 'MFGR#2221'", "EUROPE"),
        "ssb_q31": _q3x("{}_region = 'ASIA'", _years, "nation"),
        "ssb_q32": _q3x("{}_nation = 'UNITED STATES'", _years, "city"),
        "ssb_q33": _q3x(ki, _years, "city"),
        "ssb_q34": _q3x(ki, "d_yearmonth = 'Dec1997'", "city"),
        "ssb_q34_year": _q3x(ki, "d_year = 1997", "city"),
        "ssb_q41": _q4x({**both, "part": mfgr, "date": None}, ("d_year", "c_nation")),
        "ssb_q42": _q4x({**both, "part": mfgr, "date": _late}, ("d_year", "s_nation", "p_category")),
        "ssb_q43": _q4x({"part": "p_category = 'MFGR#14'", "supplier": "s_nation = 'UNITED STATES'", "customer": "c_region = 'AMERICA'", "date": _late}, ("d_year", "s_city", "p_brand1")),
        "ssb_revenue": revenue,
        "ssb_revenue_all_discounts": lambda t: revenue(t, 19920101, 19951231, 51, other_filters=False),
        "ssb_revenue_sweep": revenue_sweep,
    }


def oracles() -> dict[str, str]:
    join = {"c": "s_customer ON lo_custkey = c_custkey", "s": "s_supplier ON lo_suppkey = s_suppkey", "p": "s_part ON lo_partkey = p_partkey", "d": "s_date ON lo_orderdate = d_datekey"}

    def q(dims: str, where: str, group: str, total: str, name: str) -> str:
        return f"SELECT {group + ', ' if group else ''}CAST(sum({total}) AS BIGINT) AS {name} FROM s_lineorder {' '.join('JOIN ' + join[d] for d in dims)} WHERE {where}" + (f" GROUP BY {group}" if group else "")

    disc, profit = "lo_extendedprice * lo_discount", "lo_revenue - lo_supplycost"
    span, late, ki = "d_year BETWEEN 1992 AND 1997", "d_year IN (1997, 1998)", "('UNITED KI1', 'UNITED KI5')"
    am = "c_region = 'AMERICA' AND s_region = 'AMERICA' AND p_mfgr IN ('MFGR#1', 'MFGR#2')"
    q34 = lambda day: q("csd", f"c_city IN {ki} AND s_city IN {ki} AND {day}", "c_city, s_city, d_year", "lo_revenue", "revenue")
    return {
        "ssb_q11": q("d", "d_year = 1993 AND lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25", "", disc, "revenue"),
        "ssb_q12": q("d", "d_yearmonthnum = 199401 AND lo_discount BETWEEN 4 AND 6 AND lo_quantity BETWEEN 26 AND 35", "", disc, "revenue"),
        "ssb_q13": q("d", "d_weeknuminyear = 6 AND d_year = 1994 AND lo_discount BETWEEN 5 AND 7 AND lo_quantity BETWEEN 26 AND 35", "", disc, "revenue"),
        "ssb_q21": q("psd", "p_category = 'MFGR#12' AND s_region = 'AMERICA'", "d_year, p_brand1", "lo_revenue", "lo_revenue"),
        "ssb_q22": q("psd", "p_brand1 BETWEEN 'MFGR#2221' AND 'MFGR#2228' AND s_region = 'ASIA'", "d_year, p_brand1", "lo_revenue", "lo_revenue"),
        "ssb_q23": q("psd", "p_brand1 = 'MFGR#2221' AND s_region = 'EUROPE'", "d_year, p_brand1", "lo_revenue", "lo_revenue"),
        "ssb_q31": q("csd", f"c_region = 'ASIA' AND s_region = 'ASIA' AND {span}", "c_nation, s_nation, d_year", "lo_revenue", "revenue"),
        "ssb_q32": q("csd", f"c_nation = 'UNITED STATES' AND s_nation = 'UNITED STATES' AND {span}", "c_city, s_city, d_year", "lo_revenue", "revenue"),
        "ssb_q33": q34(span), "ssb_q34": q34("d_yearmonth = 'Dec1997'"), "ssb_q34_year": q34("d_year = 1997"),
        "ssb_q41": q("cspd", am, "d_year, c_nation", profit, "profit"),
        "ssb_q42": q("cspd", f"{am} AND {late}", "d_year, s_nation, p_category", profit, "profit"),
        "ssb_q43": q("cspd", f"c_region = 'AMERICA' AND s_nation = 'UNITED STATES' AND {late} AND p_category = 'MFGR#14'", "d_year, s_city, p_brand1", profit, "profit"),
        "ssb_revenue": q("", "lo_orderdate BETWEEN 19930101 AND 19931231 AND lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25", "", disc, "revenue"),
        "ssb_revenue_all_discounts": q("", "lo_orderdate BETWEEN 19920101 AND 19951231 AND lo_quantity < 51", "", disc, "revenue"),
        "ssb_revenue_sweep": " UNION ALL ".join(f"SELECT {e} AS lo_hi, CAST(sum({disc}) AS BIGINT) AS revenue FROM s_lineorder WHERE lo_orderdate BETWEEN 19920101 AND {e} AND lo_quantity < 51" for e in SWEEP),
    }
