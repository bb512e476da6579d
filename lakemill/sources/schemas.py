"""Declared schemas of the TPC-H and SSB tables (fixed values).

Each line is a table: its name, then its columns and types.
"""

from __future__ import annotations

MONEY = "decimal(15,2)"

TPCH = {
    "lineitem": f"l_orderkey long, l_partkey int, l_suppkey int, l_linenumber long, l_quantity {MONEY}, l_extendedprice {MONEY}, l_discount {MONEY}, l_tax {MONEY}, l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string",
    "orders": f"o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice {MONEY}, o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "customer": f"c_custkey long, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal {MONEY}, c_mktsegment string, c_comment string",
    "part": f"p_partkey int, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice {MONEY}, p_comment string",
    "supplier": f"s_suppkey int, s_name string, s_address string, s_nationkey int, s_phone string, s_acctbal {MONEY}, s_comment string",
    "partsupp": f"ps_partkey int, ps_suppkey int, ps_availqty int, ps_supplycost {MONEY}, ps_comment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int, n_comment string",
    "region": "r_regionkey int, r_name string, r_comment string",
}

SSB = {
    "lineorder": "lo_orderkey long, lo_linenumber int, lo_custkey int, lo_partkey int, lo_suppkey int, lo_orderdate int, lo_orderpriority string, lo_shippriority string, lo_quantity int, lo_extendedprice long, lo_ordtotalprice long, lo_discount int, lo_revenue long, lo_supplycost int, lo_tax int, lo_commitdate int, lo_shipmode string",
    "customer": "c_custkey int, c_name string, c_address string, c_city string, c_nation string, c_region string, c_phone string, c_mktsegment string",
    "supplier": "s_suppkey int, s_name string, s_address string, s_city string, s_nation string, s_region string, s_phone string",
    "part": "p_partkey int, p_name string, p_mfgr string, p_category string, p_brand1 string, p_color string, p_type string, p_size int, p_container string",
    "date": "d_datekey int, d_date string, d_dayofweek string, d_month string, d_year int, d_yearmonthnum int, d_yearmonth string, d_daynuminweek int, d_daynuminmonth int, d_daynuminyear int, d_monthnuminyear int, d_weeknuminyear int, d_sellingseason string, d_lastdayinweekfl int, d_lastdayinmonthfl int, d_holidayfl int, d_weekdayfl int",
}
