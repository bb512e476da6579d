"""Command line: `python -m lakemill.cli query|verify|load|sort|histogram|checksum`.

query runs one TPC-H or SSB plan over a folder of tables and prints rows as
text or one JSON line with its times; verify compares a saved result with a
golden answer; load turns .tbl files into Parquet; sort
writes denormalised, sorted fact files; histogram and checksum scan a column.
"""

from __future__ import annotations

import argparse
import json
import statistics
import sys
import time
from collections.abc import Iterator
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lakemill.functions import text
from lakemill.operators import layout
from lakemill.operators.zonemap import Between
from lakemill.plans import ssb, tpch
from lakemill.session import session
from lakemill.sources import files, fixture
from lakemill.verify import compare_files

ZONES = 64
TPCH = {"q1": tpch.q1, "q3": tpch.q3, "q5": tpch.q5, "q6": tpch.q6, "q13": tpch.q13, "q16": tpch.q16}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakemill", description=__doc__)
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query")
    q.add_argument("name", help="q1 q3 q5 q6 q13 q16 revenue q3sel, or q11..q43 and revenue with --ssb")
    q.add_argument("path")
    q.add_argument("--ssb", action="store_true")
    q.add_argument("--format", choices=("parquet", "tbl", "fixture"), default="parquet")
    q.add_argument("--since", help="first day (SSB: yyyymmdd)")
    q.add_argument("--until", help="day after the last (SSB: the last, yyyymmdd)")
    q.add_argument("--quantity", type=int, default=None, help="quantity bound without other filters; 0 for none")
    q.add_argument("--selectivity", type=int, default=20, help="of q3sel, in percent")
    q.add_argument("--no-other-filters", action="store_true")
    q.add_argument("--sideways", action="store_true", help="denormalise facts and prune them by dimension attributes")
    q.add_argument("-Z", "--zones", action="store_true", help="read a sorted copy of lineitem through its zone map (q6, revenue, q1); made once for the files")
    q.add_argument("--limit", type=int, default=None)
    q.add_argument("--show", type=int, default=10_000, help="rows to print at most")
    q.add_argument("--trials", type=int, default=1)
    q.add_argument("--output", choices=("text", "json"), default="text")
    q.add_argument("--save", help="also write the result as delimited text")
    v = sub.add_parser("verify")
    v.add_argument("result")
    v.add_argument("answer")
    v.add_argument("--relative", type=float, default=0.0, help="relative tolerance of numbers")
    v.add_argument("--last-digit", type=int, default=None, help="numbers may be off by one in this decimal place")
    load = sub.add_parser("load")
    load.add_argument("source")
    load.add_argument("target")
    load.add_argument("--ssb", action="store_true")
    load.add_argument("--tables", nargs="*")
    load.add_argument("--codec", default="zstd", choices=("zstd", "snappy", "lz4", "gzip", "none"))
    s = sub.add_parser("sort")
    s.add_argument("source")
    s.add_argument("target")
    s.add_argument("--ssb", action="store_true")
    s.add_argument("--files", type=int, default=64)
    for name in ("histogram", "checksum"):
        h = sub.add_parser(name)
        h.add_argument("path", help="a Parquet table")
        h.add_argument("columns", nargs="+")
    return p


def tables(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    if a.format == "fixture":
        return fixture.ssb(spark, a.path) if a.ssb else fixture.tpch(spark, a.path, idle_customers=True)
    read = files.read_tables(spark, a.path, a.ssb, a.format)
    return read if a.ssb else files.plan_tables(read)


def plan(a: argparse.Namespace, t: dict[str, DataFrame]) -> DataFrame:
    others = not a.no_other_filters
    if a.sideways and (a.ssb or a.name in ("q3", "q3sel", "q5")):  # plans that join facts with dimensions
        t = t | ({"lineorder": layout.wide_lineorder(t)} if a.ssb else {"lineitem": layout.wide_lineitem(t), "orders": layout.wide_orders(t)})
    if a.ssb:
        if a.name == "revenue":
            return ssb.revenue(t, int(a.since or 19930101), int(a.until or 19931231), a.quantity or 0, others)
        return ssb.plans()[f"ssb_{a.name}"](t)
    days = {k: date.fromisoformat(v) for k, v in (("since", a.since), ("until", a.until)) if v}
    if a.zones and a.name in ("q1", "q6", "revenue"):
        since, until = (None, date(1998, 9, 3)) if a.name == "q1" else (days.get("since", date(1994, 1, 1)), days.get("until", date(1995, 1, 1)))
        line = t["lineitem"]
        zoned = layout.zones(line.sparkSession, "lineitem", a.path, lambda: line, ZONES, ("l_shipdate",), "l_shipdate")
        t = t | {"lineitem": zoned.scan(Between("l_shipdate", since, until, True))}
    if a.name == "q3sel":
        return tpch.q3sel(t, a.selectivity, others)
    if a.name == "revenue":
        return tpch.revenue(t, quantity=51 if a.quantity is None else a.quantity, other_filters=others, **days)
    if a.name in ("q5", "q6"):
        return TPCH[a.name](t, **days)
    return tpch.q3(t, limit=a.limit) if a.name == "q3" else TPCH[a.name](t)


def _scans(node: Any) -> Iterator[Any]:
    """The file scans of an executed plan, a node of the JVM."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _scans(node.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from _scans(node.plan())
    elif name == "FileSourceScanExec":
        yield node
    elif name != "ReusedExchangeExec":
        children = node.children()
        for k in range(children.size()):
            yield from _scans(children.apply(k))


def scan_metrics(df: DataFrame) -> dict[str, int]:
    """What the scans of a plan that has run read: files, bytes, rows."""
    found = [{m: int(scan.metrics().apply(m).value()) for m in ("numFiles", "filesSize", "numOutputRows")} for scan in _scans(df._jdf.queryExecution().executedPlan())]
    total = lambda m: sum(f[m] for f in found)
    return {"files": total("numFiles"), "read_mb": total("filesSize") / 2**20, "rows": total("numOutputRows")}


def run_query(spark: SparkSession, a: argparse.Namespace) -> None:
    """Runs a plan and shows at most --show rows, all that comes to the driver;
    a saved result is written whole, by its tasks."""
    seconds = []
    for _ in range(a.trials):
        began = time.perf_counter()
        df = plan(a, tables(spark, a)).limit(a.show)
        rows = df.collect()
        seconds.append(time.perf_counter() - began)
    if a.save:
        files.write_result(plan(a, tables(spark, a)), a.save)
    if a.output == "json":
        times = {"avg": statistics.fmean(seconds), "min": min(seconds), "max": max(seconds), "std": statistics.pstdev(seconds)}
        read = scan_metrics(df)
        read["mb_per_second"] = read["read_mb"] / times["avg"]
        print(json.dumps({"query": a.name, "rows": len(rows), "seconds": times, "scan": read, "result": [r.asDict() for r in rows]}, default=str))
        return
    print("|".join(df.columns))
    for r in rows:
        print("|".join("" if v is None else str(v) for v in r))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "verify":
        found = compare_files(a.result, a.answer, a.relative, a.last_digit)
        print("\n".join(found) or "same")
        return int(bool(found))
    spark = spark or session(a.master)
    if a.command == "query":
        run_query(spark, a)
    elif a.command == "load":
        files.tbl_to_parquet(spark, a.source, a.target, a.ssb, a.codec, tuple(a.tables) if a.tables else None)
    elif a.command == "sort":
        t = files.read_tables(spark, a.source, a.ssb)
        if a.ssb:
            layout.write_sorted(layout.wide_lineorder(t), f"{a.target}/lineorder.parquet", a.files, *layout.LINEORDER_KEYS)
        else:
            layout.write_sorted(layout.wide_orders(t), f"{a.target}/orders.parquet", a.files, *layout.ORDERS_KEYS)
            layout.write_sorted(layout.wide_lineitem(t), f"{a.target}/lineitem.parquet", a.files, *layout.LINEITEM_KEYS)
    elif a.command == "histogram":
        for c in a.columns:
            for r in text.length_histogram(spark.read.parquet(a.path), c).toLocalIterator():
                print(f"{c}|{r.length}|{r.records}")
    else:
        for r in text.scan_checksum(spark.read.parquet(a.path), *a.columns).collect():
            print("|".join(map(str, r)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
