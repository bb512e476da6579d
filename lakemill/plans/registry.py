"""Every query of the engine proper, with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakemill.plans import slices, ssb, tpch
from lakemill.sources import fixture

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for k, plan in tpch.plans().items():
        out[k] = lambda spark, d, plan=plan: plan(fixture.tpch(spark, d, idle_customers=True))
    for k, plan in ssb.plans().items():
        out[k] = lambda spark, d, plan=plan: plan(fixture.ssb(spark, d))
    return out | slices.plans()


def oracles() -> dict[str, str]:
    prelude = fixture.sql(idle_customers=True)
    return {k: prelude + q for k, q in (tpch.oracles() | ssb.oracles()).items()} | slices.oracles()
