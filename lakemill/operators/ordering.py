"""Places in the order of a table without a task that sorts all of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64
#: Keys that tell where buckets begin; the bounds decide balance, not results.
SAMPLE = 2048


def before(rows: DataFrame, keys: tuple[str, ...], weight: Column, name: str, total: str | None = None) -> DataFrame:
    """rows, one for each key, with the sum of weight over all smaller keys
    (nulls first) and, if named, over all keys.

    Rows go to ranges of the key, whose bounds come from a bounded sample by
    hash, and are summed within them; each range begins at the sum of those
    before it."""
    rows = rows.withColumn("_w", weight)
    key = F.struct(*keys)
    drawn = rows.select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(SAMPLE)
    bounds = drawn.orderBy(*[F.asc_nulls_first(k) for k in keys]).collect()[:: SAMPLE // BUCKETS][1:]
    kinds = [rows.schema[k].dataType for k in keys]
    literals = [F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, b, kinds)]) for b in bounds]
    at = F.size(F.filter(F.array(*literals), lambda b: b <= key)) if literals else F.lit(0)
    rows = rows.withColumn("_bucket", at)
    sums = rows.groupBy("_bucket").agg(F.sum("_w").alias("_t"))  # at most BUCKETS rows
    order = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_bucket", F.coalesce(F.sum("_t").over(order), F.lit(0)).alias("_start"), F.sum("_t").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_inside", F.coalesce(F.sum("_w").over(inside), F.lit(0))).join(starts, "_bucket").withColumn(name, F.col("_start") + F.col("_inside"))
    if total:
        out = out.withColumn(total, F.col("_all"))
    return out.drop("_w", "_bucket", "_inside", "_start", "_all")


def same(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> Column:
    """The join condition of equal keys, null with null."""
    return reduce(Column.__and__, (left[k].eqNullSafe(right[k]) for k in keys))
