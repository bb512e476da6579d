"""Zone maps: min and max per chunk of a table, and pruning with them.

A chunk is a range of a key (key div rows), so that chunk numbers are the same
in every run. A zone map may also hold attributes of dimensions that the fact
table reaches by foreign keys ("sideways"): the table is denormalised first,
and facts are then pruned by a dimension's filter before any join.

Pruning never changes a result: it drops chunks that cannot hold a row, and the
row filter still runs. A chunk without statistics (all null) is kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many ranges of active chunks become a filter that reaches the scan;
#: beyond, the active chunks are joined.
MAX_RANGES = 256


@dataclass(frozen=True)
class Between:
    """lo <= column <= hi; None leaves an end open. hi_open: column < hi."""

    column: str
    lo: Any = None
    hi: Any = None
    hi_open: bool = False

    def rows(self) -> Column:
        c = F.col(self.column)
        low = F.lit(True) if self.lo is None else c >= F.lit(self.lo)
        high = F.lit(True) if self.hi is None else (c < F.lit(self.hi) if self.hi_open else c <= F.lit(self.hi))
        return low & high

    def chunks(self) -> Column:
        """Whether a chunk's range overlaps; unknown ranges do."""
        lo, hi = F.col(f"min_{self.column}"), F.col(f"max_{self.column}")
        low = F.lit(True) if self.lo is None else hi >= F.lit(self.lo)
        high = F.lit(True) if self.hi is None else (lo < F.lit(self.hi) if self.hi_open else lo <= F.lit(self.hi))
        return F.coalesce(low & high, F.lit(True))


def point(column: str, value: Any) -> Between:
    return Between(column, value, value)


def chunk_of(key: str, rows: int) -> Column:
    return F.floor(F.col(key) / rows).cast("long")


def build(df: DataFrame, key: str, rows: int, *columns: str) -> DataFrame:
    """chunk_id, n_rows, and min_c, max_c of each column. One partial sum per
    chunk leaves each task."""
    stats = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(chunk_of(key, rows).alias("chunk_id")).agg(F.count(F.lit(1)).alias("n_rows"), *stats)


def evaluate(zonemap: DataFrame, *predicates: Between) -> DataFrame:
    """The zone map with `active`: all predicates may hold in the chunk."""
    return zonemap.withColumn("active", reduce(Column.__and__, (p.chunks() for p in predicates), F.lit(True)))


def active_chunks(zonemap: DataFrame, *predicates: Between) -> DataFrame:
    return evaluate(zonemap, *predicates).where("active").select("chunk_id")


def pruning_report(zonemap: DataFrame, *predicates: Between) -> DataFrame:
    return evaluate(zonemap, *predicates).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.when(F.col("active"), 0).otherwise(1)).alias("chunks_pruned"),
        F.sum("n_rows").alias("all_rows"), F.coalesce(F.sum(F.when(F.col("active"), F.col("n_rows"))), F.lit(0)).alias("rows_scanned"),
    )


def active_ranges(zonemap: DataFrame, *predicates: Between, most: int = MAX_RANGES) -> list[tuple[int, int]] | None:
    """Runs of neighbouring active chunks, first and last; None if over `most`.

    A range begins where the chunk before is not active, so only the ends of
    ranges, at most 2 * (most + 1) rows, come to the driver."""
    on = active_chunks(zonemap, *predicates)
    before = on.select((F.col("chunk_id") + 1).alias("chunk_id"))
    after = on.select((F.col("chunk_id") - 1).alias("chunk_id"))
    firsts = sorted(r[0] for r in on.join(before, "chunk_id", "left_anti").limit(most + 1).collect())
    if len(firsts) > most:
        return None
    lasts = sorted(r[0] for r in on.join(after, "chunk_id", "left_anti").collect())
    return list(zip(firsts, lasts))


def scan(df: DataFrame, key: str, rows: int, zonemap: DataFrame, *predicates: Between) -> DataFrame:
    """The rows of df that meet the predicates, from active chunks only.

    Few ranges of chunks become ranges of the key, which Parquet skips row
    groups by; many are a semi join on the chunk."""
    ranges = active_ranges(zonemap, *predicates)
    rest = reduce(Column.__and__, (p.rows() for p in predicates), F.lit(True))
    if ranges is None:
        active = active_chunks(zonemap, *predicates)
        return df.withColumn("_chunk", chunk_of(key, rows)).join(active.withColumnRenamed("chunk_id", "_chunk"), "_chunk", "left_semi").drop("_chunk").where(rest)
    inside = reduce(Column.__or__, (F.col(key).between(a * rows, (b + 1) * rows - 1) for a, b in ranges), F.lit(False))
    return df.where(inside & rest)
