"""Single operators that the benchmark plans are made of, for tables of any
columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def semi_join(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    return df.join(other.select(right), F.col(left) == F.col(right), "left_semi")


def anti_join(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    """NOT IN over keys that are not null; null keys of `other` match nothing."""
    return df.join(other.select(right), F.col(left) == F.col(right), "left_anti")


def outer_count(df: DataFrame, key: str, other: DataFrame, other_key: str, name: str = "n") -> DataFrame:
    """Rows of `other` for each key of df, 0 where there are none. They are
    counted before the join, so a hot key is one row in it."""
    counts = other.groupBy(F.col(other_key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    return df.select(key).join(counts, F.col(key) == F.col("_key"), "left").select(key, F.coalesce("_n", F.lit(0)).alias(name))


#: Rows of one key, and bytes of one share, that a task may build a table of.
HOT_ROWS, SHARE_BYTES = 1_000_000, 64 << 20


def partitioned_hash_join(df: DataFrame, other: DataFrame, left: str, right: str, hot_rows: int = HOT_ROWS, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """Both sides are dealt by a hash of the key, and each share of `other` is
    built into a table in memory. A share that does not fit ends the job, so
    `other` is measured first: its bytes, as planned, give the number of shares,
    and rows of keys that more than hot_rows rows have, which no number of
    shares parts, are joined by a sort, which spills."""
    keys = other.groupBy(F.col(right).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select("_hot")
    is_hot = not keys.isEmpty()
    size = int(str(other._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(usual, -(-size // share_bytes)) if size < 1 << 60 else usual  # beyond: a plan without statistics
    on = F.col(left) == F.col(right)

    def cold(side: DataFrame, key: str) -> DataFrame:
        return side.join(keys, F.col(key) == F.col("_hot"), "left_anti") if is_hot else side

    out = cold(df, left).repartition(shares, left).join(cold(other, right).repartition(shares, right).hint("shuffle_hash"), on)
    if is_hot:
        hot = lambda side, key: side.join(keys, F.col(key) == F.col("_hot"), "left_semi")
        out = out.unionByName(hot(df, left).hint("merge").join(hot(other, right), on))
    return out


def distinct_count(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(column).alias(name))


def histogram_of_counts(df: DataFrame, key: str) -> DataFrame:
    """How many keys have how many rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows_per_key")).groupBy("rows_per_key").agg(F.count(F.lit(1)).alias("n_keys")).orderBy(F.desc("n_keys"), F.desc("rows_per_key"))


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of an order: each task keeps n."""
    return df.orderBy(*order).limit(n)


def sampled_ids(df: DataFrame, low: int, high: int, rows: int, seed: int = 0, random: bool = True) -> DataFrame:
    """Ids low..high - 1: in order, or drawn with a seed."""
    spark = df.sparkSession
    n = high - low
    return spark.range(rows).select((F.floor(F.rand(seed) * n).cast("long") + low if random else F.col("id") % n + low).alias("id"))
