"""Mixing sources to target weights.

Sources are ordered by code point (null last) and weigh 5, 2, 1, repeating.
They share the total size by weight; no target exceeds `most` times its
source's size, and what a capped source leaves is reshared by weight among the
others. That fixed point is found directly: with sources sorted by size over
weight, the capped ones come first, and one level (share per unit of weight)
holds for the rest.

A document is taken floor(rate) times, rate = target / source size, and once
more if its hash, read as a number in [0, 1), is below the rate's fraction.
The hash has `SEEDS` independent seeds, and each source uses the one whose sum
comes nearest to its target, so that small sources come near theirs as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import stage
from lakemill.operators.ordering import before

WEIGHTS = (5, 2, 1)
SEEDS = 16
_RANGE = 1 << 32


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _draws(doc_id: Column) -> list[Column]:
    """SEEDS numbers in [0, 2^32) for each id: 8 from each SHA-256."""
    out = []
    for salt in range(SEEDS // 8):
        digest = F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{salt}")), 256)
        out += [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(8)]
    return out


def targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size), one row a source, to that and target, rate.

    Sources may be as many as web domains: places and sums in their orders are
    made by ranges, and what comes to the driver is one row."""
    by_name = ("no_name", "source")
    s = before(sources.withColumn("no_name", F.col("source").isNull()), by_name, F.lit(1), "place")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("long")
    s = s.select("source", "no_name", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    # From the source that meets its cap first to the one that would last.
    s = stage(s.withColumn("fill", F.col("cap").cast("double") / F.col("weight")), "sources")
    order = ("fill", *by_name)
    lower = before(before(s, order, F.col("cap"), "caps"), order, F.col("weight"), "weights", "all_weights")
    total = s.agg(F.sum("source_size")).first()[0]
    level = (F.lit(total) - F.col("caps")).cast("double") / (F.col("all_weights") - F.col("weights"))
    held = level * F.col("weight") <= F.col("cap")
    # The first source below its cap sets the level of all that are.
    first = lower.where(held).agg(F.min(F.struct("fill", level.alias("level"))).alias("x")).select("x.level").first()
    cap = F.col("cap").cast("double")
    target = F.least(F.lit(first.level) * F.col("weight"), cap) if first and first.level is not None else cap
    return s.select("source", "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3) -> DataFrame:
    """docs with size, source_size, target, copies (bigint) for each row.

    Null text has size 0, texts of any length count whole; null source is a
    source of its own, the last. Of seeds that come equally near the first is
    used. Rows with one id get the same draw, so rows without an id do, too:
    rows that repeat get the same copies. Empty table: no rows. Clashing names:
    only the three named columns are read; size, source_size, target and copies
    of docs, if any, are replaced.
    """
    kept = docs.drop("size", "source_size", "target", "copies", "mix_source", "mix_rate", "mix_seed")
    sized = kept.withColumn("size", words(F.col(text_col)))
    # The texts are counted once for both sums; the two tables of sources are
    # staged so that their size is known when rows are joined with them.
    small = stage(sized.select(F.col(source_col).alias("own"), "size", F.col(id_col).alias("id")), "sizes")
    plan = stage(targets(small.groupBy(F.col("own").alias("source")).agg(F.sum("size").alias("source_size")), most), "targets")
    part = F.col("rate") - F.floor("rate")
    taken = small.join(plan, F.col("own").eqNullSafe(F.col("source"))).select("source", "source_size", "target", "rate", "size", F.array(*_draws(F.col("id"))).alias("draws"))
    sums = [F.sum(F.when(F.col("draws")[k] < part * _RANGE, F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(SEEDS)]
    off = lambda k: F.abs(F.col(f"s{k}") - part * F.col("source_size"))
    best = F.least(*[F.struct(off(k).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)])["seed"]
    seeds = taken.groupBy("source", "source_size", "target", "rate").agg(*sums).select(F.col("source").alias("mix_source"), "source_size", "target", F.col("rate").alias("mix_rate"), best.alias("mix_seed"))
    seeds = stage(seeds, "seeds")
    part = F.col("mix_rate") - F.floor("mix_rate")
    copies = F.floor("mix_rate") + (F.array(*_draws(F.col(id_col)))[F.col("mix_seed")] < part * _RANGE).cast("long")
    return sized.join(seeds, F.col(source_col).eqNullSafe(F.col("mix_source")), "left").withColumn("copies", F.coalesce(copies, F.lit(0)).cast("long")).drop("mix_source", "mix_rate", "mix_seed")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {table}),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
b AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM a),
c AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS own FROM b),
e AS (SELECT *, arg_min(own, CAST(cap AS DOUBLE) / weight) FILTER (WHERE own * weight <= cap) OVER () AS level FROM c),
p AS (SELECT source, source_size, least(coalesce(level * weight, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM e),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM p),
h AS (SELECT d.doc_id, d.size, r.source, r.source_size, r.target, r.rate, k.k,
        CAST('0x' || substr(sha256(CAST(d.doc_id AS VARCHAR) || ':' || CAST(k.k // 8 AS VARCHAR)), CAST(8 * (k.k % 8) + 1 AS INTEGER), 8) AS BIGINT) AS draw
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source CROSS JOIN range(16) k(k)),
s AS (SELECT source, k, abs(sum(CASE WHEN draw < (rate - floor(rate)) * 4294967296 THEN size ELSE 0 END) - any_value((rate - floor(rate)) * source_size)) AS off FROM h GROUP BY source, k),
z AS (SELECT source, k FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, k) = 1)
SELECT {columns} FROM h JOIN z ON h.source IS NOT DISTINCT FROM z.source AND h.k = z.k
"""
