"""The corpus pipeline: from raw documents to a mixed, sharded training set.

Every stage works on all rows that the one before kept, and all but the last
return the columns of `documents`. A stage's result is a Parquet table in the
shared folder, which the next stage reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm.common import Scratch, discard, stage, table
from lakemill.llm.decontaminate import decontaminate
from lakemill.llm.mix import mix
from lakemill.llm.quality_lines import NEW, judge
from lakemill.llm.shard import shard
from lakemill.llm.similar import semi
from lakemill.llm.simhash import near_groups


def _beside(docs: DataFrame, step: Callable[[DataFrame], DataFrame], *used: str) -> DataFrame:
    """step(docs), with the columns of docs as they were: those that share a
    name with a column that the step makes are set aside meanwhile."""
    aside = {c: f"_own_{k}" for k, c in enumerate(docs.columns) if c.lower() in used}
    out = step(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the line marks reject go.

    Null and empty texts have no words and go. Every row is judged by its whole
    text, of any length, so repeated rows go or stay alike, and ids, null or
    not, play no part. A content share that equals the least one stays. Empty
    table: no rows. Columns of any name come through as they were."""
    return _beside(docs, lambda d: judge(d, table(spark, sf_dir, "labels")).where("kept"), *NEW)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 of their five-word shingles
    one row stays: that of the smallest id, null ids last, and of rows that
    repeat with that id any one.

    Null, empty and blank texts are one group. Texts of any length are compared
    whole. Empty table: no rows. Columns of any name come through as they were."""
    number = "_row" + "_" * max(map(len, docs.columns))  # no column's name
    rows = stage(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("x")
    kept = stage(near_groups(rows, number).groupBy("root").agg(best).select(F.col("x.row").alias(number)), "kept")
    return semi(rows, kept, number).select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay. Every row is searched by itself in
    its whole text, of any length; repeated rows go or stay alike, and ids, null
    or not, play no part. Empty table or benchmark: nothing goes. Columns of any
    name come through as they were."""
    return _beside(docs, lambda d: decontaminate(d, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")), "n_words", "hit_words", "hit_items", "contaminated")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks.

    Null and empty texts have size 0 and are drawn as others are; a null source
    is a source of its own. Texts of any length count whole. Rows with one id,
    or without, get the same draw. Empty table: no rows. Columns of any name
    come through as they were."""
    repeat = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    return _beside(docs, lambda d: mix(d).where("copies > 0").withColumn("_copy", repeat), "size", "source_size", "target", "copies", "mix_source", "mix_rate", "mix_seed")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a place in it for every row: equal texts in one shard, null
    and empty ones with them, repeated rows and rows without an id in places of
    their own. Texts of any length count whole, groups of equal size go in order
    of their hash. Empty table: no rows. Other columns stay behind."""
    return shard(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicate_removal),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
    ("sharding", sharding),
]

#: Line labelling and fingerprints are beyond SQL; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return step(spark, docs, sf_dir)
        with Scratch() as made:
            done = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
            made.clear(done)  # what the step staged on its way
        discard(docs)
        docs = done
