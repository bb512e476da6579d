"""Every operator: narrow ids, repeated rows, nulls, and columns of any name
beside its own give the results of the plain table."""

import pytest
from pyspark.sql import functions as F

from lakemill.llm import decontaminate, license_scan, mix, pii, quality_lines, secrets, shard, simhash, substring_dedup
from tests.llm.corpus import SCHEMA, documents

NAMES = "grp gram grams doc owner extent windows least most fp first root component_id kept spans base more found match size bundle block shard slot law copies target draws own id source_size rate n_words n_removed n_hit hit_words hit_items contaminated kept_text labels score notices y sample_text line_marks counts value_hash repos owners one n at tab key part u v".split()


def ops(spark):
    bench = spark.createDataFrame([(1, "w1 w2 w3"), (2, None)], "item_id int, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    return {
        "substring_dedup": lambda d: substring_dedup.dedup(d),
        "pii": lambda d: pii.scan(d),
        "license_scan": lambda d: license_scan.scan(d),
        "quality_lines": lambda d: quality_lines.judge(d, labels).select("doc_id", *quality_lines.NEW),
        "decontaminate": lambda d: decontaminate.decontaminate(d, bench).select("doc_id", "n_words", "hit_words", "hit_items", "contaminated"),
        "shard": lambda d: shard.shard(d, shards=3).drop("slot"),
        "mix": lambda d: mix.mix(d).select("doc_id", "size", "source_size", "target", "copies"),
        "secrets": lambda d: secrets.scan(d),
        "simhash": lambda d: simhash.near_duplicates(d),
    }


@pytest.mark.parametrize("name", "substring_dedup pii license_scan quality_lines decontaminate shard mix secrets simhash".split())
def test_other_columns_and_narrow_ids(spark, name):
    rows = documents()[:70:2] + documents()[60:100:3] + [documents()[3]] * 2 + [(None, "null id here", None, None, None), (5, None, None, None, None)]
    plain = spark.createDataFrame(rows, SCHEMA)
    wide = plain.withColumn("doc_id", F.col("doc_id").cast("int")).withColumns({c: F.lit(f"own {c}") for c in NAMES if c not in plain.columns})
    op = ops(spark)[name]
    got, want = (sorted(map(str, (tuple(r) for r in op(d).collect()))) for d in (wide, plain))
    assert len(got) == len(rows) and got == want
