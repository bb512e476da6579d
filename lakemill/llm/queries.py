"""The opN queries: thin digests over the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.substring_dedup import dedup

    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm import pii
    from lakemill.llm.spans import joined

    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = pii.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", n("email"), n("ip"), n("card"), n("phone"), pii.digest("base").alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.html_extract import main_text

    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.license_scan import scan

    # label:first_word:last_word:errors of each notice, in order
    found = F.transform("notices", lambda n: F.concat_ws(":", n["label"], *[n[c].cast("string") for c in ("first_word", "last_word", "errors")]))
    return scan(table(spark, sf_dir, "documents")).withColumn("notices", F.array_join(found, ","))


def op5_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.quality_lines import judge

    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.decontaminate import decontaminate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.length(F.translate(F.hex("hit_words"), "0", ""))  # a hit word is the byte 01
    return found.select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), "contaminated",
    )


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.shard import shard

    return shard(table(spark, sf_dir, "documents"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.mix import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm import secrets
    from lakemill.llm.spans import joined

    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", secrets.digest("base").alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_live", "n_copied")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.simhash import as_hex, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def oracles() -> dict[str, str]:
    from lakemill.llm.mix import ORACLE

    return {
        "op1_substring_dedup": SUBSTRING_SQL,
        "op6_decontaminate": DECONTAMINATE_SQL,
        "op8_mix": ORACLE.format(table="documents", columns="h.doc_id, h.size, h.source_size, h.target, CAST(h.size * (floor(h.rate) + CASE WHEN draw < (rate - floor(rate)) * 4294967296 THEN 1 ELSE 0 END) AS BIGINT) AS taken"),
    }


SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS owner FROM win) WHERE owner < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM late, range(13) r(j)),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) x ANTI JOIN gone g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
DECONTAMINATE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS k
         FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
win AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
        FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM item) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, win.n, item_id FROM win JOIN item ON win.k = item.k AND win.n = item.n),
cover AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, range(10) r(j) WHERE j < n GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_pii, op3_html_extract, op4_license_scan, op5_quality_lines, op6_decontaminate, op7_shard, op8_mix, op9_secrets, op10_simhash)}
