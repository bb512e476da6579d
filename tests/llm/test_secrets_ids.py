"""Secrets in rows without an id."""

from lakemill.llm import secrets


def test_null_ids(spark):
    live, example = "ghp_" + "aB3dE5gH7jK9" * 3, "ghp_" + "zY8xW6vU4tS2" * 3
    rows = [(None, f"a {live}", "a"), (None, f"b {example}", "a"), (2, f"{example}", "b"), (3, f"c {example}", "c"), (None, "password=hunter22", "d"), (None, "none", "a"), (None, None, None)]
    got = {r.base[0]["match"] if r.base else (r.spans[0]["match"] if r.spans else r.n_copied): (r.n_live, r.n_copied) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id IS NULL").collect()}
    assert got == {live: (1, 0), 1: (0, 1), "password=hunter22": (1, 0), 0: (0, 0)}
