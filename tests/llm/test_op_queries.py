"""Every opN query on a whole table: its columns, one row a document, and its
digests against brute force."""

import zlib

import duckdb
import pytest

from lakemill.llm import queries
from lakemill.verify import compare
from tests.conftest import SMALL
from tests.llm import test_decontaminate, test_license_scan, test_mix, test_quality_lines, test_simhash, test_substring_dedup
from tests.llm.corpus import sha, space_words

COLUMNS = {
    "op1_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op2_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op3_html_extract": "page_id bigint, url string, text string, n_chars bigint",
    "op4_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op5_quality_lines": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op7_shard": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op10_simhash": "doc_id bigint, fingerprint string, component_id bigint",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, docs, name):
    df = queries.QUERIES[name](spark, SMALL)
    want = COLUMNS[name].split(", ")
    assert [f"{c} {t}" for c, t in df.dtypes][: len(want)] == want
    key = want[0].split()[0]
    ids = [r[0] for r in df.select(key).collect()]
    assert len(ids) == len(set(ids)) and (key == "page_id" or sorted(ids) == [d.doc_id for d in docs])


def test_every_operator_has_a_query():
    assert set(COLUMNS) == set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    want = con.sql(queries.oracles()[name])
    assert compare(queries.QUERIES[name](spark, SMALL), want.columns, want.fetchall()) == []


def test_digests_against_brute_force(spark, docs):
    run = lambda name: {r[0]: tuple(r)[1:] for r in queries.QUERIES[name](spark, SMALL).collect()}
    pairs = [(d.doc_id, d.text) for d in docs]
    text = dict(pairs)
    dedup = test_substring_dedup.brute(pairs)
    assert run("op1_substring_dedup") == {k: (n, m, sha(t)) for k, (n, m, t) in dedup.items()}
    for k, r in run("op4_license_scan").items():
        assert r[:5] == test_license_scan.brute(text[k])
    for k, r in run("op5_quality_lines").items():
        assert r[:6] == test_quality_lines.brute(text[k])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert run("op6_decontaminate") == test_decontaminate.brute(pairs, items)
    for k, r in run("op7_shard").items():
        assert r[:2] == (len(text[k].encode()) + 8, zlib.crc32(text[k].encode()))
    copies = test_mix.brute([(d.doc_id, d.source, len(space_words(d.text))) for d in docs])
    assert {k: r[3] for k, r in run("op8_mix").items()} == {k: n * len(space_words(text[k])) for k, n in copies.items()}
    fps = {k: test_simhash.fingerprint(t) for k, t in pairs}
    of = test_simhash.classes(list(fps), list(fps.values()))
    assert run("op10_simhash") == {k: (f"{fps[k]:016x}", of[k]) for k in fps}
