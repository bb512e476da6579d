"""Every query of the engine proper against its oracle in DuckDB."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lakemill.plans import registry
from lakemill.verify import compare
from tests.conftest import MID, SMALL

TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()
NAMES = sorted(registry.oracles())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_against_oracle(spark, duck, name):
    want = duck.sql(registry.oracles()[name])
    df = registry.queries()[name](spark, SMALL)
    assert compare(df, want.columns, want.fetchall()) == []


def test_anchors(spark):
    """Row counts and scalars that were measured apart from this code."""
    q = registry.queries()
    rows = {"tpch_q1": 6, "tpch_q3": 841, "tpch_q5": 5, "tpch_q13": 23, "tpch_q16": 317, "ssb_q21": 224, "ssb_q22": 42, "ssb_q31": 149, "ssb_q33": 6, "ssb_q34": 0, "ssb_q42": 89}
    assert {k: q[k](spark, MID).count() for k in rows} == rows
    assert q["tpch_q6"](spark, MID).first()[0] == 3652441.1856
    assert [q[f"ssb_q1{k}"](spark, MID).first()[0] for k in (1, 2, 3)] == [12967086011, 1005136731, 677873063]


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracles())


def test_imports_without_session_and_without_training_operators():
    root = Path(__file__).resolve().parent.parent
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("lakemill.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 60 and not any(k == "pipeline" or k[:2] == "op" and k[2].isdigit() for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env=os.environ | {"PYTHONPATH": str(root)})


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6


def test_workers_import_the_package_from_any_folder(tmp_path):
    """As a driver would that only puts this folder on its own path."""
    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
assert e.queries()["scan_checksum_text"](spark, {SMALL!r}).count() == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env)
