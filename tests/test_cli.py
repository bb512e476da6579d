import json

import pytest

from lakemill import cli
from lakemill.plans import registry
from tests.conftest import SMALL


def run(spark, capsys, *argv):
    assert cli.main(list(argv), spark) == 0
    return capsys.readouterr().out.strip().split("\n")


@pytest.mark.parametrize("name", ["q1", "q3", "q5", "q6", "q13", "q16"])
@pytest.mark.parametrize("more", [(), ("--sideways",)])
def test_tpch(spark, capsys, name, more):
    out = run(spark, capsys, "query", name, SMALL, "--format", "fixture", "--output", "json", *more)
    want = [r.asDict() for r in registry.queries()[f"tpch_{name}"](spark, SMALL).collect()]
    assert json.loads(out[-1])["result"] == json.loads(json.dumps(want, default=str))


def test_options(spark, capsys):
    base = ("query", "revenue", SMALL, "--format", "fixture")
    plain = float(run(spark, capsys, *base)[1])
    wide = float(run(spark, capsys, *base, "--no-other-filters", "--quantity", "0", "--until", "1996-01-01")[1])
    assert 0 < plain < wide
    few, many = (len(run(spark, capsys, "query", "q3sel", SMALL, "--format", "fixture", "--selectivity", s)) for s in ("20", "100"))
    assert few < many
    assert len(run(spark, capsys, "query", "q3", SMALL, "--format", "fixture", "--limit", "3")) == 4
    assert run(spark, capsys, "query", "q21", SMALL, "--format", "fixture", "--ssb")[0] == "d_year|p_brand1|lo_revenue"
    assert run(spark, capsys, "query", "q31", SMALL, "--format", "fixture", "--ssb") == run(spark, capsys, "query", "q31", SMALL, "--format", "fixture", "--ssb", "--sideways")
    one = run(spark, capsys, "query", "revenue", SMALL, "--format", "fixture", "--ssb", "--since", "19920101", "--until", "19920131")
    assert one[0] == "revenue"


def test_scans(spark, capsys):
    path = f"{SMALL}/customer.parquet"
    n = spark.read.parquet(path).count()
    lines = run(spark, capsys, "histogram", path, "c_name")
    assert sum(int(x.split("|")[2]) for x in lines) == n
    assert run(spark, capsys, "checksum", path, "c_name")[0].split("|")[:2] == ["c_name", str(n)]


def test_save_and_verify(spark, capsys, tmp_path):
    run(spark, capsys, "query", "q1", SMALL, "--format", "fixture", "--save", str(tmp_path / "r"))
    rows = registry.queries()["tpch_q1"](spark, SMALL).collect()
    header = list(rows[0].asDict())
    lines = ["|".join(header[::-1])] + ["|".join(str(r[c]) for c in header[::-1]) for r in rows[::-1]]
    (tmp_path / "answer").write_text("\n".join(lines) + "\n")
    assert run(spark, capsys, "verify", str(tmp_path / "r"), str(tmp_path / "answer")) == ["same"]
    (tmp_path / "other").write_text("\n".join(lines[:-1]) + "\n")
    assert cli.main(["verify", str(tmp_path / "r"), str(tmp_path / "other")]) == 1
    (tmp_path / "off").write_text("a\n1.01\n")
    (tmp_path / "on").write_text("a\n1.02\n")
    assert cli.main(["verify", str(tmp_path / "off"), str(tmp_path / "on"), "--last-digit", "2"]) == 0
    assert cli.main(["verify", str(tmp_path / "off"), str(tmp_path / "on")]) == 1


def test_load_and_sort(spark, capsys, tmp_path):
    rows = {
        "region": "2|ASIA|c|\n", "nation": "8|INDIA|2|c|\n", "customer": "1|n|a|8|p|1.00|BUILDING|c|\n",
        "orders": "7|1|O|9.99|1995-01-01|1|k|0|c|\n", "lineitem": "7|1|1|1|2.00|10.00|0.10|0.00|N|O|1995-06-01|1995-06-02|1995-06-03|i|m|c|\n",
    }
    for name, line in rows.items():
        (tmp_path / f"{name}.tbl").write_text(line)
    run(spark, capsys, "load", str(tmp_path), str(tmp_path / "p"), "--tables", *rows)
    for name in ("part", "supplier", "partsupp"):
        spark.createDataFrame([], cli.files.TPCH[name]).write.parquet(str(tmp_path / f"p/{name}.parquet"))
    run(spark, capsys, "sort", str(tmp_path / "p"), str(tmp_path / "s"), "--files", "2")
    line = spark.read.parquet(str(tmp_path / "s/lineitem.parquet")).first()
    assert (line.r_name, line.c_mktsegment, str(line.o_orderdate)) == ("ASIA", "BUILDING", "1995-01-01")
    assert run(spark, capsys, "query", "q3", str(tmp_path / "p"))[1] == "7|9.0|1995-01-01|0"
