"""Proposals before a capital and behind a colon."""

from pyspark.sql import functions as F

from lakemill.llm import pii


def test_forms(spark):
    cases = {
        "IBAN DE89 3704 0044 0532 0130 00 Bitte": "DE89 3704 0044 0532 0130 00",
        "DE89370400440532013000 Bitte": "DE89370400440532013000",
        "DE89 3704 0044 0532 0130 00 bitte": "DE89 3704 0044 0532 0130 00",
        "Konto DE89370400440532013000 Bitte": "DE89370400440532013000",
        "SSN:123-45-6789": "123-45-6789",
        "Tel:555-123-4567": "555-123-4567",
        "at 12:3456789 or so": None,
        ":5551234567": None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.text: [s["match"] for s in r.p if s["kind"] != "mailish"] for r in df.select("text", pii.proposals(F.col("text")).alias("p")).collect()}
    assert all((want in got[t]) if want else not got[t] for t, want in cases.items())
    found = {r.doc_id: [s["match"] for s in r.spans] for r in pii.scan(df).collect()}
    told = ("IBAN", "Konto", "SSN", "Tel")  # what the words before speak for is kept
    assert all(want in found[k] for k, (t, want) in enumerate(cases.items()) if t.startswith(told))
