"""Text predicates, scans with checksums, and length histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.session import reach_workers


def like_ordered(column: Column, *parts: str) -> Column:
    """Whether the parts occur in this order without overlap: LIKE '%a%b%'.

    Signs that LIKE reads as wildcards stand for themselves."""
    plain = [p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") for p in parts]
    return column.like("%" + "%".join(plain) + "%")


def split_row(line: Column, delimiter: str = "|") -> Column:
    """The fields of one delimited line, without the empty one that a closing
    delimiter leaves."""
    quoted = "\\" + delimiter
    return F.split(F.regexp_replace(line, f"{quoted}$", ""), quoted, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, name in enumerate(batch.schema.names):
            text = batch.column(k).drop_null().cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
            own = np.frombuffer(text.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
            yield pa.RecordBatch.from_pydict({"column_name": [name], "records": [len(text)], "sum_length": [len(own)], "sum_bytes": [int(own.sum(dtype=np.int64))]})


def scan_checksum(df: DataFrame, *columns: str) -> DataFrame:
    """Per text column: records that are not null, total bytes and the sum of
    all byte values. Nothing built in adds up bytes, so a batch of text is one
    array sum, and only one row a batch leaves the scan."""
    reach_workers(df.sparkSession)
    parts = df.select(*columns).mapInArrow(_sums, "column_name string, records long, sum_length long, sum_bytes long")
    return parts.groupBy("column_name").agg(*[F.sum(c).alias(c) for c in ("records", "sum_length", "sum_bytes")])


def length_histogram(df: DataFrame, column: str) -> DataFrame:
    """Rows by length in bytes, ascending; null is left out."""
    return df.where(F.col(column).isNotNull()).groupBy(F.octet_length(column).alias("length")).agg(F.count(F.lit(1)).alias("records")).orderBy("length")


def ascii_sum(column: Column) -> Column:
    """Sum of the code points of a short text, in expressions alone."""
    return F.aggregate(F.split(column, ""), F.lit(0).cast("long"), lambda a, x: a + F.ascii(x).cast("long"))


__all__ = ["ascii_sum", "length_histogram", "like_ordered", "scan_checksum", "split_row"]
