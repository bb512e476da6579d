"""Sources and sinks: delimited .tbl files, Parquet, pipe-delimited results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lakemill.functions.fixed import in_hundredths
from lakemill.sources.schemas import SSB, TPCH


def read_tbl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """One table from a file, folder or glob of `|`-delimited lines.

    Every file is its own input split, malformed lines are dropped, and padded
    text is trimmed on the right. A closing delimiter is read as one more field
    and left behind.
    """
    schema = StructType.fromDDL(ddl)
    wide = StructType([*schema.fields, StructField("_end", StringType())])
    df = spark.read.csv(path, sep="|", schema=wide, mode="DROPMALFORMED", quote="", escape="", enforceSchema=True, dateFormat="yyyy-MM-dd")
    return df.select(*[F.rtrim(f.name).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in schema.fields])


def read_tables(spark: SparkSession, folder: str, ssb: bool = False, fmt: str = "parquet") -> dict[str, DataFrame]:
    """All tables of a benchmark from one folder: `<name>.tbl*` or `<name>.parquet`."""
    out = {}
    for name, ddl in (SSB if ssb else TPCH).items():
        out[name] = read_tbl(spark, f"{folder}/{name}.tbl*", ddl) if fmt == "tbl" else spark.read.parquet(f"{folder}/{name}.parquet")
    return out


def tbl_to_parquet(spark: SparkSession, source: str, target: str, ssb: bool = False, codec: str = "zstd", names: tuple[str, ...] | None = None) -> None:
    for name, ddl in (SSB if ssb else TPCH).items():
        if names is None or name in names:
            read_tbl(spark, f"{source}/{name}.tbl*", ddl).write.mode("overwrite").parquet(f"{target}/{name}.parquet", compression=codec)


def write_tbl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="|", header=False, quote="", escape="")


def write_result(df: DataFrame, path: str) -> None:
    """A result as `|`-delimited text with a header, a file for each task."""
    df.write.mode("overwrite").csv(path, sep="|", header=True)


def plan_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Declared TPC-H tables to the columns that the plans read: amounts as
    whole hundredths."""
    out = dict(tables)
    out["lineitem"] = tables["lineitem"].withColumns(in_hundredths(("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
    return out


__all__ = ["plan_tables", "read_tables", "read_tbl", "tbl_to_parquet", "write_result", "write_tbl"]
