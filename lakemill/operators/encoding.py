"""Column-encoding analysis: what bit packing, run lengths, deltas and
dictionaries would take, and which codec to choose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.functions.fixed import bits
from lakemill.operators.ordering import before

BLOCK, MINIBLOCKS = 128, 4
#: Values that a codec's ratio is measured on.
SAMPLE = 20_000
#: Measured decompression speeds in units of 100 MB/s.
SPEEDS = {"snappy": 434, "lz4": 328, "deflate": 194}


def _block(key: str, rows: int) -> Column:
    return F.floor(F.col(key) / rows).cast("long")


def bit_packing(df: DataFrame, key: str, column: str) -> DataFrame:
    """Frame of reference: per block of 128 keys its least value and the one
    width that its widest quarter needs; a block takes a header of the
    reference and four widths, and 128 values of that width."""
    x = F.col(column).cast("long")
    quarter = F.floor((F.col(key) % BLOCK) / (BLOCK // MINIBLOCKS)).cast("int")
    per_quarter = df.where(x.isNotNull()).groupBy(_block(key, BLOCK).alias("block_id"), quarter.alias("quarter")).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(F.lit(1)).alias("n"))
    per_block = per_quarter.groupBy("block_id").agg(F.min("lo").alias("reference"), F.max("hi").alias("most"), F.sum("n").alias("n_values"))
    width = bits(F.col("most") - F.col("reference"))
    return per_block.select("block_id", "reference", "most", "n_values", width.alias("bit_width"), (F.lit(8) + width * (BLOCK // 8)).alias("packed_bytes"))


def unpacked(df: DataFrame, key: str, column: str) -> DataFrame:
    """Round trip: offsets from the block's reference, masked to its width, and
    back; (key, value)."""
    packed = bit_packing(df, key, column).select(F.col("block_id").alias("_b"), "reference", "bit_width")
    rows = df.select(F.col(key), F.col(column).cast("long").alias("value")).where("value is not null").withColumn("_b", _block(key, BLOCK)).join(packed, "_b")
    offset = (F.col("value") - F.col("reference")).bitwiseAND(F.expr("shiftleft(1L, cast(bit_width as int)) - 1"))
    return rows.select(key, (F.col("reference") + offset).alias("value"))


def run_lengths(df: DataFrame, key: str, column: str, rows: int = 4096) -> DataFrame:
    """Per block of keys: values, runs of equal neighbours in key order, and the
    width of differences between neighbours."""
    x = F.col(column).cast("long")
    w = Window.partitionBy("block_id").orderBy(key)
    seen = df.where(x.isNotNull()).select(_block(key, rows).alias("block_id"), F.col(key), x.alias("x")).withColumn("d", F.col("x") - F.lag("x").over(w))
    per = seen.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_values"), (F.sum(F.when(F.col("d") == 0, 0).otherwise(1))).alias("runs"), F.min("d").alias("_lo"), F.max("d").alias("_hi"))
    return per.select("block_id", "n_values", "runs", bits(F.coalesce(F.col("_hi") - F.col("_lo"), F.lit(0))).alias("delta_width"))


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """Codes from 0 in binary order of the values, so that ranges of codes are
    ranges of values. Values are counted within ranges of themselves, so no
    task sorts all of them, whatever they begin with."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    return before(counts, ("value",), F.lit(1), "_code").select("value", "n_rows", F.col("_code").cast("int").alias("code"))


def static_codec(dtype: str, width: int | None = None) -> str:
    """The rule by type: whole numbers, dates and amounts are packed, 64-bit
    ones in their own form, text goes through LZ4, text below 3 signs is packed."""
    if dtype in ("bigint", "long"):
        return "pfor64"
    if dtype == "string":
        return "pfor" if width is not None and width < 3 else "lz4"
    return "pfor"


def advise(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Per whole-number column: bytes plain, packed, and as a dictionary, and
    the smallest of them."""
    out = None
    for c in columns:
        packed = bit_packing(df, key, c).agg(F.sum("packed_bytes").alias("packed_bytes"), F.sum("n_values").alias("n_values")).withColumn("column_name", F.lit(c))
        codes = df.where(F.col(c).isNotNull()).agg(F.countDistinct(c).alias("n_distinct")).withColumn("column_name", F.lit(c))
        one = packed.join(codes, "column_name")  # one row each
        plain, coded = F.col("n_values") * 8, F.col("n_distinct") * 8 + F.ceil(F.col("n_values") * bits(F.col("n_distinct") - 1) / 8).cast("long")
        best = F.when((F.col("packed_bytes") <= plain) & (F.col("packed_bytes") <= coded), "pfor").when(coded <= plain, "dictionary").otherwise("plain")
        row = one.select("column_name", "n_values", "n_distinct", plain.alias("plain_bytes"), "packed_bytes", coded.alias("dictionary_bytes"), best.alias("encoding"))
        out = row if out is None else out.unionAll(row)
    return out


def measured_ratios(df: DataFrame, column: str, codecs: tuple[str, ...] = ("snappy", "lz4", "deflate")) -> dict[str, float]:
    """Plain bytes over encoded bytes of a bounded sample of a column's values."""
    import pyarrow as pa

    held = [r[0] for r in df.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).orderBy(F.xxhash64(column), column).limit(SAMPLE).collect()]
    plain = "\n".join(held).encode()
    names = {"deflate": "gzip"}
    return {c: len(plain) / max(1, len(pa.Codec(names.get(c, c)).compress(plain, asbytes=True))) for c in codecs}


def choose_codec(ratios: dict[str, float], storage: float = 65.0) -> str:
    """The codec that delivers most plain bytes per second: the slower of what
    storage feeds it (times its ratio) and what it decompresses. Speeds and
    storage are in units of 100 MB/s."""
    value = {c: min(storage * r, SPEEDS.get(c, float("inf"))) for c, r in ratios.items()}
    return max(sorted(value), key=value.__getitem__)
