"""Fixed-point money and exact sums.

Amounts are whole hundredths in a bigint, so that sums do not depend on the
order in which rows arrive. A sum over a whole table may exceed a bigint at
scale, so its result is a decimal.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def hundredths(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


LIMB = 20  # bits: sums of low limbs hold for 2^43 rows


def exact_sum(x: Column) -> Column:
    """The sum of a bigint column as a decimal, beyond a bigint's range.

    High and low parts are summed apart, both as bigints (which generated code
    adds far faster than decimals), and put together once a group. With values
    below 2^40, 2^43 rows fit."""
    high = F.sum(F.shiftright(x, LIMB)).cast("decimal(28,0)")
    low = F.sum(x.bitwiseAND(F.lit((1 << LIMB) - 1))).cast("decimal(28,0)")
    return high * F.lit(1 << LIMB).cast("decimal(7,0)") + low


def scaled(total: Column, scale: int) -> Column:
    """A whole-number sum as a double, divided once."""
    return total.cast("double") / F.lit(float(scale))


def bits(span: Column) -> Column:
    """ceil(log2(span + 1)) of a whole number from 0: the binary digits it needs."""
    return F.when(span > 0, F.length(F.conv(span.cast("string"), 10, 2))).otherwise(0).cast("long")


def yyyymmdd(day: Column) -> Column:
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


#: Amounts whose plain column plan tables keep beside the hundredths, as
#: `<name>_raw`, so that a filter on them can reach the file scan.
FILTERED = ("l_quantity", "l_discount")


def in_hundredths(columns: tuple[str, ...]) -> dict[str, Column]:
    """The columns as whole hundredths, and the plain ones of FILTERED."""
    return {c: hundredths(F.col(c)) for c in columns} | {f"{c}_raw": F.col(c) for c in FILTERED if c in columns}


def within(df: DataFrame, column: str, lo: int | None, hi: int | None) -> DataFrame:
    """The rows whose amount, in hundredths, is lo to hi; None leaves an end
    open. The plain column, if it is there, is held to bounds that take in all
    that rounds to these."""
    bounds = [(lo, -1, Column.__ge__), (hi, 1, Column.__le__)]
    for bound, side, compare in bounds:
        if bound is None:
            continue
        df = df.where(compare(F.col(column), F.lit(bound)))
        if f"{column}_raw" in df.columns:
            exact = isinstance(df.schema[f"{column}_raw"].dataType, DecimalType)
            df = df.where(compare(F.col(f"{column}_raw"), F.lit(Decimal(bound).scaleb(-2)) if exact else F.lit((bound + side * 0.6) / 100)))
    return df
