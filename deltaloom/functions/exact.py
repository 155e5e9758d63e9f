"""Exact sums of floats and intervals, with built-in functions only.

A finite double is an integer mantissa times a power of two. Mantissas of one power are summed as
decimals, which is exact, retractable, and combined map-side; only the last step, which turns a
group's few sums into one rounded float, uses big integers. NaN and the infinities are counted apart.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

#: Powers under which what is not finite is counted.
NAN, PLUS, MINUS = 10_001, 10_002, 10_003
SUMS = "map<int,decimal(38,0)>"


def power_of(x: Column) -> Column:
    """The power of two that makes ``x`` an integer, which has at most 56 bits; a code for NaN and the infinities; NULL for NULL."""
    x = x.cast("double")
    size = F.when(x == 0, F.lit(1.0)).otherwise(F.abs(x))
    scale = F.least(F.lit(54) - F.floor(F.log2(size)), F.lit(1074)).cast("int")
    return F.when(F.isnan(x), F.lit(NAN)).when(x == float("inf"), F.lit(PLUS)).when(x == float("-inf"), F.lit(MINUS)).when(x.isNotNull(), scale)


def mantissa_of(x: Column, power: Column) -> Column:
    """``x`` times two to that power, as an exact decimal; 1 of what is not finite."""
    half = F.floor(power / 2)
    scaled = x.cast("double") * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)
    return F.when(power >= NAN, F.lit(1)).otherwise(F.when(power < NAN, scaled).cast("bigint")).cast("decimal(38,0)")


def round_once(sums: dict[int, int] | None, n: int | None = None, real: bool = False) -> float | None:
    """The float nearest to the sum (divided by ``n``, if given)."""
    if sums is None:
        return None
    sums = {k: int(v) for k, v in sums.items() if v}
    if sums.get(NAN) or sums.get(PLUS) and sums.get(MINUS):
        return float("nan")
    if sums.get(PLUS) or sums.get(MINUS):
        return float("inf") if sums.get(PLUS) else float("-inf")
    total = sum((Fraction(v) / (Fraction(2) ** k) for k, v in sums.items()), Fraction(0))
    if n is not None:
        if not n:
            return None
        total /= int(n)
    try:
        out = float(total)
    except OverflowError:
        out = float("inf") if total > 0 else float("-inf")
    return float(nearest_real(total, out)) if real else out


def nearest_real(total: Fraction, near: float) -> np.float32:
    """The single-precision float nearest to ``total``, not to its double; ties to the even one."""
    with np.errstate(over="ignore"):
        mid = np.float32(near)
        around = [np.nextafter(mid, np.float32("-inf")), mid, np.nextafter(mid, np.float32("inf"))]
    finite = [f for f in around if np.isfinite(f)]
    if not np.isfinite(mid) or not finite:
        return mid
    return min(finite, key=lambda f: (abs(Fraction(float(f)) - total), int(f.view(np.uint32)) & 1))


def _rounded(sums: pa.Array, counts: list | None, real: bool) -> pa.Array:
    counts = counts or [None] * len(sums)
    return pa.array([None if x is None else round_once(dict(x), n, real) for x, n in zip(sums.to_pylist(), counts, strict=True)], pa.float32() if real else pa.float64())


# Arrow, because pandas cannot tell NaN from NULL.


@F.arrow_udf(DoubleType())
def rounded_sum(sums: pa.Array) -> pa.Array:
    return _rounded(sums, None, False)


@F.arrow_udf(FloatType())
def rounded_real_sum(sums: pa.Array) -> pa.Array:
    return _rounded(sums, None, True)


@F.arrow_udf(DoubleType())
def rounded_mean(sums: pa.Array, n: pa.Array) -> pa.Array:
    return _rounded(sums, n.to_pylist(), False)


def merge_sums(a: Column, b: Column) -> Column:
    """Two maps of sums added, without entries of zero."""
    empty = F.create_map().cast(SUMS)
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    zero = F.lit(0).cast("decimal(38,0)")
    return F.map_filter(F.map_zip_with(a, b, lambda k, x, y: (F.coalesce(x, zero) + F.coalesce(y, zero)).cast("decimal(38,0)")), lambda k, v: v != 0)


def exact_float_sums(rows: DataFrame, keys: list[str], args: dict[str, Column], sign: Column) -> DataFrame:
    """A row per group with, for each argument, its map of sums; ``sign`` (1 or -1) weighs each row.

    Two aggregations, by group and power and then by group; the second gets at most some 2,000 rows of a group.
    """
    parts = F.array(*[F.struct(F.lit(i).alias("i"), power_of(c).alias("p"), c.cast("double").alias("x")) for i, c in enumerate(args.values())])
    each = rows.select(*[f"`{k}`" for k in keys], sign.alias("__w"), F.explode(parts).alias("__a")).filter("__a.p IS NOT NULL")
    each = each.withColumn("__m", mantissa_of(F.col("__a.x"), F.col("__a.p")) * F.col("__w").cast("decimal(1,0)"))
    by_power = each.groupBy(*keys, F.col("__a.i").alias("__i"), F.col("__a.p").alias("__p")).agg(F.sum(F.col("__m").cast("decimal(38,0)")).alias("__s"))
    made = [F.map_from_entries(F.collect_list(F.when(F.col("__i") == i, F.struct(F.col("__p"), F.col("__s").cast("decimal(38,0)"))))).alias(name) for i, name in enumerate(args)]
    return by_power.groupBy(*keys).agg(*made)


def interval_micros(x: Column) -> Column:
    """What intervals are ordered by: months of 30 days, days of 24 hours."""
    return ((x["months"].cast("decimal(38,0)") * 30 + x["days"]) * 86_400_000_000 + x["micros"]).cast("decimal(38,0)")


def interval_mean(months: Column, days: Column, micros: Column, n: Column) -> Column:
    """The summed fields divided by ``n``: a month's remainder becomes days of thirty to the month, and a day's remainder time."""
    m = F.call_function("div", months, n)
    left_days = (months - m * n).cast("decimal(25,0)") * 30 + days
    d = F.call_function("div", left_days.cast("decimal(38,0)"), n)
    left = (left_days - d * n).cast("decimal(25,0)") * 86_400_000_000 + micros
    return F.struct(m.cast("int").alias("months"), d.cast("int").alias("days"), F.round(left.cast("decimal(38,0)") / n, 0).cast("bigint").alias("micros"))
