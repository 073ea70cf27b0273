"""Column expressions over feature arrays."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.layers import Activation


def activate(z: Column, kind: Activation) -> Column:
    if kind is Activation.RELU:
        return F.greatest(z, F.lit(0.0))
    if kind is Activation.SIGMOID:
        return 1 / (1 + F.exp(-z))
    return z


#: Features of a row that are written out one by one in compiled code; longer rows go through lambdas, which are interpreted.
UNROLLED = 16


def scaled(h: Column, by: Column, dim: int) -> Column:
    """The features of `h`, which has `dim`, times a number."""
    if not 0 < dim <= UNROLLED:
        return F.transform(h, lambda x: x * by)
    return F.when(h.isNotNull(), F.array(*(F.get(h, F.lit(k)) * by for k in range(dim))))


def added(a: Column, b: Column, dim: int) -> Column:
    """The sums of two arrays' features; both have `dim`."""
    if not 0 < dim <= UNROLLED:
        return F.zip_with(a, b, lambda x, y: x + y)
    return F.when(a.isNotNull() & b.isNotNull(), F.array(*(F.get(a, F.lit(k)) + F.get(b, F.lit(k)) for k in range(dim))))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def softmax(h: Column) -> Column:
    """Each row's features as probabilities; the greatest is taken off first, so nothing overflows."""
    # Two one-element arrays hold the greatest feature and the exponentials, so each is computed once a row.
    top = F.array(F.struct(h.alias("h"), F.array_max(h).alias("top")))
    powers = F.transform(top, lambda r: F.transform(r["h"], lambda x: F.exp(x - r["top"])))
    totals = F.transform(powers, lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, b: a + b).alias("total")))
    return F.transform(totals, lambda r: F.transform(r["e"], lambda x: x / r["total"]))[0]


def argmax(h: Column) -> Column:
    """Position of the greatest feature, the first of equals; null for an empty array."""
    return F.nullif(F.array_position(h, F.array_max(h)), F.lit(0)).cast("long") - 1


def concat_features(h: Column, m: Column) -> Column:
    return F.concat(h, m)


def quantise(h: Column) -> Column:
    """(scale, int8 features): each feature as a whole multiple of a 127th of the row's greatest."""
    top = F.array_max(F.transform(h, F.abs))
    scale = F.when(top > 0, top / 127).otherwise(1.0)
    return F.struct(scale.alias("scale"), F.transform(h, lambda x: F.round(x / scale).cast("tinyint")).alias("q"))


def dequantise(q: Column) -> Column:
    return F.transform(q["q"], lambda x: x * q["scale"])


def leaky(z: Column, slope: float) -> Column:
    return F.when(z >= 0, z).otherwise(z * slope)


def to_long(df: DataFrame, column: str = "h") -> DataFrame:
    """id, k and x: a row for each feature."""
    return df.select("id", F.posexplode(column).alias("k", "x"))


def from_long(df: DataFrame) -> DataFrame:
    """id and h from rows (id, k, x), by k."""
    return df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("h")).select("id", F.col("h.x").alias("h"))


def to_wide(df: DataFrame, dim: int, column: str = "h") -> DataFrame:
    """id and x0, x1, ...: a column for each of `dim` features."""
    return df.select("id", *(F.col(column)[k].alias(f"x{k}") for k in range(dim)))


def from_wide(df: DataFrame, dim: int) -> DataFrame:
    return df.select("id", F.array(*(f"x{k}" for k in range(dim))).alias("h"))
