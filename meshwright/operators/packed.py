"""Sums of compressed features, several to a long.

All nodes' features share one scale a column, so their 8-bit whole numbers can be
summed up as they are and be scaled once a destination. Two or three of them lie in
one long, each in bits enough for the sum of the greatest in-degree; adding the longs
adds all of them at once, and a negative part borrows from its neighbour, which the
unpacking gives back. So both the features sent to the edges and the sums sent to
the destinations are a half or a third as many.

The error of a sum is at most half a scale (a 254th of the column's greatest value)
for each message; of a mean, half a scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions.arrays import zeros
from meshwright.functions.storage import cut
from meshwright.layers import Aggregation

LEVELS = 127
#: Bits of a part, and the greatest number of messages whose sum fits them.
LANES = {bits: (1 << (bits - 1)) // (LEVELS + 1) for bits in (21, 32)}


def bits_for(most_messages: int) -> int:
    return next((b for b, most in LANES.items() if most_messages < most), 64)


def scales(features: DataFrame, dim: int) -> list[float]:
    """One scale a column: a 127th of its greatest absolute value (1 for a column of zeros), in one pass."""
    top = features.agg(*(F.max(F.abs(F.col("h")[k])).alias(f"s{k}") for k in range(dim))).first()
    return [(x or 0.0) / LEVELS or 1.0 for x in top]


def pack(features: DataFrame, of: list[float], bits: int) -> DataFrame:
    """id and p: the features as whole numbers of scales, in longs."""
    lanes = 64 // bits
    # Not round(), which goes through decimals.
    whole = [F.floor(F.col("h")[k] / F.lit(x) + F.lit(0.5)).cast("long") for k, x in enumerate(of)]
    longs = []
    for at in range(0, len(whole), lanes):
        together = whole[at]
        for i, x in enumerate(whole[at + 1 : at + lanes], 1):
            together = together + F.shiftleft(x, i * bits)
        longs.append(together)
    return features.select("id", F.array(*longs).alias("p") if longs else F.array().cast("array<bigint>").alias("p"))


def unpack(sums: list[Column], of: list[float], bits: int) -> list[Column]:
    """The columns' sums, scaled."""
    if bits == 64:
        return [x.cast("double") * F.lit(s) for x, s in zip(sums, of, strict=True)]
    lanes, out = 64 // bits, []
    for k, scale in enumerate(of):
        x, i = sums[k // lanes], k % lanes
        # What lies below, if negative, has taken one away: rounding at half of it gives that back.
        above = F.shiftright(x + F.lit(1 << (i * bits - 1)), i * bits) if i else x
        part = F.shiftright(F.shiftleft(above, 64 - bits), 64 - bits)
        out.append(part.cast("double") * F.lit(scale))
    return out


def reduce_packed(edges: DataFrame, features: DataFrame, kind: Aggregation, dim: int, most_messages: int) -> DataFrame:
    """dst and m: the sums or means of the sources' features (id, h), which no node gets more than `most_messages` of."""
    # Read twice, for the scales and for the packing.
    features = cut(features)
    of, bits = scales(features, dim), bits_for(most_messages)
    messages = edges.select("src", "dst").join(pack(features, of, bits).withColumnRenamed("id", "src"), "src")
    n = -(-dim // (64 // bits))
    # The highest part has a bit to spare, so no sum overflows.
    sums = messages.groupBy("dst").agg(F.count("*").alias("n"), *(F.sum(F.col("p")[j]).alias(f"p{j}") for j in range(n)))
    m = unpack([F.col(f"p{j}") for j in range(n)], of, bits)
    if kind is Aggregation.MEAN:
        m = [x / F.col("n") for x in m]
    return sums.select("dst", F.array(*m).alias("m") if m else zeros(0).alias("m"))
