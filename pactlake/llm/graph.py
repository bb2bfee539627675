"""Connected components of links that no machine needs to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Of links between nodes (any orderable type), a row (node, component) for each node with a link
    to another: component is the smallest node it can reach.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step hangs neighbours on
    the smallest node known around; O(log^2 n) rounds, and the number of links never grows. Every
    minimum is combined before its shuffle, the joins on a node can be split by AQE, and each round
    is written to the shared folder. Null ends and loops are ignored; no links give no rows.
    """
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    now = materialize(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi, lo).distinct())
    sign = _sign(now)
    while sign[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = materialize(moved.union(least).distinct())
        sign, before = _sign(now), sign
        if sign == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def _sign(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.pmod(F.xxhash64("lo", "hi"), F.lit(1 << 30)))).first())
