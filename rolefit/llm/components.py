"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _to_least(pairs: DataFrame) -> DataFrame:
    """(u, v) pairs with m, the least of u and its partners. A hub is reduced in every task before it is shuffled."""
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return pairs.join(least, "u")


def _state(pairs: DataFrame):
    return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each end of a link: root is the least node reachable. Nodes without links do not occur.

    Rows with a null end and links of a node with itself are ignored. Each round is written to the shared folder; rounds
    grow with the logarithm of a component's size. Only a row count and a checksum reach the driver.
    """
    real = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = cut(real.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    state = _state(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _to_least(large.distinct())
        after = cut(
            small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u > v").distinct(), "links"
        )
        before, state, now = state, _state(after), after
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
