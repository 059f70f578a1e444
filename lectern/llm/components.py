"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import durable


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every linked node; the component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., "Connected components in MapReduce and beyond",
    2014): the number of rounds grows with the logarithm of the largest component's size, and each round's links go
    to a durable table.  A node of very many links is one key of a grouped minimum, never a collected group.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    e = durable(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small_in = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = small_in.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            small_in.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u != v").distinct()
        )
        e = durable(small, "links")
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
