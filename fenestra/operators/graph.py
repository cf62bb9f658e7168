"""Graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenestra.checkpoints import cut


def components(links: DataFrame) -> DataFrame:
    """(u, root): every node but the roots, with the smallest node that it is connected to. links: (u, v), of one type.

    Large-star and small-star rounds, each an aggregation and a join, until the
    edges stay as they are. Rows with a null end are no links.
    """
    pairs = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        pairs = cut(small.distinct())
        now = tuple(pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38, 0))"))).first())
        if now == state:
            return pairs.select("u", F.col("v").alias("root"))
        state = now


def grouped(members: DataFrame, node: str, *keys: str) -> DataFrame:
    """(node, root): the nodes of members joined into groups by sharing any of the keys; the root is a group's smallest node. Null and empty keys join nobody."""
    tagged = members.select(node, F.explode(F.array(*(F.when(F.col(k).cast("string") != "", F.concat_ws("\x1f", F.lit(k), F.col(k).cast("string"))) for k in keys))).alias("key")).where(F.col("key").isNotNull())
    first = tagged.groupBy("key").agg(F.min(node).alias("v"))
    links = tagged.join(first, "key").select(F.col(node).alias("u"), "v")
    roots = components(links).withColumnRenamed("u", node)
    return members.select(node).distinct().join(roots, node, "left").select(node, F.coalesce("root", node).alias("root"))
