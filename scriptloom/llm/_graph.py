"""Connected components of a link table, by alternating star contractions (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import discard, materialise


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node long, component long``: for each node of a link, the smallest node reachable from it.

    Links with a null end and links of a node to itself are ignored; nodes without any link aren't in the result. Each
    round is two joins and aggregates over the link table; no neighbour list is gathered, so a hub is no single task's
    load. Rounds grow with the logarithm of the links. The driver sees one count and one checksum a round.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    edges = (
        links.where(u.isNotNull() & v.isNotNull() & (u != v))
        .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .distinct()
    )
    edges = materialise(edges, "links")
    seen = _summary(edges)
    while seen[0]:
        # large star: the larger neighbours of each node move to the smallest node near it
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small star: the smaller neighbours of each node, and itself, move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u > v")
            .distinct()
        )
        after = materialise(small, "links")
        now = _summary(after)
        discard(edges)
        edges = after
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
