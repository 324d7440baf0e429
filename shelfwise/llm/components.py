"""Connected components of a link table by alternating star contraction, as joins and
aggregations; nothing but a convergence figure reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, label): the smallest node of each component, for every node that
    has a link. Self links, repeated links and nulls are ignored. Each step hangs every node under the smallest
    neighbour (large star: those above it; small star: those below), so hubs are handled by
    map-side minimum aggregation and never gathered."""
    edges = materialise(
        links.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    seen = None
    while True:
        # large star: every neighbour above u hangs under u's smallest neighbour
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (both.where("v > u").join(least, "u").where("v != m")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        # small star: u and its neighbours below hang under the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        edges = materialise(
            large.join(low, "hi").select(F.greatest("lo", "m").alias("hi"), F.col("m").alias("lo"))
            .where("hi != lo")
            .union(low.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("label"))).distinct()
