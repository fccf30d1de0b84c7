"""Connected components of an edge table by alternating stars.

A large star links every larger neighbour of a node to the node's smallest
neighbour, a small star links every smaller neighbour; repeated, each component
becomes one star around its smallest node. Minima are aggregated before they are
joined back, so a node with very many links is only a skewed join key. Every
round is written to the shared folder; only two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges (a, b: long) to (node, root): the smallest node that each node reaches.

    Nodes without a link are absent; loops, repeats and nulls are ignored; no
    edges give no rows. Stops when a round changes nothing.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links, before = materialise(links, "links"), None
    for _ in range(max_rounds):
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())
        before = state
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).distinct()
        old, links = links, materialise(small, "links")
        discard(old)
    raise RuntimeError("components did not settle")
