"""Connected components of a table of links, by alternating stars.

Each round hangs the larger neighbours of every node on its least neighbour (large star),
then the smaller ones (small star). The number of rounds grows with the logarithm of the
graph's size, not with its diameter; a node with very many neighbours is a partial
aggregation and the split side of a join, and no list of neighbours is ever built.
Every round is a table in the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star operation on links (a > b)."""
    if large:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        out = links.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
    return out.where("a != b")


def components(links: DataFrame) -> DataFrame:
    """node, component (its least reachable node) for every node of ``links`` (a, b) but the least ones."""
    links = materialize(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        links = materialize(_star(_star(links, True), False).distinct(), "links")
        # converged when a round changes nothing: the links are then stars, node to least node
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now
