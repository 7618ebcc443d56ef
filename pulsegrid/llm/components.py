"""Connected components of an edge table, by alternating large-star and small-star steps in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LINKS_A_TASK = 500_000


def _least(links: DataFrame) -> DataFrame:
    """Of each u with a lesser neighbour, the least of them."""
    return links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")


def connected_components(edges: DataFrame, most_rounds: int = 60, keep: Scratch | None = None) -> DataFrame:
    """edges(a, b) of long ids to (node, component): component is the least id reachable from node.

    Only nodes that have an edge to another node are returned. Null ends and loops are ignored; no edges give no
    rows. Every round is written down, so a lost executor costs no more than one round; all but the result, which goes
    to `keep` if there is one, is removed. Rounds of few links run in few tasks.
    """
    with Scratch(edges.sparkSession) as own:
        links = own(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        tasks = -(-links.count() // LINKS_A_TASK) or 1
        before = None
        for _ in range(most_rounds):
            # a link holds its greater end first, so one way is enough: large stars hang u's greater neighbours on u's least, small stars the lesser
            large = links.join(_least(links), F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b"))
            least = _least(large)
            small = large.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
            links = own(small.coalesce(tasks).distinct().coalesce(tasks))
            now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
            if tuple(now) == before:
                break
            before = tuple(now)
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        stars = stars.union(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).coalesce(tasks).distinct().coalesce(tasks)
        return keep(stars) if keep else own.result(stars)
