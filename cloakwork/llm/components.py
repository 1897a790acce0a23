"""Connected components of a graph that no single machine need hold: alternating large-star and small-star rounds.

Each round replaces every link by one to the smallest neighbour, once over larger neighbours and once over smaller
ones, until only stars are left; chains shrink by half a round or faster. Each round is written to the shared folder.
Links to a hot node are counted by partial aggregation and joined by exchanges that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.shared import cut, hot_join

MAX_ROUNDS = 60


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return hot_join(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the smallest of them. Links have u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = hot_join(links, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable, itself included) of every node of links(u, v)."""
    now = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    for _ in range(MAX_ROUNDS):
        now = cut(_small(_large(now)), "links")
        # done when all links are those of stars: every member has one center, and no center is a member elsewhere
        members = now.groupBy("u").count()
        if members.where("count > 1").isEmpty() and members.join(now.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
