"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Up to so many links, the table of smallest neighbours (at most two rows of 16 bytes a link) is broadcast; beyond, it is joined by shuffle.
BROADCAST_LINKS = 200_000


def _joined(rows: DataFrame, least: DataFrame, n_links: int) -> DataFrame:
    if n_links <= BROADCAST_LINKS:
        return rows.join(F.broadcast(least), "u")
    return rows.join(cut(least), "u")  # cut, so that both sides are plain shuffles and Spark can split a hub's partition


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: (a, b) long. Returns (node, root) for every node that has a link to another, root being the smallest node it can reach.

    Links to oneself, links with a null end and repeated links count for nothing; an empty table gives an empty table.
    All state is distributed; the driver sees one count and one checksum a round.
    """
    edges = cut(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 24)).alias("h")).first()
        if now["n"] == 0 or now == mark:
            break
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            _joined(both, least, now["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        if now["n"] > BROADCAST_LINKS:
            large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _joined(large, least, now["n"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
