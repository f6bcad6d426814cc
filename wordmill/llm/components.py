"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, written


def _least_neighbour(pairs: DataFrame, total: int) -> DataFrame:
    """pairs (u, v), total in number or more, with the least v of each u, and u itself, as m."""
    least = pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count("*").alias("size"))
    return join_hot(pairs, least, "u", "size", total)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node in links (u, v): root is the least node that can be reached.

    Large-star and small-star steps take turns, each round written to the shared folder. A round
    moves at most two rows for a link, whatever a node's degree; the number of rounds grows with
    the logarithm of a component's size. A node with very many links is no task of its own (join_hot).
    Self links and links with a null end are left out.
    """
    edges = written(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(),
        "links",
    )
    before, total = None, edges.count()
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        near = _least_neighbour(written(large.where("u <> v").distinct(), "links"), total)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            near.select("u", F.col("m").alias("v"))
        )
        edges = written(small.distinct(), "links")
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before, total = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
