"""Breadth-first traversal by unrolled joins: at most a few hops, each a distinct frontier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 3


def _steps(edges: DataFrame, mentions: DataFrame | None) -> DataFrame:
    own = edges.select("source_node_uuid", "target_node_uuid", F.col("uuid").alias("edge"))
    return own if mentions is None else own.unionByName(mentions.select("source_node_uuid", "target_node_uuid", F.lit(None).cast("string").alias("edge")))


def bfs_edges(edges: DataFrame, origins: DataFrame, depth: int = MAX_DEPTH, mentions: DataFrame | None = None) -> DataFrame:
    """(uuid, depth): edges on directed walks of up to `depth` hops from the origins (uuid); a mention is a hop too."""
    steps, frontier, found = _steps(edges, mentions), origins.select("uuid").distinct(), []
    for d in range(1, depth + 1):
        hop = frontier.join(steps, F.col("uuid") == F.col("source_node_uuid"))
        found.append(hop.filter("edge IS NOT NULL").select(F.col("edge").alias("uuid"), F.lit(d).cast("bigint").alias("depth")))
        frontier = hop.select(F.col("target_node_uuid").alias("uuid")).distinct()
    return reduce(DataFrame.unionByName, found).groupBy("uuid").agg(F.min("depth").alias("depth"))


def bfs_nodes(edges: DataFrame, origins: DataFrame, depth: int = MAX_DEPTH, mentions: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(uuid, depth): nodes reached in one to `depth` hops; an origin only if a cycle leads back to it.

    With groups (uuid, group_id), only nodes of the group of an origin that leads to them; walks may pass others.
    """
    if groups is not None:
        of = groups.select("uuid", F.col("group_id").alias("from"))
        steps, frontier, found = _steps(edges, mentions), origins.select("uuid").distinct().join(of, "uuid"), []
        for d in range(1, depth + 1):
            frontier = frontier.join(steps, F.col("uuid") == F.col("source_node_uuid")).select(F.col("target_node_uuid").alias("uuid"), "from").distinct()
            found.append(frontier.withColumn("depth", F.lit(d).cast("bigint")))
        reached = reduce(DataFrame.unionByName, found).groupBy("uuid", "from").agg(F.min("depth").alias("depth"))
        return reached.join(groups.select("uuid", F.col("group_id").alias("from")), ["uuid", "from"]).select("uuid", "depth")
    steps, frontier, found = _steps(edges, mentions), origins.select("uuid").distinct(), []
    for d in range(1, depth + 1):
        frontier = frontier.join(steps, F.col("uuid") == F.col("source_node_uuid")).select(F.col("target_node_uuid").alias("uuid")).distinct()
        found.append(frontier.withColumn("depth", F.lit(d).cast("bigint")))
    return reduce(DataFrame.unionByName, found).groupBy("uuid").agg(F.min("depth").alias("depth"))
