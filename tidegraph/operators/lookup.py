"""Point, group and neighbourhood reads; pages go by uuid, descending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, groups: list[str], limit: int | None = None, cursor: str | None = None) -> DataFrame:
    """Rows of the groups below the cursor, highest uuid first; no group matches nothing."""
    out = df.filter(F.col("group_id").isin(groups) if groups else F.lit(False))
    out = out.filter(F.col("uuid") < cursor) if cursor else out
    out = out.orderBy(F.desc("uuid"))
    return out.limit(limit) if limit else out


def between(edges: DataFrame, source: str, target: str) -> DataFrame:
    return edges.filter((F.col("source_node_uuid") == source) & (F.col("target_node_uuid") == target))


def touching(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter((F.col("source_node_uuid") == node) | (F.col("target_node_uuid") == node))


def across(nodes: DataFrame, links: DataFrame, origins: DataFrame, reverse: bool = False) -> DataFrame:
    """Distinct nodes at the far end of links from the origins (uuid); reverse walks from targets to sources."""
    near, far = ("target_node_uuid", "source_node_uuid") if reverse else ("source_node_uuid", "target_node_uuid")
    reached = links.join(origins.select(F.col("uuid").alias(near)), near, "left_semi").select(F.col(far).alias("uuid")).distinct()
    return nodes.join(reached, "uuid", "left_semi")


def endpoints(edges: DataFrame) -> DataFrame:
    """One row (uuid, edge) for each end of each edge."""
    both = F.explode(F.array("source_node_uuid", "target_node_uuid")).alias("uuid")
    return edges.select(both, F.col("uuid").alias("edge"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges).select("uuid"), "uuid", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    return endpoints(edges).groupBy("uuid").agg(F.count("*").alias("degree"))


def overview(edges: DataFrame, top_nodes: int, top_edges: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of highest degree, and the edges among them with the highest sum of degrees."""
    nodes = degrees(edges).orderBy(F.desc("degree"), "uuid").limit(top_nodes)
    s, t = (nodes.select(F.col("uuid").alias(f"{x}_node_uuid"), F.col("degree").alias(f"{x}_degree")) for x in ("source", "target"))
    among = edges.join(s, "source_node_uuid").join(t, "target_node_uuid").withColumn("weight", F.col("source_degree") + F.col("target_degree"))
    return nodes, among.orderBy(F.desc("weight"), "uuid").limit(top_edges)


def facts_of(edges: DataFrame) -> DataFrame:
    """Each node's facts, one a line, ordered by edge."""
    both = edges.select(F.explode(F.array_distinct(F.array("source_node_uuid", "target_node_uuid"))).alias("node"), "uuid", "fact")
    return both.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("uuid", "fact"))), lambda x: x.fact), "\n").alias("facts"))
