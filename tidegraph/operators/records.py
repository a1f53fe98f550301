"""Records and attributes: what a row shows of itself, sets of ids, and lists that are united."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Core keys of a node or an edge, which are columns and no attributes.
CORE = "uuid name group_id name_embedding fact_embedding summary created_at labels source_node_uuid target_node_uuid fact episodes expired_at valid_at invalid_at".split()
EMBEDDINGS = ("name_embedding", "fact_embedding")
ID = r"^[a-zA-Z0-9_-]+$"


def attributes(column: str = "attributes", drop: tuple[str, ...] | list[str] = tuple(CORE)) -> Column:
    """A map without the named keys; null stays null."""
    return F.map_filter(column, lambda k, _: ~k.isin(*drop))


def without_embeddings(column: str = "attributes") -> Column:
    return attributes(column, EMBEDDINGS)


def shown_labels(labels: str = "labels", group: str = "group_id") -> Column:
    """Labels without the dynamic one of the group, Entity_<group> with dashes left out."""
    return F.array_remove(F.col(labels), F.concat(F.lit("Entity_"), F.regexp_replace(group, "-", "")))


def of_types(nodes: DataFrame, excluded: list[str], known: list[str] | None = None) -> DataFrame:
    """Nodes with none of the excluded labels; a name that is neither Entity nor known is an error."""
    if known is not None and (odd := sorted(set(excluded) - {*known, "Entity"})):
        raise ValueError(f"unknown entity types {odd}")
    if not excluded:
        return nodes
    specific = F.array_remove("labels", "Entity")  # an entity of no other type is a plain Entity
    kind = F.when(F.size(specific) == 0, F.array(F.lit("Entity"))).otherwise(specific)
    return nodes.filter(~F.arrays_overlap(kind, F.array(*map(F.lit, excluded))))


def checked_ids(ids: list[str]) -> list[str]:
    """Ids of ASCII letters, digits, dashes and underscores; an empty one is allowed, anything else an error."""
    if odd := [i for i in ids if i and not re.fullmatch(ID[1:-1], i)]:
        raise ValueError(f"invalid ids {odd}")
    return ids


def valid_id(column: str) -> Column:
    return F.coalesce(F.col(column) == "", F.lit(True)) | F.col(column).rlike(ID)


def groups(df: DataFrame) -> DataFrame:
    return df.select("group_id").distinct()


def united(df: DataFrame, columns: list[str], key: str = "uuid") -> DataFrame:
    """One row a key with the union of each list column over its rows, sorted; null lists count as empty."""
    return df.groupBy(key).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in columns])


def relations(edges: DataFrame) -> DataFrame:
    """(source_node_uuid, target_node_uuid, names, n): the relation names between two nodes and the number of facts."""
    return edges.groupBy("source_node_uuid", "target_node_uuid").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"), F.count("*").alias("n"))


def id_difference(given: DataFrame, expected: DataFrame, key: str = "uuid") -> DataFrame:
    """(uuid, side): ids expected but not given are missing, ids given but not expected are extra."""
    g, e = (d.select(F.col(key).alias("uuid")).distinct() for d in (given, expected))
    return e.join(g, "uuid", "left_anti").withColumn("side", F.lit("missing")).unionByName(g.join(e, "uuid", "left_anti").withColumn("side", F.lit("extra")))


def embeddings(df: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """(uuid, vector) of the wanted rows that have one."""
    return df.filter(F.col(column).isNotNull()).join(wanted.select("uuid"), "uuid", "left_semi").select("uuid", F.col(column).alias("vector"))
