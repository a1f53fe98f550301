"""Steps of writing to the graph: triplets, batch resolution, sagas, removal of episodes, seeds and caches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vector
from . import resolve, temporal


def dedupe_batch(names: DataFrame) -> DataFrame:
    """(uuid, root): names of one batch resolved among themselves, chains compressed to their least uuid.

    Telling names that are equal in loose form hang on their least uuid, and only loose forms are compared with each other.
    """
    key = text.normalised("name")
    first = names.groupBy(key.alias("k")).agg(F.min("uuid").alias("b"))
    exact = names.select(F.col("uuid").alias("a"), key.alias("k")).join(first, "k").filter("a <> b").select("a", "b")
    told = names.filter(text.telling(text.fuzzy("name")))
    least = told.groupBy(text.fuzzy("name").alias("f")).agg(F.min("uuid").alias("b"))
    same = told.select(F.col("uuid").alias("a"), text.fuzzy("name").alias("f")).join(least, "f").filter("a <> b").select("a", "b")
    loose = resolve.loose_pairs(told, told, 0.9).select("f", "b").join(least.withColumnRenamed("b", "a"), "f").filter("a > b").select("a", "b")
    roots = resolve.components(exact.unionByName(same).unionByName(loose))
    return names.select("uuid").join(roots, "uuid", "left").select("uuid", F.coalesce("root", "uuid").alias("root"))


def case_merged(names: DataFrame, order: str = "pos") -> DataFrame:
    """One row for each name whatever its case, the first by order."""
    return resolve.first_of(names, [F.lower("name")], [order])


def merged_node(stored: DataFrame, given: DataFrame) -> DataFrame:
    """A stored node updated by a given one of the same uuid: attributes and labels united, a given summary wins."""
    g = given.select("uuid", F.col("attributes").alias("_a"), F.col("labels").alias("_l"), F.col("summary").alias("_s"))
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("attributes", none), F.coalesce("_a", none)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return (
        stored.join(g, "uuid", "left")
        .withColumn("attributes", F.map_concat(kept, new))
        .withColumn("labels", F.array_union("labels", F.coalesce("_l", F.array().cast("array<string>"))))
        .withColumn("summary", F.coalesce(F.nullif("_s", F.lit("")), "summary"))
        .select(*stored.columns)
    )


def triplet_edges(edges: DataFrame, stored: DataFrame) -> DataFrame:
    """Given edges, with a new uuid where a stored edge of theirs joins other endpoints."""
    s = stored.select("uuid", F.col("source_node_uuid").alias("_s"), F.col("target_node_uuid").alias("_t"))
    moved = F.col("_s").isNotNull() & ((F.col("_s") != F.col("source_node_uuid")) | (F.col("_t") != F.col("target_node_uuid")))
    fresh = F.sha2(F.concat_ws("|", "uuid", "source_node_uuid", "target_node_uuid"), 256)
    return edges.join(s, "uuid", "left").withColumn("uuid", F.when(moved, fresh).otherwise(F.col("uuid"))).select(*edges.columns)


def saga_links(episodes: DataFrame, saga: str = "saga", order: str = "valid_at") -> tuple[DataFrame, DataFrame]:
    """HAS_EPISODE and NEXT_EPISODE links (source, target) of episodes with a saga column."""
    has = episodes.select(F.col(saga).alias("source_node_uuid"), F.col("uuid").alias("target_node_uuid"))
    return has, temporal.chain(episodes, saga, order)


def removed_episode(episode: str, episodes: DataFrame, mentions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that go with an episode: nodes that it alone mentions, edges that it was the first to state."""
    other = mentions.groupBy(F.col("target_node_uuid").alias("uuid")).agg(F.countDistinct("source_node_uuid").alias("n"))
    own = mentions.filter(F.col("source_node_uuid") == episode).select(F.col("target_node_uuid").alias("uuid")).distinct()
    return own.join(other.filter("n = 1"), "uuid").select("uuid"), edges.filter(F.get("episodes", F.lit(0)) == episode).select("uuid")


def of_episodes(episodes: DataFrame, edges: DataFrame, by: str = "entity_edges") -> DataFrame:
    """Edges that episodes list, or (by="episodes") that list one of the episodes."""
    if by == "entity_edges":
        return edges.join(episodes.select(F.explode("entity_edges").alias("uuid")), "uuid", "left_semi")
    hit = edges.select(F.col("uuid").alias("u"), F.explode("episodes").alias("uuid")).join(episodes.select("uuid"), "uuid", "left_semi").select(F.col("u").alias("uuid")).distinct()
    return edges.join(hit, "uuid", "left_semi")


def episodes_by_mentions(edges: DataFrame, episodes: DataFrame, limit: int) -> DataFrame:
    """The first `limit` episodes of each edge's list."""
    return episodes.join(edges.select(F.explode(F.slice("episodes", 1, limit)).alias("uuid")).distinct(), "uuid", "left_semi")


def closest(names: DataFrame, known: DataFrame, least: float = 0.9) -> DataFrame:
    """(uuid, match): the known entity of the group whose name vector is closest, above a cosine."""
    k = known.select("group_id", F.col("uuid").alias("b"), F.col("name_embedding").alias("kv"))
    s = names.join(k, "group_id").withColumn("score", vector.cosine("name_embedding", "kv")).filter(F.col("score") > least)
    return resolve.first_of(s, ["uuid"], [F.desc("score"), F.asc("b")]).select("uuid", F.col("b").alias("match"))


def identity_seed(spark: SparkSession, group_id: str, person: str, roles: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a self that is a person and has roles."""
    uid = lambda x: f"seed:{group_id}:{x}"
    nodes = [(uid("self"), group_id, "Self", True)] + [(uid(x), group_id, x, False) for x in (person, *roles)]
    edges = [(uid("same"), group_id, uid("self"), uid(person), "SAME_AS")] + [(uid(f"role:{r}"), group_id, uid("self"), uid(r), "HAS_ROLE") for r in roles]
    return spark.createDataFrame(nodes, "uuid string, group_id string, name string, is_identity boolean"), spark.createDataFrame(edges, "uuid string, group_id string, source_node_uuid string, target_node_uuid string, name string")


def cached(requests: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers, new cache rows) of requests (model, messages): known keys are joined, only the rest is computed."""
    keyed = requests.withColumn("key", F.md5(F.concat_ws(":", "model", "messages")))
    missing = compute(keyed.dropDuplicates(["key"]).join(cache, "key", "left_anti")).select("key", "response")
    return keyed.join(cache.unionByName(missing), "key", "left"), missing


def salvaged(reply: str):
    """The longest prefix of a truncated JSON reply that parses once its open brackets are closed; None if there is none."""
    reply = re.sub(r"^```(?:json)?|```$", "", reply.strip()).strip()
    for end in range(len(reply), 0, -1):
        if reply[end - 1] not in '}]",0123456789elL ' and end != len(reply):
            continue
        stack, quoted, escaped = [], False, False
        for c in reply[:end]:
            if quoted:
                quoted, escaped = escaped or c != '"', c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]" and stack:
                stack.pop()
        if quoted:
            continue
        try:
            return json.loads(reply[:end].rstrip(" ,:") + "".join(reversed(stack)))
        except ValueError:
            continue
    return None
