"""Episode ingestion in batch and by micro-batches, with pluggable models and deterministic stand-ins.

A micro-batch upserts by content-derived uuids, so one that is replayed changes nothing. Rows of a group are written in
order of arrival by the single writer of the store; a late batch adds its episodes and earlier times to the stored facts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import resolve
from ..sources.store import GraphStore

# Names that are pronouns and stand for nobody.
BLOCKED = "i you me we us he she they it my your yours mine our his her their this that these those".split()


def capitalised(content: pd.Series) -> pd.Series:
    """A stand-in for entity extraction: runs of capitalised words."""
    return content.fillna("").str.findall(r"\b[A-Z][\w'-]*(?: [A-Z][\w'-]*)*")


def hashed_vector(content: pd.Series, size: int = 16) -> pd.Series:
    """A stand-in for an embedder: signed counts of hashed words."""
    import zlib

    def one(s: str) -> list[float]:
        v = [0.0] * size
        for w in (s or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % size] += 1.0 if h & 1024 else -1.0
        return v

    return content.map(one)


def extracted(episodes: DataFrame, extract: Callable[[pd.Series], pd.Series] = capitalised) -> DataFrame:
    """(episode, group_id, name, at): names found in episodes (uuid, group_id, content, created_at), pronouns left out."""
    names = _names_udf(extract)
    d = episodes.select(F.col("uuid").alias("episode"), "group_id", F.col("created_at").alias("at"), F.explode(F.array_distinct(names(F.col("content")))).alias("name"))
    return d.filter((F.trim("name") != "") & ~F.lower("name").isin(BLOCKED))


def _names_udf(extract):
    @F.pandas_udf("array<string>")
    def names(s: pd.Series) -> pd.Series:
        return extract(s)

    return names


def _embed_udf(embed):
    @F.pandas_udf("array<float>")
    def vectors(s: pd.Series) -> pd.Series:
        return embed(s)

    return vectors


def ingest(store: GraphStore, episodes: DataFrame, extract=capitalised, embed=hashed_vector) -> None:
    """One batch: episodes, their entities (resolved against the stored ones of the group), mentions and co-mention facts."""
    found = extracted(episodes, extract).withColumn("key", text.normalised("name"))
    known = store.read("entity").select(F.col("group_id"), text.normalised("name").alias("key"), F.col("uuid").alias("stored"))
    stored = known.groupBy("group_id", "key").agg(F.min("stored").alias("stored"))
    named = found.join(stored, ["group_id", "key"], "left").withColumn("uuid", F.coalesce("stored", F.sha2(F.concat_ws("|", F.lit("entity"), "group_id", "key"), 256)))
    new = named.filter("stored IS NULL").groupBy("uuid", "group_id").agg(F.min("name").alias("name"), F.min("at").alias("created_at"))
    entities = new.select("uuid", "group_id", "name", "created_at", F.array(F.lit("Entity")).alias("labels"), _embed_udf(embed)(F.col("name")).alias("name_embedding"))
    mention = F.sha2(F.concat_ws("|", F.lit("mention"), "episode", "uuid"), 256)
    mentions = named.select(mention.alias("uuid"), "group_id", F.col("episode").alias("source_node_uuid"), F.col("uuid").alias("target_node_uuid"), F.col("at").alias("created_at")).dropDuplicates(["uuid"])
    one = named.select("episode", "group_id", "at", F.col("uuid").alias("source_node_uuid"), F.col("name").alias("n1"))
    two = named.select("episode", F.col("uuid").alias("target_node_uuid"), F.col("name").alias("n2"))
    facts = one.join(two, "episode").filter("source_node_uuid < target_node_uuid").withColumn("fact", F.concat("n1", F.lit(" appears with "), "n2"))
    facts = facts.groupBy("group_id", "source_node_uuid", "target_node_uuid").agg(F.min("fact").alias("fact"), F.min("at").alias("created_at"), F.array_sort(F.collect_set("episode")).alias("episodes"))
    facts = facts.select(F.sha2(F.concat_ws("|", F.lit("fact"), "group_id", "source_node_uuid", "target_node_uuid"), 256).alias("uuid"), "group_id", "source_node_uuid", "target_node_uuid", "created_at", F.lit("APPEARS_WITH").alias("name"), "fact", F.col("created_at").alias("valid_at"), "episodes")
    facts = restated(facts, store.read("entity_edge"))
    store.upsert({"episodic": episodes, "entity": entities, "mentions": mentions, "entity_edge": resolve.exact_facts(facts)})


def restated(facts: DataFrame, stored: DataFrame) -> DataFrame:
    """Facts with the episodes of their stored row before their own, and the earlier of both times: an older or repeated
    batch takes nothing away. What ended a stored fact still ends it."""
    old = stored.select("uuid", F.col("episodes").alias("_e"), F.col("created_at").alias("_c"), F.col("valid_at").alias("_v"), F.col("invalid_at").alias("_i"), F.col("expired_at").alias("_x"))
    d = facts.join(old, "uuid", "left")
    d = d.withColumn("episodes", F.array_distinct(F.concat(F.coalesce("_e", F.array().cast("array<string>")), "episodes")))
    return d.withColumn("created_at", F.least("created_at", "_c")).withColumn("valid_at", F.least("valid_at", "_v")).withColumn("invalid_at", F.col("_i")).withColumn("expired_at", F.col("_x")).drop("_e", "_c", "_v", "_i", "_x")


def stream(store: GraphStore, source: DataFrame, checkpoint: str, **how):
    """Starts a query that ingests each micro-batch of a streaming DataFrame of episodes."""
    return source.writeStream.foreachBatch(lambda batch, _: ingest(store, batch, **how)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_by_group(spark: SparkSession, path: str) -> DataFrame:
    """Events read as a stream, in one available-now run of stateful counts by group."""
    from ..operators.util import checkpoints

    checkpoints(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    name = path.rsplit("/", 1)[1]
    events = spark.readStream.schema(schema).option("pathGlobFilter", name if not name.endswith("*") else "*").parquet(path.rsplit("/", 1)[0])
    counts = events.groupBy(F.concat(F.lit("u"), "user_id").alias("group_id")).agg(F.count("*").alias("n"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")
