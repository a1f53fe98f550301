"""Rerankers over result lists (list_id, uuid, rank from 0) or candidates in order (uuid, pos)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector


def ranked(df: DataFrame, list_id: int, score: str = "score", key: str = "uuid") -> DataFrame:
    """A scored list as (list_id, key, rank)."""
    w = Window.partitionBy(F.lit(list_id)).orderBy(F.desc(score), key)
    return df.select(F.lit(list_id).alias("list_id"), F.col(key), (F.row_number().over(w) - 1).cast("bigint").alias("rank"))


def rrf(lists: DataFrame, rank_const: int = 1, min_score: float = 0.0, key: str = "uuid") -> DataFrame:
    """Sum of 1 / (rank + rank_const) over the lists; best first, ties by first list and rank."""
    s = lists.groupBy(key).agg(F.sum(1 / (F.col("rank") + rank_const)).alias("score"), F.min(F.struct("list_id", "rank")).alias("first"))
    return s.filter(F.col("score") >= min_score).orderBy(F.desc("score"), "first", key).select(key, "score")


def neighbours(edges: DataFrame, centre: str) -> DataFrame:
    """uuids next to the centre, either direction."""
    far = F.when(F.col("source_node_uuid") == centre, F.col("target_node_uuid")).when(F.col("target_node_uuid") == centre, F.col("source_node_uuid"))
    return edges.select(far.alias("uuid")).filter("uuid IS NOT NULL").distinct()


def node_distance(candidates: DataFrame, edges: DataFrame, centre: str, min_score: float = 0.0) -> DataFrame:
    """The centre first (10), its neighbours (1), the rest (0); each in the order given."""
    near = neighbours(edges, centre).withColumn("near", F.lit(True))
    s = candidates.join(near, "uuid", "left").withColumn("score", F.when(F.col("uuid") == centre, 10.0).when(F.col("near"), 1.0).otherwise(0.0))
    return s.filter(F.col("score") >= min_score).select("uuid", "score", "pos").orderBy(F.desc("score"), "pos")


def episode_mentions(candidates: DataFrame, mentions: DataFrame, order: str = "ascending") -> DataFrame:
    """By number of mentions: ascending with unmentioned last (infinite), or descending with unmentioned as 0."""
    n = mentions.groupBy(F.col("target_node_uuid").alias("uuid")).agg(F.count("*").cast("double").alias("n"))
    s = candidates.join(n, "uuid", "left").withColumn("score", F.coalesce("n", F.lit(float("inf") if order == "ascending" else 0.0)))
    return s.select("uuid", "score", "pos").orderBy(F.asc("score") if order == "ascending" else F.desc("score"), "pos")


def mmr(candidates: DataFrame, query: list[float], lam: float = 0.5, min_score: float = -2.0, embedding: str = "embedding", normalise_query: bool = False) -> DataFrame:
    """Maximal marginal relevance in one pass over a candidate list of bounded length (twice a search limit)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    q = vector.normalised(q) if normalise_query else q
    c = candidates.select("uuid", vector.normalised(embedding).alias("v"))
    other = c.select(F.col("uuid").alias("other"), F.col("v").alias("w"))
    alike = c.join(F.broadcast(other), F.col("uuid") != F.col("other"), "left").groupBy("uuid", "v").agg(F.max(vector.dot("v", "w")).alias("most"))
    s = alike.select("uuid", (lam * vector.dot("v", q) + (lam - 1) * F.greatest(F.coalesce("most", F.lit(0.0)), F.lit(0.0))).alias("score"))
    return s.filter(F.col("score") >= min_score).orderBy(F.desc("score"), "uuid")


def cross_encoder(candidates: DataFrame, query: str, scorer, passage: str = "fact") -> DataFrame:
    """Scores (query, passage) pairs in Arrow batches by `scorer(query, list of passages) -> list of floats`."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(scorer(query, s.fillna("").tolist()), dtype="float64")

    return candidates.withColumn("score", score(F.col(passage))).orderBy(F.desc("score"), "uuid")


def overlap_score(query: str, passages: list[str]) -> list[float]:
    """A deterministic stand-in for a cross-encoder: the share of the query's words in the passage."""
    q = set(query.lower().split())
    return [len(q & set(p.lower().split())) / max(1, len(q)) for p in passages]


def rescored(df: DataFrame, score: Column, min_score: float, limit: int) -> DataFrame:
    return df.withColumn("score", score).filter(F.col("score") >= min_score).orderBy(F.desc("score"), "uuid").limit(limit)
