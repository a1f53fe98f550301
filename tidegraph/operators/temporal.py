"""Bi-temporal reads and invalidation: facts are closed, never deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(edges: DataFrame, valid: Column, known: Column | None = None) -> DataFrame:
    """Facts that held at `valid`, and, if given, were believed at `known`."""
    out = edges.filter((F.col("valid_at") <= valid) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > valid)))
    if known is not None:
        out = out.filter((F.col("created_at") <= known) & (F.col("expired_at").isNull() | (F.col("expired_at") > known)))
    return out


def last_n(episodes: DataFrame, n: int, at: Column | None = None, order: str = "valid_at", group: str = "group_id") -> DataFrame:
    """Each group's latest n episodes up to a time, in order of time."""
    d = episodes.filter(F.col(order) <= at) if at is not None else episodes
    w = Window.partitionBy(group).orderBy(F.desc(order), F.desc("uuid"))
    return d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r").orderBy(group, order, "uuid")


def previous(episodes: DataFrame, n: int, order: str = "valid_at", group: str = "group_id", include_self: bool = True) -> DataFrame:
    """(uuid, previous): for each episode its group's latest n up to its own time, one window pass without a range join."""
    w = Window.partitionBy(group).orderBy(order, "uuid")
    frame = w.rowsBetween(-(n - 1), 0) if include_self else w.rowsBetween(-n, -1)
    return episodes.withColumn("previous", F.collect_list("uuid").over(frame)).select("uuid", "previous")


def chain(episodes: DataFrame, saga: str = "saga", order: str = "valid_at") -> DataFrame:
    """NEXT_EPISODE links (source, target) inside each saga."""
    w = Window.partitionBy(saga).orderBy(order, "uuid")
    return episodes.withColumn("source_node_uuid", F.lag("uuid").over(w)).filter("source_node_uuid IS NOT NULL").select("source_node_uuid", F.col("uuid").alias("target_node_uuid"))


def invalidate(old: DataFrame, new: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """Old facts closed by contradicting new ones; pairs has (old, new) uuids.

    A pair whose intervals do not meet is left alone; else an old fact that began earlier ends when the earliest such
    new one begins, and expires now unless it already had.
    """
    n = new.select(F.col("uuid").alias("new"), F.col("valid_at").alias("n_valid"), F.col("invalid_at").alias("n_invalid"))
    o = old.select(F.col("uuid").alias("old"), F.col("valid_at").alias("o_valid"), F.col("invalid_at").alias("o_invalid"))
    apart = F.coalesce(F.col("o_invalid") <= F.col("n_valid"), F.lit(False)) | F.coalesce(F.col("n_invalid") <= F.col("o_valid"), F.lit(False))
    close = pairs.join(o, "old").join(n, "new").filter(~apart & (F.col("o_valid") < F.col("n_valid")))
    ends = close.groupBy(F.col("old").alias("uuid")).agg(F.min("n_valid").alias("_end"))
    return old.join(ends, "uuid", "left").withColumn("invalid_at", F.coalesce("_end", "invalid_at")).withColumn("expired_at", F.when(F.col("_end").isNotNull(), F.coalesce("expired_at", now)).otherwise(F.col("expired_at"))).select(*old.columns)


def invalidate_within(facts: DataFrame, key: str, now: Column) -> DataFrame:
    """`invalidate` for all pairs of facts that share `key`, in one window pass and without making the pairs.

    A later fact n meets o if n begins after o does and n's end, if any, is later too: if the lesser of n's ends comes
    after o's beginning. o ends at the earliest such beginning, unless it has ended by then.
    """
    marks = facts.select(F.col(key).alias("_k"), F.least("valid_at", "invalid_at").alias("_t"), F.lit(1).alias("_n"), F.col("valid_at").alias("_v"), F.lit(None).cast("string").alias("_u"), F.lit(None).cast("timestamp_ntz").alias("_i"))
    asked = facts.select(F.col(key).alias("_k"), F.col("valid_at").alias("_t"), F.lit(0).alias("_n"), F.lit(None).cast("timestamp_ntz").alias("_v"), F.col("uuid").alias("_u"), F.col("invalid_at").alias("_i"))
    both = marks.filter("_v IS NOT NULL").unionByName(asked.filter("_t IS NOT NULL")).filter("_k IS NOT NULL")
    w = Window.partitionBy("_k").orderBy(F.desc("_t"), "_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = both.withColumn("_end", F.min("_v").over(w)).filter("_n = 0 AND _end IS NOT NULL AND (_i IS NULL OR _i > _end)").groupBy(F.col("_u").alias("uuid")).agg(F.min("_end").alias("_end"))
    return facts.join(ends, "uuid", "left").withColumn("invalid_at", F.coalesce("_end", "invalid_at")).withColumn("expired_at", F.when(F.col("_end").isNotNull(), F.coalesce("expired_at", now)).otherwise(F.col("expired_at"))).select(*facts.columns)


def settle_new(new: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    """New facts against candidates (new, valid_at): closed ones expire now; an open one ends at the earliest later candidate."""
    c = candidates.select(F.col("new").alias("uuid"), F.col("valid_at").alias("c_valid"))
    later = new.join(c, "uuid").filter(F.col("c_valid") > F.col("valid_at")).groupBy("uuid").agg(F.min("c_valid").alias("_end"))
    d = new.join(later, "uuid", "left")
    ends = F.when(F.col("invalid_at").isNull(), F.col("_end")).otherwise(F.col("invalid_at"))
    return d.withColumn("invalid_at", ends).withColumn("expired_at", F.when(F.col("invalid_at").isNotNull(), F.coalesce("expired_at", now)).otherwise(F.col("expired_at"))).select(*new.columns)
