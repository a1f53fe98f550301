"""Readers of episodes, transcripts, chat sessions and type definitions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("message", "json", "text")


def episodes(spark: SparkSession, path: str, kind: str, group_id: str = "", file_format: str | None = None) -> DataFrame:
    """Files as episodes: lines of text, whole JSON lines, or messages (columns content, valid_at if the format has them)."""
    if kind not in KINDS:
        raise ValueError(f"unknown episode kind {kind}")
    if file_format == "parquet":
        d = spark.read.parquet(path)
    else:
        d = spark.read.text(path).withColumnRenamed("value", "content")
    at = F.col("valid_at") if "valid_at" in d.columns else F.lit(None).cast("timestamp_ntz")
    return d.filter("trim(content) <> ''").select(F.sha2(F.concat_ws("|", F.lit(group_id), "content"), 256).alias("uuid"), F.lit(group_id).alias("group_id"), F.lit(kind).alias("source"), "content", at.alias("valid_at"))


def transcript(spark: SparkSession, path: str, speakers: dict[int, str], start: str) -> DataFrame:
    """Blank-line blocks `<speaker> (<m>m <s>s): text` as messages at absolute times."""
    whole = spark.read.text(path, wholetext=True)
    block = whole.select(F.posexplode(F.split("value", r"\n\s*\n")).alias("pos", "b"))
    part = lambda i: F.regexp_extract("b", r"(?s)^\s*(\d+)\s*\((?:(\d+)m\s*)?(\d+)s\):\s*(.*?)\s*$", i)
    names = F.create_map(*[F.lit(x) for kv in speakers.items() for x in kv]) if speakers else F.create_map().cast("map<int,string>")
    d = block.filter(part(4) != "").select("pos", part(1).cast("int").alias("speaker"), (F.coalesce(part(2).try_cast("int"), F.lit(0)) * 60 + part(3).cast("int")).alias("seconds"), part(4).alias("text"))
    name = F.coalesce(F.try_element_at(names, F.col("speaker")), F.concat(F.lit("Speaker "), "speaker"))
    at = F.lit(start).cast("timestamp_ntz") + F.make_interval(secs=F.col("seconds"))
    return d.select("pos", name.alias("agent_id"), at.alias("valid_at"), F.concat(name, F.lit(": "), "text").alias("content"))


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """JSON rows with haystack_sessions (lists of role and content) and haystack_dates as one message a row."""
    schema = "haystack_sessions array<array<struct<role: string, content: string>>>, haystack_dates array<string>"
    d = spark.read.schema(schema).json(path).withColumn("row", F.monotonically_increasing_id())
    s = d.select("row", F.posexplode(F.arrays_zip("haystack_sessions", "haystack_dates")).alias("session", "z"))
    m = s.select("row", "session", "z.haystack_dates", F.posexplode("z.haystack_sessions").alias("turn", "m"))
    at = F.try_to_timestamp(F.regexp_replace("haystack_dates", r"\s*\([A-Za-z]+\)", ""), F.lit("yyyy/MM/dd HH:mm")).cast("timestamp_ntz")
    return m.select("row", "session", "turn", at.alias("valid_at"), F.col("m.role").alias("agent_id"), F.concat("m.role", F.lit(": "), "m.content").alias("content"))


def ontology(spark: SparkSession, text: str) -> DataFrame:
    """Type definitions as rows (kind, name, field, type, source, target), from JSON, or YAML where that reader is installed."""
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    rows = []
    for kind in ("entity_types", "edge_types"):
        for t in data.get(kind, []):
            ends = t.get("signatures") or [{}]
            for f in t.get("fields") or [{}]:
                rows += [(kind.split("_")[0], t["name"], f.get("name"), f.get("type"), e.get("source"), e.get("target")) for e in ends]
    return spark.createDataFrame(rows, "kind string, name string, field string, type string, source string, target string")
