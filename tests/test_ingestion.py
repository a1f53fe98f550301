"""Steps of writing to the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.operators import ingestion
from tidegraph.operators.util import checkpoints


def test_batch_and_triplets(spark):
    checkpoints(spark)
    n = spark.createDataFrame([("1", "Joe Michaels"), ("2", "joe  michaels"), ("3", "Joe-Michaels"), ("4", "Somebody Else")], "uuid string, name string")
    assert {r.uuid: r.root for r in ingestion.dedupe_batch(n).collect()} == {"1": "1", "2": "1", "3": "1", "4": "4"}
    near = [("7", "Northern Lights Observatory"), ("6", "Northern Lights Observatory!"), ("5", "Northern Lights Observatoryy"), ("8", "Southern Lights Observatory"), ("9", None)]
    near += [("x", "Bo"), ("y", "Bo.")]  # equal in loose form, but neither is telling
    got = {r.uuid: r.root for r in ingestion.dedupe_batch(spark.createDataFrame(near, "uuid string, name string")).collect()}
    assert got == {"5": "5", "6": "5", "7": "5", "8": "8", "9": "9", "x": "x", "y": "y"}
    schema = "uuid string, attributes map<string,string>, labels array<string>, summary string"
    stored = spark.createDataFrame([("a", {"age": "30", "city": "New York"}, ["Entity", "Person"], "old")], schema)
    given = spark.createDataFrame([("a", {"age": "31", "department": "Engineering"}, ["Person", "Employee"], "new")], schema)
    r = ingestion.merged_node(stored, given).first()
    assert r.attributes == {"age": "31", "city": "New York", "department": "Engineering"} and r.labels == ["Entity", "Person", "Employee"] and r.summary == "new"
    edge = "uuid string, source_node_uuid string, target_node_uuid string"
    old = spark.createDataFrame([("e", "alice", "bob")], edge)
    got = [r.uuid for r in ingestion.triplet_edges(spark.createDataFrame([("e", "alice", "charlie")], edge), old).collect()]
    assert got != ["e"] and ingestion.triplet_edges(old, old).first().uuid == "e"


def test_removed_episode(spark):
    link = "source_node_uuid string, target_node_uuid string"
    m = spark.createDataFrame([("ep", "a"), ("ep", "b"), ("other", "b")], link)
    e = spark.createDataFrame([("x", ["ep", "other"]), ("y", ["other", "ep"])], "uuid string, episodes array<string>")
    eps = spark.createDataFrame([("ep", ["x"])], "uuid string, entity_edges array<string>")
    nodes, edges = ingestion.removed_episode("ep", eps, m, e)
    assert [r.uuid for r in nodes.collect()] == ["a"] and [r.uuid for r in edges.collect()] == ["x"]
    assert [r.uuid for r in ingestion.of_episodes(eps, e).collect()] == ["x"]
    assert sorted(r.uuid for r in ingestion.of_episodes(eps, e, "episodes").collect()) == ["x", "y"]


def test_cache_and_salvage(spark):
    asked = spark.createDataFrame([("m", "one"), ("m", "two"), ("m", "two")], "model string, messages string")
    none = spark.createDataFrame([], "key string, response string")
    run = lambda d: d.withColumn("response", F.upper("messages"))
    answers, new = ingestion.cached(asked, none, run)
    assert sorted(r.response for r in answers.collect()) == ["ONE", "TWO", "TWO"] and new.count() == 2
    assert ingestion.cached(asked, new, run)[1].count() == 0
    assert ingestion.salvaged('{"a": [1, 2, {"b": "x"}, {"b": "y') == {"a": [1, 2, {"b": "x"}]} or ingestion.salvaged('{"a": [1, 2') == {"a": [1, 2]}
    assert ingestion.salvaged('```json\n{"a": 1}\n```') == {"a": 1} and ingestion.salvaged("nothing") is None
