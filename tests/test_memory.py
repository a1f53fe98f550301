"""The store under failure, resolution end to end, communities and records, on small fixtures."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegraph.functions import text
from tidegraph.operators import candidates, community, records, resolve, retrieve, traverse
from tidegraph.operators.filters import SearchFilters
from tidegraph.operators.util import checkpoints
from tidegraph.plans import search
from tidegraph.sources.store import Conflict, GraphStore
from tidegraph.streaming import ingest

DAY = lambda n: dt.datetime(2024, 1, n)


def test_store_keeps_the_old_version_when_a_commit_dies(spark, tmp_path, monkeypatch):
    s = GraphStore(spark, f"file://{tmp_path}/s")
    one = spark.createDataFrame([("a", "g", "old")], "uuid string, group_id string, name string")
    assert s.upsert({"entity": one}) == 1
    monkeypatch.setattr(s, "_flip", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        s.upsert({"entity": one.withColumn("name", F.lit("new"))})
    monkeypatch.undo()
    assert [r.name for r in s.read("entity").collect()] == ["old"] and s.number() == 1
    with pytest.raises(Conflict):  # a writer that read version 0
        s.commit({"entity": s.read("entity").limit(0)}, after=0)
    assert s.read("entity").count() == 1
    twice = spark.createDataFrame([("a", "g", "second", 2), ("a", "g", "first", 1), ("b", "g", "b", 1)], "uuid string, group_id string, name string, at int")
    s.upsert({"entity": twice}, order="at")
    assert sorted(r.name for r in s.read("entity").collect()) == ["b", "second"] and [r.name for r in s.read("entity", 1).collect()] == ["old"]
    s.vacuum(1)
    assert s.read("entity").count() == 2 and {r.table: r.n for r in s.count().collect()}["entity"] == 2
    s.log("calls", spark.createDataFrame([("p", 3)], "prompt string, tokens int"))
    s.log("calls", spark.createDataFrame([("q", 4)], "prompt string, tokens int"))
    assert s.logged("calls").agg(F.sum("tokens")).first()[0] == 7


def test_batches_add_to_a_fact(spark, tmp_path):
    s = GraphStore(spark, f"file://{tmp_path}/s")
    row = lambda u, n: spark.createDataFrame([(u, "g", "Ann met Bob", DAY(n))], "uuid string, group_id string, content string, created_at timestamp_ntz")
    for u, n in (("e1", 5), ("e2", 2), ("e1", 5)):  # a late one, and one that is replayed
        ingest.ingest(s, row(u, n))
    got = s.read("entity_edge").collect()
    assert [(r.episodes, r.valid_at) for r in got] == [(["e1", "e2"], DAY(2))]
    assert "yours" in ingest.BLOCKED and "someone" not in ingest.BLOCKED


def _edges(spark, rows):
    schema = "uuid string, group_id string, source_node_uuid string, target_node_uuid string, name string, fact string, fact_embedding array<float>, valid_at timestamp_ntz, invalid_at timestamp_ntz, expired_at timestamp_ntz"
    return spark.createDataFrame([(u, "g", s, t, "R", f, v, a, b, None) for u, s, t, f, v, a, b in rows], schema)


def test_facts_are_resolved_end_to_end(spark):
    x, y = [1.0, 0.0], [0.0, 1.0]
    stored = _edges(spark, [("s1", "a", "b", "Ann lives in  Berlin", x, DAY(1), None), ("s2", "a", "c", "Ann works at C", x, DAY(2), None), ("s3", "a", "d", "Ann left D", x, DAY(20), None), ("s4", "a", "e", "far", y, DAY(1), None), ("s5", "a", "f", "over", x, DAY(1), DAY(3))])
    new = _edges(spark, [("n1", "a", "b", "ann lives in berlin", x, DAY(9), None), ("n2", "a", "b", "Ann dwells in Berlin", x, DAY(9), None), ("n3", "a", "h", "Ann works at H", x, DAY(10), None)])
    shown = []

    def judge(pairs):
        shown.extend((r.probe, r.uuid, r.kind) for r in pairs.collect())
        return spark.createDataFrame([("n2", "s1", "same"), ("n3", "s1", "same"), ("n3", "s2", "contradicts"), ("n3", "s3", "contradicts"), ("n3", "s4", "contradicts"), ("n3", "s5", "contradicts"), ("n1", "s2", "contradicts")], "probe string, uuid string, verdict string")

    kept, ended, same = candidates.resolved_edges(new, stored, judge, F.lit(DAY(30)).cast("timestamp_ntz"))
    assert {p for p, *_ in shown} == {"n2", "n3"} and ("n2", "s1", "duplicate") in shown and ("n2", "s1", "other") not in shown and all(u != "s4" for _, u, _ in shown)
    assert {(r.uuid, r.match) for r in same.collect()} == {("n1", "s1"), ("n2", "s1")}
    assert [(r.uuid, r.invalid_at, r.expired_at) for r in kept.collect()] == [("n3", DAY(20), DAY(30))]  # a later fact is known
    assert [(r.uuid, r.invalid_at, r.expired_at) for r in ended.collect()] == [("s2", DAY(10), DAY(30))]


def test_names_left_open_are_decided_with_guards(spark):
    names = spark.createDataFrame([("q1", "Ann Smith"), ("q2", "Zo"), ("q3", "Unknown Person")], "uuid string, name string")
    known = spark.createDataFrame([("k1", "ann  smith"), ("k2", "Zoe Miller"), ("k3", "Bob")], "uuid string, name string")
    near = spark.createDataFrame([("q2", "k2"), ("q3", "k3"), ("q1", "k3")], "probe string, uuid string")
    decide = lambda d: spark.createDataFrame([("q2", "k2"), ("q2", "k9"), ("q3", "k2"), ("q1", "k3")], "uuid string, match string")
    got = {r.uuid: r.match for r in candidates.resolved_nodes(names, known, near, decide).collect()}
    assert got == {"q1": "k1", "q2": "k2", "q3": None}
    facts = spark.createDataFrame([("g", "ANN smith", "Bob", "ok", "2024-01-02T00:00:00", "nonsense"), ("g", "Ann Smith", "Nobody", "no end", None, None), ("g", "Bob", "Bob", "  ", None, None)], "group_id string, source string, target string, fact string, valid_at string, invalid_at string")
    got = candidates.valid_facts(facts, known.withColumn("group_id", F.lit("g"))).collect()
    assert [(r.source_node_uuid, r.target_node_uuid, r.valid_at, r.invalid_at) for r in got] == [("k1", "k3", DAY(2), None)]


def test_communities_are_built_and_updated(spark):
    checkpoints(spark)
    nodes = spark.createDataFrame([(u, "g", u) for u in "abcdef"] + [("z", "h", "z")], "uuid string, group_id string, summary string")
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f")]
    edges = spark.createDataFrame([p for p in pairs for _ in range(2)] + [("a", "z")] * 5, "source_node_uuid string, target_node_uuid string")
    rows, links = community.built(nodes, edges, lambda x, y: f"{x}+{y}", lambda s: F.concat(F.lit("about "), s), DAY(1))
    members = {}
    for r in links.collect():
        members.setdefault(r.source_node_uuid, set()).add(r.target_node_uuid)
    assert sorted(map(sorted, members.values())) == [["a", "b", "c"], ["d", "e", "f"], ["z"]]
    assert all(set(r.summary.split("+")) == members[r.uuid] and r.name == f"about {r.summary}" for r in rows.collect())
    fresh = spark.createDataFrame([("n", "g", "n")], "uuid string, group_id string, summary string")
    graph = community.projection(spark.createDataFrame([("n", "a"), ("n", "b"), ("n", "d")], "source_node_uuid string, target_node_uuid string"))
    changed, more = community.updated(fresh, rows, links, graph, lambda x, y: f"{x}+{y}")
    assert [r.target_node_uuid for r in more.collect()] == ["n"] and changed.first().uuid == more.first().source_node_uuid
    assert "a" in changed.first().summary and changed.first().summary.endswith("+n") and changed.count() == 1


def test_edge_filters_and_recipes(spark):
    nodes = spark.createDataFrame([("a", "g", ["Entity", "Person"], "a"), ("b", "g", ["Entity", "Person"], "b"), ("p", "g", ["Entity", "Place"], "p")], "uuid string, group_id string, labels array<string>, name string")
    edges = spark.createDataFrame([("e1", "g", "a", "b", "KNOWS", "ann knows bob"), ("e2", "g", "a", "p", "LIVES", "ann lives here")], "uuid string, group_id string, source_node_uuid string, target_node_uuid string, name string, fact string")
    request = search.Request(query="ann", filters=SearchFilters(node_labels=["Person"]))
    assert [r.uuid for r in search.simple({"entity": nodes, "entity_edge": edges}, request).collect()] == ["e1"]
    assert sorted(r.uuid for r in search.simple({"entity": nodes, "entity_edge": edges}, search.Request(query="ann")).collect()) == ["e1", "e2"]
    assert search.RECIPES["combined_mmr"].edge.mmr_lambda == 1 and search.RECIPES["community_cross_encoder"].limit == 3 and len(search.RECIPES) == 16
    walk = traverse.bfs_nodes(edges, nodes.filter("uuid = 'a'"), 1, groups=nodes.withColumn("group_id", F.when(F.col("uuid") == "p", "other").otherwise("g")))
    assert [r.uuid for r in walk.collect()] == ["b"]


def test_records(spark):
    d = spark.createDataFrame([("u", "g-1", ["Entity", "Entity_g1", "X"], {"name": "n", "fact_embedding": "v", "age": "4"})], "uuid string, group_id string, labels array<string>, attributes map<string,string>")
    r = d.select(records.attributes().alias("a"), records.without_embeddings().alias("b"), records.shown_labels().alias("l")).first()
    assert (r.a, r.b, r.l) == ({"age": "4"}, {"name": "n", "age": "4"}, ["Entity", "X"])
    assert records.of_types(d, ["X"]).count() == 0 and records.of_types(d, ["Entity"], ["X"]).count() == 1
    with pytest.raises(ValueError):
        records.of_types(d, ["Y"], ["X"])
    with pytest.raises(ValueError):
        records.checked_ids(["ok_1", "", "not ok"])
    times = spark.createDataFrame([("a", DAY(3)), ("b", None), ("c", DAY(1))], "uuid string, valid_at timestamp_ntz")
    assert [r.uuid for r in candidates.oldest_first(times).collect()] == ["c", "a", "b"]
    s = times.filter("uuid = 'a'").select(text.iso_json(F.struct("uuid", F.struct("valid_at").alias("x"))).alias("j"), text.utc("valid_at", "Asia/Tokyo").alias("t")).first()
    assert s.j == '{"uuid":"a","x":{"valid_at":"2024-01-03T00:00:00"}}' and s.t == DAY(2).replace(hour=15)
    circle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "a string, b string")
    with pytest.raises(ValueError):
        resolve.directed_map(circle, max_rounds=5).collect()


def test_texts_per_probe_by_classes_as_by_loops(spark):
    """Whatever counts as a common term, the best rows are those of a loop over all pairs; rows with equal words are compared once."""
    import math
    import random
    from collections import Counter

    rng = random.Random(8)
    names = [" ".join(rng.choice(["red", "blue", "bolt", "rod", "ring", f"n{rng.randint(0, 30)}"]) for _ in range(rng.randint(1, 4))) for _ in range(160)] + ["", "red"]
    rows = [(f"u{i:03}", rng.choice("gh"), n) for i, n in enumerate(names)]
    asked = [(u, g, n) for u, g, n in rows if int(u[1:]) % 5 == 0]
    n, a, df = len(rows), sum(len(r[2].split()) for r in rows) / len(rows), Counter(t for r in rows for t in set(r[2].split()))
    want = set()
    for u, g, q in asked:
        s = {}
        for v, h, m in rows:
            w = m.split()
            if h == g and set(w) & set(q.split()):
                s[v] = round(sum(sorted(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / a)) for t in set(q.split()) & set(w))), 9)
        want |= {(u, v, k + 1) for k, v in enumerate(sorted(s, key=lambda v: (-s[v], v))[:3])}
    d = spark.createDataFrame(rows, "uuid string, group_id string, name string")
    p = spark.createDataFrame(asked, "probe string, group_id string, query string")
    for common in (0, 4, 64):
        got = candidates.texts_per_probe(p, d, ("name",), 3, common=common)
        assert {(r.probe, r.uuid, r.rank) for r in got.collect()} == want, common
    known = retrieve.first_rows(d.withColumn("v", F.lit(1)), ["group_id", "v"], 3)
    assert {r.first: len(r.rows) for r in known.collect()} == {min(u for u, h, _ in rows if h == g): 3 for g in "gh"}
