"""Golden cases of the graph operators on small graphs."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.functions import chunking, text, vector
from tidegraph.operators import community, filters, lookup, rerank, resolve, retrieve, temporal, traverse
from tidegraph.operators.util import checkpoints
from tidegraph.plans import queries, search
from tidegraph.sources.views import view
from tidegraph.sources.store import GraphStore, NotFound, merge

EDGE = "uuid string, source_node_uuid string, target_node_uuid string"


def edges(spark, rows):
    return spark.createDataFrame([(f"{a}-{b}", a, b) for a, b in rows], EDGE)


def values(df, *cols):
    return [tuple(r) if len(cols) != 1 else r[0] for r in df.select(*cols).collect()]


def test_bfs_depths(spark):
    e = spark.createDataFrame([("r1", "e1", "e2"), ("r2", "e2", "e3")], EDGE)
    m = spark.createDataFrame([("m", "ep", "e1")], EDGE)
    at = lambda *u: spark.createDataFrame([(x,) for x in u], "uuid string")
    got = lambda f, o, d: {r.uuid for r in f(e, at(o), d, m).collect()}
    assert [got(traverse.bfs_edges, "ep", d) for d in (1, 2, 3)] == [set(), {"r1"}, {"r1", "r2"}]
    assert [got(traverse.bfs_edges, "e1", d) for d in (1, 2)] == [{"r1"}, {"r1", "r2"}]
    assert [got(traverse.bfs_nodes, "ep", d) for d in (1, 2)] == [{"e1"}, {"e1", "e2"}]
    loop = edges(spark, [("a", "b"), ("b", "a")])
    assert {r.uuid for r in traverse.bfs_nodes(loop, at("a"), 2).collect()} == {"a", "b"}


def test_rerankers(spark):
    lists = spark.createDataFrame([(0, "a", 0), (0, "b", 1), (0, "c", 2), (1, "b", 0), (1, "a", 1), (1, "d", 2)], "list_id int, uuid string, rank long")
    top = values(rerank.rrf(lists), "uuid", "score")
    assert top[:2] == [("a", 1.5), ("b", 1.5)]
    one = spark.createDataFrame([(0, "a", 0), (0, "b", 1)], "list_id int, uuid string, rank long")
    assert values(rerank.rrf(one, 60), "score") == [1 / 60, 1 / 61]
    c = spark.createDataFrame([("e2", 0), ("e3", 1)], "uuid string, pos int")
    assert values(rerank.node_distance(c, edges(spark, [("e1", "e2")]), "e1"), "uuid", "score") == [("e2", 1.0), ("e3", 0.0)]
    c = spark.createDataFrame([("e1", 0), ("e2", 1)], "uuid string, pos int")
    m = edges(spark, [("ep", "e1")])
    assert values(rerank.episode_mentions(c, m), "uuid", "score") == [("e1", 1.0), ("e2", float("inf"))]
    assert values(rerank.episode_mentions(c, m, "descending"), "uuid", "score") == [("e1", 1.0), ("e2", 0.0)]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])]
    d = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert values(d, vector.cosine("a", "b")) == [1.0, 0.0, -1.0, 0.0, 0.0, None]


def test_names(spark):
    d = spark.createDataFrame([("  Alice   Smith ",), ("Alice-Smith!",), ("aa",), ("alice",), ("",)], "n string")
    assert values(d, text.fuzzy("n"))[:2] == ["alice smith", "alice smith"]
    assert values(d, text.telling("n"))[2] is False
    assert sorted(values(d, text.shingles("n"))[3]) == ["ali", "ice", "lic"]
    assert values(d, text.shingles("n"))[2] == []
    assert values(d, text.entropy("n"))[4] == 0.0
    sets = spark.createDataFrame([(["a", "b"], ["a", "c"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert values(sets, F.round(text.jaccard("a", "b"), 4)) == [0.3333, 1.0, 0.0]


def test_truncate(spark):
    d = spark.createDataFrame([("First sentence. Second sentence. Third sentence. Fourth sentence.",)], "t string")
    assert values(d, text.truncated("t", 40)) == ["First sentence. Second sentence."]
    d = spark.createDataFrame([("What is this? This is a test. More text here.",)], "t string")
    assert values(d, text.truncated("t", 30)) == ["What is this? This is a test."]


def test_resolution(spark):
    known = spark.createDataFrame([("k1", "Joe Michaels"), ("k2", "Sam Peters"), ("k3", "sam  peters"), ("k4", "Unique Person")], "uuid string, name string")
    names = spark.createDataFrame([("a", "joe michaels"), ("b", "Joe"), ("c", "Joe-Michaels"), ("d", "Sam Peters"), ("e", "Unique Person")], "uuid string, name string")
    got = {r.uuid: r.match for r in resolve.resolve(names, known).collect()}
    assert got == {"a": "k1", "b": None, "c": "k1", "d": None, "e": "k4"}


def test_candidates_by_bands(spark):
    """Buckets give the pairs that loops over all signatures give, and no more."""
    rng = random.Random(3)
    rows = [(str(i), f"{rng.choice(['Blue', 'Green'])} {rng.choice(['River', 'Rivers', 'Lake'])} {rng.choice(['Trading', 'Traders'])} {rng.randint(0, 9)}") for i in range(60)]
    rows += [("n", None), ("e", ""), ("p", "?!"), rows[0]]
    d = spark.createDataFrame(rows, "uuid string, name string")
    names, known = d.filter("uuid < '3' OR uuid >= 'a'"), d.filter("uuid >= '2'")
    signed = lambda x: {r.uuid: r.m for r in x.select("uuid", text.shingles(text.fuzzy("name")).alias("s")).filter("size(s) > 0").select("uuid", text.minhash("s").alias("m")).collect()}
    a, b = signed(names), signed(known)
    want = {(x, y) for x, s in a.items() for y, t in b.items() if any(s[i : i + 4] == t[i : i + 4] for i in range(0, 32, 4))}
    got = resolve.lsh_candidates(names, known).collect()
    sides = {k: {} for k in ("name", "known")}
    for r in got:
        sides[r.side].setdefault((r.band, r.key), set()).add(r.uuid)
    assert len(got) == len(set(got)) and set(sides["name"]) == set(sides["known"])
    assert {(x, y) for k, xs in sides["name"].items() for x in xs for y in sides["known"][k]} == want and 0 < len(want) < len(a) * len(b)
    assert resolve.lsh_candidates(names.limit(0), known).count() == 0


def test_duplicate_facts_by_words_as_by_pairs(spark):
    checkpoints(spark)
    rng = random.Random(4)
    rows = [(f"f{i:02}", rng.choice("ab"), "z", " ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 3)))) for i in range(50)] + [("n", "a", "z", None), ("o", None, "z", "w1"), ("q", None, "z", "w1")]
    e = spark.createDataFrame(rows, EDGE + ", fact string")
    by_words, by_pairs = (dict(values(d, "uuid", "root")) for d in (resolve.duplicate_facts(e), resolve.duplicate_facts(e, judge=lambda p: p)))
    assert by_words == by_pairs and 3 < len(set(by_words.values())) < len(rows)


def test_components_and_map(spark):
    checkpoints(spark)
    pairs = lambda rows: spark.createDataFrame(rows, "a string, b string")
    assert dict(values(resolve.components(pairs([("c", "b"), ("b", "a"), ("z", "y")])), "uuid", "root")) == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}
    assert dict(values(resolve.directed_map(pairs([("a", "b"), ("b", "c")])), "uuid", "root")) == {"a": "c", "b": "c", "c": "c"}
    e = resolve.rewrite(edges(spark, [("alias", "t")]), spark.createDataFrame([("alias", "canon")], "uuid string, root string"))
    assert values(e, "source_node_uuid", "target_node_uuid") == [("canon", "t")]


def test_label_propagation(spark):
    checkpoints(spark)
    nodes = spark.createDataFrame([(x, "g") for x in "ab"], "uuid string, group_id string")
    labels = lambda g: len({r.label for r in community.propagate(nodes, g).collect()})
    assert labels(community.projection(edges(spark, [("a", "b"), ("b", "a")]))) == 1
    assert labels(spark.createDataFrame([], "n string, m string, weight long")) == 2
    members = spark.createDataFrame([("1", "C1", "e1"), ("2", "C1", "e2"), ("3", "C2", "e3")], EDGE)
    got = community.of_entities(members, community.projection(edges(spark, [("e1", "e4"), ("e2", "e4"), ("e3", "e4")]))).filter("uuid = 'e4'")
    assert values(got, "community", "is_new") == [("C1", True)]


def test_date_filters(spark):
    now = dt.datetime(2024, 5, 1)
    day = lambda n: now + dt.timedelta(days=n)
    d = spark.createDataFrame([("e", now, day(2), day(4), day(6)), ("n", now, None, None, None)], "uuid string, created_at timestamp_ntz, valid_at timestamp_ntz, invalid_at timestamp_ntz, expired_at timestamp_ntz")
    f = filters.SearchFilters(dates={"created_at": [[("=", now)]], "expired_at": [[("<>", now)]], "valid_at": [[(">=", day(1))], [("<=", day(3))]], "invalid_at": [[(">", day(3))], [("<", day(5))]]})
    assert values(d.filter(f.edge()), "uuid") == ["e"]
    assert values(d.filter(filters.SearchFilters(dates={"valid_at": [[("IS NULL",)]]}).edge()), "uuid") == ["n"]
    assert d.filter(filters.SearchFilters(edge_uuids=[]).edge()).count() == 0
    assert d.filter(filters.SearchFilters(edge_uuids=None).edge()).count() == 2


def test_as_of_episodes(spark):
    now = dt.datetime(2024, 5, 10)
    d = spark.createDataFrame([(str(n), "g", now - dt.timedelta(days=n)) for n in (2, 4, 6)], "uuid string, group_id string, valid_at timestamp_ntz")
    assert values(temporal.last_n(d, 5, F.lit(now - dt.timedelta(days=3)).cast("timestamp_ntz")), "uuid") == ["6", "4"]
    assert dict(values(temporal.previous(d, 2), "uuid", "previous"))["2"] == ["4", "2"]


def test_invalidation(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    schema = "uuid string, valid_at timestamp_ntz, invalid_at timestamp_ntz, expired_at timestamp_ntz"
    old = spark.createDataFrame([("o1", t(1), None, None), ("o2", t(1), t(2), None), ("o3", t(9), None, None)], schema)
    new = spark.createDataFrame([("n", t(5), None, None)], schema)
    pairs = spark.createDataFrame([("o1", "n"), ("o2", "n"), ("o3", "n")], "old string, new string")
    got = {r.uuid: (r.invalid_at, r.expired_at) for r in temporal.invalidate(old, new, pairs, F.lit(t(20)).cast("timestamp_ntz")).collect()}
    assert got == {"o1": (t(5), t(20)), "o2": (t(2), None), "o3": (None, None)}
    settled = temporal.settle_new(new, spark.createDataFrame([("n", t(9)), ("n", t(7))], "new string, valid_at timestamp_ntz"), F.lit(t(20)).cast("timestamp_ntz"))
    assert values(settled, "invalid_at", "expired_at") == [(t(7), t(20))]


def test_per_probe_and_vector(spark):
    d = spark.createDataFrame([("alice", "g", [1.0, 0.0]), ("bob", "g", [0.0, 1.0]), ("alice smith", "g", [1.0, 0.0])], "uuid string, group_id string, v array<float>")
    probe = d.filter("uuid = 'alice'").select(F.col("uuid").alias("probe"), "group_id", F.col("v").alias("pv"))
    assert set(values(retrieve.per_probe(probe, d, ["group_id"], "pv", "v", 5, 0.9), "uuid")) == {"alice", "alice smith"}
    assert values(retrieve.by_vector(d, [0.0, 2.0], "v", 5), "uuid") == ["bob"]


def test_search_recipes(spark):
    assert len(search.RECIPES) == 16
    rows = [("1", "g", "a", "b", "r", "alice likes tea", [1.0, 0.0], ["x"]), ("2", "g", "b", "c", "r", "bob likes coffee", [0.0, 1.0], ["x", "y"])]
    e = spark.createDataFrame(rows, "uuid string, group_id string, source_node_uuid string, target_node_uuid string, name string, fact string, fact_embedding array<float>, episodes array<string>")
    ask = search.Request("tea", [1.0, 0.1], centre="a")
    for name in ("edge_rrf", "edge_mmr", "edge_node_distance", "edge_cross_encoder", "edge_episode_mentions"):
        got = search.search({"entity_edge": e}, search.RECIPES[name], ask)["edge"]
        assert values(got, "uuid")[0] == "1", name
    assert search.search({"entity_edge": e}, search.RECIPES["edge_rrf"], search.Request(" "))["edge"].count() == 0
    with pytest.raises(ValueError):
        search.search({"entity_edge": e}, search.RECIPES["edge_node_distance"], search.Request("tea", [1.0, 0.1]))


def test_store_and_ingest(spark, tmp_path):
    from tidegraph.streaming.ingest import ingest

    store = GraphStore(spark, f"file://{tmp_path}/graph")
    now = dt.datetime(2024, 1, 1)
    eps = spark.createDataFrame([("ep1", "g1", "Alice met Bob", now), ("ep2", "g1", "then Alice left", now)], "uuid string, group_id string, content string, created_at timestamp_ntz").withColumn("valid_at", F.col("created_at"))
    ingest(store, eps)
    ingest(store, eps)  # a replay changes nothing
    names = {r.name: r.uuid for r in store.read("entity").collect()}
    assert set(names) == {"Alice", "Bob"} and store.read("mentions").count() == 3 and store.read("entity_edge").count() == 1
    assert store.by_uuid("entity", names["Bob"]).count() == 1
    with pytest.raises(NotFound):
        store.by_uuid("entity", "none")
    store.delete_nodes("entity", spark.createDataFrame([(names["Bob"],)], "uuid string"))
    assert store.read("entity_edge").count() == 0 and store.read("mentions").count() == 2
    store.clear(["g1"])
    assert store.read("episodic").count() == 0
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "uuid string, name string")
    assert dict(values(merge(a, spark.createDataFrame([("2", "z"), ("3", "w")], "uuid string, name string")), "uuid", "name")) == {"1": "x", "2": "z", "3": "w"}


def test_chunking():
    import itertools
    import json

    data = json.dumps([{"id": i, "data": "x" * 100} for i in range(20)])
    chunks = chunking.json_chunks(data, 100, 20)
    ids = {x["id"] for c in chunks for x in json.loads(c)}
    assert ids == set(range(20)) and len(chunks) > 1
    assert chunking.key_count({"a": 1, "b": {"c": 1, "d": 2}, "e": [{"f": 1}, {"g": 2}]}, 2) == 7
    assert [chunking.key_count({"a": {"b": {"c": {"d": 1}}}}, d) for d in (1, 2)] == [1, 2]
    long = "\n\n".join("word " * 80 for _ in range(30))
    assert all(len(c) <= 800 for c in chunking.text_chunks(long, 200, 20))
    for n, k in ((6, 2), (7, 3), (30, 15)):
        sets = chunking.covering(list(range(n)), k)
        assert all(any({a, b} <= set(s) for s in sets) for a, b in itertools.combinations(range(n), 2))


def test_lookups(spark):
    e = edges(spark, [("a", "b"), ("c", "a")]).withColumn("fact", F.col("uuid"))
    assert dict(values(lookup.degrees(e), "uuid", "degree")) == {"a": 2, "b": 1, "c": 1}
    assert dict(values(lookup.facts_of(e), "node", "facts"))["a"] == "a-b\nc-a"
    n = spark.createDataFrame([("a", "g"), ("z", "g")], "uuid string, group_id string")
    assert values(lookup.orphans(n, e), "uuid") == ["z"]
    assert values(lookup.page(n, ["g"], 5, "z"), "uuid") == ["a"] and lookup.page(n, []).count() == 0


def test_readers(spark, tmp_path):
    from tidegraph.sources import readers

    (tmp_path / "t.txt").write_text("0 (1m 2s): Hello there\n\n1 (3s): Hi\nagain\n")
    got = values(readers.transcript(spark, f"file://{tmp_path}/t.txt", {0: "Ann"}, "2024-01-01 00:00:00").orderBy("pos"), "content", "valid_at")
    assert got == [("Ann: Hello there", dt.datetime(2024, 1, 1, 0, 1, 2)), ("Speaker 1: Hi\nagain", dt.datetime(2024, 1, 1, 0, 0, 3))]
    o = readers.ontology(spark, '{"entity_types": [{"name": "Person", "fields": [{"name": "age", "type": "int"}]}], "edge_types": [{"name": "KNOWS", "signatures": [{"source": "Person", "target": "Person"}]}]}')
    assert o.count() == 2


def _all(spark, name):
    return queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()


def test_queries_over_all_entities_and_facts(spark):
    sf = "/root/testdata/sf0.001"
    pairs = values(view(spark, sf, "entity_edge"), "source_node_uuid", "target_node_uuid")
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {r.uuid: r.root for r in _all(spark, "connected_components")} == {x: find(x) for x in root}
    names = set(values(view(spark, sf, "entity"), "uuid"))
    customers = {x for x in names if x.startswith("c:")}
    assert {r.uuid: r.root for r in _all(spark, "directed_uuid_map")} == dict.fromkeys(customers, "c:0")
    assert {r.uuid for r in _all(spark, "resolve_nodes")} == {"x" + x for x in names}


def test_invalidation_within_a_key_equals_all_pairs(spark):
    rng = random.Random(4)
    day = lambda: None if rng.random() < 0.2 else dt.datetime(2024, 1, rng.randint(1, 28))
    rows = [(f"f{i}", rng.choice("abc"), day(), day(), day()) for i in range(150)] + [("z", None, day(), None, None)]
    facts = spark.createDataFrame(rows, "uuid string, k string, valid_at timestamp_ntz, invalid_at timestamp_ntz, expired_at timestamp_ntz")
    pairs = facts.alias("o").join(facts.alias("n"), "k").filter("o.uuid <> n.uuid").select(F.col("o.uuid").alias("old"), F.col("n.uuid").alias("new"))
    now = F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz")
    want = {tuple(r) for r in temporal.invalidate(facts, facts, pairs, now).collect()}
    assert {tuple(r) for r in temporal.invalidate_within(facts, "k", now).collect()} == want
    again = facts.unionByName(facts)  # rows that repeat a uuid are not multiplied
    assert temporal.invalidate_within(again, "k", now).count() == 2 * len(rows)
    bought = view(spark, "/root/testdata/sf0.001", "entity_edge").filter("name = 'BOUGHT'")
    assert {r.uuid for r in _all(spark, "invalidate_edges")} == set(values(bought, "uuid"))


def test_queries_over_all_vectors_and_settled_labels(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.uuid: (r.group_id, np.array(r.embedding, dtype=float)) for r in view(spark, sf, "vectors").collect()}
    cos = lambda a, b: float(rows[a][1] @ rows[b][1] / np.linalg.norm(rows[a][1]) / np.linalg.norm(rows[b][1]))
    best = sorted(rows, key=lambda u: (-cos("v:0", u), u))[:40]
    assert {r.uuid for r in _all(spark, "mmr_rerank")} == set(best)
    want = set()
    for p in (u for u in rows if int(u[2:]) % 50 == 0):
        near = [u for u in rows if rows[u][0] == rows[p][0] and cos(p, u) > 0]
        want |= {(p, u) for u in sorted(near, key=lambda u: (-cos(p, u), u))[:5]}
    assert {(r.probe, r.uuid) for r in _all(spark, "relevant_nodes")} == want
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", 2) for i in range(30)] + [(f"n{i + 1:02}", f"n{i:02}", 1) for i in range(30)], "n string, m string, weight long")
    nodes = spark.createDataFrame([(f"n{i:02}", "g") for i in range(31)], "uuid string, group_id string")
    checkpoints(spark)
    assert len({r.label for r in community.propagate(nodes, chain, None).collect()}) < len({r.label for r in community.propagate(nodes, chain).collect()})


def test_bm25_of_equal_rows_ties_in_any_order(spark):
    """Three terms whose parts sum to unlike last digits in unlike orders; rows come in many partitions."""
    name = lambda i: "red widget economy" if i % 4 == 0 else "red rod large" if i % 2 else "hot widget economy" if i % 3 else "hot red widget"
    d = spark.createDataFrame([(f"u{i:03}", name(i)) for i in range(403)], "uuid string, name string").repartition(8)
    got = values(retrieve.bm25(d, ("name",), "the red widget economy", 101), "uuid", "score")
    assert [u for u, _ in got] == [f"u{i:03}" for i in range(0, 403, 4)] and len({s for _, s in got}) == 1


def test_duplicate_facts_in_shares_explode_only_what_meets(spark, monkeypatch):
    checkpoints(spark)
    rng = random.Random(6)
    rows = [(f"f{i:03}", f"a{rng.randint(0, 120)}", "z", f"w{rng.randint(0, 3)} x") for i in range(200)] + [("n", None, "z", "x"), ("o", None, "z", "x"), ("p", "a1", "z", None)]
    e = spark.createDataFrame(rows, EDGE + ", fact string")
    want = dict(values(resolve.duplicate_facts(e, judge=lambda p: p), "uuid", "root"))
    links, seen = resolve._word_links, []
    monkeypatch.setattr(resolve, "_word_links", lambda d: seen.append({r.uuid for r in d.collect()}) or links(d))
    for shares in (1, 5):
        assert dict(values(resolve.duplicate_facts(e, shares=shares), "uuid", "root")) == want
    ends = [r[1:3] for r in rows]
    assert all(s == {r[0] for r in rows if ends.count(r[1:3]) > 1} for s in seen) and len(seen) == 2 and len(seen[0]) < len(rows)


def test_resolution_asks_once_a_name(spark, monkeypatch):
    """Many rows of few names: what is kept on disk has a row a name, and the results are those of each row."""
    from tidegraph.operators import util

    names = spark.createDataFrame([(f"a{i:03}", ["Joe-Michaels", "SAM PETERS", "Unique Person", None, "Nobody Known"][i % 5]) for i in range(500)], "uuid string, name string")
    known = spark.createDataFrame([("k1", "joe michaels"), ("k2", "Sam Peters"), ("k3", "sam  peters"), ("k4", "Unique Person"), ("k0", "Joe  Michaels")], "uuid string, name string")
    write, rows = util.append, []
    monkeypatch.setattr(util, "append", lambda d, path: rows.append(d.count()) or write(d, path))
    got = {r.uuid: (r.match, r.score) for r in resolve.resolve(names, known).collect()}
    assert got == {f"a{i:03}": [("k0", 1.0), (None, None), ("k4", 1.0), (None, None), (None, None)][i % 5] for i in range(500)}
    assert rows and max(rows) <= 5


def test_labels_over_facts_by_blocks_as_by_exchanges(spark, monkeypatch):
    """Loops, facts both ways and repeated ones, swaps for ever, nodes without facts, ends that are no nodes; no join a round."""
    checkpoints(spark)
    rng = random.Random(9)
    for k in range(2):
        nodes = spark.createDataFrame([(f"n{i:02}", rng.choice("gh")) for i in range(40)] + [("s0", "k"), ("s1", "k"), ("lone", "k")], "uuid string, group_id string")
        e = edges(spark, [(f"n{rng.randint(0, 39):02}", f"n{rng.randint(0, 41):02}") for _ in range((45, 90)[k])] + [("s0", "s1"), ("s1", "s0"), ("n03", "n03")])
        want = set(values(community.propagate(nodes, community.projection(e), None), "uuid", "label"))
        assert set(values(community.propagate_facts(nodes, e, shares=2, block=16), "uuid", "label")) == want and len(want) == 43
    monkeypatch.setattr(community, "propagate", None)
    assert len(_all(spark, "label_propagation_all")) > 300


def _most_joined(spark, since):
    """The most rows that a join made in the executions from number `since` on."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, most = store.executionsList(), 0
    for e in (runs.apply(i).executionId() for i in range(runs.size())):
        if e >= since:
            values_of, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
            for n in (nodes.apply(i) for i in range(nodes.size())):
                rows = [m.accumulatorId() for m in (n.metrics().apply(i) for i in range(n.metrics().size())) if m.name() == "number of output rows"]
                most = max([most] + [int(values_of.apply(m).replace(",", "")) for m in rows if "Join" in n.name() and values_of.contains(m)])
    return most


def _shingles(name):
    s = name.replace(" ", "")
    return {s[i : i + 3] for i in range(len(s) - 2)} or ({s} if len(s) == 1 else set())


def _score(a, b):
    return len(a & b) / len(a | b)


def test_resolution_where_all_names_differ_and_share_their_shingles(spark):
    """The best match of each by loops, whether its set of shingles is known or not, and no join of names that are unlike."""
    ends = ["".join("abc"[i // 3**k % 3] for k in range(6)) for i in range(729)]
    known = spark.createDataFrame([(f"k{i:03}", f"Customer#{e}") for i, e in enumerate(ends) if i % 3], "uuid string, name string")
    given = ends + [e + "x" for e in ends[:60]]
    names = spark.createDataFrame([(f"a{i:03}", f"CUSTOMER # {e}") for i, e in enumerate(given)], "uuid string, name string")
    sets = [(f"k{i:03}", _shingles(f"customer {e}")) for i, e in enumerate(ends) if i % 3]
    want = {}
    for i, e in enumerate(given):
        less, b = min((-_score(_shingles(f"customer {e}"), s), b) for b, s in sets)
        want[f"a{i:03}"] = (b, -less) if -less >= 0.9 else (None, None)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    since = max((runs.apply(i).executionId() for i in range(runs.size())), default=-1) + 1
    assert {r.uuid: (r.match, r.score) for r in resolve.resolve(names, known).collect()} == want
    assert {s == 1.0 for _, s in want.values() if s} == {True, False} and (None, None) in want.values()
    assert 0 < _most_joined(spark, since) < 20 * len(ends)


def test_loose_pairs_equal_all_pairs(spark, monkeypatch):
    """Names of one to 90 characters, edited a little, in one share of keys and in many."""
    rng = random.Random(8)
    rows = ["", "a", "b", "ab", "abc", "aaaa", "aaaaaa", None]
    for n in (4, 9, 14, 22, 35, 60, 90):
        for _ in range(4):
            base = "".join(rng.choice("abcdefgh01 ") for _ in range(n)).strip()
            for _ in range(5):
                at = rng.randrange(n)
                rows.append(base[:at] + rng.choice(["", "x", "z9"]) + base[at + rng.randint(0, 1) :] + rng.choice(["", "y", " "]))
    d = spark.createDataFrame([(f"u{i:03}", x) for i, x in enumerate(rows)], "uuid string, name string")
    names, known = d.filter("uuid < 'u120'"), d.filter("uuid >= 'u004'")
    forms = lambda x: {f: u for f, u in sorted(values(x.select(text.fuzzy("name").alias("f"), "uuid").filter("f IS NOT NULL"), "f", "uuid"), key=lambda r: r[1], reverse=True) if _shingles(f)}
    a, b = forms(names), forms(known)
    for threshold, keys in ((0.9, 4000), (0.7, resolve.KEYS)):
        monkeypatch.setattr(resolve, "KEYS", keys)
        want = {(f, b[g], s) for f in a for g in b if (s := _score(_shingles(f), _shingles(g))) >= threshold}
        got = resolve.loose_pairs(names, known, threshold).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
        assert 5 < sum(s < 1 for _, _, s in want) < len(a) * len(b) / 4
