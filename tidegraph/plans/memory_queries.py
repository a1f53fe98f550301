"""Registered queries of candidates, records and the store, over whole tables, each beside its SQL; see queries.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import candidates, records, resolve, retrieve, traverse
from ..operators.util import checkpoints
from ..sources.store import GraphStore
from ..sources.views import view
from . import search
from .queries import _HYBRID, COS, SQL, _bm25_sql, _q, query

VECTORS = 500  # embeddings that rows are given in turn
SHARE = 4_000_000  # rows of lineitem whose facts are made at a time
PROBE = 50  # ids divisible by it are searched for
NUMBER = "CAST(split_part({0}.uuid, ':', 2) AS BIGINT)"
_FACTS = f"SELECT e.uuid, e.group_id, e.source_node_uuid, e.target_node_uuid, v.embedding AS fact_embedding FROM entity_edge e JOIN vectors v ON v.uuid = 'v:' || ({NUMBER.format('e')} % {VECTORS}) WHERE e.name = 'BOUGHT'"
_NODES = f"SELECT e.uuid, e.group_id, e.name, v.embedding AS name_embedding FROM entity e JOIN vectors v ON v.uuid = 'v:' || ({NUMBER.format('e')} % {VECTORS})"


def _over(spark, sf, sql: str, *views: str) -> DataFrame:
    for v in views:
        view(spark, sf, v).createOrReplaceTempView(v)
    return spark.sql(sql)


def _rounded(df: DataFrame, *more: str) -> DataFrame:
    return df.select("probe", "uuid", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"), *more)


_BEST = f"SELECT probe, uuid, {COS.format('pv', 'fact_embedding')} AS c FROM met"
_RANKED = "row_number() OVER (PARTITION BY probe ORDER BY c DESC, uuid)"
_RELATED = f"""WITH fe AS MATERIALIZED ({_FACTS}), x AS (SELECT *, least(source_node_uuid, target_node_uuid) AS lo, greatest(source_node_uuid, target_node_uuid) AS hi FROM fe),
p AS (SELECT uuid AS probe, group_id, lo, hi, fact_embedding AS pv FROM x WHERE {NUMBER.format('x')} % {PROBE} = 0),
rel AS (SELECT probe, uuid, c, {_RANKED} AS r FROM (SELECT probe, uuid, {COS.format('pv', 'fact_embedding')} AS c FROM p JOIN x USING (group_id, lo, hi)) WHERE c > 0.1 QUALIFY r <= 5)"""


def _facts(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = _over(spark, sf, _FACTS, "entity_edge", "vectors")
    return e, e.filter(F.split("uuid", ":")[1].cast("bigint") % PROBE == 0)


@query("relevant_edges_topk", "entity_edge vectors", _RELATED + "\nSELECT probe, uuid, round(c, 6) AS score, r AS rank FROM rel")
def relevant_edges_topk(spark, sf):
    e, p = _facts(spark, sf)
    return _rounded(candidates.relevant_edges(p, e, 5, 0.1))


@query(
    "invalidation_candidates_topk",
    "entity_edge vectors",
    _RELATED
    + f""", ends AS (SELECT uuid, group_id, fact_embedding, source_node_uuid AS n FROM fe UNION ALL SELECT uuid, group_id, fact_embedding, target_node_uuid FROM fe),
pe AS (SELECT uuid AS probe, group_id, fact_embedding AS pv, n FROM ends WHERE {NUMBER.format('ends')} % {PROBE} = 0),
met AS (SELECT DISTINCT probe, uuid, pv, fact_embedding FROM pe JOIN ends USING (group_id, n) WHERE (probe, uuid) NOT IN (SELECT (probe, uuid) FROM rel)),
s AS ({_BEST})
SELECT probe, uuid, round(c, 6) AS score, r AS rank FROM (SELECT *, {_RANKED} AS r FROM s WHERE c > 0.1) WHERE r <= 5""",
)
def invalidation_candidates_topk(spark, sf):
    """Without those that relevant_edges_topk found as possible duplicates."""
    e, p = _facts(spark, sf)
    return _rounded(candidates.invalidation_candidates(p, e, 5, 0.1, without=candidates.relevant_edges(p, e, 5, 0.1)))


@query("relevant_edges_aligned", "entity_edge vectors", _RELATED + "\nSELECT p.probe, coalesce(string_agg(uuid, ',' ORDER BY r), '') AS matches FROM (SELECT DISTINCT probe FROM p) p LEFT JOIN rel ON rel.probe = p.probe AND uuid <> p.probe GROUP BY p.probe")
def relevant_edges_aligned(spark, sf):
    e, p = _facts(spark, sf)
    found = candidates.relevant_edges(p, e, 5, 0.1).filter("uuid <> probe")
    d = candidates.aligned(p.select(F.col("uuid").alias("probe"), F.col("uuid").alias("place")).distinct(), found, "place")
    return d.select("probe", F.array_join("matches", ",").alias("matches"))


@query(
    "relevant_nodes_hybrid",
    "entity vectors",
    rf"""WITH ne AS MATERIALIZED ({_NODES}), p AS (SELECT uuid AS probe, group_id, name, name_embedding AS pv FROM ne WHERE {NUMBER.format('ne')} % {PROBE} = 0),
near AS (SELECT probe, uuid, c, {_RANKED} AS r FROM (SELECT probe, uuid, {COS.format('pv', 'name_embedding')} AS c FROM p JOIN ne USING (group_id)) WHERE c > 0.1 QUALIFY r <= 5),
tok AS (SELECT uuid, group_id, list_filter(regexp_split_to_array(lower(name), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM ne),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)::DOUBLE) AS a FROM tok),
asked AS (SELECT DISTINCT probe, p.group_id, unnest(t) AS w FROM p JOIN tok ON uuid = probe),
tf AS (SELECT uuid, group_id, len(t)::DOUBLE AS dl, w, count(*)::DOUBLE AS tf FROM (SELECT uuid, group_id, t, unnest(t) AS w FROM tok) GROUP BY ALL),
df AS (SELECT w, count(*)::DOUBLE AS df FROM tf GROUP BY w),
sc AS (SELECT probe, uuid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS c FROM asked JOIN tf USING (group_id, w) JOIN df USING (w), st GROUP BY probe, uuid),
hit AS (SELECT probe, uuid, c, {_RANKED} AS r FROM sc QUALIFY r <= 5)
SELECT probe, uuid, round(c, 6) AS score, r AS rank, 'vector' AS "by" FROM near
UNION ALL SELECT probe, uuid, round(c, 6), r, 'text' FROM hit WHERE (probe, uuid) NOT IN (SELECT (probe, uuid) FROM near)""",
)
def relevant_nodes_hybrid(spark, sf):
    n = _over(spark, sf, _NODES, "entity", "vectors")
    p = n.filter(F.split("uuid", ":")[1].cast("bigint") % PROBE == 0).select(F.col("uuid").alias("probe"), "group_id", F.col("name").alias("query"), F.col("name_embedding").alias("vector"))
    return _rounded(candidates.relevant_nodes(p, n, 5, 0.1), "by")


@query("hybrid_node_search", "vectors", _HYBRID[: _HYBRID.rindex("SELECT uuid, round")] + SQL["hybrid_rrf"][SQL["hybrid_rrf"].index(", b AS (SELECT uuid, 0 AS l") :])
def hybrid_node_search(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("v:"), "doc_id").alias("uuid"), F.col("text").alias("name"))
    nodes = view(spark, sf, "vectors").join(docs, "uuid").select("uuid", "group_id", "name", F.lit("").alias("summary"), F.col("embedding").alias("name_embedding"))
    return search.hybrid_nodes(nodes, ["la le"], [_q(spark, sf)], 10, min_score=0.0).select("uuid", F.round("score", 6).alias("score"))


@query("node_bm25_indexed", "entity", _bm25_sql("entity", "name, summary", ["red", "widget", "economy"], 20))
def node_bm25_indexed(spark, sf):
    """Postings are stored first; the search reads the asked terms' buckets alone."""
    checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
    retrieve.indexed(view(spark, sf, "entity"), ("name", "summary"), path, buckets=16)
    return retrieve.bm25_indexed(spark, path, "the red widget economy", 20, buckets=16).select("uuid", F.round("score", 6).alias("score"))


@query(
    "bfs_nodes_same_group",
    "entity entity_edge",
    """WITH RECURSIVE w AS (SELECT DISTINCT o.group_id AS g, e.target_node_uuid AS n, 1 AS d FROM entity_edge e JOIN entity o ON o.uuid = e.source_node_uuid WHERE list_contains(o.labels, 'Supplier')
UNION SELECT g, e.target_node_uuid, d + 1 FROM w JOIN (SELECT DISTINCT source_node_uuid, target_node_uuid FROM entity_edge) e ON e.source_node_uuid = n WHERE d < 3)
SELECT n AS uuid, min(d)::BIGINT AS depth FROM w JOIN entity x ON x.uuid = n AND x.group_id = g GROUP BY n""",
)
def bfs_nodes_same_group(spark, sf):
    n = view(spark, sf, "entity")
    d = traverse.bfs_nodes(view(spark, sf, "entity_edge"), n.filter(F.array_contains("labels", "Supplier")), 3, groups=n)
    return d.groupBy("uuid").agg(F.min("depth").alias("depth"))


@query("not_yet_linked", "entity_edge", "SELECT 'c:' || c_custkey AS source_node_uuid, 'n:' || (c_custkey % 25) AS target_node_uuid FROM customer WHERE ('c:' || c_custkey, 'n:' || (c_custkey % 25)) NOT IN (SELECT (source_node_uuid, target_node_uuid) FROM entity_edge WHERE name = 'LOCATED_IN')")
def not_yet_linked(spark, sf):
    pairs = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("'c:' || c_custkey AS source_node_uuid", "'n:' || (c_custkey % 25) AS target_node_uuid")
    return candidates.not_linked(pairs, view(spark, sf, "entity_edge"), "LOCATED_IN")


_SIGNATURES = [("Customer", "Part", "BOUGHT"), ("Supplier", "Part", "SUPPLIES"), ("Entity", "Place", "LOCATED_IN"), ("Place", "Place", "IN_REGION"), ("Customer", "Goods", "ORDERED")]


@query(
    "allowed_edge_types",
    "entity entity_edge",
    f"""WITH l AS (SELECT uuid, unnest(list_distinct(list_concat(labels, ['Entity']))) AS label FROM entity), g(s, t, k) AS (VALUES {", ".join(map(str, _SIGNATURES))})
SELECT e.uuid, string_agg(DISTINCT k, ',' ORDER BY k) AS types FROM entity_edge e JOIN l a ON a.uuid = e.source_node_uuid JOIN l b ON b.uuid = e.target_node_uuid JOIN g ON g.s = a.label AND g.t = b.label GROUP BY e.uuid""",
)
def allowed_edge_types(spark, sf):
    s = spark.createDataFrame(_SIGNATURES, "source_label string, target_label string, edge_type string")
    d = candidates.allowed_types(view(spark, sf, "entity_edge"), view(spark, sf, "entity"), s)
    return d.select("uuid", F.array_join("types", ",").alias("types"))


@query("all_groups", "entity", "SELECT DISTINCT group_id FROM entity")
def all_groups(spark, sf):
    return records.groups(view(spark, sf, "entity"))


@query("attribution_union", "mentions", "SELECT target_node_uuid AS uuid, string_agg(DISTINCT agent_id, ',' ORDER BY agent_id) AS agents FROM mentions GROUP BY ALL")
def attribution_union(spark, sf):
    m = view(spark, sf, "mentions").select(F.col("target_node_uuid").alias("uuid"), F.array("agent_id").alias("agents"))
    return records.united(m, ["agents"]).select("uuid", F.array_join("agents", ",").alias("agents"))


@query("relations_between", "entity_edge", "SELECT source_node_uuid, target_node_uuid, string_agg(DISTINCT name, ', ' ORDER BY name) AS names, count(*)::BIGINT AS n FROM entity_edge GROUP BY ALL")
def relations_between(spark, sf):
    return records.relations(view(spark, sf, "entity_edge"))


@query("id_difference", "entity entity_edge", "WITH g AS (SELECT DISTINCT target_node_uuid AS uuid FROM entity_edge), x AS (SELECT uuid FROM entity WHERE NOT list_contains(labels, 'Part')) SELECT uuid, 'missing' AS side FROM x WHERE uuid NOT IN (SELECT uuid FROM g) UNION ALL SELECT uuid, 'extra' FROM g WHERE uuid NOT IN (SELECT uuid FROM x)")
def id_difference(spark, sf):
    given = view(spark, sf, "entity_edge").select(F.col("target_node_uuid").alias("uuid"))
    return records.id_difference(given, view(spark, sf, "entity").filter(~F.array_contains("labels", "Part")))


@query("escaped_names", "entity", r"""SELECT uuid, regexp_replace(name, '([+\-&|!(){}\[\]^"~*?:\\/ORNTAD])', '\\\1', 'g') AS name FROM entity""")
def escaped_names(spark, sf):
    return view(spark, sf, "entity").select("uuid", text.escaped("name").alias("name"))


@query("composed_queries", "episodic", "SELECT saga, string_agg('message(' || coalesce(agent_id, '') || '): ' || content || chr(10), '' ORDER BY valid_min) AS query FROM episodic GROUP BY saga")
def composed_queries(spark, sf):
    m = F.array_sort(F.collect_list(F.struct("valid_min", F.col("source").alias("role_type"), F.col("agent_id").alias("role"), "content")))
    return view(spark, sf, "episodic").groupBy("saga").agg(m.alias("m")).select("saga", text.composed("m").alias("query"))


@query("duplicate_facts", "entity_edge", "WITH e AS (SELECT * FROM entity_edge QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY source_node_uuid, target_node_uuid) = 1) SELECT uuid, min(uuid) OVER (PARTITION BY source_node_uuid, target_node_uuid) AS root FROM e")
def duplicate_facts(spark, sf):
    """One row a uuid, as a store has it. All facts of a pair of nodes here share their names' words, so each pair's are one component."""
    e = resolve.first_of(view(spark, sf, "entity_edge"), ["uuid"], ["source_node_uuid", "target_node_uuid"])
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    return resolve.duplicate_facts(e, shares=1 + lines // SHARE)


@query("store_upsert_read", "entity", "SELECT uuid, CASE WHEN list_contains(labels, 'Place') THEN upper(name) || '!' ELSE name END AS name, group_id FROM entity")
def store_upsert_read(spark, sf):
    """The whole entity table into a store, then new names of places, and the current version back."""
    checkpoints(spark)
    s = GraphStore(spark, f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}")
    e = view(spark, sf, "entity")
    s.upsert({"entity": e})
    s.upsert({"entity": e.filter(F.array_contains("labels", "Place")).withColumn("name", F.concat(F.upper("name"), F.lit("!")))})
    s.vacuum(1)
    return s.read("entity").select("uuid", "name", "group_id")
