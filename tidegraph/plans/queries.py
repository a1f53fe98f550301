"""Registered queries over the graph views, each beside the SQL that says the same to DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import community, filters, ingestion, lookup, rerank, resolve, retrieve, temporal, traverse
from ..operators.filters import SearchFilters
from ..sources import store
from ..sources.views import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CENTRE, DAY = "c:1", "1996-06-01 00:00:00"


def query(name: str, views: str = "", sql: str | None = None):
    """Registers a query, and its SQL after the views it names."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            with_views = f"WITH {'RECURSIVE ' if 'RECURSIVE' in sql else ''}{duck(*views.split())}" if views else ""
            body = sql.replace("RECURSIVE ", "").strip()
            if views:
                SQL[name] = f"{with_views},\n{body.removeprefix('WITH ')}" if body.startswith("WITH ") else f"{with_views}\n{body}"
            else:
                SQL[name] = sql
        return f

    return add


def _ts(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _sts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


def _q(spark, sf) -> list[float]:
    row = view(spark, sf, "vectors").filter("uuid = 'v:0'").select("embedding").first()
    return [float(x) for x in row[0]]


COS = "list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
Q0 = "(SELECT embedding FROM vectors WHERE uuid = 'v:0')"


def _bm25_sql(cte: str, fields: str, terms: list[str], limit: int, where: str = "true") -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return rf"""WITH tok AS (SELECT uuid, list_filter(regexp_split_to_array(lower(concat_ws(' ', {fields})), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM {cte}),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)::DOUBLE) AS a FROM tok),
tf AS (SELECT uuid, len(t)::DOUBLE AS dl, w, count(*)::DOUBLE AS tf FROM (SELECT uuid, t, unnest(t) AS w FROM tok) WHERE w IN ({listed}) GROUP BY ALL),
df AS (SELECT w, count(*)::DOUBLE AS df FROM tf GROUP BY w),
sc AS (SELECT uuid, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM tf JOIN df USING (w), st WHERE uuid IN (SELECT uuid FROM {cte} WHERE {where}) GROUP BY uuid)
SELECT uuid, round(score, 6) AS score FROM sc ORDER BY score DESC, uuid LIMIT {limit}"""


# ---- retrieval


@query("node_cosine_topk", "vectors", f"SELECT uuid, round({COS.format('embedding', Q0)}, 6) AS score FROM vectors WHERE {COS.format('embedding', Q0)} > 0.1 ORDER BY {COS.format('embedding', Q0)} DESC, uuid LIMIT 20")
def node_cosine_topk(spark, sf):
    return retrieve.by_vector(view(spark, sf, "vectors"), _q(spark, sf), "embedding", 20, 0.1).select("uuid", F.round("score", 6).alias("score"))


@query("node_bm25_topk", "entity", _bm25_sql("entity", "name, summary", ["red", "widget", "economy"], 20))
def node_bm25_topk(spark, sf):
    return retrieve.bm25(view(spark, sf, "entity"), ("name", "summary"), "the red widget economy", 20).select("uuid", F.round("score", 6).alias("score"))


@query("edge_bm25_topk", "entity_edge", _bm25_sql("entity_edge", "name, fact", ["bought", "blue", "bolt"], 20, "group_id = 'g1'"))
def edge_bm25_topk(spark, sf):
    e = view(spark, sf, "entity_edge")
    return retrieve.bm25(e, ("name", "fact"), "bought a blue bolt", 20, SearchFilters(group_ids=["g1"]).edge()).select("uuid", F.round("score", 6).alias("score"))


@query("episode_bm25_topk", "episodic", _bm25_sql("episodic", "content, source", ["message", "que", "ist"], 20, "agent_id = 'user'"))
def episode_bm25_topk(spark, sf):
    return retrieve.bm25(view(spark, sf, "episodic"), ("content", "source"), "message que ist", 20, F.col("agent_id") == "user").select("uuid", F.round("score", 6).alias("score"))


_HYBRID = _bm25_sql("notes", "content", ["la", "le"], 20).replace("WITH ", "WITH notes AS (SELECT v.uuid, v.embedding, d.text AS content FROM vectors v JOIN documents d ON v.uuid = 'v:' || d.doc_id),\n", 1)


@query(
    "hybrid_rrf",
    "vectors",
    _HYBRID[: _HYBRID.rindex("SELECT uuid, round")]
    + f""", b AS (SELECT uuid, 0 AS l, row_number() OVER (ORDER BY score DESC, uuid) - 1 AS r FROM sc QUALIFY r < 20),
cs AS (SELECT uuid, {COS.format('embedding', Q0)} AS c FROM notes), c AS (SELECT uuid, 1 AS l, row_number() OVER (ORDER BY c DESC, uuid) - 1 AS r FROM cs WHERE c > 0 QUALIFY r < 20)
SELECT uuid, round(sum(1 / (r + 1)), 6) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY uuid""",
)
def hybrid_rrf(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("v:"), "doc_id").alias("uuid"), F.col("text").alias("content"))
    notes = view(spark, sf, "vectors").join(docs, "uuid")
    lists = rerank.ranked(retrieve.bm25(notes, ("content",), "la le", 20), 0).unionByName(rerank.ranked(retrieve.by_vector(notes, _q(spark, sf), "embedding", 20, 0.0), 1))
    return rerank.rrf(lists).select("uuid", F.round("score", 6).alias("score"))


@query(
    "relevant_nodes",
    "vectors",
    f"""WITH p AS (SELECT uuid AS probe, group_id, embedding AS pe FROM vectors WHERE CAST(split_part(uuid, ':', 2) AS BIGINT) % 50 = 0)
SELECT probe, uuid, round(c, 6) AS score, r AS rank FROM (SELECT probe, uuid, {COS.format('pe', 'embedding')} AS c, row_number() OVER (PARTITION BY probe ORDER BY {COS.format('pe', 'embedding')} DESC, uuid) AS r FROM p JOIN vectors USING (group_id) WHERE {COS.format('pe', 'embedding')} > 0.0) WHERE r <= 5""",
)
def relevant_nodes(spark, sf):
    """Probes are all ids divisible by 50."""
    v = view(spark, sf, "vectors")
    probes = v.filter(F.split("uuid", ":")[1].cast("bigint") % 50 == 0).select(F.col("uuid").alias("probe"), "group_id", F.col("embedding").alias("pe"))
    return retrieve.per_probe(probes, v, ["group_id"], "pe", "embedding", 5, 0.0).select("probe", "uuid", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


# ---- filters and lookups

_DATE_SQL = "SELECT uuid FROM entity_edge WHERE ((valid_at >= TIMESTAMP '1996-01-01' AND valid_at < TIMESTAMP '1996-03-01') OR valid_at IS NULL) AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '1997-01-01')"


@query("temporal_filter_or_of_and", "entity_edge", _DATE_SQL)
def temporal_filter(spark, sf):
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    f = SearchFilters(dates={"valid_at": [[(">=", day("1996-01-01")), ("<", day("1996-03-01"))], [("IS NULL",)]], "invalid_at": [[("IS NULL",)], [(">", day("1997-01-01"))]]})
    return view(spark, sf, "entity_edge").filter(f.edge()).select("uuid")


@query("facts_as_of", "entity_edge", f"SELECT uuid, fact FROM entity_edge WHERE valid_at <= TIMESTAMP '{DAY}' AND (invalid_at > TIMESTAMP '{DAY}' OR invalid_at IS NULL) AND created_at <= TIMESTAMP '{DAY}'")
def facts_as_of(spark, sf):
    at = F.lit(DAY).cast("timestamp_ntz")
    e = view(spark, sf, "entity_edge").withColumn("expired_at", F.lit(None).cast("timestamp_ntz"))
    return temporal.as_of(e, at, at).select("uuid", "fact")


@query("label_filter_any", "entity", "SELECT uuid FROM entity WHERE list_has_any(labels, ['Place', 'Part'])")
def label_any(spark, sf):
    return view(spark, sf, "entity").filter(SearchFilters(node_labels=["Place", "Part"]).node()).select("uuid")


@query("label_filter_all", "entity", "SELECT uuid FROM entity WHERE list_has_all(labels, ['Entity', 'Goods'])")
def label_all(spark, sf):
    return view(spark, sf, "entity").filter(SearchFilters(node_labels=["Entity", "Goods"], label_match="all").node()).select("uuid")


@query("edge_type_and_group_filter", "entity_edge", "SELECT uuid FROM entity_edge WHERE name IN ('LOCATED_IN', 'IN_REGION') AND group_id IN ('g0', 'g2')")
def edge_type(spark, sf):
    return view(spark, sf, "entity_edge").filter(SearchFilters(edge_types=["LOCATED_IN", "IN_REGION"], group_ids=["g0", "g2"]).edge()).select("uuid")


@query("edge_uuid_filter", "entity_edge", "SELECT uuid, fact FROM entity_edge WHERE uuid IN ('lc:1', 'lc:2', 'ir:3')")
def edge_uuid(spark, sf):
    return view(spark, sf, "entity_edge").filter(SearchFilters(edge_uuids=["lc:1", "lc:2", "ir:3"]).edge()).select("uuid", "fact")


@query("edge_uuid_filter_empty", "entity_edge", "SELECT uuid FROM entity_edge WHERE false")
def edge_uuid_empty(spark, sf):
    return view(spark, sf, "entity_edge").filter(SearchFilters(edge_uuids=[]).edge()).select("uuid")


@query("property_filter", "", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def property_filter(spark, sf):
    v = spark.read.parquet(f"{sf}/events.parquet").withColumn("attributes", F.from_json("props", "map<string, bigint>"))
    return v.filter(SearchFilters(properties=[("k", ">=", F.lit(50))]).node()).select("event_id", F.col("attributes")["k"].alias("k"))


@query("attribution_filter", "", "SELECT event_id FROM events WHERE list_has_any([event_type, 'u' || user_id], ['click', 'u7'])")
def attribution(spark, sf):
    v = spark.read.parquet(f"{sf}/events.parquet").withColumn("agent_ids", F.array("event_type", F.concat(F.lit("u"), "user_id")))
    return v.filter(SearchFilters(overlaps={"agent_ids": ["click", "u7"]}).node()).select("event_id")


@query("exclude_participants", "", "SELECT event_id FROM events WHERE NOT list_has_any([event_type, 'u' || user_id], ['click', 'u7'])")
def exclude(spark, sf):
    v = spark.read.parquet(f"{sf}/events.parquet").withColumn("participant_ids", F.array("event_type", F.concat(F.lit("u"), "user_id")))
    return v.filter(SearchFilters(excludes={"participant_ids": ["click", "u7"]}).node()).select("event_id")


@query("keyset_page", "entity", "SELECT uuid, name FROM entity WHERE group_id IN ('g1', 'g3') AND uuid < 'p:5' ORDER BY uuid DESC LIMIT 25")
def keyset_page(spark, sf):
    return lookup.page(view(spark, sf, "entity"), ["g1", "g3"], 25, "p:5").select("uuid", "name")


@query("edges_between", "entity_edge", "SELECT uuid, fact FROM entity_edge WHERE source_node_uuid = 'n:1' AND target_node_uuid = 'r:1'")
def edges_between(spark, sf):
    return lookup.between(view(spark, sf, "entity_edge"), "n:1", "r:1").select("uuid", "fact")


@query("edges_by_node", "entity_edge", "SELECT uuid, name FROM entity_edge WHERE source_node_uuid = 'n:1' OR target_node_uuid = 'n:1'")
def edges_by_node(spark, sf):
    return lookup.touching(view(spark, sf, "entity_edge"), "n:1").select("uuid", "name")


@query("mentioned_nodes", "mentions", "SELECT DISTINCT target_node_uuid AS uuid FROM mentions WHERE source_node_uuid IN ('ev:1', 'ev:2', 'ev:3', 'ev:50')")
def mentioned_nodes(spark, sf):
    m = view(spark, sf, "mentions")
    origins = spark.createDataFrame([("ev:1",), ("ev:2",), ("ev:3",), ("ev:50",)], "uuid string")
    users = m.select(F.col("target_node_uuid").alias("uuid")).distinct()
    return lookup.across(users, m, origins)


@query("communities_by_nodes", "entity", "SELECT DISTINCT 'k:' || group_id AS uuid FROM entity WHERE uuid IN ('c:1', 'c:2', 's:1')")
def communities_by_nodes(spark, sf):
    e = view(spark, sf, "entity")
    members = e.select(F.concat(F.lit("k:"), "group_id").alias("source_node_uuid"), F.col("uuid").alias("target_node_uuid"))
    return lookup.across(members.select(F.col("source_node_uuid").alias("uuid")).distinct(), members, e.filter(F.col("uuid").isin("c:1", "c:2", "s:1")).select("uuid"), reverse=True)


@query("edge_endpoint_join", "entity_edge entity", "SELECT x.uuid, s.name AS source_name, t.name AS target_name FROM entity_edge x JOIN entity s ON s.uuid = x.source_node_uuid JOIN entity t ON t.uuid = x.target_node_uuid")
def endpoint_join(spark, sf):
    e = view(spark, sf, "entity").select("uuid", "name")
    x = view(spark, sf, "entity_edge").select("uuid", "source_node_uuid", "target_node_uuid")
    s, t = (e.select(F.col("uuid").alias(f"{k}_node_uuid"), F.col("name").alias(f"{k}_name")) for k in ("source", "target"))
    return x.join(s, "source_node_uuid").join(t, "target_node_uuid").select("uuid", "source_name", "target_name")


@query("orphans", "entity entity_edge", "SELECT uuid FROM entity WHERE uuid NOT IN (SELECT source_node_uuid FROM entity_edge WHERE name = 'BOUGHT' UNION ALL SELECT target_node_uuid FROM entity_edge WHERE name = 'BOUGHT')")
def orphans(spark, sf):
    return lookup.orphans(view(spark, sf, "entity"), view(spark, sf, "entity_edge").filter("name = 'BOUGHT'")).select("uuid")


# ---- episodes


@query("last_n_episodes", "episodic", "SELECT uuid, group_id, valid_min::BIGINT AS valid_min FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY valid_min DESC, uuid DESC) AS r FROM episodic WHERE valid_min <= 2000) WHERE r <= 3")
def last_n(spark, sf):
    return temporal.last_n(view(spark, sf, "episodic"), 3, F.lit(2000), "valid_min").select("uuid", "group_id", "valid_min")


@query("previous_episodes_asof", "episodic", "SELECT uuid, array_to_string(list(uuid) OVER (PARTITION BY group_id ORDER BY valid_min, uuid ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ',') AS previous FROM episodic")
def previous_episodes(spark, sf):
    return temporal.previous(view(spark, sf, "episodic"), 3, "valid_min").select("uuid", F.array_join("previous", ",").alias("previous"))


@query("saga_chain", "episodic", "SELECT * FROM (SELECT lag(uuid) OVER (PARTITION BY saga ORDER BY valid_min, uuid) AS source_node_uuid, uuid AS target_node_uuid FROM episodic) WHERE source_node_uuid IS NOT NULL")
def saga_chain(spark, sf):
    return temporal.chain(view(spark, sf, "episodic"), "saga", "valid_min")


@query("saga_latest", "episodic", "SELECT saga, uuid FROM (SELECT *, row_number() OVER (PARTITION BY saga ORDER BY valid_min DESC, uuid DESC) AS r FROM episodic) WHERE r = 1")
def saga_latest(spark, sf):
    return temporal.last_n(view(spark, sf, "episodic"), 1, None, "valid_min", "saga").select("saga", "uuid")


# ---- rerankers

_LISTS = "l(list_id, uuid, rank) AS (VALUES (0, 'a', 0), (0, 'b', 1), (0, 'c', 2), (1, 'b', 0), (1, 'a', 1), (1, 'd', 2))"


@query("rrf_fusion", "", f"WITH {_LISTS} SELECT uuid, round(sum(1 / (rank + 1)), 6) AS score FROM l GROUP BY uuid HAVING sum(1 / (rank + 1)) >= 0.4")
def rrf_fusion(spark, sf):
    rows = [(0, "a", 0), (0, "b", 1), (0, "c", 2), (1, "b", 0), (1, "a", 1), (1, "d", 2)]
    return rerank.rrf(spark.createDataFrame(rows, "list_id int, uuid string, rank bigint"), min_score=0.4).select("uuid", F.round("score", 6).alias("score"))


@query(
    "mmr_rerank",
    "vectors",
    f"""WITH c AS MATERIALIZED (SELECT uuid, embedding FROM vectors ORDER BY {COS.format('embedding', Q0)} DESC, uuid LIMIT 40),
m AS (SELECT a.uuid, max({COS.format('a.embedding', 'b.embedding')}) AS m FROM c a JOIN c b ON a.uuid <> b.uuid GROUP BY a.uuid)
SELECT uuid, round(0.5 * list_inner_product(CAST(embedding AS DOUBLE[]), CAST({Q0} AS DOUBLE[])) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 0.5 * greatest(m, 0), 5) AS score FROM c JOIN m USING (uuid)""",
)
def mmr_rerank(spark, sf):
    """Candidates are the best 40 of all vectors, twice a limit of 20."""
    v, q = view(spark, sf, "vectors"), _q(spark, sf)
    c = v.join(retrieve.by_vector(v, q, "embedding", 40, -2.0).select("uuid"), "uuid", "left_semi")
    return rerank.mmr(c, q, 0.5, -1e9).select("uuid", F.round("score", 5).alias("score"))


_DIST = f"""SELECT e.uuid, CASE WHEN e.uuid = '{CENTRE}' THEN 10.0 WHEN n.uuid IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM entity e LEFT JOIN
(SELECT DISTINCT CASE WHEN source_node_uuid = '{CENTRE}' THEN target_node_uuid ELSE source_node_uuid END AS uuid FROM entity_edge WHERE source_node_uuid = '{CENTRE}' OR target_node_uuid = '{CENTRE}') n ON n.uuid = e.uuid WHERE e.group_id IN ('g1', 'g4')"""


@query("node_distance_rerank", "entity entity_edge", _DIST)
def node_distance(spark, sf):
    c = view(spark, sf, "entity").filter("group_id IN ('g1', 'g4')").select("uuid", F.lit(0).alias("pos"))
    return rerank.node_distance(c, view(spark, sf, "entity_edge"), CENTRE).select("uuid", "score")


@query("edge_node_distance", "entity entity_edge", f"WITH d AS ({_DIST}) SELECT x.uuid, d.score FROM entity_edge x JOIN d ON d.uuid = x.source_node_uuid")
def edge_node_distance(spark, sf):
    d = node_distance(spark, sf).withColumnRenamed("uuid", "source_node_uuid")
    return view(spark, sf, "entity_edge").join(d, "source_node_uuid").select("uuid", "score")


@query("episode_mentions_rerank", "mentions", "SELECT target_node_uuid AS uuid, count(*)::DOUBLE AS score FROM mentions GROUP BY ALL")
def mentions_rerank(spark, sf):
    m = view(spark, sf, "mentions")
    c = m.select(F.col("target_node_uuid").alias("uuid")).distinct().withColumn("pos", F.lit(0))
    return rerank.episode_mentions(c, m).select("uuid", "score")


@query("cross_encoder_rerank", "entity_edge", "SELECT uuid, round(len(list_intersect(['supplies', 'part', '7'], list_distinct(string_split(lower(fact), ' '))))::DOUBLE / 3, 6) AS score FROM entity_edge")
def cross_encoder(spark, sf):
    return rerank.cross_encoder(view(spark, sf, "entity_edge"), "supplies part 7", rerank.overlap_score).select("uuid", F.round("score", 6).alias("score"))


# ---- traversal


def _walk_sql(depth: int) -> str:
    return f"""RECURSIVE WITH w AS (SELECT target_node_uuid AS n, uuid AS e, 1 AS d FROM entity_edge WHERE source_node_uuid IN ('{CENTRE}', 's:3')
UNION SELECT x.target_node_uuid, x.uuid, d + 1 FROM w JOIN entity_edge x ON x.source_node_uuid = w.n WHERE d < {depth})"""


def _origins(spark) -> DataFrame:
    return spark.createDataFrame([(CENTRE,), ("s:3",)], "uuid string")


for _d in (1, 2, 3):

    @query(f"bfs_edges_d{_d}", "entity_edge", _walk_sql(_d) + " SELECT e AS uuid, min(d)::BIGINT AS depth FROM w GROUP BY e")
    def bfs_edges(spark, sf, depth=_d):
        return traverse.bfs_edges(view(spark, sf, "entity_edge"), _origins(spark), depth)


@query("bfs_nodes_d3", "entity_edge", _walk_sql(3) + " SELECT n AS uuid, min(d)::BIGINT AS depth FROM w GROUP BY n")
def bfs_nodes(spark, sf):
    return traverse.bfs_nodes(view(spark, sf, "entity_edge"), _origins(spark), 3)


# ---- time


@query(
    "invalidate_edges",
    "entity_edge",
    f"""WITH b AS (SELECT * FROM entity_edge WHERE name = 'BOUGHT'), p AS (SELECT o.uuid, min(n.valid_at) AS e FROM b o JOIN b n ON o.source_node_uuid = n.source_node_uuid AND o.uuid <> n.uuid
WHERE NOT coalesce(o.invalid_at <= n.valid_at, false) AND NOT coalesce(n.invalid_at <= o.valid_at, false) AND o.valid_at < n.valid_at GROUP BY o.uuid)
SELECT b.uuid, strftime(coalesce(e, b.invalid_at), '%Y-%m-%d %H:%M:%S') AS invalid_at, CASE WHEN e IS NOT NULL THEN '{DAY}' END AS expired_at FROM b LEFT JOIN p USING (uuid)""",
)
def invalidate(spark, sf):
    """Over all BOUGHT facts."""
    b = view(spark, sf, "entity_edge").filter("name = 'BOUGHT'").withColumn("expired_at", F.lit(None).cast("timestamp_ntz"))
    return temporal.invalidate_within(b, "source_node_uuid", F.lit(DAY).cast("timestamp_ntz")).select("uuid", _ts("invalid_at"), _ts("expired_at"))


@query("validity_intervals", "entity_edge", f"SELECT uuid, {_sts('valid_at')}, {_sts('invalid_at')} FROM entity_edge WHERE name = 'BOUGHT'")
def validity(spark, sf):
    return view(spark, sf, "entity_edge").filter("name = 'BOUGHT'").select("uuid", _ts("valid_at"), _ts("invalid_at"))


@query("fact_date_range", "entity_edge", "SELECT uuid, coalesce(strftime(valid_at, '%Y-%m-%d %H:%M:%S'), 'date unknown') || ' - ' || coalesce(strftime(invalid_at, '%Y-%m-%d %H:%M:%S'), 'present') AS range FROM entity_edge")
def fact_dates(spark, sf):
    return view(spark, sf, "entity_edge").select("uuid", text.date_range("valid_at", "invalid_at").alias("range"))


# ---- resolution


@query("edge_exact_dedup", "entity_edge", r"SELECT min(uuid) AS uuid FROM entity_edge GROUP BY source_node_uuid, target_node_uuid, trim(regexp_replace(lower(fact), '\s+', ' ', 'g'))")
def edge_exact_dedup(spark, sf):
    return resolve.exact_facts(view(spark, sf, "entity_edge")).select("uuid")


@query("bulk_edge_candidates", "entity_edge", r"SELECT x.uuid AS a, y.uuid AS b FROM entity_edge x JOIN entity_edge y USING (source_node_uuid, target_node_uuid) WHERE x.uuid < y.uuid AND list_has_any(string_split_regex(lower(trim(x.fact)), '\s+'), string_split_regex(lower(trim(y.fact)), '\s+'))")
def bulk_edge_candidates(spark, sf):
    return resolve.fact_candidates(view(spark, sf, "entity_edge"))


_NORM = r"trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(name), '\s+', ' ', 'g')), '[^a-z0-9'' ]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("name_normalise", "entity", f"SELECT uuid, {_NORM} AS name FROM entity")
def name_normalise(spark, sf):
    return view(spark, sf, "entity").select("uuid", text.fuzzy("name").alias("name"))


@query("name_entropy", "entity", "WITH c AS (SELECT uuid, unnest(string_split(replace(name, ' ', ''), '')) AS ch FROM entity), k AS (SELECT uuid, ch, count(*)::DOUBLE AS k FROM c WHERE ch <> '' GROUP BY ALL), p AS (SELECT uuid, k / sum(k) OVER (PARTITION BY uuid) AS p FROM k) SELECT uuid, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY uuid")
def name_entropy(spark, sf):
    return view(spark, sf, "entity").select("uuid", F.round(text.entropy("name"), 6).alias("entropy"))


_SH = "list_distinct(list_transform(range(1, length(replace({0}, ' ', '')) - 1), lambda i: substr(replace({0}, ' ', ''), i, 3)))"


@query("shingle_jaccard_pairs", "", f"WITH s AS (SELECT n_nationkey AS k, {_SH.format('lower(n_name)')} AS s FROM nation) SELECT a.k AS a, b.k AS b, round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))), 6) AS score FROM s a JOIN s b ON a.k < b.k")
def shingle_jaccard(spark, sf):
    s = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("k"), text.shingles(F.lower("n_name")).alias("s"))  # 25 rows by the tables' definition
    a, b = (s.select(F.col("k").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(text.jaccard("sa", "sb"), 6).alias("score"))


def _aliases(spark, sf) -> tuple[DataFrame, DataFrame]:
    known = view(spark, sf, "entity")
    return known.select(F.concat(F.lit("x"), "uuid").alias("uuid"), F.replace(F.upper("name"), F.lit("#"), F.lit("  # ")).alias("name")), known


@query("lsh_candidates")
def lsh_candidates(spark, sf):
    return resolve.lsh_candidates(*_aliases(spark, sf))


@query("resolve_nodes")
def resolve_nodes(spark, sf):
    return resolve.resolve(*_aliases(spark, sf))


@query("connected_components")
def connected_components(spark, sf):
    """Over all facts; the recursion is too slow in SQL, tests compare with a loop."""
    from ..operators.util import checkpoints

    checkpoints(spark)
    return resolve.components(view(spark, sf, "entity_edge").select(F.col("source_node_uuid").alias("a"), F.col("target_node_uuid").alias("b")))


_CHAINS = """WITH i AS (SELECT n, n - row_number() OVER (ORDER BY n) AS run FROM (SELECT DISTINCT c_custkey AS n FROM customer WHERE c_custkey <> 0)), r AS (SELECT n, min(n) OVER (PARTITION BY run) - 1 AS root FROM i)
SELECT 'c:' || n AS uuid, 'c:' || root AS root FROM r UNION SELECT 'c:' || root, 'c:' || root FROM r"""


@query("directed_uuid_map", "", _CHAINS)
def directed_uuid_map(spark, sf):
    """Each customer is the alias of the one numbered before it; a run of numbers leads to what precedes its first."""
    from ..operators.util import checkpoints

    checkpoints(spark)
    c = view(spark, sf, "entity").filter(F.array_contains("labels", "Customer"))
    n = F.split("uuid", ":")[1].cast("bigint")
    return resolve.directed_map(c.select(F.col("uuid").alias("a"), F.concat(F.lit("c:"), (n - 1).cast("string")).alias("b")).filter("a <> 'c:0'"))


@query("pointer_rewrite", "entity_edge", "SELECT uuid, CASE WHEN source_node_uuid LIKE 'c:%' THEN 'c:' || (CAST(split_part(source_node_uuid, ':', 2) AS BIGINT) // 10) ELSE source_node_uuid END AS source_node_uuid, target_node_uuid FROM entity_edge")
def pointer_rewrite(spark, sf):
    """Ten customers become one, in all facts."""
    c = view(spark, sf, "entity").filter(F.array_contains("labels", "Customer"))
    roots = c.select("uuid", F.concat(F.lit("c:"), F.expr("CAST(split_part(uuid, ':', 2) AS BIGINT) div 10")).alias("root"))
    return resolve.rewrite(view(spark, sf, "entity_edge"), roots).select("uuid", "source_node_uuid", "target_node_uuid")


# ---- communities, aggregates, sinks


@query("neighbour_projection", "entity_edge", "SELECT n, m, count(*)::BIGINT AS weight FROM (SELECT source_node_uuid AS n, target_node_uuid AS m FROM entity_edge UNION ALL SELECT target_node_uuid, source_node_uuid FROM entity_edge WHERE source_node_uuid <> target_node_uuid) GROUP BY n, m")
def neighbour_projection(spark, sf):
    return community.projection(view(spark, sf, "entity_edge"))


def _round_sql(k: int) -> str:
    return f"""v{k} AS (SELECT n AS uuid, label, sum(weight) AS s FROM g JOIN l{k - 1} ON l{k - 1}.uuid = g.m GROUP BY n, label), b{k} AS (SELECT uuid, s, label FROM v{k} QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY s DESC, label DESC) = 1),
l{k} AS (SELECT l.uuid, CASE WHEN b.uuid IS NULL THEN l.label WHEN b.s > 1 THEN b.label ELSE greatest(b.label, l.label) END AS label FROM l{k - 1} l LEFT JOIN b{k} b USING (uuid))"""


_LP = "WITH g AS (SELECT n, m, count(*) AS weight FROM (SELECT source_node_uuid AS n, target_node_uuid AS m FROM entity_edge UNION ALL SELECT target_node_uuid, source_node_uuid FROM entity_edge WHERE source_node_uuid <> target_node_uuid) GROUP BY n, m), l0 AS (SELECT uuid, row_number() OVER (PARTITION BY group_id ORDER BY uuid DESC) - 1 AS label FROM entity)"


@query("label_propagation_2_rounds", "entity entity_edge", _LP + ", " + ", ".join(map(_round_sql, (1, 2))) + " SELECT uuid, label::BIGINT AS label FROM l2")
def label_propagation(spark, sf):
    from ..operators.util import checkpoints

    checkpoints(spark)
    return community.propagate(view(spark, sf, "entity"), community.projection(view(spark, sf, "entity_edge")), 2)


@query("label_propagation_all")
def label_propagation_all(spark, sf):
    """Over all facts until the labels settle; label_propagation_2_rounds, which SQL can express, stops after two."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    return community.propagate_facts(view(spark, sf, "entity"), view(spark, sf, "entity_edge"), shares=1 + lines // 8_000_000)


@query("entity_community_mode", "entity entity_edge", "WITH m AS (SELECT 'k:' || group_id AS c, uuid FROM entity WHERE list_contains(labels, 'Place')), v AS (SELECT DISTINCT n, mm FROM (SELECT source_node_uuid AS n, target_node_uuid AS mm FROM entity_edge UNION ALL SELECT target_node_uuid, source_node_uuid FROM entity_edge)), k AS (SELECT n AS uuid, c, count(*) AS k FROM v JOIN m ON m.uuid = v.mm GROUP BY n, c) SELECT uuid, c AS community, false AS is_new FROM m UNION ALL SELECT uuid, c, true FROM k WHERE uuid NOT IN (SELECT uuid FROM m) QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY k DESC, c) = 1")
def entity_community(spark, sf):
    members = view(spark, sf, "entity").filter(F.array_contains("labels", "Place")).select(F.concat(F.lit("k:"), "group_id").alias("source_node_uuid"), F.col("uuid").alias("target_node_uuid"))
    return community.of_entities(members, community.projection(view(spark, sf, "entity_edge")))


@query("graph_overview", "entity_edge", "WITH d AS (SELECT uuid, count(*) AS degree FROM (SELECT source_node_uuid AS uuid FROM entity_edge UNION ALL SELECT target_node_uuid FROM entity_edge) GROUP BY uuid ORDER BY degree DESC, uuid LIMIT 400) SELECT x.uuid, (s.degree + t.degree)::BIGINT AS weight FROM entity_edge x JOIN d s ON s.uuid = x.source_node_uuid JOIN d t ON t.uuid = x.target_node_uuid ORDER BY weight DESC, x.uuid LIMIT 40")
def graph_overview(spark, sf):
    return lookup.overview(view(spark, sf, "entity_edge"), 400, 40)[1].select("uuid", "weight")


@query("facts_per_node", "entity_edge", "SELECT node, string_agg(fact, chr(10) ORDER BY uuid, fact) AS facts FROM (SELECT source_node_uuid AS node, uuid, fact FROM entity_edge UNION ALL SELECT target_node_uuid, uuid, fact FROM entity_edge) GROUP BY node")
def facts_per_node(spark, sf):
    return lookup.facts_of(view(spark, sf, "entity_edge"))


@query("remove_episode", "entity_edge", "SELECT uuid FROM entity_edge WHERE uuid NOT IN (SELECT uuid FROM entity_edge WHERE episode = 'ord:1')")
def remove_episode(spark, sf):
    e = view(spark, sf, "entity_edge").withColumn("episodes", F.array("episode"))
    m = e.select(F.col("episode").alias("source_node_uuid"), F.explode(F.array("source_node_uuid", "target_node_uuid")).alias("target_node_uuid"))
    _, gone = ingestion.removed_episode("ord:1", e.select(F.col("episode").alias("uuid")).distinct(), m, e)
    return e.join(gone, "uuid", "left_anti").select("uuid")


@query("detach_delete", "entity_edge", "SELECT uuid FROM entity_edge WHERE source_node_uuid NOT LIKE 'c:1%' AND target_node_uuid NOT LIKE 'c:1%'")
def detach_delete(spark, sf):
    gone = view(spark, sf, "entity").filter("uuid LIKE 'c:1%'").select("uuid")
    return store.without_nodes(view(spark, sf, "entity_edge"), gone).select("uuid")


@query("upsert", "entity", "SELECT uuid, CASE WHEN uuid LIKE 'n:%' THEN upper(name) || '!' ELSE name END AS name FROM entity UNION ALL SELECT 'z:1', 'new'")
def upsert(spark, sf):
    e = view(spark, sf, "entity").select("uuid", "name")
    batch = e.filter("uuid LIKE 'n:%'").select("uuid", F.concat(F.upper("name"), F.lit("!")).alias("name")).unionByName(spark.createDataFrame([("z:1", "new")], "uuid string, name string"))
    return store.merge(e, batch)


@query("linked_edges_only", "entity_edge entity", "SELECT uuid FROM entity_edge WHERE source_node_uuid IN (SELECT uuid FROM entity WHERE group_id = 'g1') AND target_node_uuid IN (SELECT uuid FROM entity WHERE group_id = 'g1')")
def linked_edges(spark, sf):
    own = view(spark, sf, "entity").filter("group_id = 'g1'").select("uuid")
    return store.linked(view(spark, sf, "entity_edge"), own, own).select("uuid")


@query("usage_totals", "", "SELECT coalesce(event_type, 'all') AS prompt, count(*)::BIGINT AS calls, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY ROLLUP (event_type)")
def usage_totals(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.rollup("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean")).select(F.coalesce("event_type", F.lit("all")).alias("prompt"), "calls", "total", "mean")


@query("latency_percentiles", "", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most FROM events GROUP BY event_type")
def latency(spark, sf):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max("value").alias("most"))


@query("estimated_tokens", "episodic", "SELECT uuid, (length(content) // 4)::BIGINT AS n FROM episodic")
def estimated_tokens(spark, sf):
    return view(spark, sf, "episodic").select("uuid", text.estimated_tokens("content").alias("n"))


@query("cap_density", "episodic", r"WITH w AS (SELECT uuid, list_filter(string_split_regex(content, '\s+'), lambda x: x <> '') AS w FROM episodic) SELECT uuid, round(CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(range(2, len(w) + 1), lambda i: regexp_matches(regexp_replace(w[i], '[^A-Za-z]', '', 'g'), '^[A-Z][A-Za-z]+$') AND upper(regexp_replace(w[i], '[^A-Za-z]', '', 'g')) <> regexp_replace(w[i], '[^A-Za-z]', '', 'g') AND NOT regexp_matches(w[i - 1], '[.!?]$')))::DOUBLE / len(w) END, 6) AS density FROM w")
def cap_density(spark, sf):
    return view(spark, sf, "episodic").select("uuid", F.round(text.cap_density("content"), 6).alias("density"))


@query("truncate_summary", "episodic", r"WITH h AS (SELECT uuid, content, substr(content, 1, 120) AS h FROM episodic) SELECT uuid, CASE WHEN length(content) <= 120 THEN content WHEN regexp_extract(h, '^(?s:(.*[.!?]))(?:\s|$)', 1) <> '' THEN trim(regexp_extract(h, '^(?s:(.*[.!?]))(?:\s|$)', 1)) ELSE rtrim(h) END AS summary FROM h")
def truncate_summary(spark, sf):
    return view(spark, sf, "episodic").select("uuid", text.truncated("content", 120).alias("summary"))


@query("json_key_count", "", "SELECT event_id, len(json_keys(props))::BIGINT AS n FROM events")
def json_key_count(spark, sf):
    from ..functions import chunking

    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", chunking.key_count_udf(2)(F.col("props")).alias("n"))


@query("chunk_text")
def chunk_text(spark, sf):
    from ..functions import chunking

    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(chunking.chunks_udf("text", 500, 50)(F.col("text"))).alias("pos", "chunk"))


@query("covering_chunks")
def covering_chunks(spark, sf):
    from ..functions import chunking

    rows = [(i, c) for i, c in enumerate(chunking.covering(list(range(30)), 15))]
    return spark.createDataFrame(rows, "i int, members array<int>")


@query("context_string")
def context_string(spark, sf):
    """The best 20 facts and entities of a search as one prompt."""
    from .search import context

    e, n = view(spark, sf, "entity_edge"), view(spark, sf, "entity")
    facts, nodes = (retrieve.bm25(d, c, "blue bolt", 20).select("uuid") for d, c in ((e, ("name", "fact")), (n, ("name", "summary"))))
    return context(e.join(F.broadcast(facts), "uuid", "left_semi"), n.join(F.broadcast(nodes), "uuid", "left_semi"))


@query("event_microbatches", "", "SELECT 'u' || user_id AS group_id, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def event_microbatches(spark, sf):
    from ..streaming.ingest import count_by_group

    return count_by_group(spark, f"{sf}/events.parquet")


@query("tumbling_windows", "", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.groupBy(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type").agg(F.count("*").alias("n"))
