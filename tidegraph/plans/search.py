"""Search configurations, recipes, and the composite search over the four scopes."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import filters, rerank, retrieve, traverse
from ..operators.filters import SearchFilters
from ..sources.schema import FULLTEXT

LIMIT = 10


@dataclass(frozen=True)
class ScopeConfig:
    """How one scope is searched: methods of bm25, cosine and bfs; a reranker of rrf, mmr, node_distance, episode_mentions, cross_encoder."""

    methods: tuple[str, ...]
    reranker: str = "rrf"
    min_score: float = 0.6
    mmr_lambda: float = 0.5
    bfs_depth: int = 3
    rank_min_score: float = 0.0


@dataclass(frozen=True)
class SearchConfig:
    edge: ScopeConfig | None = None
    node: ScopeConfig | None = None
    episode: ScopeConfig | None = None
    community: ScopeConfig | None = None
    limit: int = LIMIT


_TWO, _ALL = ("bm25", "cosine"), ("bm25", "cosine", "bfs")


def _recipes() -> dict[str, SearchConfig]:
    """Each reranker for edges and nodes, two and one for communities, and three over all scopes."""
    out = {}
    for r in ("rrf", "mmr", "node_distance", "episode_mentions", "cross_encoder"):
        m = _ALL if r == "cross_encoder" else _TWO
        out[f"edge_{r}"] = SearchConfig(edge=ScopeConfig(m, r))
        out[f"node_{r}"] = SearchConfig(node=ScopeConfig(m, r))
    for r in ("rrf", "mmr", "cross_encoder"):
        out[f"community_{r}"] = SearchConfig(community=ScopeConfig(_TWO, r))
        m = _ALL if r == "cross_encoder" else _TWO
        own = {"mmr_lambda": 1.0} if r == "mmr" else {}
        out[f"combined_{r}"] = SearchConfig(ScopeConfig(m, r, **own), ScopeConfig(m, r, **own), ScopeConfig(("bm25",), "cross_encoder" if r == "cross_encoder" else "rrf"), ScopeConfig(_TWO, r, **own))
    out["community_cross_encoder"] = replace(out["community_cross_encoder"], limit=3)
    return out


RECIPES = _recipes()
VECTORS = {"entity": "name_embedding", "entity_edge": "fact_embedding", "community": "name_embedding"}
PASSAGE = {"entity": "name", "entity_edge": "fact", "community": "name", "episodic": "content"}


@dataclass(frozen=True)
class Request:
    query: str = ""
    vector: list[float] | None = None
    filters: SearchFilters = SearchFilters()
    centre: str | None = None
    origins: list[str] | None = None
    scorer: object = rerank.overlap_score


def scope(tables: dict[str, DataFrame], table: str, config: ScopeConfig, request: Request, limit: int) -> DataFrame:
    """Rows of one table with `score`: twice the limit from each method, fused and cut. An empty query finds nothing."""
    df = tables[table]
    where = request.filters.edge() if table == "entity_edge" else request.filters.node() if table == "entity" else SearchFilters(group_ids=request.filters.group_ids).node()
    if not request.query.strip():
        return df.limit(0).withColumn("score", F.lit(0.0))
    if table == "entity_edge" and request.filters.node_labels:  # both endpoints have the labels
        own, labelled = df.columns, tables["entity"].filter(filters.labelled("labels", request.filters.node_labels, request.filters.label_match))
        for end in ("source_node_uuid", "target_node_uuid"):
            df = df.join(labelled.select(F.col("uuid").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
        df = df.select(*own, F.coalesce(F.col("_source_node_uuid") & F.col("_target_node_uuid"), F.lit(False)).alias("_ends"))
        where = where & F.col("_ends")
    out = _found(tables, df, table, config, request, limit, where)
    return out.drop("_ends")


def _found(tables: dict[str, DataFrame], df: DataFrame, table: str, config: ScopeConfig, request: Request, limit: int, where: Column) -> DataFrame:
    lists: list[DataFrame] = []
    if "bm25" in config.methods:
        lists.append(rerank.ranked(retrieve.bm25(df, FULLTEXT[table], request.query, 2 * limit, where), 0))
    if "cosine" in config.methods and request.vector is not None and table in VECTORS:
        lists.append(rerank.ranked(retrieve.by_vector(df, request.vector, VECTORS[table], 2 * limit, config.min_score, where), 1))
    if "bfs" in config.methods and table in ("entity", "entity_edge"):
        spark = df.sparkSession
        if request.origins:
            origins = spark.createDataFrame([(o,) for o in request.origins], "uuid string")
        else:  # seeds are what the other methods found
            hits = reduce(DataFrame.unionByName, lists).select("uuid").distinct() if lists else df.limit(0).select("uuid")
            origins = hits if table == "entity" else df.join(hits, "uuid", "left_semi").select(F.col("source_node_uuid").alias("uuid"))
        walk = traverse.bfs_nodes if table == "entity" else traverse.bfs_edges
        found = df.filter(where).join(walk(tables["entity_edge"], origins, config.bfs_depth, tables.get("mentions")), "uuid")
        lists.append(rerank.ranked(found.withColumn("score", -F.col("depth")).orderBy("depth", "uuid").limit(2 * limit), 2))
    if not lists:
        return df.limit(0).withColumn("score", F.lit(0.0))
    fused = rerank.rrf(reduce(DataFrame.unionByName, lists))
    placed = fused.withColumn("list_id", F.lit(0)).withColumn("pos", F.monotonically_increasing_id())
    rows = df.join(F.broadcast(fused), "uuid")
    if config.reranker == "rrf":
        out = rows
    elif config.reranker == "mmr":
        out = df.join(rerank.mmr(rows, request.vector, config.mmr_lambda, config.rank_min_score, VECTORS[table]), "uuid")
    elif config.reranker == "cross_encoder":
        first = rows.orderBy(F.desc("score"), "uuid").limit(limit).drop("score")
        out = rerank.cross_encoder(first, request.query, request.scorer, PASSAGE[table])
    elif config.reranker == "node_distance":
        if request.centre is None:
            raise ValueError("node_distance needs a centre node")
        if table == "entity":
            out = df.join(rerank.node_distance(placed.select("uuid", "pos"), tables["entity_edge"], request.centre).drop("pos"), "uuid")
        else:
            near = rerank.neighbours(tables["entity_edge"], request.centre).withColumnRenamed("uuid", "source_node_uuid").withColumn("near", F.lit(1.0))
            out = rows.drop("score").join(near, "source_node_uuid", "left").withColumn("score", F.when(F.col("source_node_uuid") == request.centre, 10.0).otherwise(F.coalesce("near", F.lit(0.0)))).drop("near")
    elif config.reranker == "episode_mentions":
        if table == "entity_edge":
            out = rows.withColumn("score", F.size("episodes").cast("double"))
        else:
            out = df.join(rerank.episode_mentions(placed.select("uuid", "pos"), tables["mentions"]).drop("pos"), "uuid")
            return out.orderBy("score", "uuid").limit(limit)
    else:
        raise ValueError(f"unknown reranker {config.reranker}")
    return out.filter(F.col("score") >= config.rank_min_score).orderBy(F.desc("score"), "uuid").limit(limit)


def search(tables: dict[str, DataFrame], config: SearchConfig, request: Request, limit: int | None = None) -> dict[str, DataFrame]:
    """One lazily planned result a configured scope."""
    config = replace(config, limit=limit or config.limit)
    names = {"edge": "entity_edge", "node": "entity", "episode": "episodic", "community": "community"}
    return {s: scope(tables, t, c, request, config.limit) for s, t in names.items() if (c := getattr(config, s))}


def merged(results: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Results of several groups side by side, neither ranked nor cut again."""
    return {k: reduce(DataFrame.unionByName, [r[k] for r in results if k in r]) for k in {k for r in results for k in r}}


def simple(tables: dict[str, DataFrame], request: Request, limit: int = LIMIT) -> DataFrame:
    """Facts by the plain recipe: fused ranks, or by distance where a centre node is given."""
    return search(tables, RECIPES["edge_rrf" if request.centre is None else "edge_node_distance"], request, limit)["edge"]


def hybrid_nodes(nodes: DataFrame, queries: list[str], vectors: list[list[float]], limit: int = LIMIT, where: SearchFilters = SearchFilters(), min_score: float = 0.6) -> DataFrame:
    """(uuid, score): the best 2 * limit nodes of each query and each vector, fused; the fused list is not cut."""
    lists = [retrieve.bm25(nodes, FULLTEXT["entity"], q, 2 * limit, where.node()) for q in queries if q.strip()]
    lists += [retrieve.by_vector(nodes, v, VECTORS["entity"], 2 * limit, min_score, where.node()) for v in vectors]
    if not lists:
        return nodes.select("uuid").limit(0).withColumn("score", F.lit(0.0))
    return rerank.rrf(reduce(DataFrame.unionByName, [rerank.ranked(d.select("uuid", "score"), i) for i, d in enumerate(lists)]))


def context(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: facts and entities as JSON for a prompt; both are search results of bounded length."""
    facts = edges.agg(F.to_json(F.sort_array(F.collect_list(F.struct("uuid", "fact")))).alias("f"))
    entities = nodes.agg(F.to_json(F.sort_array(F.collect_list(F.struct("uuid", "name", "summary")))).alias("e"))
    return facts.crossJoin(entities).select(F.concat(F.lit("FACTS\n"), "f", F.lit("\nENTITIES\n"), "e").alias("context"))
