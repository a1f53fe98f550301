"""The driver's tables seen as a graph: entities, facts, episodes, mentions and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _load(spark: SparkSession, sf: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf}/{n}.parquet").createOrReplaceTempView(n)


#: Each view as SQL that Spark and DuckDB both run, and the tables that it reads.
SQL = {
    "entity": (
        """SELECT 'c:' || c_custkey AS uuid, c_name AS name, 'g' || (c_nationkey % 5) AS group_id, array('Entity', 'Customer') AS labels, c_mktsegment AS summary FROM customer
UNION ALL SELECT 's:' || s_suppkey, s_name, 'g' || (s_nationkey % 5), array('Entity', 'Supplier'), 'supplier' FROM supplier
UNION ALL SELECT 'p:' || p_partkey, p_name, 'g' || (p_partkey % 5), array('Entity', 'Part', 'Goods'), p_type FROM part
UNION ALL SELECT 'n:' || n_nationkey, n_name, 'g' || (n_nationkey % 5), array('Entity', 'Place'), 'nation' FROM nation
UNION ALL SELECT 'r:' || r_regionkey, r_name, 'g' || (r_regionkey % 5), array('Entity', 'Place'), 'region' FROM region""",
        ("customer", "supplier", "part", "nation", "region"),
    ),
    "entity_edge": (
        """SELECT 'b:' || l_orderkey || ':' || l_linenumber AS uuid, 'g' || (c_nationkey % 5) AS group_id, 'c:' || c_custkey AS source_node_uuid, 'p:' || p_partkey AS target_node_uuid, 'BOUGHT' AS name, c_name || ' bought ' || p_name AS fact,
 o_orderdate AS valid_at, lead(o_orderdate) OVER (PARTITION BY c_custkey, p_partkey ORDER BY o_orderdate, l_orderkey, l_linenumber) AS invalid_at, l_shipdate AS created_at, 'ord:' || l_orderkey AS episode
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'lc:' || c_custkey, 'g' || (c_nationkey % 5), 'c:' || c_custkey, 'n:' || n_nationkey, 'LOCATED_IN', c_name || ' is located in ' || n_name, CAST(NULL AS TIMESTAMP_NTZ), CAST(NULL AS TIMESTAMP_NTZ), CAST(NULL AS TIMESTAMP_NTZ), 'ref' FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'ls:' || s_suppkey, 'g' || (s_nationkey % 5), 's:' || s_suppkey, 'n:' || n_nationkey, 'LOCATED_IN', s_name || ' is located in ' || n_name, CAST(NULL AS TIMESTAMP_NTZ), CAST(NULL AS TIMESTAMP_NTZ), CAST(NULL AS TIMESTAMP_NTZ), 'ref' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'ir:' || n_nationkey, 'g' || (n_nationkey % 5), 'n:' || n_nationkey, 'r:' || r_regionkey, 'IN_REGION', n_name || ' is in ' || r_name, CAST(NULL AS TIMESTAMP_NTZ), CAST(NULL AS TIMESTAMP_NTZ), CAST(NULL AS TIMESTAMP_NTZ), 'ref' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT DISTINCT 'su:' || l_suppkey || ':' || l_partkey, 'g' || (s_nationkey % 5), 's:' || l_suppkey, 'p:' || l_partkey, 'SUPPLIES', s_name || ' supplies part ' || l_partkey, CAST(NULL AS TIMESTAMP_NTZ), CAST(NULL AS TIMESTAMP_NTZ), CAST(NULL AS TIMESTAMP_NTZ), 'ref' FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
        ("lineitem", "orders", "customer", "part", "nation", "region", "supplier"),
    ),
    "episodic": (
        """SELECT 'conv:' || conv_id || ':' || turn AS uuid, 'g' || (conv_id % 5) AS group_id, 'saga:' || conv_id AS saga, role AS agent_id, text AS content, 'message' AS source, conv_id * 60 + turn AS valid_min FROM conversations""",
        ("conversations",),
    ),
    "mentions": (
        """SELECT 'm:' || event_id AS uuid, 'ev:' || event_id AS source_node_uuid, 'u:' || user_id AS target_node_uuid, event_type AS agent_id, ts AS created_at FROM events""",
        ("events",),
    ),
    "vectors": (
        """SELECT 'v:' || vec_id AS uuid, 'l' || label AS group_id, embedding FROM embeddings""",
        ("embeddings",),
    ),
}


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One graph table over the driver's tables."""
    sql, tables = SQL[name]
    _load(spark, sf, *tables)
    return spark.sql(sql)


def duck(*names: str) -> str:
    """The same views as DuckDB common table expressions (after WITH)."""
    out = []
    for n in names:
        sql = SQL[n][0].replace("TIMESTAMP_NTZ", "TIMESTAMP").replace("array(", "list_value(")
        out.append(f"{n} AS MATERIALIZED ({sql})")  # once, however often it is named
    return ",\n".join(out)
