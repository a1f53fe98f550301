"""The tables of the graph memory as Spark DDL, and the edges each node table anchors."""

ATTRIBUTION = "source_ids array<string>, source_contexts array<string>, participant_ids array<string>"
LINK = "uuid string, group_id string, source_node_uuid string, target_node_uuid string, created_at timestamp_ntz"

TABLES = {
    "entity": f"uuid string, name string, group_id string, labels array<string>, created_at timestamp_ntz, name_embedding array<float>, summary string, attributes map<string,string>, agent_ids array<string>, traits array<string>, is_system boolean, is_identity boolean, {ATTRIBUTION}",
    "episodic": "uuid string, name string, group_id string, created_at timestamp_ntz, source string, source_description string, content string, valid_at timestamp_ntz, entity_edges array<string>, agent_id string, source_id string, source_context string, participant_ids array<string>",
    "community": f"uuid string, name string, group_id string, created_at timestamp_ntz, name_embedding array<float>, summary string, agent_ids array<string>, {ATTRIBUTION}",
    "saga": "uuid string, name string, group_id string, created_at timestamp_ntz",
    "entity_edge": f"{LINK}, name string, fact string, fact_embedding array<float>, episodes array<string>, expired_at timestamp_ntz, valid_at timestamp_ntz, invalid_at timestamp_ntz, attributes map<string,string>, agent_ids array<string>, is_system boolean, {ATTRIBUTION}",
    "mentions": f"{LINK}, agent_id string, source_id string, source_context string, participant_ids array<string>",
    "has_member": LINK,
    "has_episode": LINK,
    "next_episode": LINK,
}
NODES = ("entity", "episodic", "community", "saga")
EDGES = ("entity_edge", "mentions", "has_member", "has_episode", "next_episode")
#: (source tables, target tables) of each edge table.
ENDS = {
    "entity_edge": (("entity",), ("entity",)),
    "mentions": (("episodic",), ("entity",)),
    "has_member": (("community",), ("entity", "community")),
    "has_episode": (("saga",), ("episodic",)),
    "next_episode": (("episodic",), ("episodic",)),
}
#: Text fields of each searchable table.
FULLTEXT = {"entity": ("name", "summary"), "episodic": ("content", "source", "source_description"), "community": ("name",), "entity_edge": ("name", "fact")}
