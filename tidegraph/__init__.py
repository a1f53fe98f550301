"""Bi-temporal knowledge-graph analytics expressed as Spark plans."""
