"""Relational operators of the map engine: joins, graph, matching, topology."""
