"""Queries of the library by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import geo_queries, graph_queries, keyframe_queries, metric_queries, retrieval_queries, scene_queries, shortcut_queries, store_queries, track_queries

_MODULES = (retrieval_queries, geo_queries, track_queries, graph_queries, keyframe_queries, metric_queries, scene_queries, shortcut_queries, store_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
