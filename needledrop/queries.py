"""All queries of the library, by name."""

from __future__ import annotations

from needledrop.functions import media_queries, parsing_queries, path_queries
from needledrop.operators import catalog_queries, files_queries, maintenance_queries, mutations_queries, reports_queries, signal_queries, spectrogram_queries, strategy_queries
from needledrop.plans import planning_queries
from needledrop.streaming import queue_queries

MODULES = (catalog_queries, files_queries, path_queries, media_queries, parsing_queries, maintenance_queries, mutations_queries, reports_queries, signal_queries, strategy_queries, spectrogram_queries, planning_queries, queue_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
