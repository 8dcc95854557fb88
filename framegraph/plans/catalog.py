"""Registry of the library's queries and of the SQL that gives the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame under a name, with its DuckDB counterpart where there is one."""

    def add(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


from . import audio_queries, color_queries, delivery_queries, graph_queries, observe_queries, stream_queries, text_queries, timing_queries  # noqa: E402, F401
