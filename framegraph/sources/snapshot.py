"""Graph snapshots and exports as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "name string, processors array<struct<alias:string,type:string,config:map<string,string>,display_name:string>>, connections array<struct<`from`:string,`to`:string>>"


def read_snapshot(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alias, type, config, display_name) and (from, to) of a JSON document in column value; a type that is no string is null."""
    d = documents.select(F.from_json("value", SCHEMA).alias("d"))
    return d.select(F.explode("d.processors").alias("p")).select("p.*"), d.select(F.explode("d.connections").alias("c")).select("c.*")


#: Entries that one JSON document holds, at most.
MOST = 1_000_000


def _bounded(*parts: DataFrame) -> None:
    n = sum(x.count() for x in parts)
    if n > MOST:
        raise ValueError(f"{n} entries are too many for one document of at most {MOST}: export processors and links as tables")


def write_snapshot(processors: DataFrame, connections: DataFrame, name: str) -> DataFrame:
    """One JSON document, entries in the order of alias and of connection ends: a snapshot of one pipeline, not of data."""
    _bounded(processors, connections)
    p = processors.agg(F.array_sort(F.collect_list(F.struct("alias", "type", F.to_json("config").alias("config"), "display_name"))).alias("p"))
    c = connections.agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("c"))
    entry = lambda x: F.struct(x["alias"].alias("alias"), x["type"].alias("type"), F.from_json(x["config"], "map<string,string>").alias("config"), x["display_name"].alias("display_name"))
    return p.join(c).select(F.to_json(F.struct(F.lit(name).alias("name"), F.transform("p", entry).alias("processors"), F.col("c").alias("connections"))).alias("value"))


def export_lines(graph) -> DataFrame:
    """The graph as JSON lines in column value, one per processor and one per link."""
    line = lambda kind, *c: F.to_json(F.struct(F.lit(kind).alias("kind"), *c)).alias("value")
    nodes = graph.processors.select(line("node", "ord", "id", "type", "display_name"))
    return nodes.unionByName(graph.links.select(line("link", "ord", "id", "src_id", "src_port", "dst_id", "dst_port", "state")))


def export_json(graph) -> DataFrame:
    """One row with the graph as one JSON document, for pipelines that a person looks at."""
    _bounded(graph.processors, graph.links)
    v = graph.processors.agg(F.array_sort(F.collect_list(F.struct("ord", "id", "type", "display_name"))).alias("v"))
    e = graph.links.agg(F.array_sort(F.collect_list(F.struct("ord", "id", "src_id", "src_port", "dst_id", "dst_port", "state"))).alias("e"))
    return v.join(e).select(F.to_json(F.struct(F.col("v").alias("nodes"), F.col("e").alias("links"))).alias("graph"))
