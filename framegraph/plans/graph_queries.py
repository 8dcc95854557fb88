"""Queries over the graph: scans, steps, checks and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators.graph import Graph
from ..sources.scratch import folder as scratch_folder
from ..sources.snapshot import export_lines, read_snapshot
from ..sources.tables import L, P, links, processors, with_
from .catalog import query

PL = with_(P, L)


def graph(spark, sf) -> Graph:
    return Graph(processors(spark, sf), links(spark, sf))


@query("src_vertices", PL + "SELECT * FROM p")
def src_vertices(spark, sf):
    return graph(spark, sf).v().rows


@query("src_vertex_by_id", PL + "SELECT * FROM p WHERE id = 'Nation/3'")
def src_vertex_by_id(spark, sf):
    return graph(spark, sf).v("Nation/3").rows


@query("src_edges", PL + "SELECT * FROM l")
def src_edges(spark, sf):
    return graph(spark, sf).e().rows


@query("src_edge_by_id", PL + "SELECT * FROM l WHERE id = 'link/no such'")
def src_edge_by_id(spark, sf):
    return graph(spark, sf).e("link/no such").rows


@query("flt_vertices", PL + "SELECT id, balance FROM p WHERE type = 'Customer' AND balance < 0")
def flt_vertices(spark, sf):
    return graph(spark, sf).v().filter((F.col("type") == "Customer") & (F.col("balance") < 0)).rows.select("id", "balance")


@query("flt_edges", PL + "SELECT id, dst_id FROM l WHERE dst_port = 'in2'")
def flt_edges(spark, sf):
    return graph(spark, sf).e().filter(F.col("dst_port") == "in2").rows.select("id", "dst_id")


@query("flt_has_component", PL + "SELECT id FROM p WHERE balance IS NOT NULL")
def flt_has_component(spark, sf):
    p = processors(spark, sf).withColumn("components", F.when(F.col("balance").isNotNull(), F.create_map(F.lit("balance"), F.col("balance").cast("string"))))
    return Graph(p, links(spark, sf)).v().has_component("balance").ids()


@query("prj_ids", PL + "SELECT id FROM p")
def prj_ids(spark, sf):
    return graph(spark, sf).v().ids()


@query("prj_edge_ids", PL + "SELECT id FROM l")
def prj_edge_ids(spark, sf):
    return graph(spark, sf).e().ids()


@query("flt_exists", PL + "SELECT count(*) > 0 AS found FROM p WHERE type = 'Supplier'")
def flt_exists(spark, sf):
    return graph(spark, sf).v().filter(F.col("type") == "Supplier").exists()


@query("prj_iter", PL + "SELECT id FROM p WHERE type = 'Region'")
def prj_iter(spark, sf):
    regions = graph(spark, sf).v().filter(F.col("type") == "Region")  # five rows
    return spark.createDataFrame([(r["id"],) for r in regions.iter()], "id string")


@query("prj_inspect", PL + "SELECT id FROM p")
def prj_inspect(spark, sf):
    return graph(spark, sf).v().inspect("seen").ids()


@query("prj_identity", PL + "SELECT id, type FROM p")
def prj_identity(spark, sf):
    return processors(spark, sf).select("id", "type")


@query("jn_out_e", PL + "SELECT l.id, l.dst_id FROM p JOIN l ON l.src_id = p.id WHERE p.type = 'Nation'")
def jn_out_e(spark, sf):
    return graph(spark, sf).v().filter(F.col("type") == "Nation").out_e().rows.select("id", "dst_id")


@query("jn_in_e", PL + "SELECT l.id, l.src_id FROM p JOIN l ON l.dst_id = p.id WHERE p.type = 'Nation'")
def jn_in_e(spark, sf):
    return graph(spark, sf).v().filter(F.col("type") == "Nation").in_e().rows.select("id", "src_id")


@query("jn_in_v", PL + "SELECT p.id, p.display_name FROM l JOIN p ON p.id = l.dst_id")
def jn_in_v(spark, sf):
    return graph(spark, sf).e().in_v().rows.select("id", "display_name")


@query("jn_out_v", PL + "SELECT p.id, p.display_name FROM l JOIN p ON p.id = l.src_id")
def jn_out_v(spark, sf):
    return graph(spark, sf).e().out_v().rows.select("id", "display_name")


@query("jn_multihop", PL + "SELECT r.id FROM p c JOIN l a ON a.src_id = c.id JOIN l b ON b.src_id = a.dst_id JOIN p r ON r.id = b.dst_id WHERE c.type = 'Customer'")
def jn_multihop(spark, sf):
    return graph(spark, sf).v().filter(F.col("type") == "Customer").out_e().in_v().out_e().in_v().ids()


@query("win_first", PL + "SELECT id FROM p ORDER BY ord, id LIMIT 1")
def win_first(spark, sf):
    return graph(spark, sf).v().first().select("id")


@query("win_last", PL + "SELECT id FROM p ORDER BY ord DESC, id DESC LIMIT 1")
def win_last(spark, sf):
    return graph(spark, sf).v().last().select("id")


@query("win_nth", PL + "SELECT id FROM p ORDER BY ord, id LIMIT 1 OFFSET 17")
def win_nth(spark, sf):
    return graph(spark, sf).v().nth(17).select("id")


@query("win_display_name", PL + ", n AS (SELECT id, type AS name, row_number() OVER (PARTITION BY type ORDER BY ord, id) AS k FROM p) SELECT id, name || CASE WHEN k = 1 THEN '' ELSE ' ' || k END AS shown FROM n")
def win_display_name(spark, sf):
    return g.display_names(processors(spark, sf), "type").select("id", "shown")


#: Names of a stem one after the other; with each the names that are taken by then.
TAKEN = "WITH RECURSIVE " + P + """, o AS (SELECT id, 'S' || (ord % 200) AS stem, 'S' || (ord % 200) || CASE WHEN ord % 7 = 0 THEN ' 2' WHEN ord % 11 = 0 THEN ' 3' ELSE '' END AS name, row_number() OVER (PARTITION BY ord % 200 ORDER BY ord, id) AS r FROM p),
w AS (SELECT stem, r, id, name AS shown, [name] AS used FROM o WHERE r = 1
  UNION ALL SELECT stem, r, id, shown, list_append(used, shown)
  FROM (SELECT o.stem, o.r, o.id, w.used, CASE WHEN list_contains(w.used, o.name) THEN o.name || ' ' || list_min(list_filter(range(2, len(w.used) + 3), lambda k: NOT list_contains(w.used, o.name || ' ' || k))) ELSE o.name END AS shown FROM w JOIN o ON o.stem = w.stem AND o.r = w.r + 1))
SELECT id, shown FROM w"""


@query("win_display_name_skipping", TAKEN)
def win_display_name_skipping(spark, sf):
    """Names of which some have the suffix that another one's repeats would get."""
    k = F.col("ord")
    wanted = F.concat(F.lit("S"), (k % 200).cast("string"), F.when(k % 7 == 0, " 2").when(k % 11 == 0, " 3").otherwise(""))
    return g.display_names(processors(spark, sf).withColumn("display_name", wanted)).select("id", "shown")


@query("win_snapshot_alias", PL + ", n AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ord, id) AS k FROM p) SELECT id, lower(type[1]) || type[2:] || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS alias, nullif(display_name, type) AS shown FROM n")
def win_snapshot_alias(spark, sf):
    return g.snapshot_aliases(processors(spark, sf))


@query("win_snapshot_display", PL + "SELECT id, nullif(display_name, 'ASIA') AS shown FROM p")
def win_snapshot_display(spark, sf):
    return processors(spark, sf).select("id", F.nullif("display_name", F.lit("ASIA")).alias("shown"))


@query("agg_count", PL + "SELECT count(*) AS n FROM p")
def agg_count(spark, sf):
    return graph(spark, sf).v().count()


@query("agg_fanin", PL + "SELECT dst_id, count(*) AS links FROM l GROUP BY dst_id")
def agg_fanin(spark, sf):
    return g.fan_in(links(spark, sf))


@query("agg_subscribers", PL + "SELECT src_id, src_port, count(*) + 1 AS subscribers FROM l GROUP BY ALL")
def agg_subscribers(spark, sf):
    return g.subscribers(links(spark, sf))


@query("set_destinations", PL + "SELECT src_id, src_port, count(*) AS destinations FROM l GROUP BY ALL")
def set_destinations(spark, sf):
    return g.destinations(links(spark, sf))


@query("agg_profile_agree", PL + ", x AS (SELECT dst_id AS src_id, 'out1' AS src_port, CASE WHEN dst_port = 'in2' THEN 'latest' ELSE 'lossless' END AS profile FROM l) SELECT src_id, src_port, count(DISTINCT profile) AS profiles FROM x GROUP BY ALL HAVING count(DISTINCT profile) > 1")
def agg_profile_agree(spark, sf):
    rows = links(spark, sf).select(F.col("dst_id").alias("src_id"), "src_port", F.when(F.col("dst_port") == "in2", "latest").otherwise("lossless").alias("profile"))
    return g.profile_conflicts(rows)


@query("jn_snapshot_refs", PL + """, s AS (SELECT CASE WHEN ord % 50 = 7 THEN 'dup' ELSE id END AS alias, CASE WHEN type = 'Region' THEN 'Planet' ELSE type END AS type FROM p),
c AS (SELECT src_id AS f, dst_id AS t FROM l), ends AS (SELECT DISTINCT alias FROM (SELECT f AS alias FROM c UNION ALL SELECT t FROM c))
SELECT 'duplicate_alias' AS kind, alias AS name FROM s GROUP BY alias HAVING count(*) > 1
UNION ALL SELECT 'unknown_alias', alias FROM ends WHERE alias NOT IN (SELECT alias FROM s)
UNION ALL SELECT DISTINCT 'unknown_type', type FROM s WHERE type NOT IN ('Nation', 'Customer', 'Supplier')""")
def jn_snapshot_refs(spark, sf):
    s = processors(spark, sf).select(F.when(F.col("ord") % 50 == 7, "dup").otherwise(F.col("id")).alias("alias"), F.when(F.col("type") == "Region", "Planet").otherwise(F.col("type")).alias("type"))
    c = links(spark, sf).select(F.col("src_id").alias("from_alias"), F.col("dst_id").alias("to_alias"))
    return g.violations(s, c, spark.createDataFrame([("Nation",), ("Customer",), ("Supplier",)], "type string"))


@query("jn_doomed_links", PL + "SELECT id FROM l WHERE src_id NOT IN (SELECT id FROM p WHERE type = 'Nation' AND ord % 3 = 0) AND dst_id NOT IN (SELECT id FROM p WHERE type = 'Nation' AND ord % 3 = 0)")
def jn_doomed_links(spark, sf):
    gone = processors(spark, sf).where("type = 'Nation' and ord % 3 = 0").select("id")
    return g.without_doomed(links(spark, sf), gone).select("id")


@query("val_cycles", PL + "SELECT id FROM p WHERE false")
def val_cycles(spark, sf):
    from ..sources.scratch import scratch

    scratch(spark)
    return graph(spark, sf).cyclic()


@query("mut_add_v", PL + "SELECT id, type, 'unset' AS state FROM p UNION ALL SELECT 'new/' || id, type, CASE WHEN type = 'Region' THEN 'Pending' ELSE 'Error' END FROM p WHERE type IN ('Region', 'Nation')")
def mut_add_v(spark, sf):
    new = processors(spark, sf).where("type in ('Region', 'Nation')").withColumn("id", F.concat(F.lit("new/"), "id"))
    out = Graph(processors(spark, sf), links(spark, sf)).add_vertices(new, spark.createDataFrame([("Region",)], "type string"))
    return out.processors.select("id", "type", F.coalesce("state", F.lit("unset")).alias("state"))


def _wanted(spark, sf):
    p = processors(spark, sf).where("type in ('Customer', 'Supplier')")
    port = F.when(F.col("ord") % 4 == 0, "out9").otherwise("out1")
    return p.select(F.concat(F.lit("new/"), "id").alias("id"), F.col("id").alias("src_id"), port.alias("src_port"), F.concat(F.lit("Region/"), (F.col("ord") % 7).cast("string")).alias("dst_id"), F.lit("in1").alias("dst_port"))


def _ports(spark, sf):
    p = processors(spark, sf)
    return p.select("id", F.lit("out1").alias("port"), F.lit(True).alias("output")).unionByName(p.select("id", F.explode(F.array(F.lit("in1"), F.lit("in2"))).alias("port"), F.lit(False).alias("output")))


@query("mut_add_e", PL + "SELECT id, src_id, dst_id FROM l UNION ALL SELECT 'new/' || id, id, 'Region/' || (ord % 7) FROM p WHERE type IN ('Customer', 'Supplier') AND ord % 4 <> 0 AND 'Region/' || (ord % 7) IN (SELECT id FROM p)")
def mut_add_e(spark, sf):
    return graph(spark, sf).add_links(_wanted(spark, sf), _ports(spark, sf)).links.select("id", "src_id", "dst_id")


@query("mut_connect", PL + "SELECT 'new/' || id AS id, CASE WHEN ord % 4 = 0 THEN 'unknown source port' WHEN 'Region/' || (ord % 7) NOT IN (SELECT id FROM p) THEN 'unknown destination' END AS error FROM p WHERE type IN ('Customer', 'Supplier')")
def mut_connect(spark, sf):
    wanted, ports = _wanted(spark, sf), _ports(spark, sf)
    out = ports.where("output").select(F.col("id").alias("src_id"), F.col("port").alias("src_port"), F.lit(True).alias("s"))
    in_ = ports.where("not output").select(F.col("id").alias("dst_id"), F.col("port").alias("dst_port"), F.lit(True).alias("d"))
    rows = wanted.join(out, ["src_id", "src_port"], "left").join(in_, ["dst_id", "dst_port"], "left")
    return rows.select("id", F.when(F.col("s").isNull(), "unknown source port").when(F.col("d").isNull(), "unknown destination").alias("error"))


@query("mut_drop", PL + "SELECT 'vertex' AS kind, id FROM p WHERE type <> 'Nation' UNION ALL SELECT 'link', l.id FROM l WHERE src_id NOT LIKE 'Nation/%' AND dst_id NOT LIKE 'Nation/%' UNION ALL SELECT 'missing', 'no such'")
def mut_drop(spark, sf):
    ids = processors(spark, sf).where("type = 'Nation'").select("id").unionByName(spark.createDataFrame([("no such",)], "id string"))
    left, missing = graph(spark, sf).drop_vertices(ids)
    kinds = (("vertex", left.processors), ("link", left.links), ("missing", missing))
    a, b, c = (df.select(F.lit(k).alias("kind"), "id") for k, df in kinds)
    return a.unionByName(b).unionByName(c)


@query("mut_drop_links", PL + "SELECT id FROM l WHERE dst_port <> 'in2'")
def mut_drop_links(spark, sf):
    return graph(spark, sf).drop_links(links(spark, sf).where("dst_port = 'in2'"))[0].links.select("id")


@query("mut_nth_mut", PL + "SELECT id, CASE WHEN id = (SELECT id FROM p ORDER BY ord, id LIMIT 1 OFFSET 5) THEN 'renamed' ELSE display_name END AS display_name FROM p")
def mut_nth_mut(spark, sf):
    gr = graph(spark, sf)
    return gr.update(gr.v().nth(5), "display_name", F.lit("renamed")).processors.select("id", "display_name")


@query("mut_config", PL + "SELECT id, CASE WHEN type = 'Nation' THEN '{\"a\":1}' ELSE '{}' END AS config, type = 'Nation' AS changed FROM p")
def mut_config(spark, sf):
    from ..functions.text import config_checksum

    p = processors(spark, sf).withColumn("config", F.lit("{}")).withColumn("checksum", config_checksum(F.col("config")))
    new = Graph(p, links(spark, sf)).update(p.where("type = 'Nation'"), "config", F.lit('{"a":1}')).processors
    return new.select("id", "config", (config_checksum(F.col("config")) != F.col("checksum")).alias("changed"))


OPS = "ops AS (SELECT event_id AS seq, user_id AS target, CASE event_type WHEN 'error' THEN 'remove' WHEN 'click' THEN 'update' ELSE 'add' END AS op, props AS payload FROM events)"


def _ops(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("target"), F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "click", "update").otherwise("add").alias("op"), F.col("props").alias("payload"))


@query("mut_ops_queue", with_(OPS) + "SELECT target, arg_max(op, seq) AS op, arg_max(payload, seq) AS payload FROM ops GROUP BY target")
def mut_ops_queue(spark, sf):
    return g.fold_operations(_ops(spark, sf))


@query("mut_plan", with_(P, OPS) + """, f AS (SELECT 'Customer/' || target AS target, arg_max(op, seq) AS op FROM ops GROUP BY target)
SELECT target, op, CASE WHEN op = 'add' AND target IN (SELECT id FROM p WHERE ord % 2 = 0) THEN 'already_running' WHEN op <> 'add' AND target NOT IN (SELECT id FROM p) THEN 'not_in_graph' ELSE 'run' END AS step FROM f""")
def mut_plan(spark, sf):
    ops = g.fold_operations(_ops(spark, sf)).withColumn("target", F.concat(F.lit("Customer/"), F.col("target").cast("string")))
    return g.plan_operations(ops, graph(spark, sf), processors(spark, sf).where("ord % 2 = 0"))


@query("mut_pause_all", PL + "SELECT id, CASE WHEN type IN ('Customer', 'Supplier') THEN 'Paused' ELSE 'Idle' END AS state FROM p")
def mut_pause_all(spark, sf):
    p = processors(spark, sf).withColumn("state", F.when(F.col("type").isin("Customer", "Supplier"), "Running").otherwise("Idle"))
    gr = Graph(p, links(spark, sf))
    return gr.update(gr.v().filter(F.col("state") == "Running").rows, "state", F.lit("Paused")).processors.select("id", "state")


@query("src_graph_export", PL + "SELECT 'node' AS kind, id, type AS what, CAST(NULL AS VARCHAR) AS src_id FROM p UNION ALL SELECT 'link', id, state, src_id FROM l")
def src_graph_export(spark, sf):
    """The whole graph as JSON lines, one per processor and link, written and read back."""
    to = scratch_folder(spark)
    export_lines(graph(spark, sf)).write.text(to)
    back = spark.read.text(to).select(F.from_json("value", "kind string, id string, type string, state string, src_id string").alias("x"))
    return back.select("x.kind", "x.id", F.coalesce("x.type", "x.state").alias("what"), "x.src_id")


SNAPSHOT = '{"name":"t","processors":[{"alias":"camera","type":"Camera","config":{"w":640},"display_name":"Cam"},{"alias":"view","type":"Display","config":{}}],"connections":[{"from":"camera.video","to":"view.video"}]}'


@query("src_snapshot", "SELECT 'processor' AS kind, 'camera' AS a, 'Camera' AS b UNION ALL SELECT 'processor', 'view', 'Display' UNION ALL SELECT 'connection', 'camera.video', 'view.video'")
def src_snapshot(spark, sf):
    p, c = read_snapshot(spark.createDataFrame([(SNAPSHOT,)], "value string"))
    return p.select(F.lit("processor").alias("kind"), F.col("alias").alias("a"), F.col("type").alias("b")).unionByName(c.select(F.lit("connection").alias("kind"), F.col("from").alias("a"), F.col("to").alias("b")))


@query("mut_snapshot_load", "SELECT 'camera' AS src_id, 'video' AS src_port, 'view' AS dst_id, 'video' AS dst_port")
def mut_snapshot_load(spark, sf):
    from ..functions.text import port_ref

    p, c = read_snapshot(spark.createDataFrame([(SNAPSHOT,)], "value string"))
    (a, ap), (b, bp) = port_ref(F.col("from")), port_ref(F.col("to"))
    ends = c.select(a.alias("src_id"), ap.alias("src_port"), b.alias("dst_id"), bp.alias("dst_port"))
    return ends.join(p.select(F.col("alias").alias("src_id")), "src_id", "left_semi").join(p.select(F.col("alias").alias("dst_id")), "dst_id", "left_semi").select("src_id", "src_port", "dst_id", "dst_port")


@query("snk_snapshot", "SELECT true AS same")
def snk_snapshot(spark, sf):
    from ..sources.snapshot import write_snapshot

    once = write_snapshot(*read_snapshot(spark.createDataFrame([(SNAPSHOT,)], "value string")), name="t")
    twice = write_snapshot(*read_snapshot(once), name="t")
    return once.join(twice.withColumnRenamed("value", "again")).select((F.col("value") == F.col("again")).alias("same"))


@query("src_registry", "SELECT name, execution, inputs, outputs, description FROM (VALUES ('framegraph.plans.processors:newest', 'reactive', 'in=latest', 'out', 'the newest frame of each tick'), ('framegraph.plans.processors:rechunked', 'reactive', 'audio=lossless', 'chunks', 'samples in chunks of one size'), ('framegraph.plans.processors:ticks', 'continuous', '', 'out', 'numbered ticks of a clock')) v(name, execution, inputs, outputs, description)")
def src_registry(spark, sf):
    from . import processors as _  # noqa: F401  registers them
    from .registry import registered

    ours = registered(spark).where("name like 'framegraph.plans.processors:%'")
    ports = F.array_join(F.transform(F.array_sort(F.map_entries("inputs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return ours.select("name", "execution", ports.alias("inputs"), F.array_join("outputs", ",").alias("outputs"), "description")
