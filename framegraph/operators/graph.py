"""A stream graph as two DataFrames, traversed by chained steps, changed by steps that return a new graph.

processors: id, type, display_name, ord and any further columns. links: id, src_id, src_port, dst_id, dst_port, ord
and any further ones. Steps are joins and filters on ids; nothing is collected. An unknown id gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import numbered


@dataclass(frozen=True)
class Steps:
    """A bag of vertices or links on the way through a graph; repeats stay."""

    graph: Graph
    rows: DataFrame
    vertices: bool

    def _with(self, rows: DataFrame, vertices: bool | None = None) -> Steps:
        return Steps(self.graph, rows, self.vertices if vertices is None else vertices)

    def filter(self, predicate: Column | str) -> Steps:
        return self._with(self.rows.where(predicate))

    def has_component(self, name: str) -> Steps:
        """Elements whose components map holds the key."""
        return self.filter(F.coalesce(F.map_contains_key("components", name), F.lit(False)))

    def ids(self) -> DataFrame:
        return self.rows.select("id")

    def exists(self) -> DataFrame:
        """One row: found."""
        return self.rows.limit(1).agg((F.count("*") > 0).alias("found"))

    def inspect(self, name: str, *what: Column) -> Steps:
        """The same elements; metrics over them arrive with the query that runs."""
        return self._with(self.rows.observe(name, *(what or (F.count(F.lit(1)).alias("n"),))))

    def _to_links(self, key: str) -> Steps:
        v = self.rows.select(F.col("id").alias("_v"))
        return self._with(self.graph.links.join(v, F.col(key) == F.col("_v")).drop("_v"), False)

    def _to_vertices(self, key: str) -> Steps:
        e = self.rows.select(F.col(key).alias("_v"))
        return self._with(self.graph.processors.join(e, F.col("id") == F.col("_v")).drop("_v"), True)

    def out_e(self) -> Steps:
        return self._to_links("src_id")

    def in_e(self) -> Steps:
        return self._to_links("dst_id")

    def out_v(self) -> Steps:
        """Links to their sources."""
        return self._to_vertices("src_id")

    def in_v(self) -> Steps:
        """Links to their destinations."""
        return self._to_vertices("dst_id")

    def first(self) -> DataFrame:
        return self.rows.orderBy("ord", "id").limit(1)

    def last(self) -> DataFrame:
        return self.rows.orderBy(F.desc("ord"), F.desc("id")).limit(1)

    def nth(self, n: int) -> DataFrame:
        """The zero-based n-th in traversal order, or nothing: a top-(n + 1), not a sort of all."""
        return self.rows.orderBy("ord", "id").offset(n).limit(1)

    def iter(self):
        """Rows one partition at a time."""
        return self.rows.toLocalIterator()

    def count(self) -> DataFrame:
        return self.rows.agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Graph:
    processors: DataFrame
    links: DataFrame

    def v(self, id_: str | None = None) -> Steps:
        return Steps(self, self.processors if id_ is None else self.processors.where(F.col("id") == id_), True)

    def e(self, id_: str | None = None) -> Steps:
        return Steps(self, self.links if id_ is None else self.links.where(F.col("id") == id_), False)

    # changes ----------------------------------------------------------------------------------------------------

    def add_vertices(self, specs: DataFrame, registry: DataFrame) -> Graph:
        """specs joined with registry (type, inputs, outputs): an unregistered type is added too, in state Error."""
        known = registry.select(F.col("type").alias("_t"), F.lit("Pending").alias("_s"))
        rows = specs.join(known, specs["type"] == known["_t"], "left").withColumn("state", F.coalesce("_s", F.lit("Error"))).drop("_t", "_s")
        return Graph(self.processors.unionByName(rows, allowMissingColumns=True), self.links)

    def connectable(self, wanted: DataFrame, ports: DataFrame) -> DataFrame:
        """The wanted links whose ends exist: ports has (id, port, output)."""
        out = ports.where("output").select(F.col("id").alias("src_id"), F.col("port").alias("src_port"))
        in_ = ports.where("not output").select(F.col("id").alias("dst_id"), F.col("port").alias("dst_port"))
        return wanted.join(out, ["src_id", "src_port"], "left_semi").join(in_, ["dst_id", "dst_port"], "left_semi")

    def add_links(self, wanted: DataFrame, ports: DataFrame) -> Graph:
        return Graph(self.processors, self.links.unionByName(self.connectable(wanted, ports), allowMissingColumns=True))

    def drop_vertices(self, ids: DataFrame) -> tuple[Graph, DataFrame]:
        """Without the vertices of ids and their links; and the ids that were not there."""
        gone = ids.select(F.col("id").alias("_gone")).distinct()
        links = self.links.join(gone, F.col("src_id") == F.col("_gone"), "left_anti").join(gone, F.col("dst_id") == F.col("_gone"), "left_anti")
        missing = ids.select("id").distinct().join(self.processors, "id", "left_anti")
        return Graph(self.processors.join(gone, F.col("id") == F.col("_gone"), "left_anti"), links), missing

    def drop_links(self, ids: DataFrame) -> tuple[Graph, DataFrame]:
        missing = ids.select("id").distinct().join(self.links, "id", "left_anti")
        return Graph(self.processors, self.links.join(ids.select("id"), "id", "left_anti")), missing

    def update(self, ids: DataFrame, column: str, value: Column) -> Graph:
        """The column set on the vertices of ids."""
        hit = ids.select(F.col("id").alias("_hit")).distinct()
        rows = self.processors.join(hit, F.col("id") == F.col("_hit"), "left").withColumn(column, F.when(F.col("_hit").isNotNull(), value).otherwise(F.col(column)))
        return Graph(rows.drop("_hit"), self.links)

    # checks -----------------------------------------------------------------------------------------------------

    def cyclic(self) -> DataFrame:
        """Vertices on cycles, or between them: what is left once vertices without incoming or outgoing links are peeled.

        Each round drops all such vertices; a graph without cycles empties after as many rounds as its longest path.
        """
        left = self.links.where("src_id is not null and dst_id is not null").select("src_id", "dst_id").distinct()
        before = None
        while True:
            left = left.join(left.select(F.col("dst_id").alias("src_id")).distinct(), "src_id", "left_semi")
            left = left.join(left.select(F.col("src_id").alias("dst_id")).distinct(), "dst_id", "left_semi").checkpoint()
            n = left.count()
            if n in (0, before):
                break
            before = n
        return left.select(F.col("src_id").alias("id")).unionByName(left.select(F.col("dst_id").alias("id"))).distinct()


def fan_in(links: DataFrame) -> DataFrame:
    return links.groupBy("dst_id").agg(F.count("*").alias("links"))


def destinations(links: DataFrame) -> DataFrame:
    """Per source port its destinations."""
    return links.groupBy("src_id", "src_port").agg(F.count("*").alias("destinations"))


def subscribers(links: DataFrame) -> DataFrame:
    """Per source port the subscriptions to provide: its destinations and one slot for a tap."""
    return links.groupBy("src_id", "src_port").agg((F.count("*") + 1).alias("subscribers"))


def profile_conflicts(links: DataFrame, profile: str = "profile") -> DataFrame:
    """Source ports whose destinations ask for more than one delivery profile."""
    found = links.groupBy("src_id", "src_port").agg(F.count_distinct(profile).alias("profiles"))
    return found.where("profiles > 1")


def violations(processors: DataFrame, connections: DataFrame, registry: DataFrame) -> DataFrame:
    """(kind, name) of what a snapshot gets wrong: duplicate aliases, unknown aliases in connections, unknown types.

    processors: alias, type. connections: from_alias, to_alias. registry: type.
    """
    twice = processors.groupBy("alias").count().where("count > 1").select(F.lit("duplicate_alias").alias("kind"), F.col("alias").alias("name"))
    ends = connections.select(F.explode(F.array("from_alias", "to_alias")).alias("alias")).distinct()
    unknown = ends.join(processors, "alias", "left_anti").select(F.lit("unknown_alias").alias("kind"), F.col("alias").alias("name"))
    types = processors.select("type").distinct().join(registry, "type", "left_anti").select(F.lit("unknown_type").alias("kind"), F.col("type").alias("name"))
    return twice.unionByName(unknown).unionByName(types)


def display_names(rows: DataFrame, name: str = "display_name") -> DataFrame:
    """shown: the name where nobody has it when the row's turn (by ord, then id) comes, else with the first free of ` 2`, ` 3`, ...

    Only names of one stem (the name without trailing numbers) can collide. A stem of one name is numbered in buckets,
    however often the name occurs; a stem of several names is an ordered fold that keeps the next number to try per name.
    """
    stem = rows.withColumn("_stem", F.regexp_replace(name, r"( [0-9]+)+$", ""))
    mixed = stem.groupBy("_stem").agg((F.min(name) != F.max(name)).alias("_mixed"))
    stem = stem.join(mixed, stem["_stem"].eqNullSafe(mixed["_stem"])).drop(mixed["_stem"])
    columns = stem.drop("_mixed").columns
    at = [columns.index(c) for c in ("_stem", name)]

    def fold(batches):
        import pyarrow as pa

        stem, used, following = None, set(), {}
        for batch in batches:
            shown = []
            for s, wanted in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                if s != stem:
                    stem, used, following = s, set(), {}
                got, k = wanted, following.get(wanted, 2)
                while got in used:
                    got, k = f"{wanted} {k}", k + 1
                following[wanted] = k
                used.add(got)
                shown.append(got)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shown, pa.string())], names=[*columns, "shown"])

    one = numbered(stem.where("_mixed is null or not _mixed"), name, "ord", "_k", by=["ord", "id"])
    one = one.withColumn("shown", F.when(F.col("_k") == 0, F.col(name)).otherwise(F.concat(name, F.lit(" "), (F.col("_k") + 1).cast("string"))))
    several = stem.where("_mixed").drop("_mixed").repartition("_stem").sortWithinPartitions("_stem", "ord", "id")
    folded = several.mapInArrow(fold, several.withColumn("shown", F.lit("")).schema)
    return one.drop("_k", "_mixed", "_stem").unionByName(folded.drop("_stem"))


def snapshot_aliases(rows: DataFrame) -> DataFrame:
    """alias: the type with a small first letter, then _2, _3 in order; show: the display name where it is not the type."""
    base = F.concat(F.lower(F.substring("type", 1, 1)), F.expr("substring(type, 2)"))
    k = F.col("_k") + 1
    return numbered(rows, "type", "ord", "_k").select("id", F.when(k > 1, F.concat(base, F.lit("_"), k.cast("string"))).otherwise(base).alias("alias"), F.nullif("display_name", "type").alias("shown"))


def fold_operations(ops: DataFrame) -> DataFrame:
    """The last queued operation of each target: (target, op, payload) from seq, target, op, payload."""
    last = F.max_by(F.struct("op", "payload"), "seq")
    return ops.groupBy("target").agg(last.alias("x")).select("target", "x.op", "x.payload")


def plan_operations(ops: DataFrame, graph: Graph, running: DataFrame) -> DataFrame:
    """(target, op, step): run, or why an operation is left out (in the graph already, running already, not in the graph)."""
    have = graph.processors.select(F.col("id").alias("target"), F.lit(True).alias("have"))
    runs = running.select(F.col("id").alias("target"), F.lit(True).alias("runs"))
    rows = ops.join(have, "target", "left").join(runs, "target", "left")
    step = F.when((F.col("op") == "add") & F.col("runs").isNotNull(), "already_running").when((F.col("op") != "add") & F.col("have").isNull(), "not_in_graph").otherwise("run")
    return rows.select("target", "op", step.alias("step"))


def without_doomed(adds: DataFrame, removed: DataFrame) -> DataFrame:
    """Link additions less those with an end that the same batch removes."""
    gone = removed.select(F.col("id").alias("_gone"))
    return adds.join(gone, F.col("src_id") == F.col("_gone"), "left_anti").join(gone, F.col("dst_id") == F.col("_gone"), "left_anti")
