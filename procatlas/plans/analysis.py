"""One analysis: source texts in, stored fact tables and a dependency graph out.

Facts are extracted once and written; listings, roll-ups and graphs then read the small fact tables
and never touch a source text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procatlas.functions import scalars
from procatlas.operators import extract, graph, maintain, resolve
from procatlas.session import configure, cut
from procatlas.sources import sinks

KEEP = ("object_id", "connection_id")


class Analysis:
    """Facts of ``objects``, each table written on first use.

    ``objects``: object_id, connection_id, dialect, schema_name, object_name, fqn, object_type,
    definition, seen_at.  ``tables``: nested table metadata, see ``operators.metadata``.
    """

    def __init__(self, spark: SparkSession, objects=None, tables=None):
        self.spark = configure(spark)
        self._objects, self._tables_source = objects, tables
        self._stored: dict[str, DataFrame] = {}

    def stored(self, name: str, build) -> DataFrame:
        if name not in self._stored:
            self._stored[name] = cut(build(), name)
        return self._stored[name]

    @property
    def objects(self) -> DataFrame:
        return self.stored("objects", lambda: self._objects)

    @property
    def tables(self) -> DataFrame:
        return self.stored("tables", lambda: self._tables_source)

    @property
    def dependencies(self) -> DataFrame:
        """Calls and references; they are written before their names are looked up, so each text is searched once."""
        return self.stored("dependencies", lambda: resolve.resolve_targets(
            cut(extract.dependencies(self.objects, KEEP), "facts"), self.objects))

    @property
    def accesses(self) -> DataFrame:
        return self.stored("accesses", lambda: extract.table_accesses(self.objects, KEEP))

    @property
    def findings(self) -> DataFrame:
        return self.stored("findings", lambda: extract.findings(self.objects))

    @property
    def complexity(self) -> DataFrame:
        return self.stored("complexity", lambda: extract.complexity(self.objects))

    @property
    def variables(self) -> DataFrame:
        return self.stored("variables", lambda: extract.variable_references(self.objects))

    @property
    def nodes(self) -> DataFrame:
        return self.stored("nodes", lambda: graph.union_nodes(
            self.objects, self.dependencies, self.accesses, self.complexity, self.findings))

    @property
    def edges(self) -> DataFrame:
        """Read from calls and accesses alone: measures and findings are only asked for by the nodes."""
        return self.stored("edges", lambda: graph.union_edges(self.objects, self.dependencies, self.accesses))

    @property
    def components(self) -> DataFrame:
        """Nodes on a cycle with their component."""
        return self.stored("components", lambda: graph.cyclic_components(self.edges))

    @property
    def deepest(self) -> DataFrame:
        return self.stored("deepest", lambda: graph.max_depth(self.nodes, self.edges))

    def _graph(self, connection_id=None) -> tuple[DataFrame, DataFrame]:
        def scoped(df: DataFrame) -> DataFrame:
            return df if connection_id is None else df.where(F.col("connection_id") == connection_id)

        return graph.assemble(scoped(self.objects), scoped(self.dependencies), scoped(self.accesses),
                              self.complexity, self.findings)

    def graph_view(self, connection_id=None, root: str | None = None, max_depth: int = 10,
                   types: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, edges, summary) of a connection: around a root if one is given, of the edge types asked for."""
        nodes, edges = (self.nodes, self.edges) if connection_id is None else map(
            lambda df: cut(df, "view"), self._graph(connection_id))
        if root is not None:
            start = nodes.where(F.col("id") == root).select("id")
            nodes, edges = graph.induced(nodes, edges, graph.reach(edges, start, max_depth))
        nodes, edges = graph.filter_types(nodes, edges, types, prune=root is not None)
        if connection_id is None and root is None and not types:  # the whole graph, whose cycles and depth are stored
            return nodes, edges, graph.summary(nodes, edges, self.components, self.deepest)
        nodes, edges = cut(nodes, "view"), cut(edges, "view")
        return nodes, edges, graph.summary(nodes, edges)

    def store(self, folder: str, job_id: str, seen_at: Column, previous: DataFrame | None = None) -> DataFrame:
        """Write the facts of this run and the merged object catalog; returns the catalog.

        Facts go under ``<table>/job_id=<job>``, so dropping a run is dropping its folders and queries
        read the newest run.  ``previous`` is the catalog of the last run, None for the first.
        """
        for name in ("dependencies", "accesses"):
            sinks.store_facts(getattr(self, name), f"{folder}/{name}/job_id={job_id}")
        for name in ("findings", "complexity", "variables"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}/job_id={job_id}")
        refreshed = ["object_id", "object_type", "dialect", "definition_hash", "cyclomatic", "lines"]
        snapshot = self.objects.withColumn(
            "definition_hash", scalars.definition_hash(F.col("definition"))).join(
            self.complexity.select("object_id", "cyclomatic", "lines"), "object_id").select(
            "connection_id", "fqn", *refreshed)
        if previous is None:
            previous = snapshot.select("*", seen_at.alias("first_seen"), seen_at.alias("last_seen"),
                                       F.lit(False).alias("is_deleted")).where(F.lit(False))
        merged = maintain.merge_objects(previous, snapshot, seen_at, refreshed)
        path = f"{folder}/objects/job_id={job_id}"
        merged.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(merged.schema).parquet(path)
