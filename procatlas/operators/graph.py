"""Property graph of objects, external names and tables, and iterative jobs over it.

Loops keep their state as tables on shared storage: each round joins the newest level with the
edges, drops what is known, and writes the next level.  Lineage therefore never grows, a lost
executor costs one round, and file sizes tell the planner when a level is small enough to broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.functions.scalars import access_edge_type
from procatlas.operators.rollup import side_by_side
from procatlas.session import Levels, cut

EDGE_COLUMNS = ["edge_id", "source", "target", "dep_type", "is_dynamic", "confidence", "source_label", "target_label"]


def _sanitised(prefix: str, name: Column) -> Column:
    """Id of an external name or a table; the same name in another connection is another node."""
    connection = F.coalesce(F.col("connection_id").cast("string"), F.lit(""))
    return F.concat(F.lit(prefix), connection, F.lit("_"), F.regexp_replace(name, "[^a-zA-Z0-9_]", "_"))


def _schema_of(name: Column) -> Column:
    return F.when(name.contains("."), F.substring_index(name, ".", 1)).otherwise("")


def object_node_id(object_id: Column) -> Column:
    return F.concat(F.lit("obj_"), object_id.cast("string"))


def call_edges(dependencies: DataFrame, objects: DataFrame) -> DataFrame:
    """Resolved and external call edges."""
    names = objects.select("object_id", F.col("object_name").alias("source_label"))
    targets = objects.select(F.col("object_id").alias("target_id"), F.col("object_name").alias("_label"))
    known = F.col("_label").isNotNull()
    return (
        dependencies.join(names, "object_id").join(targets, "target_id", "left")
        .select(
            F.concat_ws("_", F.lit("dep"), "object_id", "dep_type", "target_name", "line").alias("edge_id"),
            object_node_id(F.col("object_id")).alias("source"),
            F.when(known, object_node_id(F.col("target_id"))).otherwise(_sanitised("ext_", F.col("target_name"))).alias("target"),
            "dep_type", "is_dynamic", F.col("confidence").cast("double").alias("confidence"), "source_label",
            F.coalesce("_label", F.substring_index("target_name", ".", -1)).alias("target_label")))


def access_edges(accesses: DataFrame, objects: DataFrame) -> DataFrame:
    names = objects.select("object_id", F.col("object_name").alias("source_label"))
    return accesses.join(names, "object_id").select(
        F.concat_ws("_", F.lit("ta"), "object_id", "operation", "full_table_name").alias("edge_id"),
        object_node_id(F.col("object_id")).alias("source"),
        _sanitised("tbl_", F.col("full_table_name")).alias("target"),
        access_edge_type(F.col("operation")).alias("dep_type"), F.lit(False).alias("is_dynamic"),
        F.lit(1.0).alias("confidence"), "source_label", F.col("table_name").alias("target_label"))


def _virtual_nodes(names: DataFrame, name: str, prefix: str, kind: str) -> DataFrame:
    """One node per connection and sanitised name; of several names under one id the smallest gives the label."""
    label = F.min(F.struct(F.substring_index(name, ".", -1).alias("label"), _schema_of(F.col(name)).alias("schema_name")))
    return names.groupBy(_sanitised(prefix, F.col(name)).alias("id")).agg(label.alias("n")).select(
        "id", "n.label", F.lit(kind).alias("object_type"), "n.schema_name",
        F.lit(None).cast("int").alias("complexity"), F.lit(0).cast("bigint").alias("finding_count"))


def object_nodes(objects: DataFrame, complexity: DataFrame, findings: DataFrame) -> DataFrame:
    counted = findings.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        objects.join(complexity.select("object_id", "cyclomatic"), "object_id", "left").join(counted, "object_id", "left")
        .select(object_node_id(F.col("object_id")).alias("id"), F.col("object_name").alias("label"), "object_type",
                "schema_name", F.col("cyclomatic").alias("complexity"), F.coalesce("n", F.lit(0)).alias("finding_count")))


def assemble(objects: DataFrame, dependencies: DataFrame, accesses: DataFrame, complexity: DataFrame,
             findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges).  Source texts are never read here."""
    return union_nodes(objects, dependencies, accesses, complexity, findings), union_edges(objects, dependencies, accesses)


def union_edges(objects, dependencies, accesses) -> DataFrame:
    slim = objects.select("object_id", "object_name")
    return call_edges(dependencies, slim).unionByName(access_edges(accesses, slim))


def union_nodes(objects, dependencies, accesses, complexity, findings) -> DataFrame:
    external = dependencies.where(F.col("target_id").isNull())
    slim = objects.select("object_id", "object_name", "object_type", "schema_name")
    return reduce(DataFrame.unionByName, [
        object_nodes(slim, complexity, findings),
        _virtual_nodes(external, "target_name", "ext_", "external"),
        _virtual_nodes(accesses, "full_table_name", "tbl_", "table")])


def steps(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Distinct (src, dst) pairs to walk: out, in or both."""
    out = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    back = edges.select(F.col("target").alias("src"), F.col("source").alias("dst"))
    chosen = {"out": out, "in": back}.get(direction)
    return (out.unionByName(back) if chosen is None else chosen).distinct()


def reach(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, direction: str = "both") -> DataFrame:
    """(id, depth) of every node within ``max_depth`` steps of ``roots`` (id)."""
    walk = cut(steps(edges, direction), "steps")
    levels = Levels(edges.sparkSession, "reach")
    newest = levels.add(roots.select("id").distinct())
    while (max_depth is None or levels.count <= max_depth) and not newest.isEmpty():
        # Used twice within the round and rebuilt from files if an executor is lost.
        arrived = newest.select(F.col("id").alias("src")).join(walk, "src").select(F.col("dst").alias("id")).distinct().persist()
        # Known nodes are first cut down to those just reached, so late, small rounds shuffle little.
        known = levels.all().select("id").join(arrived, "id", "left_semi")
        newest = levels.add(arrived.join(known, "id", "left_anti"))
        arrived.unpersist()
    return levels.all().select("id", F.col("level").alias("depth"))


def induced(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the set and edges with both ends in it."""
    kept = ids.select("id")
    inner = edges.join(kept.withColumnRenamed("id", "source"), "source", "left_semi").join(
        kept.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes.join(kept, "id", "left_semi"), inner


def filter_types(nodes: DataFrame, edges: DataFrame, types: list[str] | None, prune: bool) -> tuple[DataFrame, DataFrame]:
    kept = edges if not types else edges.where(F.col("dep_type").isin(types))
    if not prune:
        return nodes, kept
    touched = kept.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes.join(touched, "id", "left_semi"), kept


def root_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("id").join(edges.select(F.col("target").alias("id")), "id", "left_anti")


def leaf_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("id").join(edges.select(F.col("source").alias("id")), "id", "left_anti")


def max_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Largest shortest distance from any root; one row.

    All roots are walked together.  Roots are numbered and packed 64 to a block; a row (node, block,
    bits) says which roots of the block reach the node at this level, so it stands for up to 64
    (root, node) pairs.  A round is one join with the steps and one ``bit_or``; earlier levels are
    only read where the new rows ask for them.

    Leaves are not walked to: they are one step behind the rest, so they only count behind the last level, where a leaf
    that no earlier level leads to adds one.
    """
    spark = edges.sparkSession
    walk = cut(steps(edges), "steps")
    going_on = walk.select(F.col("src").alias("dst")).distinct()
    inner = cut(walk.join(going_on, "dst", "left_semi").select("src", "dst"), "inner")
    # Roots with the same first target share a block; the numbers are fixed by writing them.
    first = walk.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("first"))
    ordered = root_nodes(nodes, edges).join(first, "id").repartitionByRange("first", "id").sortWithinPartitions("first", "id")
    numbered = cut(ordered.select("id", F.monotonically_increasing_id().alias("n")), "roots")
    levels = Levels(spark, "depth")
    last = newest = levels.add(numbered.select(
        "id", F.shiftright("n", 6).alias("block"), F.expr("shiftleft(1L, cast(n % 64 as int))").alias("bits")))
    while not newest.isEmpty():
        last = newest
        arrived = _arrive(newest, inner).persist()
        seen = levels.all().drop("level").join(arrived.select("id", "block"), ["id", "block"], "left_semi")
        newest = levels.add(_unseen(arrived, seen))
        arrived.unpersist()
    # The last level is empty; with no roots the first one is.
    deepest = levels.count - 2
    if deepest < 0:
        return spark.createDataFrame([(0,)], "max_depth int")
    leaving = walk.join(going_on, "dst", "left_anti")
    came = cut(_arrive(last, leaving), "leaves")
    before = leaving.join(came.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    earlier = levels.all().where(F.col("level") < deepest).drop("level").join(came.select("block").distinct(), "block", "left_semi")
    seen = _arrive(earlier, before).withColumnRenamed("came", "bits").join(came.select("id", "block"), ["id", "block"], "left_semi")
    return spark.createDataFrame([(deepest + (not _unseen(came, seen).isEmpty()),)], "max_depth int")


def _arrive(rows: DataFrame, walk: DataFrame) -> DataFrame:
    """(id, block, came): where the bits of (id, block, bits) get to by one step."""
    return (rows.select(F.col("id").alias("src"), "block", "bits").join(walk, "src")
            .groupBy(F.col("dst").alias("id"), "block").agg(F.bit_or("bits").alias("came")))


def _unseen(arrived: DataFrame, seen: DataFrame) -> DataFrame:
    """(id, block, bits): the bits of ``arrived`` (id, block, came) that ``seen`` (id, block, bits) does not have."""
    both = arrived.withColumn("bits", F.lit(0).cast("long")).unionByName(seen.withColumn("came", F.lit(0).cast("long")))
    return both.groupBy("id", "block").agg(F.expr("bit_or(came) & ~bit_or(bits)").alias("bits")).where("bits != 0")


def cyclic_core(walk: DataFrame) -> DataFrame:
    """The steps (src, dst) left when nodes without a way in or out have been trimmed to the end."""
    core = cut(walk, "core")
    size = core.count()
    while size:
        ins = core.select(F.col("dst").alias("src")).distinct()
        outs = core.select(F.col("src").alias("dst")).distinct()
        core = cut(core.join(ins, "src", "left_semi").join(outs, "dst", "left_semi"), "core")
        smaller = core.count()
        if smaller == size:
            break
        size = smaller
    return core


def _spread(steps_: DataFrame, start: DataFrame) -> DataFrame:
    """(node, color): the smallest color of ``start`` (node, color) that reaches each node along the steps."""
    colors = cut(start, "colors")
    while True:
        came = (steps_.join(colors.withColumnRenamed("node", "src"), "src")
                .groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("came")))
        joined = cut(colors.join(came, "node", "full").select(
            "node", F.least("color", "came").alias("color"),
            (F.col("color").isNull() | (F.col("came") < F.col("color"))).alias("changed")), "colors")
        colors = joined.select("node", "color")
        if joined.where("changed").isEmpty():
            return colors


def cyclic_components(edges: DataFrame) -> DataFrame:
    """(id, component): every node on a directed cycle of any length, with its strongly connected component.

    Rounds of colors: each node takes the smallest id that reaches it; the nodes of a color that lead back to
    the color's own node are one component.  They go, steps between colors go, and the rest is colored anew.
    """
    rest, found = cyclic_core(steps(edges)), []
    while not rest.isEmpty():
        nodes = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
        colors = cut(_spread(rest, nodes.withColumn("color", F.col("node"))), "colors")
        both = (rest.join(colors.select(F.col("node").alias("src"), "color"), "src")
                .join(colors.select(F.col("node").alias("dst"), F.col("color").alias("other")), "dst").where("color = other"))
        inside = cut(both.select("src", "dst", "color"), "inside")
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        own = colors.where("node = color")
        component = cut(_spread(back, own).select(F.col("node").alias("id"), F.col("color").alias("component")), "component")
        looped = inside.where("src = dst").select(F.col("src").alias("id"))
        several = component.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
        found.append(cut(component.join(several, "component", "left_semi").select("id", "component").unionByName(
            component.join(looped, "id", "left_semi").select("id", "component")).distinct(), "cyclic"))
        done = component.select("id")
        rest = cyclic_core(inside.select("src", "dst").join(done.withColumnRenamed("id", "src"), "src", "left_anti")
                           .join(done.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    if not found:
        return edges.select(F.col("source").alias("id"), F.col("source").alias("component")).limit(0)
    return reduce(DataFrame.unionByName, found)


def cycles(edges: DataFrame, max_length: int, within: DataFrame | None = None) -> DataFrame:
    """Simple directed cycles up to ``max_length``, smallest id first: (cycle, length, has_longer).

    Only steps inside a strongly connected component are walked.  ``has_longer`` says whether a path of a component was
    still open at that length, so longer cycles may exist; ``cyclic_components`` has the nodes on cycles of any length and can be
    given as ``within`` where it is known.
    """
    within = cyclic_components(edges) if within is None else within
    walk = cut(steps(edges).join(within.select(F.col("id").alias("src"), "component"), "src")
               .join(within.select(F.col("id").alias("dst"), F.col("component").alias("other")), "dst")
               .where("component = other").select("src", "dst"), "walk")
    paths = walk.where("src <= dst").select(
        F.col("src").alias("start"), F.array("src").alias("path"), F.col("dst").alias("next"))
    found = []
    for length in range(1, max_length + 1):
        paths = cut(paths, "paths")
        if paths.isEmpty():
            break
        found.append(paths.where("next = start").select(
            F.array_join("path", ">").alias("cycle"), F.lit(length).alias("length")))
        grown = paths.where("next != start").withColumn("path", F.concat("path", F.array("next")))
        paths = (
            grown.select("start", "path", F.col("next").alias("src")).join(walk, "src")
            .where((F.col("dst") >= F.col("start")) & ((F.col("dst") == F.col("start")) | ~F.array_contains("path", F.col("dst"))))
            .select("start", "path", F.col("dst").alias("next")))
    if not found:
        return edges.sparkSession.createDataFrame([], "cycle string, length int, has_longer boolean")
    return reduce(DataFrame.unionByName, found).withColumn("has_longer", F.lit(not paths.isEmpty()))


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle of any length."""
    return cyclic_components(edges).select("id")


def call_chain(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Edges downstream and, separately, upstream of the roots: (direction, edge columns)."""
    out = []
    for label, direction in (("downstream", "out"), ("upstream", "in")):
        ids = cut(reach(edges, roots, max_depth, direction).select("id"), "chain")
        out.append(edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
            ids.withColumnRenamed("id", "target"), "target", "left_semi").withColumn("direction", F.lit(label)))
    return out[0].unionByName(out[1])


def call_tree(edges: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """Calls expanded from the roots: (path, depth, node, is_circular, is_truncated); a repeated node is not expanded.

    ``is_truncated`` marks the rows at the last level whose calls are not shown.  There is a row for each path, which can be very
    many; ``call_tree_counts`` has them by number.
    """
    walk = cut(steps(edges.where(F.col("dep_type") == "calls")), "steps")
    level = roots.select(F.array("id").alias("path"), F.lit(0).alias("depth"), F.col("id").alias("node"),
                         F.lit(False).alias("is_circular"))
    levels = [cut(level, "tree")]
    for d in range(1, depth + 1):
        open_rows = levels[-1].where(~F.col("is_circular")).select("path", F.col("node").alias("src"))
        level = open_rows.join(walk, "src").select(
            F.concat("path", F.array("dst")).alias("path"), F.lit(d).alias("depth"), F.col("dst").alias("node"),
            F.array_contains("path", F.col("dst")).alias("is_circular"))
        levels.append(cut(level, "tree"))
        if levels[-1].isEmpty():
            break
    calls = walk.select(F.col("src").alias("node")).distinct().withColumn("more", F.lit(True))
    last = (F.col("depth") == depth) & ~F.col("is_circular") & F.col("more").isNotNull()
    rows = reduce(DataFrame.unionByName, levels).join(calls, "node", "left")
    return rows.select("path", "depth", "node", "is_circular", last.alias("is_truncated"))


def call_tree_counts(edges: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """The tree of calls with shared subtrees once: (node, depth, paths, is_truncated).

    ``paths`` counts the call sequences of that length from a root to the node, as a decimal; where calls are circular a sequence may
    come by a node again, so only ``depth`` ends it.  A level has a row for each node, however many paths lead to it.
    """
    walk = cut(steps(edges.where(F.col("dep_type") == "calls")), "steps")
    whole = "decimal(38,0)"
    levels = [cut(roots.groupBy(F.col("id").alias("node")).agg(F.lit(1).cast(whole).alias("paths")), "counts")]
    for _ in range(depth):
        level = (levels[-1].withColumnRenamed("node", "src").join(walk, "src").groupBy(F.col("dst").alias("node"))
                 .agg(F.sum("paths").cast(whole).alias("paths")))
        levels.append(cut(level, "counts"))
        if levels[-1].isEmpty():
            break
    calls = walk.select(F.col("src").alias("node")).distinct().withColumn("more", F.lit(True))
    rows = reduce(DataFrame.unionByName, [df.withColumn("depth", F.lit(d)) for d, df in enumerate(levels)]).join(calls, "node", "left")
    return rows.select("node", "depth", "paths", ((F.col("depth") == depth) & F.col("more").isNotNull()).alias("is_truncated"))


def summary(nodes: DataFrame, edges: DataFrame, within: DataFrame | None = None, deepest: DataFrame | None = None) -> DataFrame:
    """Node, edge, root, leaf and cyclic component counts and the maximum depth, as one row.

    ``within`` and ``deepest`` are the results of ``cyclic_components`` and ``max_depth`` where they are known.
    """
    within = cyclic_components(edges) if within is None else within
    one = lambda df, label: df.agg(F.count(F.lit(1)).alias(label))
    parts = [one(nodes, "nodes"), one(edges, "edges"), one(root_nodes(nodes, edges), "roots"), one(leaf_nodes(nodes, edges), "leaves"),
             one(within.select("component").distinct(), "cyclic_components"), max_depth(nodes, edges) if deepest is None else deepest]
    return side_by_side(*parts)
