"""Property graphs as node and edge tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """(node, kind, label, provenance) rows to one for each node, provenance united."""
    return nodes.groupBy("node").agg(F.min("kind").alias("kind"), F.min("label").alias("label"), F.array_sort(F.collect_set("provenance")).alias("provenance"))


def merged_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source", "relation", "target").agg(F.array_sort(F.collect_set("evidence")).alias("evidence"))


def counts_by_kind(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("element"), "kind", "n")
    return a.unionByName(edges.groupBy(F.col("relation").alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("element"), "kind", "n"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges one of whose ends is no node."""
    known = nodes.select("node").distinct()
    left = edges.join(known, edges["source"] == known["node"], "left_anti").withColumn("end", F.lit("source"))
    return left.unionByName(edges.join(known, edges["target"] == known["node"], "left_anti").withColumn("end", F.lit("target")))


def paths(edges: DataFrame, starts: DataFrame, hops: int = 2) -> DataFrame:
    """All paths of up to ``hops`` edges from the start nodes that visit no node twice: struct array, in order."""
    step = F.struct(F.col("source"), F.col("relation"), F.col("target"))
    found = starts.join(edges, starts["node"] == edges["source"]).select(starts["node"].alias("start"), F.col("target").alias("_at"), F.array("source", "target").alias("visited"), F.array(step).alias("path"))
    out = found
    for _ in range(hops - 1):
        e = edges.select(F.col("source").alias("_s"), F.col("relation").alias("_r"), F.col("target").alias("_t"))
        found = found.join(e, found["_at"] == e["_s"]).filter(~F.array_contains("visited", F.col("_t")))
        found = found.select("start", F.col("_t").alias("_at"), F.concat("visited", F.array("_t")).alias("visited"), F.concat("path", F.array(F.struct(F.col("_s").alias("source"), F.col("_r").alias("relation"), F.col("_t").alias("target")))).alias("path"))
        out = out.unionByName(found)
    return out.select("start", F.col("_at").alias("end"), F.size("path").alias("hops"), "path")


def advice(chunks: DataFrame, edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """For each document kind: what its verified rules lead to by two hops, collected by relation.

    ``chunks`` (chunk, verified), ``edges`` (source, relation, target): a chunk DEFINES rules, a rule APPLIES_TO kinds
    and points to templates, units and fields.
    """
    rules = chunks.filter("verified").join(edges.filter("relation = 'DEFINES'"), F.col("chunk") == F.col("source")).select(F.col("target").alias("rule")).distinct()
    fitting = rules.join(edges.filter("relation = 'APPLIES_TO'"), F.col("rule") == F.col("source")).select("rule", F.col("target").alias("kind")).join(kinds.select("kind"), "kind", "left_semi")
    rest = edges.filter("relation NOT IN ('DEFINES', 'APPLIES_TO')").select(F.col("source").alias("rule"), F.col("relation").alias("rel"), F.col("target").alias("to"))
    return fitting.join(rest, "rule").groupBy("kind", "rel").agg(F.array_sort(F.collect_set("to")).alias("targets"))


def guarded(candidates: str, allowed: str):
    """The candidates that the graph allows, or all if it allows none of them."""
    both = F.array_intersect(candidates, allowed)
    return F.when(F.size(both) > 0, both).otherwise(F.col(candidates))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two builds has; empty if they are the same."""
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))


def closure(tree: DataFrame, node: str = "node", parent: str = "parent", depth: int | None = None) -> DataFrame:
    """(node, ancestor, distance) of a tree of any depth, or up to ``depth``, by joining level on level.

    A cycle shows as a node that is its own ancestor; no walk enters a node twice. Each level is written to the shared
    folder, so that the next one does not compute it anew.
    """
    up = tree.filter(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("distance"))
    step = up.select(F.col("node").alias("_n"), F.col("ancestor").alias("_a"))
    folder, d = _levels_dir(tree.sparkSession), 1
    level = up.withColumn("_seen", F.array("ancestor"))
    while True:
        level.write.parquet(f"{folder}/{d}")
        level = tree.sparkSession.read.schema(level.schema).parquet(f"{folder}/{d}")
        if d == depth or level.isEmpty():
            break
        d += 1
        # A merge join: a broadcast would send the tree through the driver once for each level.
        level = level.filter("node <> ancestor").join(step.hint("merge"), F.col("ancestor") == F.col("_n")).filter(~F.array_contains("_seen", F.col("_a")))
        level = level.select("node", F.col("_a").alias("ancestor"), F.lit(d).alias("distance"), F.concat("_seen", F.array("_a")).alias("_seen"))
    return tree.sparkSession.read.schema(level.schema).parquet(*[f"{folder}/{k}" for k in range(1, d + 1)]).drop("_seen")


def _levels_dir(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``, or in local mode in a temporary one; it goes when the driver's process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillon-")
    folder = f"{root.rstrip('/')}/closure-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, folder)
    return folder


def _removed(spark: SparkSession, folder: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        return


def tree_faults(tree: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """Repeated nodes, unknown parents and cycles, each with a reason."""
    known = tree.select(F.col(node).alias("_k")).distinct()
    twice = tree.groupBy(node).count().filter("count > 1").select(F.col(node).alias("node"), F.lit("repeated").alias("fault"))
    orphan = tree.filter(F.col(parent).isNotNull()).join(known, F.col(parent) == F.col("_k"), "left_anti").select(F.col(node).alias("node"), F.lit("unknown_parent").alias("fault"))
    cycle = closure(tree, node, parent).filter("node = ancestor").select("node", F.lit("cycle").alias("fault")).distinct()
    return twice.unionByName(orphan).unionByName(cycle)
