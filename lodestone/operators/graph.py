"""Graphs as edge tables: components, closures and checks."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder; only a local master may leave that unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = _local_folder()
    return f"{root.rstrip('/')}/graph-{uuid.uuid4().hex}"


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lodestone-")


def written(df: DataFrame, path: str) -> DataFrame:
    """Writes and reads a table: the lineage ends there and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def evidence_edges(edges: DataFrame, weak_relations: tuple[str, ...] = ("same_file",)) -> DataFrame:
    """Edges that group: strong, exact, and of a relation that is evidence."""
    return edges.where((F.col("strength") == "strong") & (F.col("quality") == "exact") & ~F.col("relation_type").isin(*weak_relations))


def connected_components(vertices: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """(id, component): the smallest id of each vertex's component; ``vertices`` (id), ``edges`` (src, dst).

    Labels spread to neighbours and then jump to their own label's label, so the
    number of rounds is about the logarithm of the diameter.  Each round is a
    written table; only the number of changed labels reaches the driver.
    """
    spark = vertices.sparkSession
    folder = work_folder(spark)
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()
    both = written(both, f"{folder}/edges")
    labels = written(vertices.select("id", F.col("id").alias("component")).distinct(), f"{folder}/labels-0")
    for k in range(1, most + 1):
        around = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.min("component").alias("near"))
        spread = labels.join(around.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = spread.select(F.col("id").alias("component"), F.col("component").alias("far"))
        moved = spread.join(jump, "component", "left").select("id", "old", F.coalesce("far", "component").alias("component"))
        moved = written(moved, f"{folder}/labels-{k}")
        labels = moved.select("id", "component")
        if moved.where("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {most} rounds")


def descendants(roots: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """(root, id) of everything reachable from each root (itself included) over edges (parent, child); cycles end."""
    spark = roots.sparkSession
    folder = work_folder(spark)
    closure = written(roots.select(F.col("id").alias("root"), "id").distinct(), f"{folder}/0")
    frontier = closure
    for k in range(1, most + 1):
        step = frontier.join(edges.select(F.col("parent").alias("id"), "child"), "id").select("root", F.col("child").alias("id")).distinct()
        frontier = written(step.join(closure, ["root", "id"], "left_anti"), f"{folder}/new-{k}")
        if frontier.isEmpty():
            return closure
        closure = written(closure.unionByName(frontier), f"{folder}/{k}")
    raise RuntimeError(f"the closure still grows after {most} rounds")


def canonical_relations(edges: DataFrame, symmetric: tuple[str, ...]) -> DataFrame:
    """Symmetric relations with their smaller endpoint first."""
    flip = F.col("kind").isin(*symmetric) & (F.col("src") > F.col("dst"))
    return edges.select(F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("dst"), "kind")


def relation_problems(edges: DataFrame, nodes: DataFrame, symmetric: tuple[str, ...]) -> DataFrame:
    """(src, dst, kind, problem): unknown endpoints, self edges and repeated canonical edges."""
    e = canonical_relations(edges, symmetric)
    ids = nodes.select("id").distinct()
    dangling = e.join(ids, e["src"] == ids["id"], "left_anti").union(e.join(ids, e["dst"] == ids["id"], "left_anti")).distinct().withColumn("problem", F.lit("unknown_endpoint"))
    selfs = e.where("src = dst").distinct().withColumn("problem", F.lit("self_edge"))
    twice = e.groupBy("src", "dst", "kind").count().where("count > 1").drop("count").withColumn("problem", F.lit("repeated"))
    return dangling.unionByName(selfs).unionByName(twice)


def leaf_families(families: DataFrame) -> DataFrame:
    """Families (id, path) that hold no other family's path below theirs."""
    parents = families.select(F.explode(_ancestors("path")).alias("path")).distinct()
    return families.join(parents, "path", "left_anti")


def _ancestors(path: str):
    parts = F.split(path, "/")
    lengths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(lengths, lambda n: F.array_join(F.slice(parts, 1, n), "/"))
