"""Similarity graph: neighbour edges, bibliographic coupling, traversal and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.runtime import Staging


def undirected(neighbours: DataFrame) -> DataFrame:
    """(src, dst, weight), src < dst, from neighbour rows (id, neighbour_id, sim); the larger weight of both directions."""
    return neighbours.groupBy(F.least("id", "neighbour_id").alias("src"), F.greatest("id", "neighbour_id").alias("dst")).agg(F.max("sim").alias("weight"))


def coupling(edges: DataFrame, references: DataFrame, boost: float = 0.15, most: float = 0.5) -> DataFrame:
    """edges with `shared`, the references both ends have in common, and the weight raised by them up to `most`.

    references (id, ref) may repeat. The edges' reference lists are met on (dst, ref), so no end's list is collected.
    """
    refs = references.select("id", "ref").where("ref is not null").distinct()
    left = edges.select("src", "dst").join(refs.withColumnRenamed("id", "src"), "src")
    common = left.join(refs.select(F.col("id").alias("dst"), "ref"), ["dst", "ref"]).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared"))
    out = edges.join(common, ["src", "dst"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return out.withColumn("weight", F.col("weight") + F.least(F.lit(most), F.col("shared") * boost))


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))


def node_degree(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes within `depth` steps of the start nodes (node) and their least distance."""
    near = adjacency(edges)  # a repeated edge repeats a node, and each step tells its nodes apart
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    staging = Staging(edges.sparkSession)
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(near, frontier["node"] == near["a"]).select(F.col("b").alias("node")).distinct()
        frontier = staging.write(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least node reachable, by passing on the least label and following labels' labels."""
    staging = Staging(edges.sparkSession)
    near = staging.write(adjacency(edges).where("a <> b").distinct(), "adjacency")
    labels = staging.write(near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        passed = near.join(labels, near["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        took = labels.join(passed, labels["node"] == passed["a"]).select("node", F.least("component", "m").alias("c"), F.col("component").alias("was"))
        of = took.select(F.col("node").alias("n2"), F.col("c").alias("c2"))
        jumped = took.join(of, took["c"] == of["n2"], "left").select("node", F.least("c", F.coalesce("c2", "c")).alias("component"), "was")
        jumped = staging.write(jumped, "labels")
        changed = jumped.where("component <> was").isEmpty()
        staging.drop(labels)
        labels = jumped.select("node", "component")
        labels._staged_path = jumped._staged_path
        if changed:
            return labels


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are among nodes (node)."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def area_edges(edges: DataFrame, clusters: DataFrame, weight: Column | None = None) -> DataFrame:
    """(a, b, weight): summed weight between clusters (id, cluster_id), noise and inner edges left out."""
    w = F.col("weight") if weight is None else weight
    a = clusters.select(F.col("id").alias("src"), F.col("cluster_id").alias("ca"))
    b = clusters.select(F.col("id").alias("dst"), F.col("cluster_id").alias("cb"))
    both = edges.join(a, "src").join(b, "dst").where("ca <> cb and ca >= 0 and cb >= 0")
    return both.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum(w).alias("weight"), F.count(F.lit(1)).alias("n_edges"))
