"""Sparse neighbourhoods next to active areas, and queries on the 2-d map."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.operators.clusters import k_distances, reduce_dims
from corpusweave.operators.ranks import first_of_groups, quantile
from corpusweave.operators.retrieval import knn
from corpusweave.runtime import Staging


def radius_pairs(points: DataFrame, radius: float) -> DataFrame:
    """(id, other, d): pairs of points (id, x, y) within the radius, self excluded.

    A grid of cells of the radius's size makes it an equi-join: a point meets the points of its own and the eight
    neighbouring cells, and the exact distance decides."""
    cell = lambda c: F.floor(F.col(c) / radius)
    a = points.select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    b = points.select(F.col("id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"), cell("x").alias("bx"), cell("y").alias("by"), F.explode(near).alias("s"))
    b = b.select("other", "x2", "y2", (F.col("bx") + F.col("s.i")).alias("cx"), (F.col("by") + F.col("s.j")).alias("cy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2))
    return a.join(b, ["cx", "cy"]).where("id <> other").withColumn("d", d).where(F.col("d") <= radius).select("id", "other", "d")


def density(points: DataFrame, radius: float) -> DataFrame:
    """(id, density): other points within the radius."""
    n = radius_pairs(points, radius).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return points.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("density"))


def map_radius(points: DataFrame, k: int = 10) -> float:
    """Median distance on the map to the k-th nearest of a sample spread over the map, a fraction of the map's span."""
    span = points.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count(F.lit(1))).first()
    area = max(span[0] or 0.0, 1e-9) * max(span[1] or 0.0, 1e-9)
    r = float(np.sqrt(area * (k + 1) / max(1, span[2]) / np.pi))
    staging = Staging(points.sparkSession)
    for _ in range(8):
        d = staging.write(density(points, r), "density")  # a quantile reads its rows several times
        got = quantile(d, "density", 0.5) or 0
        staging.drop(d)
        if k * 0.8 <= got <= k * 1.25:
            break
        r *= float(np.sqrt(k / max(got, 0.5)))
    return r


def low_density(points: DataFrame, percentile: float, radius: float | None = None) -> DataFrame:
    """(id, density) of points whose density is at most the percentile of all."""
    d = density(points, radius or map_radius(points))
    d = Staging(points.sparkSession).write(d, "density")
    edge = quantile(d, "density", percentile / 100)
    return d.where(F.col("density") <= F.lit(edge)).select("id", "density")


def sparse_leads(points: DataFrame, dim: int, percentile: float = 20, k: int = 10, seeds: tuple[int, ...] = (1, 2), robust: float = 0.6, most: int = 12) -> list[dict]:
    """Leads of points (id, v, cluster_id): sparse on the map beside a cluster, sparse in full dimension too, and still
    so under other projections; at most `most`, apart by two radii, the sparsest first. What reaches the driver are the
    surviving anchors alone."""
    def mapped(p: DataFrame) -> DataFrame:
        return reduce_dims(p, 2).select("id", "cluster_id", F.col("r")[0].alias("x"), F.col("r")[1].alias("y"))

    staging = Staging(points.sparkSession)
    flat = staging.write(mapped(points), "map")
    r = map_radius(flat)
    low = low_density(flat, percentile, r).select("id")
    clustered = flat.where("cluster_id >= 0").select(F.col("id").alias("other"))
    beside = radius_pairs(flat, 2 * r).join(clustered, "other", "left_semi").select("id").unionByName(clustered.select(F.col("other").alias("id"))).distinct()
    kd = k_distances(points.select("id", "v"), k, dim)
    kd = staging.write(kd, "k_distances")
    anchors = staging.write(low.join(beside, "id", "left_semi").join(kd.where(F.col("kd") >= F.lit(quantile(kd, "kd", 0.5))), "id"), "anchors")
    votes = anchors.select("id")
    for seed in seeds:
        part = points.withColumn("__keep", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10)) < 8)
        part = part.join(anchors.select("id", F.lit(True).alias("__anchor")), "id", "left").where("__keep or __anchor").drop("__keep", "__anchor")
        votes = votes.unionAll(low_density(staging.write(mapped(part), "map"), percentile).select("id").join(anchors.select("id"), "id", "left_semi"))
    share = votes.groupBy("id").agg((F.count(F.lit(1)) / (len(seeds) + 1)).alias("robustness")).where(F.col("robustness") >= robust)
    best = anchors.join(share, "id").join(flat, "id").orderBy(F.desc("kd"), "id").limit(50 * most)
    taken: list[dict] = []
    for row in best.collect():
        if all(np.hypot(row.x - t["x"], row.y - t["y"]) >= 2 * r for t in taken):
            taken.append({"id": row.id, "x": row.x, "y": row.y, "robustness": row.robustness, "sparsity": row.kd})
        if len(taken) == most:
            break
    if not taken:
        return []
    asks = points.where(F.col("id").isin([t["id"] for t in taken])).select("id", "v")
    near = knn(asks, points.select("id", "v"), k, True, dim).join(points.select(F.col("id").alias("neighbour_id"), "cluster_id"), "neighbour_id")
    w = Window.partitionBy("id").orderBy(F.desc("n"), "cluster_id")
    nearest = near.where("cluster_id >= 0").groupBy("id", "cluster_id").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(w)).where("r = 1")
    of = {r.id: r.cluster_id for r in nearest.collect()}
    evidence: dict[int, list] = {}
    for r in near.where("rank <= 6").orderBy("id", "rank").collect():
        evidence.setdefault(r.id, []).append((r.neighbour_id, r.cluster_id))
    return [t | {"nearest_cluster": of.get(t["id"]), "evidence": evidence.get(t["id"], [])} for t in taken]


def quota_sample(df: DataFrame, cap: int, group: str, order: str, key: str, forced: DataFrame | None = None) -> DataFrame:
    """About `cap` rows, each group by its share and at least one, the largest by `order` first; and, whatever the
    quotas, every row whose key is among `forced` (key), such as the matches of a search. No row comes twice."""
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    total = n.agg(F.sum("__n").alias("__all"))
    quota = n.crossJoin(F.broadcast(total)).select(F.col(group).alias("__g"), F.greatest(F.lit(1), F.round(F.lit(cap) * F.col("__n") / F.greatest(F.lit(cap), F.col("__all")))).cast("int").alias("__q"))
    known = df.join(quota, df[group].eqNullSafe(quota["__g"])).drop("__g")
    got = first_of_groups(known, [group], [F.desc_nulls_last(order), F.col(key)], F.col("__q"), key).drop("rank", "__q")
    if forced is None:
        return got
    more = df.join(forced.select(key).distinct(), key, "left_semi").join(got.select(key), key, "left_anti")
    return got.unionByName(more.select(*got.columns))


def area_bubbles(nodes: DataFrame) -> DataFrame:
    """(cluster_id, n, x, y) of nodes (id, cluster_id, x, y), noise left out."""
    return nodes.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
