"""Grouping vectors into similarity clusters: bisecting k-means on directions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.vectors import matrix, usable
from corpusweave.runtime import Staging

#: Sums of more partitions than WIDE are added up in two steps, sums of no more than DIRECT bytes on the driver.
WIDE, DIRECT = 128, 16_000_000
#: Vectors of a node up to which one task bisects it to the end; larger nodes are split by passes over the cluster.
NODE_ROWS = 20_000


@dataclass
class Tree:
    """splits[p] = (left node, right node, left centre, right centre), parents before children."""

    splits: dict[int, tuple[int, int, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def assign(self, x: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
        node = np.zeros(len(x), np.int64) if node is None else node.copy()
        for p, (left, right, a, b) in self.splits.items():
            at = np.flatnonzero(node == p)
            if len(at):
                node[at] = np.where(x[at] @ (a - b) >= 0, left, right)
        return node


@dataclass(frozen=True)
class Limits:
    """When a node is split: its mean cosine to its centre is below `compact`, it has twice `least` vectors, and one
    direction of its spread stands out from what a shapeless cloud of its size shows. `lloyd` passes mend a split."""

    compact: float = 0.66
    least: int = 8
    lloyd: int = 2

    def halves(self, n: float, s: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """First centres of both halves, on both sides of the mean along the widest direction; none for a leaf."""
        dim, mean = len(s), s / n
        if n < 2 * self.least or np.linalg.norm(mean) >= self.compact:
            return None
        values, vectors = np.linalg.eigh(m / n - np.outer(mean, mean))
        cloud = max(values.sum(), 1e-12) / dim * (1 + np.sqrt(dim / n)) ** 2
        if values[-1] <= 1.15 * cloud:
            return None
        step = np.sqrt(values[-1]) * vectors[:, -1]
        return _unit(mean + step), _unit(mean - step)


def bisect_here(x: np.ndarray, limits: Limits) -> list[tuple[int, np.ndarray]]:
    """(size, sum) of the leaves of the vectors x, by the same rule as over the cluster."""
    todo, leaves = [x], []
    while todo:
        x = todo.pop()
        n, s = len(x), x.sum(0)
        two = limits.halves(n, s, x.T @ x)
        if two is not None:
            side = x @ (two[0] - two[1]) >= 0
            for _ in range(limits.lloyd):
                if side.all() or not side.any():
                    break
                side = x @ (_unit(x[side].sum(0)) - _unit(x[~side].sum(0))) >= 0
            if side.any() and not side.all():
                todo += [x[side], x[~side]]
                continue
        leaves.append((n, s))
    return leaves


def _summed(rows: DataFrame, run: Callable, nodes: int, width: int) -> dict[int, np.ndarray]:
    """Sums of the arrays that `run` gives per node and partition (node, data); `width` numbers are expected a node."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(d) for d in pdf["data"])
        return pd.DataFrame({"node": [pdf["node"].iloc[0]], "data": [total.tobytes()]})

    partial, parts = rows.mapInArrow(run, "node long, data binary"), rows.rdd.getNumPartitions()
    if 8 * parts * nodes * width > DIRECT:
        if parts > WIDE:
            partial = partial.withColumn("slice", F.spark_partition_id() % WIDE).groupBy("node", "slice").applyInPandas(add, "node long, data binary")
        partial = partial.groupBy("node").applyInPandas(add, "node long, data binary")
    out: dict[int, np.ndarray] = {}
    for r in partial.collect():
        out[r.node] = out[r.node] + np.frombuffer(r.data) if r.node in out else np.frombuffer(r.data)
    return out


def _per_node(dim: int, assign: Callable[[np.ndarray, np.ndarray], np.ndarray], nodes: frozenset[int], what: Callable[[np.ndarray, int], np.ndarray]) -> Callable:
    """A pass over rows (v, node): the sum of `what` of each node's vectors, a row for each of the nodes met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            node = assign(x, batch.column("node").to_numpy(zero_copy_only=False))
            for p in nodes.intersection(node.tolist()):
                got = what(x[node == p], p)
                total[p] = total[p] + got if p in total else got
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["node", "data"])

    return run


def moments(x: np.ndarray, _: int = 0) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])


def second_moment(points: DataFrame, dim: int) -> np.ndarray:
    """Mean outer product of all unit vectors of points (id, v)."""
    got = _summed(points.select("v", F.lit(0).cast("long").alias("node")), _per_node(dim, lambda x, node: node, frozenset({0}), moments), 1, 1 + dim + dim * dim)
    return got[0][dim + 1 :].reshape(dim, dim) / got[0][0] if got else np.zeros((dim, dim))


def _near(points: DataFrame, dim: int, centres: np.ndarray, radius: float) -> dict[int, np.ndarray]:
    """Count and sum of the vectors nearest to each centre and within the radius of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            sim = x @ centres.T
            best = sim.argmax(1)
            inside = sim[np.arange(len(x)), best] >= radius
            for p in np.unique(best[inside]):
                y = x[inside & (best == p)]
                got = np.concatenate([[len(y)], y.sum(0)])
                total[int(p)] = total[int(p)] + got if int(p) in total else got
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["node", "data"])

    return _summed(points, run, len(centres), 1 + dim)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x)
    return x / n if n else x


@dataclass
class Clusters:
    """Mean directions of the clusters, and (size, sum) of the leaves of the trees they come from."""

    centres: np.ndarray
    leaves: list[tuple[int, np.ndarray]]


def fit(points: DataFrame, dim: int, radius: float = 0.55, limits: Limits = Limits(), merge: float = 0.75) -> Clusters:
    """Clusters of points (id, v) from the leaves of bisecting k-means.

    Every node that is not compact is split (see Limits), those of the largest dispersion first where one goes before
    another: nodes are independent, so the order and the number split at once change nothing. A cluster cut in two by an
    early split has leaves of nearly equal direction: leaves whose centres have a cosine of `merge` are joined, then
    centres are moved to the mean of the vectors within `radius`. Clusters of fewer than limits.least vectors within the
    radius are noise. A compact leaf may still hide a small cluster beside a large one: the vectors outside the radius
    of all centres are written and bisected again, until that finds no further centre. Only sums per node and leaf reach
    the driver.
    """
    staging = Staging(points.sparkSession)
    centres, leaves, rows = np.zeros((0, dim)), [], points
    while True:
        fresh = bisect(rows, dim, limits)
        leaves += fresh
        found = _joined(fresh, dim, merge)
        after = _refined(points, dim, np.concatenate([centres, found]), radius, limits.least, merge) if len(found) else centres
        if len(after) <= len(centres):
            return Clusters(after if len(after) else centres, leaves)
        centres = after
        rows = staging.write(_outside(points, dim, centres, radius), "outside")


def _outside(points: DataFrame, dim: int, centres: np.ndarray, radius: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            yield batch.filter(pa.array((x @ centres.T).max(1, initial=-1) < radius))

    return points.mapInArrow(run, points.schema)


def bisect(points: DataFrame, dim: int, limits: Limits) -> list[tuple[int, np.ndarray]]:
    """(size, sum) of the leaves of points (id, v).

    While a node has more than NODE_ROWS vectors, all such nodes are split at once: a pass for their moments and
    limits.lloyd passes for their halves, over the vectors of such nodes only, which are written anew whenever they have
    become half as many. Smaller nodes are then bisected to the end by one task each.
    """
    staging = Staging(points.sparkSession)
    zero = F.lit(0).cast("long")
    rows, tree, open_nodes, written = points.select("v", zero.alias("node")), Tree(), [0], None
    ready: list[DataFrame] = []  # vectors of nodes small enough for a task
    leaves: list[tuple[int, np.ndarray]] = []
    next_id = 1
    while open_nodes:
        large = frozenset(open_nodes)
        now = lambda x, node, tree=tree: tree.assign(x, node)
        found = _summed(rows, _per_node(dim, now, large, moments), len(large), 1 + dim + dim * dim)
        trial: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        small: set[int] = set()
        for p in sorted(found, key=lambda p: np.linalg.norm(found[p][1 : dim + 1]) - found[p][0]):
            n, s = found[p][0], found[p][1 : dim + 1]
            two = limits.halves(n, s, found[p][dim + 1 :].reshape(dim, dim))
            if two is None:
                leaves.append((int(n), s))
            elif n <= NODE_ROWS:
                small.add(p)
            else:
                trial[p] = two
        for _ in range(limits.lloyd):
            def sides(x: np.ndarray, p: int, trial=trial) -> np.ndarray:
                side = x @ (trial[p][0] - trial[p][1]) >= 0
                return np.concatenate([[side.sum(), (~side).sum()], x[side].sum(0), x[~side].sum(0)])

            if trial:
                got = _summed(rows, _per_node(dim, now, frozenset(trial), sides), len(trial), 2 + 2 * dim)
                for p, d in got.items():
                    if d[0] and d[1]:
                        trial[p] = (_unit(d[2 : dim + 2]), _unit(d[dim + 2 :]))
                    else:  # nothing parts its vectors
                        leaves.append((int(found[p][0]), found[p][1 : dim + 1]))
                        del trial[p]
        if small:
            ready.append(_of_nodes(rows, dim, tree, frozenset(small)))
        tree = Tree(dict(tree.splits))
        open_nodes = []
        for p, (a, b) in trial.items():
            tree.splits[p] = (next_id, next_id + 1, a, b)
            open_nodes += [next_id, next_id + 1]
            next_id += 2
        still = sum(found[p][0] for p in trial)
        before = 2 * sum(d[0] for d in found.values()) if written is None else written
        if open_nodes and still <= before / 2:
            if small:  # their rows are in the table that is about to be left
                ready[-1] = staging.write(ready[-1], "small_nodes")
            rows, tree, written = staging.write(_of_nodes(rows, dim, tree, frozenset(open_nodes)), "open_nodes"), Tree(), still

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        got = bisect_here(np.array(pdf["v"].tolist(), np.float64).reshape(-1, dim), limits)
        return pd.DataFrame({"n": [n for n, _ in got], "s": [s.tobytes() for _, s in got]})

    if ready:
        every = ready[0]
        for r in ready[1:]:
            every = every.unionByName(r)
        leaves += [(r.n, np.frombuffer(r.s)) for r in every.groupBy("node").applyInPandas(finish, "n long, s binary").collect()]
    return leaves


def _of_nodes(rows: DataFrame, dim: int, tree: Tree, nodes: frozenset[int]) -> DataFrame:
    """(v, node): unit vectors of the nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.array(sorted(nodes))
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            node = tree.assign(x, batch.column("node").to_numpy(zero_copy_only=False))
            keep = np.isin(node, wanted)
            flat = pa.array(x[keep].astype(np.float32).ravel())
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([v, pa.array(node[keep])], ["v", "node"])

    return rows.select("v", "node").mapInArrow(run, "v array<float>, node long")


def _joined(leaves: list[tuple[int, np.ndarray]], dim: int, merge: float) -> np.ndarray:
    """Directions of the leaves, those of nearly one direction together, the most distinct leaf first."""
    sums: list[np.ndarray] = []
    for _, s in sorted(leaves, key=lambda leaf: -np.linalg.norm(leaf[1])):
        like = [k for k, t in enumerate(sums) if _unit(s) @ _unit(t) >= merge]
        if like:
            sums[like[0]] = sums[like[0]] + s
        else:
            sums.append(s.copy())
    return np.array([_unit(s) for s in sums]).reshape(-1, dim)


def leaf_table(points: DataFrame, found: Clusters, radius: float = 0.55) -> DataFrame:
    """(leaf_id, size, cohesion, cluster_id): the leaves of the trees, the largest first, and the cluster that each one's
    direction lies in; -1 where that is none."""
    rows = []
    for k, (n, s) in enumerate(sorted(found.leaves, key=lambda leaf: (-leaf[0], leaf[1].tolist()))):
        sim = found.centres @ _unit(s) if len(found.centres) else np.zeros(0)
        rows.append((k, int(n), float(np.linalg.norm(s) / n), int(sim.argmax()) if len(sim) and sim.max() >= radius else -1))
    return points.sparkSession.createDataFrame(rows, "leaf_id int, size long, cohesion double, cluster_id int")


def _refined(points: DataFrame, dim: int, centres: np.ndarray, radius: float, least: int, merge: float) -> np.ndarray:
    """Centres moved to the mean of the vectors within their radius; those with too few or like a larger one go."""
    for _ in range(3):
        if not len(centres):
            break
        near = _near(points, dim, centres, radius)
        kept: list[np.ndarray] = []
        for k in sorted(near, key=lambda k: -near[k][0]):
            c = _unit(near[k][1:])
            if near[k][0] >= least and all(c @ o < merge for o in kept):
                kept.append(c)
        centres = np.array(kept).reshape(-1, dim)
    return centres


def members(points: DataFrame, dim: int, centres: np.ndarray, radius: float) -> DataFrame:
    """(id, cluster_id, cosine): the nearest cluster of each vector; -1 where none is within the radius."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            if len(centres):
                sim = x @ centres.T
                best = sim.argmax(1)
                cos = sim[np.arange(len(x)), best]
            else:
                best, cos = np.full(len(x), -1), np.full(len(x), -1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.where(cos >= radius, best, -1).astype(np.int32)), pa.array(cos)], ["id", "cluster_id", "cosine"]
            )

    return points.mapInArrow(run, "id long, cluster_id int, cosine double")


def cluster_vectors(bundle: DataFrame, dim: int = 64, radius: float = 0.55) -> DataFrame:
    """(vec_id, stored_label, cluster_id, cosine) of the usable vectors of bundle (vec_id, embeddings, labels).

    Null, all-zero and otherwise dimensioned vectors are left out; repeated vectors count as often as they occur. An
    empty table gives an empty result. The unit vectors are written once and read by each pass.
    """
    points = Staging(bundle.sparkSession).write(usable(bundle, "vec_id", "embeddings", dim), "points")
    got = members(points, dim, fit(points, dim, radius).centres, radius)
    labels = bundle.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("labels").alias("stored_label"))
    return labels.join(got.withColumnRenamed("id", "vec_id"), "vec_id")


def cluster_labels(found: DataFrame) -> DataFrame:
    """(cluster_id, label): the label that most members bear, null and -1 aside; of equally frequent ones the least."""
    votes = found.where("cluster_id >= 0 and stored_label >= 0").groupBy("cluster_id", "stored_label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("cluster_id").agg(F.max(F.struct("n", (-F.col("stored_label")).alias("neg"))).alias("b")).select(
        "cluster_id", (-F.col("b.neg")).cast("int").alias("label")
    )


def mislabelled(found: DataFrame) -> DataFrame:
    """(vec_id, label): members whose stored label is null or not their cluster's label."""
    got = found.where("cluster_id >= 0").join(F.broadcast(cluster_labels(found)), "cluster_id")
    return got.where("not (stored_label <=> label)").select("vec_id", "label")


def describe(found: DataFrame, typical: int = 5) -> DataFrame:
    """(cluster_id, label, size, mean_cosine, typical_members): centre-nearest members first, ties by the lesser id.

    The nearest are ranked within hashed parts of a cluster first, so that no task ranks a whole large cluster."""
    inside = found.where("cluster_id >= 0")
    sizes = inside.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.avg("cosine").alias("mean_cosine"))
    order = [F.desc("cosine"), "vec_id"]
    part = Window.partitionBy("cluster_id", "part").orderBy(*order)
    first = inside.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("r", F.row_number().over(part)).where(F.col("r") <= typical)
    top = first.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))).where(F.col("r") <= typical)
    best = top.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id"))).alias("t"))
    best = best.select("cluster_id", F.transform("t", lambda x: x["vec_id"]).alias("typical_members"))
    return sizes.join(best, "cluster_id").join(cluster_labels(found), "cluster_id", "left").select("cluster_id", "label", "size", "mean_cosine", "typical_members")
