"""Exact neighbours of a table with itself, block against block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.operators import clusters, graph, leads, neighbours, ranks
from corpusweave.operators.neighbours import all_nearest
from corpusweave.plans import catalogue
from corpusweave.runtime import Staging

GRAPH = ["coupling_edges", "graph_bfs", "area_edges", "node_degree", "induced_edges"]


def brute(v: np.ndarray, ids: np.ndarray, k: int) -> set:
    x = v.astype(np.float32).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    out = set()
    for i in range(len(ids)):
        s = np.round(x @ x[i], 9)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out |= {(int(ids[i]), int(ids[j]), r + 1) for r, j in enumerate(order)}
    return out


@pytest.mark.parametrize("block", [40, 100, 1000])
def test_all_nearest_equals_brute_force_across_blocks(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 8))
    v = np.concatenate([centres[rng.integers(0, 4, 260)] + 0.4 * rng.normal(size=(260, 8)), rng.normal(size=(40, 8))])
    v[250:260] = v[7]  # repeated vectors: ties go to the least ids
    v[299] = 0
    ids = rng.permutation(3000)[:300]
    points = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "id long, v array<float>")
    got = {(r.id, r.neighbour_id, r["rank"]) for r in all_nearest(points, 6, 8, block).collect()}
    assert got == brute(v, ids, 6)


def test_groups_far_apart_are_not_multiplied(monkeypatch):
    """Of two blocks only what may reach a bound is multiplied, and nothing that reaches it is missed."""
    rng = np.random.default_rng(4)
    centres = np.linalg.qr(rng.normal(size=(64, 64)))[0][:6]
    blocks = []
    for own in ((0, 1, 2, 3), (3, 4, 5, 0)):
        cell = np.repeat(own, 300)
        v = centres[cell] + 0.09 * rng.normal(size=(1200, 64))
        v[::20] = rng.normal(size=(60, 64))
        v[7] = 0
        x = neighbours._unit(v)
        ids, groups = 2 * rng.permutation(10_000)[:1200] + len(blocks), neighbours._groups(x, cell)
        _, _, sim = neighbours._within(ids, x, 6)
        least = sim.reshape(-1, 6)[:, 5]
        by = np.lexsort((-least, groups))
        blocks.append((ids[by], x[by], least[by], groups[by]))
    multiplied, products = [], neighbours._products
    monkeypatch.setattr(neighbours, "_products", lambda x, y, *more: multiplied.append(len(x) * len(y)) or products(x, y, *more))
    row, other, sim = neighbours._between(*([b[c] for b in blocks] for c in range(4)), 6)
    want = set()
    for (ids, x, least, _), (ids2, y, _, _) in (blocks, blocks[::-1]):
        s = x @ y.T
        for i in range(len(ids)):
            order = np.lexsort((ids2, -np.round(s[i], 9)))[:6]
            want |= {(int(ids[i]), int(ids2[j])) for j in order if s[i, j] >= least[i] - neighbours.ROUNDING}
    assert set(zip(row.tolist(), other.tolist())) == want and len(want) > 300
    assert sum(multiplied) < 0.5 * 1200 * 1200


def test_a_block_by_itself_multiplies_what_may_reach_a_bound(monkeypatch):
    """Groups of a block that are far apart are not multiplied with one another, and its exact neighbours stay the same."""
    rng = np.random.default_rng(7)
    cell = np.repeat(np.arange(8), 200)
    v = np.linalg.qr(rng.normal(size=(64, 64)))[0][:8][cell] + 0.05 * rng.normal(size=(1600, 64))
    v[::40] = rng.normal(size=(40, 64))
    v[9], v[11] = 0, v[10]
    x, ids = neighbours._unit(v), rng.permutation(10_000)[:1600]
    multiplied, products = [], neighbours._products
    monkeypatch.setattr(neighbours, "_products", lambda x, y, *more: multiplied.append(len(x) * len(y)) or products(x, y, *more))
    row, col, _ = neighbours._within(ids, x, 6, neighbours._groups(x, cell))
    assert (np.diff(row) >= 0).all()
    s, want = np.round(x @ x.T, 9), set()
    for i in range(1600):
        want |= {(i, int(j)) for j in [j for j in np.lexsort((ids, -s[i])) if j != i][:6]}
    assert set(zip(row.tolist(), col.tolist())) == want and len(row) == 6 * 1600
    assert sum(multiplied) < 0.4 * 1600 * 1600


def test_far_rows_of_a_block_are_multiplied_at_once(monkeypatch):
    """The few rows that all may reach meet the other block in one product for each tile, not in one for every group of it."""
    rng = np.random.default_rng(8)
    cell = np.repeat(np.arange(10), 100)
    centres, blocks = np.linalg.qr(rng.normal(size=(64, 64)))[0][:10], []
    for b in range(2):
        v = centres[cell] + 0.04 * rng.normal(size=(1000, 64))
        v[::10] = rng.normal(size=(100, 64))
        x = neighbours._unit(v)
        groups = neighbours._groups(x, cell)
        by = np.argsort(groups, kind="stable")
        blocks.append((2 * np.arange(1000) + b, x[by], np.where(groups[by] % 2, 0.3, 0.97), groups[by]))
    calls, products = [], neighbours._products
    monkeypatch.setattr(neighbours, "_products", lambda *a: calls.append(1) or products(*a))
    neighbours._between(*([a, b] for a, b in zip(*blocks)), 6)
    assert len(calls) < 40


def test_all_nearest_of_few_and_no_points(spark):
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "id long, v array<float>")
    assert {(r.id, r.neighbour_id) for r in all_nearest(some, 6, 2).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}
    assert all_nearest(some.where("id < 0"), 6, 2).count() == 0


def test_tables_meet_themselves_without_copies_of_their_rows(spark):
    """The blocks of a pair are read where they are kept; a join that copies each row for every block would shuffle them."""
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(200)], "id long, v array<float>")
    plan = all_nearest(points, 3, 4, 50)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate explode" not in plan


@pytest.mark.parametrize("block", [50, 1000])
def test_density_clusters_equal_brute_force(spark, block):
    """Two groups that no neighbour list ties, only one pair of cores, are one cluster; counts and rims are exact."""
    rng = np.random.default_rng(3)
    turn = lambda a: np.stack([np.cos(a), np.sin(a)], 1)
    dense = [turn(c + rng.uniform(-0.01, 0.01, 60)) for c in (0.0, 1.5)]
    chain = turn(np.array([0.055, 0.0551, 0.0552, 0.0553, 0.0554, 0.0555, 1.58]))  # apart from its neighbours' lists, within eps of the first group
    v = np.concatenate([*dense, chain, turn(rng.uniform(2.5, 5.5, 40))])
    ids = rng.permutation(1000)[: len(v)]
    points = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "id long, v array<float>")
    got = {r.id: r.cluster_id for r in clusters.dbscan(points, 0.07, 5, 2, block=block).collect()}
    x = v.astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = x @ x.T
    near = np.sqrt(np.maximum(0, 2 - 2 * sim)) <= 0.07
    core = near.sum(1) >= 5
    name = np.where(core, ids, -1)
    while True:
        least = np.array([name[near[i] & core].min() if core[i] else -1 for i in range(len(ids))])
        if (least == name).all():
            break
        name = least
    order = {c: n for n, c in enumerate(sorted(set(name[core].tolist())))}
    want = {}
    for i in range(len(ids)):
        at = np.flatnonzero(near[i] & core)
        best = i if core[i] else min(at, key=lambda j: (-sim[i, j], ids[j]), default=None)
        want[int(ids[i])] = -1 if best is None else order[name[best]]
    assert got == want



@pytest.mark.parametrize("query", [lambda p: clusters.dbscan(p, 0.3, 5, 4, block=50), lambda p: clusters.k_distances(p, 5, 4)])
def test_no_row_is_repeated_for_every_block(spark, monkeypatch, query):
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(200)], "id long, v array<float>").cache()
    assert points.count() == 200

    def repeated(*_):
        raise AssertionError("rows are repeated")

    monkeypatch.setattr(clusters.F, "explode", repeated)
    assert query(points).count() == 200


@pytest.mark.parametrize("name", GRAPH)
def test_graph_queries_read_edges_written_once(spark, monkeypatch, name):
    """The edges are read from where they were written, so the products of blocks run once."""
    names, write = [], Staging.write

    def seen(self, df, what, partition_by=None):
        names.append(what)
        return write(self, df, what, partition_by)

    monkeypatch.setattr(Staging, "write", seen)
    catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert names.count("edges") == names.count("blocks") == 1


def test_maps_and_densities_are_written_once(spark, monkeypatch):
    """A radius is tried, and points are ranked, on maps and densities that are not made again for every job."""
    rng = np.random.default_rng(6)
    points = spark.createDataFrame([(i, i % 3, rng.normal(size=4).tolist()) for i in range(120)], "id long, cluster_id int, v array<float>")
    read = {"quantile": [], "density": []}

    def watch(name):
        real = getattr(leads, name)

        def watched(df, *more):
            read[name].append(hasattr(df, "_staged_path"))
            return real(df, *more)

        monkeypatch.setattr(leads, name, watched)

    watch("quantile")
    watch("density")
    leads.sparse_leads(points, 4)
    assert len(read["quantile"]) > 3 and all(read["quantile"]) and len(read["density"]) > 3 and all(read["density"])


def test_steps_of_a_traversal_do_not_tell_all_edges_apart(spark, monkeypatch):
    """Repeated edges change nothing, and no step groups the edges by both ends."""
    edges = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.5), (2, 3, 0.5), (3, 4, 0.5), (4, 5, 0.5)], "src long, dst long, weight double")
    plans, write = [], Staging.write
    monkeypatch.setattr(Staging, "write", lambda self, df, *more: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(self, df, *more))
    got = graph.neighbourhood(edges, spark.createDataFrame([(1,)], "node long"), 3)
    assert sorted(map(tuple, got.collect())) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert len(plans) == 3 and not any("Aggregate [a#" in p for p in plans)


@pytest.mark.parametrize("block", [40, 1000])
def test_neighbours_of_some_points_among_all(spark, block):
    """Points that are not asked get no rows, and are neighbours like any other."""
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(size=(4, 8))[rng.integers(0, 4, 260)] + 0.4 * rng.normal(size=(260, 8)), rng.normal(size=(40, 8))])
    v[250:260], v[299] = v[7], 0
    ids = rng.permutation(3000)[:300]
    points = spark.createDataFrame([(int(i), x.tolist(), None if i % 9 == 0 else int(i % 3)) for i, x in zip(ids, v)], "id long, v array<float>, c int")
    got = {(r.id, r.neighbour_id, r["rank"]) for r in all_nearest(points, 6, 8, block, F.col("c") == 1).collect()}
    assert got == {z for z in brute(v, ids, 6) if z[0] % 3 == 1 and z[0] % 9} and got
    assert all_nearest(points, 6, 8, block, F.col("c") == 7).count() == 0


def test_induced_edges_asks_for_the_kept_nodes_alone(spark, monkeypatch):
    """Only neighbours of kept nodes are looked for, so every edge written has one of them."""
    written, write = [], Staging.write

    def seen(self, df, what, partition_by=None):
        out = write(self, df, what, partition_by)
        written.append((what, out))
        return out

    monkeypatch.setattr(Staging, "write", seen)
    catalogue.QUERIES["induced_edges"](spark, "/root/testdata/sf0.001")
    edges = dict(written)["edges"]
    kept = {r.vec_id for r in spark.read.parquet("/root/testdata/sf0.001/bundle.parquet").where("labels between 0 and 3").select("vec_id").collect()}
    assert all(r.src in kept or r.dst in kept for r in edges.collect()) and edges.count()


def test_vectors_far_from_all_centres_have_a_cell_to_themselves(spark):
    """Blocks of near vectors hold none that nearly all others may reach; those that are asked come before the others."""
    rng = np.random.default_rng(10)
    v = np.linalg.qr(rng.normal(size=(64, 64)))[0][:6][np.arange(1200) % 6] + 0.05 * rng.normal(size=(1200, 64))
    v[::10] = rng.normal(size=(120, 64))
    points = spark.createDataFrame([(i, x.tolist(), i % 4 == 0) for i, x in enumerate(v)], "id long, v array<float>, asked boolean")
    placed, far = neighbours._placed(points, 64, 1200, 12)
    cell = {r.id: r.cell for r in placed.collect()}
    assert {i for i, c in cell.items() if c in far} == set(range(0, 1200, 10))
    assert max(c for i, c in cell.items() if i % 4 == 0) < min(c for i, c in cell.items() if i % 4)


def test_a_rank_makes_its_table_once_and_cuts_it_by_its_rows(spark, monkeypatch):
    """Bounds of the ranges are told from the table as written, and few rows are not cut into ranges of next to nothing."""
    made, written, write = spark.sparkContext.accumulator(0), {}, Staging.write

    def pass_on(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    def seen(self, df, what, partition_by=None):
        out = write(self, df, what, partition_by)
        written[what] = out
        return out

    monkeypatch.setattr(Staging, "write", seen)
    values = spark.range(40_000, numPartitions=4).selectExpr("id", "id * 7919 % 40009 as kd").mapInArrow(pass_on, "id long, kd long")
    got = ranks.with_rank(values, "kd", "id")
    assert [r["rank"] for r in got.orderBy("kd").collect()] == list(range(40_000))
    assert made.value == 40_000 and written["ranges"].select("__range").distinct().count() == 3
