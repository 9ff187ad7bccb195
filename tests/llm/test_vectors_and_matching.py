"""Clustering, nearest vectors and matching against brute force, and their edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.llm import bisecting as B
from corpusweave.llm import matching as M
from corpusweave.llm.bisecting import cluster_vectors, describe, mislabelled
from corpusweave.llm.forest import nearest_neighbours, similar_pairs
from corpusweave.llm.vectors import usable

BUNDLE = "vec_id long, embeddings array<float>, labels int, model string, level string"


def blobs(seed: int = 1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows, truth = [], {}
    for c, n in enumerate((300, 120, 60, 40, 30, 20)):
        for _ in range(n):
            v = centres[c] + rng.normal(size=64) * 0.08
            truth[len(rows)] = c
            rows.append((v * rng.choice([1.0, 3.0])).tolist())
    for _ in range(60):
        rows.append(rng.normal(size=64).tolist())
    return rows, truth


@pytest.fixture(scope="module")
def bundle(spark):
    rows, truth = blobs()
    data = []
    for i, v in enumerate(rows):
        label = truth.get(i, -1)
        if i % 25 == 0:
            label = None if i % 50 == 0 else (label + 1) % 6
        data.append((i, v, label, "m", "clash"))
    data += [(9000, None, 1, "m", "x"), (9001, [0.0] * 64, 1, "m", "x"), (9002, [1.0] * 48, 1, "old", "x"), (9003, [float("nan")] * 64, 1, "m", "x"), (9004, [None] * 64, 1, "m", "x")]
    return spark.createDataFrame(data, BUNDLE), rows, truth


def test_clusters_and_wrong_labels(spark, bundle):
    df, rows, truth = bundle
    found = cluster_vectors(df).persist()
    got = {r.vec_id: r.cluster_id for r in found.collect()}
    assert len(got) == len(rows)
    of = {}
    for i, c in truth.items():
        of.setdefault(c, set()).add(got[i])
    assert all(len(s) == 1 and s != {-1} for s in of.values()) and len({next(iter(s)) for s in of.values()}) == 6
    assert all(got[i] == -1 for i in range(len(truth), len(rows)))
    assert {(r.vec_id, r.label) for r in mislabelled(found).collect()} == {(i, c) for i, c in truth.items() if i % 25 == 0}
    about = {r.label: r for r in describe(found).collect()}
    assert {about[c]["size"] for c in about} == {300, 120, 60, 40, 30, 20} and all(len(r.typical_members) == 5 for r in about.values())


def test_nodes_split_over_the_cluster_give_the_same_clusters(spark, bundle, monkeypatch):
    df, rows, truth = bundle
    cluster = lambda: {r.vec_id: r.cluster_id for r in cluster_vectors(df).collect()}
    here = cluster()
    monkeypatch.setattr(B, "NODE_ROWS", 25)
    monkeypatch.setattr(B, "DIRECT", 0)
    there = cluster()
    assert len({(here[i], there[i]) for i in here}) == len(set(here.values())) == len(set(there.values()))


def test_leaves(spark, bundle):
    df, rows, truth = bundle
    points = usable(df, "vec_id", "embeddings", 64)
    found = B.fit(points, 64)
    got = B.leaf_table(points, found).collect()
    assert sum(r.size for r in got) >= len(rows) and {r.cluster_id for r in got} >= set(range(6))
    assert [r.size for r in got] == sorted((r.size for r in got), reverse=True)


def test_vectors_that_nothing_parts(spark):
    same = spark.createDataFrame([(i, [1.0] * 64, 1, "m", "x") for i in range(40)], BUNDLE)
    assert {r.cluster_id for r in cluster_vectors(same).collect()} == {0}


def test_no_vectors(spark):
    none = spark.createDataFrame([], BUNDLE)
    assert cluster_vectors(none).count() == 0 and similar_pairs(none).count() == 0 and nearest_neighbours(none).count() == 0


def cosines(rows):
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def test_similar_pairs_with_copies(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(400, 64)).tolist()
    for i in range(0, 40):
        rows.append((np.array(rows[i]) + rng.normal(size=64) * 0.12).tolist())
    rows += [rows[7], (np.array(rows[7]) * 2.5).tolist(), rows[7]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embeddings array<float>")
    got = {(r.vec_id_a, r.vec_id_b) for r in similar_pairs(df).collect()}
    g = np.triu(cosines(rows), 1)
    assert got == {(int(i), int(j)) for i, j in np.argwhere(g >= 0.95)} and len(got) > 40


def test_blocks_cut_deeper_give_the_same_pairs(spark, monkeypatch):
    import corpusweave.llm.forest as forest

    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    rows = [(base + rng.normal(size=64) * 0.6).tolist() for _ in range(600)]
    rows += [(np.array(rows[i]) + rng.normal(size=64) * 0.1).tolist() for i in range(30)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embeddings array<float>")
    plain = forest.max if hasattr(forest, "max") else max
    monkeypatch.setattr(forest, "max", lambda *a: 100 if a and a[0] == 8192 else plain(*a), raising=False)
    got = {(r.vec_id_a, r.vec_id_b) for r in similar_pairs(df, wanted=64).collect()}
    want = {(int(i), int(j)) for i, j in np.argwhere(np.triu(cosines(rows), 1) >= 0.95)}
    assert len(got & want) / len(want) >= 0.95 and got <= want


def test_neighbours_recall(spark, bundle):
    df, rows, _ = bundle
    near = nearest_neighbours(df, 10).collect()
    g = cosines(rows)
    np.fill_diagonal(g, -2)
    hits = total = 0
    asked = {r.vec_id for r in near}
    assert asked == {i for i in range(len(rows)) if i % 20 == 0}
    for i in asked:
        best = set(np.argsort(-g[i])[:10].tolist())
        mine = [r for r in near if r.vec_id == i]
        assert sorted(r.rank for r in mine) == list(range(1, 11))
        hits += len(best & {r.neighbour_id for r in mine})
        total += 10
    assert hits / total >= 0.9


def test_many_copies_keep_places_bounded(spark):
    df = spark.range(1500).select(F.col("id").alias("vec_id"), F.array(*(F.lit(float(i + 1)) for i in range(64))).cast("array<float>").alias("embeddings"))
    near = nearest_neighbours(df, 3)
    assert near.count() == 75 * 3 and near.where("vec_id = neighbour_id").count() == 0


def test_title_evidence():
    t = lambda a, b: M.title_evidence(M.title_words(a), M.title_words(b))
    base = "On the scale of index factorisation in shallow gait analysis after a short warm-up"
    assert t(base, base) == M.TITLE["same"] == t(f"<b>[Preprint] {base.upper()} (extended abstract)</b>", base)
    assert t("On the scale of idnex factorisation in $shallow$ gait analysis after a…", base) == M.TITLE["noise"]
    for tail in (" II", ", part 2", " (second report)"):
        assert t(base + tail, base) == M.SEQUEL and t(base + tail, base + tail) == M.TITLE["same"]
    assert t(base.replace("scale", "prompt"), base) == M.TITLE["one word"]
    assert t("Something else entirely about other things here", base) == M.TITLE["other"] == t("", base)


def test_names_in_every_writing():
    for text in ("Ana Lee; Bo Kim", "Lee, A.; Kim, B.", "A. Lee, B. Kim", "ANA LEE and BO KIM"):
        assert M.name_keys(text) == ["kim|b", "lee|a"]
    assert M.name_keys("Lee et al.") == ["lee|"] and M.name_keys(None) == [] == M.name_keys("")


def test_belief_prefers_the_better_rival(spark):
    edges = spark.createDataFrame([(1, 10, 4.0), (1, 11, 1.0), (2, 11, 3.0), (3, 12, -2.0)], "i long, j long, w double")
    p = {(r.i, r.j): r.confidence for r in M.propagate(edges).collect()}
    assert p[1, 10] > 0.9 and p[2, 11] > 0.9 and p[1, 11] < 0.2 and p[3, 12] < 0.2
    assert M.propagate(edges.limit(0)).count() == 0


def test_matches(spark):
    title = "Layered route drift and policy compiler: a study of ice tracking at negligible cost"
    store = spark.createDataFrame(
        [("p1", title, "Ana Lee; Bo Kim", 2014, "x"), ("p1b", title.upper(), "Ana Lee; Bo Kim", 2015, "x"), ("p2", title, "Zed Quux", 2001, "x"), ("p3", None, None, None, "x"), ("p4", "Other words of quite another paper here", None, None, "x")],
        "paper_id string, title string, authors string, year int, key string",
    )
    records = spark.createDataFrame(
        [(1, title.replace("drift", "dirft"), "Lee et al.", 2014), (2, title + " II", "Lee et al.", 2014), (3, title, "Lee, A.", None), (4, None, "Lee", 2014), (5, "", None, None), (6, title, None, None), (7, title, "Someone Else", 2014), (1, title, "Lee et al.", 2014)],
        "record_id long, title string, authors string, year int",
    )
    got = {(r.record_id, r.paper_id) for r in M.match_records(records, store).collect()}
    assert {(1, "p1"), (1, "p1b"), (3, "p1"), (3, "p1b")} <= got
    assert not [x for x in got if x[0] in (2, 4, 5, 7)] and ("p3" not in {p for _, p in got})
    assert M.match_records(records.limit(0), store).count() == 0 and M.match_records(records, store.limit(0)).count() == 0


RECORDS, STORE = "record_id long, source string, title string, authors string, year int", "paper_id string, title string, authors string, year int"


def matched(spark, records, store) -> set:
    got = M.match_records(spark.createDataFrame(records, RECORDS), spark.createDataFrame(store, STORE))
    return {(r.record_id, r.paper_id) for r in got.collect()}


def test_hot_surname_and_word_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(M, "KEY_ROWS", 3)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(40)]
    titles = ["Quokkas"] * 5 + [" ".join(["quokkas", *rng.sample(words, 6)]) for _ in range(60)]
    store = [(f"p{i:03d}", t, "Ana Lee", 2010 + i % 3) for i, t in enumerate(titles)]
    records = [(i, "s", t, "Lee, A.", 2010 + i % 3) for i, t in enumerate(titles)]
    assert {(i, f"p{i:03d}") for i in range(65)} <= matched(spark, records, store)


@pytest.mark.parametrize("authors", [None, "Ana Lee"])
def test_half_of_a_long_title_always_meets_it(spark, authors):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(300)]
    titles = [rng.sample(words, 18) for _ in range(300)]
    store = [(f"p{i:03d}", " ".join(t), "Ana Lee", 2010) for i, t in enumerate(titles)]
    records = [(i, "s", " ".join(t[:9]), authors, 2010) for i, t in enumerate(titles)]
    assert matched(spark, records, store) == {(i, f"p{i:03d}") for i in range(300)}


def test_candidates_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(25)]
    name = lambda: rng.choice([None, "Ana Lee", "Bo Kim", "Ana Lee; Bo Kim"])
    year = lambda: rng.choice([None, 2001, 2002, 2003])
    records = [(i, "s", " ".join(rng.choices(words, k=rng.randint(1, 9))), name(), year()) for i in range(80)]
    store = [(f"p{i}", " ".join(rng.choices(words, k=rng.randint(1, 9))), name(), year()) for i in range(80)]
    a = M._described(spark.createDataFrame(records, RECORDS), "record_id")
    b = M._described(spark.createDataFrame(store, STORE).withColumn("stored", F.col("paper_id").substr(2, 9).cast("long")), "stored")
    got = {(r.record_id, r.stored) for r in M.candidates(a, b, M._counts(a, b)).collect()}

    def should_meet(x, y) -> bool:
        s, t = set(x[2].split()), set(y[1].split())
        least, most = sorted((len(s), len(t)))
        named = not x[3] or not y[2] or bool(set(x[3].split()) & set(y[2].split()) & {"Lee", "Lee;", "Kim"}) or ("Lee" in x[3] and "Lee" in y[2])
        dated = x[4] is None or y[3] is None or abs(x[4] - y[3]) <= 1
        return named and dated and 2 * least >= most and len(s & t) >= M.least_shared(least)

    want = {(x[0], int(y[0][1:])) for x in records for y in store if should_meet(x, y)}
    assert want and want <= got


def test_belief_decides_between_rivals(spark):
    """A pair of positive evidence that only the factors turn down."""
    title = "Layered route drift and policy compiler: a study of ice tracking"
    longer = title + " at negligible cost"
    store = [("p1", title, "Ana Lee", 2014), ("p2", longer, "Bo Kim", 2015), ("p3", "Coarse shard pruning for wildfire alerts under load", "Cy Poe", 2010)]
    records = [
        (1, "s", title, None, 2014),  # both titles are within reach of it, its own is nearer
        (2, "s", "Coarse shard pruning for wildfire alerts under load", "Poe, C.", 2010),
        (3, "t", "Coarse shard pruning for wildfire alerts under load II", "Poe, C.", 2010),  # a sequel is another paper
    ]
    rows = M.scored_pairs(spark.createDataFrame(records, RECORDS), spark.createDataFrame(store, STORE))
    without = {(r.record_id, r.paper_id) for r in rows.where("w > 0").collect()}
    got = matched(spark, records, store)
    assert got == {(1, "p1"), (2, "p3")} and without == got | {(1, "p2")}


def test_doubtful_second_record_of_a_source_is_held_back(spark):
    edges = spark.createDataFrame([(1, 10, "s", 6.0), (2, 10, "s", 0.5), (3, 11, "s", 6.0), (4, 11, "t", 0.5)], "i long, j long, source string, w double")
    p = {(r.i, r.j): r.confidence for r in M.propagate(edges).collect()}
    assert p[1, 10] > 0.9 and p[2, 10] < 0.5 < p[4, 11] and p[3, 11] > 0.9


def test_matching_broadcasts_no_table_by_its_compressed_size(spark, monkeypatch):
    from corpusweave.llm import matching
    from corpusweave.runtime import Staging

    rows = [(i, "x", f"title number {i} about several topics {i % 7}", f"Name{i % 9}, A", 2020) for i in range(40)]
    records = spark.createDataFrame(rows, "record_id long, source string, title string, authors string, year int")
    store = records.select(F.concat(F.lit("p"), "record_id").alias("paper_id"), "title", "authors", "year")
    plans, write = [], Staging.write

    def seen(self, df, name, partition_by=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, name, partition_by)

    monkeypatch.setattr(Staging, "write", seen)
    out = matching.match_records(records, store)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() >= 40
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
