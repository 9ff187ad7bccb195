"""Harvests, dispatch, bundles, federated search, index and ranks on small tables."""

import datetime as dt
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.config import Config, ConfigError, JsonLines, configure_logging, resolve_backends
from corpusweave.operators import areas, clusters, enrich, federate, leads, ranks, retrieval, validation
from corpusweave.operators.embed import SvdEmbedder
from corpusweave.operators.index import NeighborIndex
from corpusweave.plans.corpora import IngestError, build_corpus, through_store
from corpusweave.sources import harvest
from corpusweave.sources.rest import RateLimited, SourceUnavailable
from corpusweave.sources.store import Folder, PaperStore, Releases, load_bundle, save_bundle
from corpusweave.streaming import streams

DAY = dt.date(2024, 4, 10)


def test_settled_months_are_fetched_once_and_failures_are_tolerated(spark, tmp_path):
    calls, broken = [], {"2024-02"}

    def fetch(query, start, end, want, first):
        calls.append((query, start[:7]))
        if start[:7] in broken:
            raise SourceUnavailable("down")
        return [{"id": f"{query}-{start[:7]}-{i}", "n": i} for i in range(first, min(first + want, 3))]

    folder = Folder(spark, str(tmp_path))
    run = lambda: harvest.harvest_months(spark, fetch, folder, "id string, n int", "2024-01-15", "2024-04-10", ["a", "b"], 40, DAY)
    rows, report = run()
    assert rows.count() == 18 and sum(r["status"] == "failed" for r in report) == 2
    calls.clear()
    broken.clear()
    rows, report = run()
    assert rows.count() == 24 and {m for _, m in calls} == {"2024-02", "2024-04"} and sum(r["status"] == "kept" for r in report) == 4
    with pytest.raises(harvest.HarvestError):
        harvest.harvest_months(spark, lambda *a: [], Folder(spark, str(tmp_path / "none")), "id string, n int", "2024-01-01", "2024-01-31", ["a"], 5, DAY)


def test_quota_and_empty_pages():
    answers = [[1], [], [2], [], [], []]
    assert harvest.fetch_slice(lambda *a: answers.pop(0), "q", "a", "b", 9, page=1) == [1, 2]
    assert len(harvest.fetch_slice(lambda q, s, e, want, first: list(range(want)), "q", "a", "b", 25, page=10)) == 25


def test_pages_follow_tokens_and_go_on(spark, tmp_path):
    page = lambda i, token: f'<r><record><header/><metadata><arXiv><id>2401.0000{i}</id><title>t {i}</title><abstract>a</abstract><categories>cs.DB</categories><created>2024-01-01</created></arXiv></metadata></record>{f"<resumptionToken>{token}</resumptionToken>" if token else ""}</r>'
    asked, down = [], [True]

    def fetch(token, since):
        asked.append((token, since))
        if token == "2" and down[0]:
            raise SourceUnavailable("down")
        return {None: page(1, "2") if since is None else '<r><error code="noRecordsMatch">none</error></r>', "2": page(2, "3"), "3": page(3, "")}[token]

    folder = Folder(spark, str(tmp_path))
    with pytest.raises(SourceUnavailable):
        harvest.harvest_pages(spark, fetch, folder, "2024-02-01")
    down[0] = False
    asked.clear()
    assert {r.arxiv_id for r in harvest.harvest_pages(spark, fetch, folder, "2024-02-01").collect()} == {"2401.00001", "2401.00002", "2401.00003"}
    assert asked[0] == ("2", None)
    assert harvest.harvest_pages(spark, fetch, folder, "2024-03-01").count() == 3 and json.loads(folder.read("state.json"))["complete"] == "2024-03-01"
    with pytest.raises(harvest.HarvestError):
        harvest.harvest_pages(spark, lambda t, s: '<error code="badVerb">no</error>', folder, "x")


def test_snapshot_is_read_again_only_when_it_changed(spark, tmp_path):
    (tmp_path / "snap.json").write_text("{}")
    folder, path = Folder(spark, str(tmp_path / "state")), str(tmp_path / "snap.json")
    assert harvest.snapshot_changed(spark, path, folder, (None, None), None)
    harvest.remember_snapshot(spark, path, folder, (None, None), None)
    assert not harvest.snapshot_changed(spark, path, folder, (None, None), None)
    assert harvest.snapshot_changed(spark, path, folder, ("2024-01-01", None), None) and harvest.snapshot_changed(spark, path, folder, (None, None), ["cs.DB"])
    (tmp_path / "snap.json").write_text("{} {}")
    assert harvest.snapshot_changed(spark, path, folder, (None, None), None)


def test_dispatch(spark):
    empty = lambda: spark.range(0)
    cfg = Config(data={"source": "bulk"})
    for sources in ({}, {"bulk": empty}, {"bulk": lambda: 1 / 0}):
        with pytest.raises(IngestError):
            build_corpus(spark, cfg, sources)
    allowed = Config(data={"source": "bulk", "allow_synthetic": True})
    rows, told = build_corpus(spark, allowed, {"bulk": empty}, 30)
    assert rows.count() == 30 and told["fallback_from"] == "bulk" and told["source"] == "synthetic"
    rows, told = build_corpus(spark, cfg, {"bulk": lambda: spark.range(3)})
    assert rows.count() == 3 and told == {"source": "bulk", "fallback_from": None, "note": ""}


def test_titles_that_meet_in_the_store_become_one(spark, tmp_path):
    text = "We show that the approach of this paper is useful for the analysis of large graphs in many of the cases."
    row = lambda i, title, version, day: (i, f"2401.0000{i}v{version}", title, text, "A", "cs.DB", "cs.DB", day, day, None, None, None, version)
    cols = "row_id long, arxiv_id string, title string, abstract string, authors string, categories string, primary_category string, first_submitted string, last_updated string, doi string, journal_ref string, license string, version int"
    store = PaperStore(spark, str(tmp_path / "store"))
    one = through_store(spark.createDataFrame([row(1, "On graphs", 1, "2024-01-05"), row(2, "Other", 1, "2024-01-06")], cols), store)
    assert one.count() == 2
    two = through_store(spark.createDataFrame([row(3, "ON GRAPHS!", 2, "2024-02-05")], cols), store)
    assert {r.arxiv_id for r in two.collect()} == {"2401.00002", "2401.00003"} and store.count() == 3
    late = through_store(spark.createDataFrame([row(4, "Later", 1, "2024-03-05")], cols), store, start="2024-03-01")
    assert {r.arxiv_id for r in late.collect()} == {"2401.00004"}


def test_bundle_of_an_older_shape(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, None, None)], "id long, name string, v array<double>")
    save_bundle(spark, str(tmp_path), {"papers": df.drop("v"), "vectors": df}, {"made": "x"})
    folder = Folder(spark, str(tmp_path))
    assert folder.exists("papers.csv") and not folder.exists("vectors.csv")
    schema = spark.createDataFrame([], "id long, name string, cited int").schema
    folder.delete("papers")
    tables, meta = load_bundle(spark, str(tmp_path), {"papers": schema, "gone": schema}, {"papers": {"cited": 0, "name": "?"}})
    assert [tuple(r) for r in tables["papers"].orderBy("id").collect()] == [(1, "a", 0), (2, "?", 0)] and tables["gone"].count() == 0 and meta["made"] == "x"


def test_releases_pin_and_log(spark, tmp_path):
    rel = Releases(spark, str(tmp_path))
    names = [rel.publish({"t": spark.range(n)}, {}) for n in (1, 2, 3)]
    rel.pin(names[0])
    assert rel.prune(1) == [names[1]] and rel.list() == [names[0], names[2]]
    assert [c["change"] for c in rel.changes()][-1] == "removed" and rel.publish({"t": spark.range(1)}, {}) not in names


def test_sources_are_asked_side_by_side(spark, tmp_path):
    def slow(phrases, cursor, limit):
        time.sleep(3)
        return []

    def limited(phrases, cursor, limit):
        raise RateLimited("later")

    asked = []
    good = lambda p, c, n: asked.append(c) or [{"source_id": f"w{i}", "title": f"Spam triage with care {i}", "doi": "10.99001/a" if i < 2 else None, "year": 2020, "cited_by_count": i} for i in range(9)]
    cache = Folder(spark, str(tmp_path))
    sources = {"good": good, "slow": slow, "limited": limited, "bad": lambda *a: 1 / 0}
    began = time.monotonic()
    out = federate.fetch_live(sources, ["spam triage"], limit=5, deadline=0.7, cache=cache, now=1000.0)
    assert time.monotonic() - began < 2.5
    assert [(o.source, o.status, len(o.rows)) for o in out] == [("good", "ok", 5), ("slow", "late", 0), ("limited", "limited", 0), ("bad", "failed", 0)]
    again = federate.fetch_live({"good": good}, ["spam triage"], limit=5, cache=cache, now=2000.0)[0]
    assert again.status == "cached" and asked == [0] and federate.fetch_live({"good": good}, ["spam triage"], cursor=5, limit=5, cache=cache, now=2000.0)[0].status == "ok"
    assert federate.fetch_live({"good": good}, ["spam triage"], limit=5, cache=cache, now=10**6)[0].status == "ok"
    records = federate.records_of(spark, out)
    assert records.count() == 5 and {r.paper_id for r in records.collect()} == {"doi:10.99001/a", "good:w2", "good:w3", "good:w4"}
    known = spark.createDataFrame([("10.99001/A", None, None, None), (None, None, "SPAM triage, with care 3", 2021)], "doi string, arxiv_id string, title string, year int")
    assert {r.paper_id for r in federate.fresh_records(records, known).collect()} == {"good:w2", "good:w4"}
    assert federate.records_of(spark, out[1:]).count() == 0
    assert [r.sort for r in federate.available_sorts(records).collect()] == ["relevance", "newest", "most_cited"]


def test_index_recall_and_saving(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 32))
    x = centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 32)) * 0.6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [1.0])], "id long, v array<double>")
    index = NeighborIndex.build(df, 32)
    queries = df.where("id < 200")
    assert index.recall_at_k(queries, 10) >= 0.95 and index.recall_at_k(queries, 10, len(index.centres)) == 1.0
    index.save(str(tmp_path / "index"))
    loaded = NeighborIndex.load(spark, str(tmp_path / "index"))
    rows = lambda ix: {(r.id, r.neighbour_id) for r in ix.search(queries, 5).collect()}
    assert rows(loaded) == rows(index) and not [1 for a, b in rows(index) if a == b]
    assert NeighborIndex.build(df.limit(0), 32).search(queries, 5).count() == 0
    kd = {r.id: r.kd for r in clusters.k_distances(df.where("id < 1500"), 5, 32).collect()}
    near = {r.id: r.kd for r in clusters.k_distances(df.where("id < 1500"), 5, 32, index).collect()}
    assert np.mean([near[i] - kd[i] < 1e-5 for i in kd]) > 0.9


def test_ranks_and_quantiles(spark):
    rng = random.Random(1)
    values = [rng.choice([1.0, 2.5, rng.random() * 100]) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(values)) + [(10_000, None)], "id long, x double")
    got = [(r.x, r.id) for r in ranks.with_rank(df.where("x is not null"), "x", "id").orderBy("rank").collect()]
    assert got == sorted((v, i) for i, v in enumerate(values))
    for q in (0.0, 0.2, 0.5, 0.98, 1.0):
        assert abs(ranks.quantile(df, "x", q) - np.quantile(values, q)) < 1e-9
    assert ranks.quantile(df.limit(0), "x", 0.5) is None
    top = ranks.first_of_groups(df.where("x is not null").withColumn("g", F.lit(1)), ["g"], [F.desc("x"), F.col("id")], 5, "id").orderBy("rank").collect()
    assert [r.id for r in top] == [i for _, i in sorted((-v, i) for i, v in enumerate(values))[:5]]


def test_forced_rows_join_a_quota(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else None, float(i)) for i in range(100)], "id long, g string, x double")
    got = {r.id for r in leads.quota_sample(df, 10, "g", "x", "id", spark.createDataFrame([(0,), (89,), (500,)], "id long")).collect()}
    assert {0, 89, 99} <= got and len(got) == 11


def test_density_clusters_tuned_and_fallback(spark):
    rng = np.random.default_rng(2)
    centres = np.eye(16)[:5]
    x = np.repeat(centres, 40, 0) + rng.normal(size=(200, 16)) * 0.05
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got, used = clusters.cluster(df, "dbscan", 16, [5], 0.05)
    of = {r.id: r.cluster_id for r in got.collect()}
    assert used == "dbscan" and len({c for c in of.values() if c >= 0}) == 5
    assert clusters.silhouette(df, got) > 0.5 and clusters.silhouette(df, got.withColumn("cluster_id", F.lit(0))) is None
    assert clusters.cluster(df, "dbscan", 16, [5], 0.05, fewest=9)[1] == "kmeans" and clusters.least_size(10, 0.01) == 10


def test_titles_stand_in_for_ids(spark):
    papers = spark.createDataFrame([(1, "A title that is long enough"), (2, "Short"), (3, None)], "id long, title string")
    works = spark.createDataFrame([("w2", "a TITLE, that is long enough"), ("w1", "A title that is long enough."), ("w3", "Short")], "work string, title string")
    assert [tuple(r) for r in enrich.by_title(papers, works, "id", "work").collect()] == [(1, "w1")]


def test_report_is_written(spark, tmp_path):
    metrics = validation.metrics_of(a=spark.sql("select 0.1 as noise_fraction"))
    results = validation.evaluate_gates(metrics, spark.createDataFrame([("max_noise_fraction", 0.35, True)], "gate string, limit double, required boolean"))
    for run in ("one", "two"):
        validation.write_report(results, metrics, str(tmp_path), run)
    page = "\n".join(r.value for r in spark.read.text(str(tmp_path / "one" / "page")).collect())
    assert "Passed." in page and "| max_noise_fraction | 0.1 | at most | 0.35 | pass |" in page
    assert spark.read.json(str(tmp_path / "history")).count() == 2
    r = validation.projection_report(spark.createDataFrame([(0.5,), (1.0,)], "robustness double")).first()
    assert (r.leads, r.robustness_mean, r.robustness_min) == (2, 0.75, 0.5)


def test_backends_and_log(capsys):
    cfg = Config()
    assert resolve_backends(cfg, 10)["index"] == "exact" and resolve_backends(cfg, 10**6)["index"] == "cells"
    with pytest.raises(ConfigError):
        resolve_backends(Config(embedding={"backend": "transformer"}), 1)
    log = configure_logging(cfg.logging)
    assert isinstance(log.handlers[0].formatter, JsonLines)
    log.warning("slow", extra={"stage": "clusters"})
    line = json.loads(capsys.readouterr().err.splitlines()[-1])
    assert line["message"] == "slow" and line["stage"] == "clusters" and line["level"] == "WARNING"


def test_words_for_areas(spark):
    df = spark.createDataFrame([(-1, "x", "growing", True, 1.25), (0, "Graphs", "growing", False, 0.5), (1, " ", None, None, None), (2, "b", "declining", True, 1.0)], "c int, l string, d string, r boolean, g double")
    got = df.select(areas.area_name(F.col("l"), F.col("c"), {2: "By hand"}).alias("n"), areas.growth_badge(F.col("d"), F.col("r")).alias("b"), areas.growth_text(F.col("g")).alias("t"))
    assert [tuple(r) for r in got.collect()] == [("Unclustered", "growing", "+25 % against the corpus"), ("Graphs", "uncertain", "-50 % against the corpus"), ("Area 1", "uncertain", None), ("By hand", "declining", "0 % against the corpus")]
    leads_ = spark.createDataFrame([(1, [1, 2, 3, 4])], "id int, evidence array<int>")
    assert areas.lead_evidence(leads_).first().evidence == [1, 2, 3]


def test_embedder_equals_its_parts(spark):
    words = ["graph", "index", "query", "robot", "drone", "grasp"]
    docs = spark.createDataFrame([(i, " ".join(words[(i + k) % 3 + (3 if i % 2 else 0)] for k in range(5))) for i in range(40)] + [(99, "unknown words alone"), (100, None)], "id long, t string")
    vectors = {r.id: np.array(r.embedding) for r in SvdEmbedder(dim=4).fit(docs, F.col("t")).transform(docs, F.col("t")).collect()}
    assert len(vectors) == 42 and abs(np.linalg.norm(vectors[0]) - 1) < 1e-6 and not vectors[100].any()
    assert vectors[0] @ vectors[6] > 0.99 > vectors[0] @ vectors[1] and not vectors[99].any()


def test_stream_into_the_store_and_the_backlog(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "2024-01"), ("b", 2, "2024-02")], "arxiv_id string, version int, year_month string")
    rows.write.parquet(str(tmp_path / "in"))
    store = PaperStore(spark, str(tmp_path / "store"))
    for _ in range(2):  # a second run finds nothing new
        streams.upsert_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "mark"), lambda b: b.where("version > 1"))
    assert [r.arxiv_id for r in store.read().collect()] == ["b"]
    due = streams.embed_backlog(spark.createDataFrame([(1, 5), (2, 9), (3, 7)], "id long, cited int"), spark.createDataFrame([(2,)], "id long"), "id", "cited", 1)
    assert [r.id for r in due.collect()] == [3]
    streams.run_to_table(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "seen_rows", str(tmp_path / "mark2"))
    assert spark.table("seen_rows").count() == 2


def test_stability_distribution_and_judgments(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "id long, cluster_id int")
    same = clusters.stability(labels.select("id"), labels, lambda some: some.withColumn("cluster_id", (F.col("id") % 2).cast("int")), [1, 2])
    assert [r.ari for r in same.collect()] == [1.0, 1.0]
    found = retrieval.cluster_distribution(spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 2)], "query_id long, doc_id long"), labels.withColumnRenamed("id", "doc_id"))
    assert {(r.query_id, r.cluster_id, r.n, r.ambiguous) for r in found.collect()} == {(1, 0, 1, True), (1, 1, 1, True), (2, 0, 2, False)}
    sheet = spark.createDataFrame([("q", "a", 1, 0), ("q", "a", 2, 1), ("q", "b", None, 2)], "query string, arxiv_id string, grade int, seq int")
    assert validation.merge_judgments(sheet).first().grades == {"a": 2}
