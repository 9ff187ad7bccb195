"""Core operators on small literal tables."""

import datetime as dt
import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.config import ConfigError, load_config
from corpusweave.functions import text as X
from corpusweave.functions.ids import bare_id, id_version, normalize_doi, parse_time
from corpusweave.operators import acronyms, clusters, graph, growth, ingest, leads, livestore, retrieval, validation
from corpusweave.plans import catalogue
from corpusweave.sources import files, rest
from corpusweave.sources.store import PaperStore, Releases
from corpusweave.sources.synthetic import synthetic_papers


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("s"))).collect()]


def test_ids_and_times(spark):
    assert col(spark, ["arXiv:2401.01234v2", " 2401.01234 ", "http://x.example/abs/2401.01234v1", "n/a", None], bare_id) == ["2401.01234"] * 3 + [None] * 2
    assert col(spark, ["https://doi.example/10.99001/AB.1", "DOI: 10.99001/ab.1 ", "10.0000/tba", "-", None], normalize_doi) == ["10.99001/ab.1"] * 2 + [None] * 3
    got = col(spark, ["2024-01-02", "2024-01-02T00:00:00Z", "2024-01-02T02:00:00+02:00", "Tue, 02 Jan 2024 00:00:00 GMT", "soon", None], lambda c: F.unix_timestamp(parse_time(c)))
    assert got == [1704153600] * 4 + [None] * 2


def test_text(spark):
    assert col(spark, [r"A \emph{deep \textbf{net}} of $x^2$ {size}~1", None, "ﬁne"], X.normalize_text) == ["A deep net of x^2 size 1", "", "fine"]
    assert col(spark, ["Über-Netze: A Study!"], X.title_key) == ["uber netze a study"]
    assert col(spark, ["cs.LG math.ST", "physics.comp-ph", None], X.has_category) == [True, False, False]
    assert col(spark, ["We show that the method of the paper is good.", "Der Hund läuft schnell davon", "", None], X.is_english) == [True, False, False, False]
    assert col(spark, ["Studies of debts and class buses"], X.phrase_text) == [" study of debt and class buse "]
    assert X.phrase_query("Studies of Debts") == "study of debt"
    assert col(spark, ["The low-data regime of BERT 2.0."], X.search_tokens) == [["low-data", "regime", "bert", "2.0"]]


def test_clean_keeps_one_row(spark):
    good = "We show that the method of this paper is a good one and that it can be used in practice."
    rows = [
        (1, "2401.00001v1", None, "A Title", good, "cs.LG", "2024-01-05"), (2, "2401.00001v2", None, "A Title", good, "cs.LG", "2024-01-05"),
        (3, "2401.00009", 1, "a  TITLE!", good, "cs.LG", "2024-01-06"), (4, "2401.00003", 1, "Other", good, "math.ST", "2024-01-05"),
        (5, "2401.00004", 1, "Late", good, "cs.LG", "2030-01-05"), (6, "2401.00005", 1, "Short", "tiny", "cs.LG", "2024-01-05"), (7, None, 1, "X", good, "cs.LG", "2024-01-05"),
    ]
    df = spark.createDataFrame(rows, "row_id long, arxiv_id string, version int, title string, abstract string, categories string, first_submitted string")
    df = df.selectExpr("*", "null as primary_category", "null as last_updated", "null as authors", "null as doi", "null as journal_ref", "null as license")
    got = ingest.clean_records(df, "cs.", "2024-01-01", "2024-12-31").collect()
    assert [(r.arxiv_id, r.version) for r in got] == [("2401.00001", 2)]
    assert ingest.clean_records(df.limit(0)).count() == 0


def test_stratified_sample_weights(spark):
    df = spark.range(930).selectExpr("id", "if(id < 900, 'a', 'b') s", "'2024-01' m")
    got = ingest.stratified_sample(df, ["s", "m"], "id", 200).groupBy("s").agg(F.count("*").alias("n"), F.sum("sample_weight").alias("w"))
    rows = {r.s: r for r in got.collect()}
    assert (rows["a"].n, rows["b"].n) == (170, 30) and abs(rows["a"].w + rows["b"].w - 930) < 1e-6


def test_phrases_and_span(spark):
    rows = [(1, "Spam triage now", ""), (2, "x", "on spam triage"), (3, "triage of any spam", ""), (4, "spam", "a b c d e f g h i triage"), (5, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, abstract string")
    got = {r.doc_id: r.level for r in retrieval.phrase_levels(df, "id", "title", "abstract", [(1, "spam triage")]).collect()}
    assert got == {1: 1, 2: 2, 3: 3}


def test_knn_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in retrieval.knn(df, df, 5, dim=8, block=37).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = u @ u.T
    np.fill_diagonal(g, -9)
    assert all(got[i] == np.argsort(-g[i])[:5].tolist() for i in range(120))


def test_acronyms(spark):
    df = spark.createDataFrame([("the self-admitted technical debt (SATD) and self-admitted technical debt (SATD)",), ("a graph neural network (GNN) here",), ("states of the art (SOTAs)",), ("the Rate of Change (RC) and (AB)",), ("none (at all)",), (None,), ("",)], "t string")
    got = {(r.acronym, r.long_form): r.n for r in acronyms.mine(df, "t").collect()}
    assert got == {("satd", "self admitted technical debt"): 2, ("gnn", "graph neural network"): 1, ("sota", "states of the art"): 1, ("rc", "rate of change"): 1}
    assert {r.n for r in acronyms.merge(acronyms.mine(df, "t"), acronyms.mine(df, "t")).collect()} == {4, 2}


def test_expansion(spark):
    counts = spark.createDataFrame([("satd", "self admitted technical debt", 2), ("td", "technical debt", 9), ("gnnx", "graph neural network", 1), ("td", "touch down", 1)], "acronym string, long_form string, n long")
    synonyms = spark.createDataFrame([("technical debt", "tech debt")], "term string, other string")

    def phrases(*texts: str, **how) -> list[set[str]]:
        q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
        rows = acronyms.expand(q, **how).collect()
        return [{r.phrase for r in rows if r.query_id == i} for i in range(len(texts))]

    a, b, c, d, e, f = phrases("SATD tools", "Self-admitted technical debts", "technical debt", "TD", "graph neural network", "?", counts=counts)
    assert a == {"satd tool", "self admitted technical debt tool"} and b == {"self admitted technical debt", "satd"}
    assert c == {"technical debt"} and d == {"td", "technical debt"} and e == {"graph neural network"} and f == set()
    assert phrases("technical debt", "tech debts", "diffusion", synonyms=synonyms) == [{"technical debt", "tech debt"}, {"tech debt", "technical debt"}, {"diffusion"}]
    q = spark.createDataFrame([(1, "SATD tools")], "query_id long, text string")
    assert acronyms.embed_text(acronyms.expand(q, counts)).first().text == "satd tools; self admitted technical debt tools"


def test_plurals():
    assert [X.phrase_query(x) for x in ("Self-Admitted Technical Debts!", "Naïve  Networks", "Strategies", "analysis")] == ["self admitted technical debt", "naive network", "strategy", "analysis"]


def test_ids_of_both_kinds(spark):
    df = spark.createDataFrame([("2501.01234v3",), ("http://preprints.example/abs/cs/0101001v1",), ("math.GT/0309136",), ("nothing",), (None,)], "x string")
    got = [(r.b, r.v) for r in df.select(bare_id(F.col("x")).alias("b"), id_version(F.col("x")).alias("v")).collect()]
    assert got == [("2501.01234", 3), ("cs/0101001", 1), ("math.GT/0309136", None), (None, None), (None, None)]


def test_span_and_highlight(spark):
    df = spark.createDataFrame([(" a b c a d b ", ["a", "b", "d"]), (" a b ", ["a", "z"]), (" x ", ["x"]), ("  ", ["x"])], "t string, w array<string>")
    assert [r.span for r in retrieval.with_span(df, "t", "w").collect()] == [3, None, 1, None]
    marked = spark.range(1).select(X.highlight(F.lit("Technical debts and debtor"), ["debt", "technical"])).first()[0]
    assert marked == "<mark>Technical</mark> <mark>debts</mark> and debtor"


def test_components_and_bfs(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (5, 6, 1.0)], "src long, dst long, weight double")
    assert {r.node: r.component for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    start = spark.createDataFrame([(1,)], "node long")
    assert {r.node: r.depth for r in graph.neighbourhood(e, start, 5).collect()} == {1: 0, 2: 1, 3: 2}


def test_assignment_is_optimal():
    rng = np.random.default_rng(2)
    for shape in ((4, 4), (3, 5), (5, 3)):
        s = rng.random(shape)
        small, large = sorted(shape)
        rows = s if shape[0] <= shape[1] else s.T
        best = max(sum(rows[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert abs(sum(s[r, c] for r, c in clusters.assignment(s)) - best) < 1e-9


def test_labels(spark):
    rows = [["kv", "cache", "kv cache", "agents", "agent"], [], ["models", "model", "methods"], ["graphs", "graphics", "query plan", "plans", "iot"], None]
    df = spark.createDataFrame([(r,) for r in rows], "t array<string>")
    assert [r[0] for r in df.select(clusters.area_label(F.col("t"))).collect()] == ["KV Cache & Agents", "Unlabeled area", "Models & Methods", "Graphs, Query Plan & IoT", "Unlabeled area"]


def test_growth_of_a_planted_cluster(spark):
    rng = np.random.default_rng(3)
    rows = []
    for m in range(36):
        for c, rate in ((0, 20 * 1.06**m), (1, 400)):
            for _ in range(int(rng.poisson(rate))):
                rows.append((dt.datetime(2021 + m // 12, m % 12 + 1, int(rng.integers(1, 28))), c))
    df = spark.createDataFrame(rows, "date timestamp_ntz, cluster_id int")
    g = growth.bootstrap_intervals(growth.relative_growth(df, "date", "cluster_id", [6]))
    assert {r.cluster_id: r.direction for r in g.collect()}[0] == "growing"
    t = {r.cluster_id: r for r in growth.poisson_trends(df, "date", "cluster_id").collect()}
    assert t[0].ci_low > 1 > t[1].ci_high


def test_metrics_and_gates(spark):
    grades = spark.createDataFrame([(1, i, g) for i, g in enumerate([2, 0, 1, 0, 2, 0])], "query_id long, doc_id long, grade int")
    ranked = spark.createDataFrame([(1, d, r) for r, d in enumerate([0, 4, 2, 1], 1)], "query_id long, doc_id long, rank int")
    m_table = validation.search_metrics(ranked, grades, 3, 25)
    m = m_table.first()
    assert (m.ndcg, m.precision, m.mrr, m.recall) == (1.0, 1.0, 1.0, 1.0)
    found = validation.metrics_of(m=m_table.select(F.col("ndcg").alias("search_ndcg")), q=spark.sql("select 1 as quality_failures"))
    limits = spark.createDataFrame([("search_ndcg_at_10", 0.75, True), ("max_noise_fraction", 0.35, True), ("unheard_of", 1.0, True)], "gate string, limit double, required boolean")
    got = {r.gate: (r.passed, r.required) for r in validation.evaluate_gates(found, limits).collect()}
    assert got == {"search_ndcg_at_10": (True, True), "max_noise_fraction": (False, True), "quality_checks": (False, False)}
    out = validation.verdict(validation.evaluate_gates(found, limits)).first()
    assert not out.passed and out.failed_required == ["max_noise_fraction"] and out.failed == ["max_noise_fraction", "quality_checks"]
    assert validation.verdict(validation.evaluate_gates(found, limits.where("gate like 'search%'"))).first().passed


def test_radius_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    p = rng.random((80, 2))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, x double, y double")
    got = {(r.id, r.other) for r in leads.radius_pairs(df, 0.15).collect()}
    assert got == {(i, j) for i in range(80) for j in range(80) if i != j and np.hypot(*(p[i] - p[j])) <= 0.15}


def test_records_merge_in_order(spark):
    t = "A long enough title"
    rows = [(1, "10.1234/a", None, "x", 2020), (2, "10.1234/A", None, "y", 2020), (3, None, None, t, 2020), (4, None, None, t, 2021), (5, None, None, t, 2015), (6, None, "2401.00001", "z", None), (7, "10.48550/arXiv.2401.00001", None, "w", None)]
    df = spark.createDataFrame(rows, "seq long, doi string, arxiv_id string, title string, year int").withColumn("page", F.lit(1))
    got = {r.seq: r.entity for r in livestore.merge_in_order(df, "page", "seq").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6}


def test_every_stored_record_has_a_verdict(spark, tmp_path):
    day = lambda n: dt.datetime(2025, 6, 1) - dt.timedelta(days=n)
    rows = [(1, "2025-05-01", day(8), True), (2, "2025", day(29), True), (3, "2025", day(30), True), (4, "2025-05", day(7), True), (5, "", day(89), True), (6, None, day(90), True), (7, None, None, True), (8, "", day(14), False), (9, "2020", day(89), True), (10, "soon", day(90), True)]
    df = spark.createDataFrame(rows, "row_id long, date string, added_at timestamp_ntz, has_vec boolean")
    df.write.parquet(str(tmp_path / "live_store.parquet"))
    got = {r.row_id: r.stale for r in catalogue.QUERIES["stale_records"](spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True, 8: True, 9: False, 10: True}


def test_dbscan_joins_dense_clumps_of_any_size(spark):
    rng = np.random.default_rng(4)
    at = lambda d: [float(np.cos(d)), float(np.sin(d)), 0.0]
    v = [at(0.0)] * 80 + [at(0.4)] * 80 + [at(0.8)] + [at(2.5)] * 3 + rng.normal(size=(60, 3)).tolist()
    x = np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)
    near = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T)) <= 0.5
    core = near.sum(1) >= 5
    label = np.where(core, np.arange(len(v)), -1)
    for _ in v:
        label = np.where(core, [min(label[(near[i] & core)], default=-1) for i in range(len(v))], -1)
    for i in np.flatnonzero(~core & (near & core).any(1)):
        label[i] = label[np.where(near[i] & core, np.round(x[i] @ x.T, 12), -2).argmax()]
    names = {c: k for k, c in enumerate(sorted(set(label[core])))}
    df = spark.createDataFrame(list(enumerate(v)), "id long, v array<double>")
    for block in (2048, 50):
        got = {r.id: r.cluster_id for r in clusters.dbscan(df, 0.5, 5, 3, block=block).collect()}
        assert got == {i: names.get(c, -1) for i, c in enumerate(label)} and got[0] == got[80] == got[160]


def test_entities_resolve_across_pages(spark, tmp_path):
    t = "A long enough title"
    rows = [(1, "10.1234/a", None, "x", 2020), (2, None, None, t, 2020), (3, None, None, t, 2023), (4, None, None, "Another title entirely", 2020), (5, None, None, "Another title entirely", 2022), (6, None, "2401.00001", "z", None), (7, None, None, None, None)]
    rows += [(201, "10.1234/A", None, "y", 2020), (302, None, None, t, 2021), (406, "10.48550/arXiv.2401.00001", None, "w", None), (507, None, None, None, None)]
    df = spark.createDataFrame(rows, "record_id long, doi string, arxiv_id string, title string, year int")
    df.write.parquet(str(tmp_path / "source_records.parquet"))
    got = {r.record_id: r.entity for r in catalogue.QUERIES["entity_resolution"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 201: 1, 302: 2, 406: 6, 507: 507}


def test_snapshot_and_oai(spark, tmp_path):
    line = {"id": "2401.00001", "title": "T", "abstract": "A", "categories": "cs.LG", "authors_parsed": [["Lee", "Ana"]], "versions": [{"created": "Wed, 1 May 2024 10:00:00 GMT"}, {"created": "Thu, 2 May 2024 10:00:00 GMT"}]}
    (tmp_path / "s.json").write_text(json.dumps(line) + "\n" + json.dumps(line | {"categories": "math.ST"}) + "\n")
    r = files.read_snapshot(spark, str(tmp_path / "s.json"), start="2024-01-01", end="2024-12-31").first()
    assert (r.arxiv_id, r.version, r.authors, r.first_submitted, r.last_updated) == ("2401.00001v2", 2, "Ana Lee", "2024-05-01 10:00:00", "2024-05-02 10:00:00")
    live = '<record><header></header><metadata><arXiv><id>2401.00002</id><created>2024-01-01</created><title>T  t</title><abstract>A</abstract><categories>cs.LG</categories><authors><author><keyname>Lee</keyname><forenames>Ana</forenames></author></authors></arXiv></metadata></record>'
    page = f'<ListRecords>{live}<record><header status="deleted"></header></record><resumptionToken cursor="0">next</resumptionToken></ListRecords>'
    got = files.oai_records(spark.createDataFrame([(page,)], "x string"), "x").collect()
    assert [(r.arxiv_id, r.title, r.authors) for r in got] == [("2401.00002", "T t", "Ana Lee")] and files.resumption_token(page) == "next"


def test_rest_pages(spark, tmp_path):
    rest.register(spark)
    for k in range(2):
        (tmp_path / f"{k}.json").write_text(json.dumps({"results": [{"source_id": f"s{k}", "title": "T", "year": 2020}]}))
    urls = json.dumps([f"file://{tmp_path}/{k}.json" for k in range(2)])
    got = spark.read.format("record_pages").option("urls", urls).load()
    assert sorted(r.source_id for r in got.collect()) == ["s0", "s1"]
    limiter = rest.RateLimiter(3)
    assert limiter.acquire(0.0) == 0.0 and limiter.acquire(1.0) == 2.0
    limiter.start_cooldown(60, 0.0)
    assert limiter.cooling_down(59.0) and not limiter.cooling_down(61.0)


def test_store_and_releases(spark, tmp_path):
    store = PaperStore(spark, str(tmp_path / "store"))
    df = lambda rows: spark.createDataFrame(rows, "arxiv_id string, version int, year_month string")
    store.upsert(df([("a", 1, "2024-01"), ("b", 1, "2024-01")]))
    store.upsert(df([("b", 2, "2024-01")]))
    store.upsert(df([("c", 1, "2024-02"), ("b", 1, "2024-01")]))
    assert {(r.arxiv_id, r.version) for r in store.read().collect()} == {("a", 1), ("b", 2), ("c", 1)}
    releases = Releases(spark, str(tmp_path / "rel"))
    names = [releases.publish({"papers": df([("a", 1, "2024-01")])}, {}) for _ in range(3)]
    assert releases.current() == names[-1] and releases.read(spark, "papers").count() == 1
    releases.set_current(names[0])
    assert releases.prune(1) == [names[1]]
    with pytest.raises(ValueError):
        releases.publish({}, {}, {"passed": False, "failed_required": ["x"]})


def test_config(tmp_path):
    (tmp_path / "base.yaml").write_text("data: {profile: standard}\nseed: 1\n")
    (tmp_path / "c.yaml").write_text("extends: base.yaml\nseed: 2\n")
    c = load_config(str(tmp_path / "c.yaml"), {"WEAVE_SEARCH__RRF_K": "30"})
    assert (c.seed, c.cap(), c.search.rrf_k) == (2, 50_000, 30) and c.data.date_end != "auto"
    for bad in ("nope: 1", "environment: production"):
        (tmp_path / "bad.yaml").write_text(bad)
        with pytest.raises(ConfigError):
            load_config(str(tmp_path / "bad.yaml"), {})


def test_synthetic_is_deterministic(spark):
    a = synthetic_papers(spark, 50).collect()
    assert a == synthetic_papers(spark.newSession(), 50).collect() and len({r.primary_category for r in a}) == 6
