"""Near-duplicates, components and survivors against brute force, and their edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.llm import neardup as N
from corpusweave.llm.components import connected_components, store_groups
from corpusweave.llm.neardup import near_duplicates, signatures, similar_papers
from corpusweave.llm.shingles import Shingler, words_of
from corpusweave.llm.survivors import Bundle, Dependency, paper_survivors, store_survivors, survivors

WORDS = [f"w{i}" for i in range(400)]


def jaccard(x: str, y: str, n: int) -> float:
    runs = lambda t: {tuple(w[i : i + n]) for w in [words_of(t or "")] for i in range(len(w) - n + 1)}
    a, b = runs(x), runs(y)
    return len(a & b) / max(1, len(a | b))


def texts() -> list[tuple[int, str | None]]:
    rng = random.Random(3)
    out: list[tuple[int, str | None]] = []
    for g in range(25):
        base = [rng.choice(WORDS) for _ in range(120)]
        for _ in range(rng.choice([1, 2, 3, 5])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            out.append((len(out), " ".join(words).upper() if rng.random() < 0.3 else " ".join(words) + "."))
    return [*out, (900, None), (901, ""), (902, "two words"), (903, "two words"), (904, "x " * 60_000)]


def test_links_join_what_brute_force_joins(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "id long, text string, sim int, key string")
    found = near_duplicates(df)
    links = {(r.a, r.b): r.sim for r in found.links.collect()}
    for (a, b), s in links.items():
        assert s == pytest.approx(jaccard(dict(rows)[a], dict(rows)[b], 5)) and s >= 0.8
    classes = {r.id: r.class_id for r in found.classes().collect()}
    assert set(classes) == {i for i, _ in rows}
    ids = [i for i, t in rows if t and len(t) < 5000]
    similar = [(a, b) for a in ids for b in ids if a < b and jaccard(dict(rows)[a], dict(rows)[b], 5) >= 0.8]
    assert len(similar) > 20 and all(classes[a] == classes[b] for a, b in similar)
    assert classes[902] == 902 and classes[903] == 903 and classes[900] == 900
    pairs = {(r.a, r.b) for r in found.pairs().collect()}
    copies = {r.id: r.rep for r in found.copies.collect()}
    assert {(a, b) for a, b in similar if a not in copies and b not in copies} <= pairs


def test_hot_bucket_of_copies_is_one_star(spark):
    df = spark.range(3000).select("id", F.lit("one text that a third of all the rows have in common " * 3).alias("text"))
    found = near_duplicates(df)
    assert found.copies.count() == 2999 and found.links.count() == 0
    assert found.classes().select("class_id").distinct().count() == 1


def test_empty_table(spark):
    found = near_duplicates(spark.createDataFrame([], "id long, text string"))
    assert found.links.count() == 0 and found.classes().count() == 0 and found.pairs().count() == 0


def test_borrowed_bins_are_equal_for_equal_sets():
    sh = Shingler(3)
    h, owner = sh(["a b c d e", "A b, c d e!", None, "a b"])
    sig, has = signatures(h, owner, 4, 32)
    assert (sig[0] == sig[1]).all() and has.tolist() == [True, True, False, False]


def test_estimate_follows_jaccard():
    rng = random.Random(1)
    base = [rng.choice(WORDS) for _ in range(300)]
    other = base[:200] + [rng.choice(WORDS) for _ in range(100)]
    h, owner = Shingler(3)([" ".join(base), " ".join(other)])
    sig, _ = signatures(h, owner, 2, 4096 // 8)
    assert abs((sig[0] == sig[1]).mean() - jaccard(" ".join(base), " ".join(other), 3)) < 0.1


def test_papers_pair_across_ids_only(spark):
    base = " ".join(random.Random(5).choice(WORDS) for _ in range(80))
    rows = [
        (1, "2401.00001v1", "A title", base, "x"), (2, "arXiv:2401.00001", "A title", base, "x"), (3, "2402.00002", "A TITLE", base + " tail", "x"),
        (4, " 2403.00003 ", None, None, "x"), (5, None, "A title", base, "x"), (6, "2404.00004", "A title", base, "x"),
    ]
    df = spark.createDataFrame(rows, "row_id long, arxiv_id string, title string, abstract string, owner string")
    got = {tuple(r) for r in similar_papers(df).collect()}
    assert got == {("2401.00001", "2402.00002"), ("2401.00001", "2404.00004"), ("2402.00002", "2404.00004")}


def test_copies_above_the_hot_share_pair_across_all_ids(spark):
    rng = random.Random(11)
    base = [rng.choice(WORDS) for _ in range(80)]
    near = " ".join([*base[:-3], "other", "last", "words"])
    rows = [(i, f"2401.{i:05d}", " ".join(base)) for i in range(60)]
    rows += [(i, f"2401.{i:05d}", near) for i in (60, 61, 62)]
    rows += [(i, f"2401.{i:05d}", " ".join(rng.choice(WORDS) for _ in range(80))) for i in range(63, 70)]
    df = spark.createDataFrame([(i, a, None, t) for i, a, t in rows], "row_id long, arxiv_id string, title string, abstract string")
    got = {tuple(r) for r in similar_papers(df).collect()}
    assert got == {(rows[i][1], rows[j][1]) for j in range(63) for i in range(j)}
    copies = {r.id: r.rep for r in near_duplicates(df.selectExpr("row_id as id", "abstract as text")).copies.collect()}
    assert copies == {i: 0 for i in range(1, 60)} | {61: 60, 62: 60}


@pytest.mark.parametrize("sample", [20_000, 40])
def test_recall_at_the_threshold(spark, monkeypatch, sample):
    """Pairs of a similarity just above 0.5, plain and in buckets spread by salt through a title that all share."""
    monkeypatch.setattr(N, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(N, "SAMPLE_LEAST", 5)
    rng = random.Random(12)
    rows, n = [], 150
    for g in range(n):
        own = [f"g{g}w{rng.randrange(10**6)}" for _ in range(120)]
        edited = own[:84] + [f"g{g}x{rng.randrange(10**6)}" for _ in range(34)]
        rows += [(2 * g, f"24{g // 90 + 10}.{2 * g:05d}", " ".join(own)), (2 * g + 1, f"24{g // 90 + 10}.{2 * g + 1:05d}", " ".join(edited))]
    title = "a study of the many words that all of these papers have in common"
    assert 0.5 <= min(jaccard(title + " " + rows[2 * g][2], title + " " + rows[2 * g + 1][2], 3) for g in range(n)) < 0.62
    df = spark.createDataFrame([(i, a, title, t) for i, a, t in rows], "row_id long, arxiv_id string, title string, abstract string")
    got = {tuple(r) for r in similar_papers(df).collect()}
    want = {(rows[2 * g][1], rows[2 * g + 1][1]) for g in range(n)}
    assert got <= want and len(got) >= 0.9 * n


def test_texts_tied_to_different_centres_are_compared(spark):
    words = [f"u{i}" for i in range(100)]
    docs = spark.createDataFrame([(i, " ".join(words[a : a + 60])) for i, a in enumerate((0, 12, 30, 18))], "id long, text string")
    sim = lambda a, b: jaccard(*(" ".join(words[x : x + 60]) for x in (a, b)), 1)
    # 0 and 2 are centres, 1 is tied to 0 alone and 3 to 2 alone; both are compared with both centres.
    tested = spark.createDataFrame([(0, 1, sim(0, 12)), (0, 2, sim(0, 30)), (0, 3, sim(0, 18)), (1, 2, sim(12, 30)), (2, 3, sim(30, 18))], "a long, b long, sim double")
    found = N.NearDuplicates(docs, docs.select("id", F.col("id").alias("rep")).limit(0), tested.where("sim >= 0.66"), 1, 0.66, tested)
    assert (1, 3) not in {(r.a, r.b) for r in found.links.collect()} and (1, 3) in {(r.a, r.b) for r in found.pairs().collect()}


def brute_components(pairs):
    label = {n: n for p in pairs for n in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(9)
    pairs = {
        "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)],
        "chain": [(i + 1, i) for i in range(40)] + [(5, 5)],
        "star": [(0, i) for i in range(1, 300)] + [(3, 7), (3, 7)],
        "none": [],
    }[kind]
    df = spark.createDataFrame(pairs, "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {n: c for n, c in brute_components([p for p in pairs if p[0] != p[1]]).items()}


def test_store_groups_by_any_spelling(spark):
    rows = [
        ("2401.00001", None, None), ("openalex:W1", "10.48550/ARXIV.2401.00001", " n/a"), ("doi:10.99001/x.1", "-", "arXiv:2401.00001v3"),
        ("crosswalk:cw-1", "https://doi.example/10.99001/X.1", ""), ("s:2", "10.0000/tba", None), ("s:3", "10.0000/tba", None), ("s:4", "none", "n/a"), (None, "10.99001/x.1", None),
    ]
    df = spark.createDataFrame(rows, "paper_id string, doi string, arxiv_id string")
    got = {r.paper_id: r.group_id for r in store_groups(df).collect()}
    assert got == {p: "2401.00001" for p in ("2401.00001", "openalex:W1", "doi:10.99001/x.1", "crosswalk:cw-1")}


def brute_survivor(rows, names, deps):
    """Best total over all combinations of source rows, by the same rules."""
    import itertools

    best = None
    for pick in itertools.product(rows, repeat=len(names)):
        chosen = dict(zip(names, pick))
        ok = all(chosen[of][x] is None or chosen[on]["t_" + on] == 0 or any(r[x] == chosen[of][x] and r["t_" + on] == chosen[on]["t_" + on] for r in rows) for of, x, on in deps)
        if ok:
            total = sum(chosen[n]["t_" + n] for n in names)
            best = total if best is None else max(best, total)
    return best


def test_branch_and_bound_reaches_the_best_total(spark):
    rng = random.Random(4)
    rows = []
    for g in range(30):
        for _ in range(rng.randint(1, 5)):
            rows.append({"row_id": len(rows), "g": g, "x": rng.choice([None, 1, 2]), "t_a": rng.choice([0, 3, 5, 9]), "t_b": len(rows) * 10 % 70, "t_c": rng.choice([0, 1, 4])})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "row_id long, g int, x int, t_a long, t_b long, t_c long")
    b = [Bundle(n, (), F.col("t_" + n)) for n in "abc"]
    got = {r["__key"]: r for r in survivors(df, F.col("g").cast("string"), [F.col("t_b")], b, [Dependency("a", F.col("x"), "b")]).chosen.collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r["g"], []).append(r)
    assert set(got) == {str(g) for g, rs in groups.items() if len(rs) > 1}
    for g, rs in groups.items():
        if len(rs) > 1:
            assert got[str(g)].trust == brute_survivor(rs, "abc", [("a", "x", "b")]), g
            assert got[str(g)].row_lead == max(rs, key=lambda r: (r["t_b"], -r["row_id"]))["row_id"]


PAPERS = "row_id long, arxiv_id string, title string, abstract string, authors string, categories string, primary_category string, first_submitted string, last_updated string, doi string, journal_ref string, license string, ingested_at timestamp_ntz, source string, year_month string, version int, part string"


def paper(i, arxiv_id, version=None, updated=None, title="T", abstract="A", authors="X", doi=None):
    return (i, arxiv_id, title, abstract, authors, "cs.LG", "cs.LG", "2024-01-01", updated, doi, None, None, None, "bulk", "2024-01", version, "clash")


def test_paper_survivor_order_and_filling(spark):
    rows = [
        paper(1, "2401.00001v1", 1, "2024-05-01", doi="10.1/x"), paper(2, "arXiv:2401.00001v2", None, None, abstract=None),
        paper(3, "2401.00002", 1, "2024-01-01"), paper(4, "2401.00002v1", 1, "Tue, 02 Jan 2024 01:00:00 GMT"), paper(5, "2401.00002", 1, "2024-01-02T01:00:00Z"),
        paper(6, "2401.00003"), paper(7, None), paper(8, "2401.00004", 1, None), paper(9, "2401.00004", 1, None),
    ]
    found = paper_survivors(spark.createDataFrame(rows, PAPERS))
    led = {r["__key"]: r.row_lead for r in found.chosen.collect()}
    assert led == {"2401.00001": 2, "2401.00002": 4, "2401.00004": 8}
    rec = {r.group_key: r for r in found.records().collect()}["2401.00001"]
    assert (rec.row_id, rec.arxiv_id, rec.abstract, rec.doi) == (2, "arXiv:2401.00001v2", "A", "10.1/x")


def test_store_survivor_counts_sources_once(spark):
    schema = "row_id long, paper_id string, title string, abstract string, authors string, date string, doi string, arxiv_id string, venue string, primary_category string, url string, sources string, year int, cited_by_count int, added_at timestamp_ntz, has_vec boolean"
    row = lambda i, pid, sources, at: (i, pid, "T", None, None, None, None, None, None, None, None, sources, None, None, at, None)
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, n)
    rows = [row(1, "p", "arxiv ; ARXIV;arxiv", day(9)), row(2, "p", "arxiv; openalex", day(2)), row(3, "q", None, day(1)), row(4, "q", "", day(1)), row(5, "q", None, None), row(6, "r", "x", day(1)), row(7, None, "x", day(1))]
    found = store_survivors(spark.createDataFrame(rows, schema))
    assert {r["__key"]: r.row_lead for r in found.chosen.collect()} == {"p": 2, "q": 3}


def test_no_groups_no_survivors(spark):
    assert paper_survivors(spark.createDataFrame([], PAPERS)).records().count() == 0


def test_buckets_are_found_without_a_row_for_each_key_and_ids_are_read_once(spark, monkeypatch):
    """Keys travel packed by part, not as a sorted row each; texts are read for comparisons without parsing ids again."""
    plans, write = {}, N.Staging.write

    def seen(self, df, what, *more):
        plans.setdefault(what, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, what, *more)

    monkeypatch.setattr(N.Staging, "write", seen)
    text = " ".join(WORDS[:60])
    rows = [(i, f"2401.{i:05d}v1", f"paper {i % 3}", f"{text} {WORDS[100 + i]}" if i < 4 else f"{WORDS[i]} {WORDS[i + 1]}") for i in range(12)]
    rows += [(20, "2401.00001v2", *rows[0][2:]), (21, "2401.00009", *rows[0][2:])]  # copies under the own and under another id
    got = {tuple(r) for r in similar_papers(spark.createDataFrame(rows, "row_id long, arxiv_id string, title string, abstract string")).collect()}
    texts_of = {}
    for _, paper, title, abstract in rows:
        texts_of.setdefault(paper.split("v")[0], []).append(f"{title} {abstract}")
    near = lambda a, b: any(jaccard(x, y, 3) >= 0.5 for x in texts_of[a] for y in texts_of[b])
    assert got == {(a, b) for a in texts_of for b in texts_of if a < b and near(a, b)} and len(got) == 10
    assert not any("Window" in p or "Sort " in p for p in plans["bucket_edges"])
    assert not any("regexp" in p for p in plans["tested"]) and len(plans["owners"]) == 1


def test_a_part_without_keys_has_no_buckets():
    assert [len(z) for z in N._buckets(iter([]))] == [0, 0, 0, 0]
