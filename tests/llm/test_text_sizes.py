"""Packing, mixing and splitting: round trips, bounds and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.llm import tokens
from corpusweave.llm.mixing import mix
from corpusweave.llm.packing import fill_report, pack, plan_containers
from corpusweave.llm.splitting import RightmostMax, boundary_strengths, cut_points, split_oversized, split_text


@pytest.fixture(scope="module")
def tok():
    return tokens.Tokenizer(tokens.VOCABULARY)


def long_text(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append(" ".join(rng.choice(["alpha", "beta", "gamma", "Überraschung", "深度学习", "x"]) for _ in range(rng.randint(3, 20))) + rng.choice([". ", "? ", ", "]))
        if i % 7 == 6:
            out.append("\n\n")
    return "".join(out)


@pytest.mark.parametrize("overlap", [0, 16])
def test_pieces_cover_the_text_and_share_the_overlap(tok, overlap):
    for seed in range(4):
        text = long_text(seed, 120)
        pieces = split_text(text, tok, 128, overlap)
        data = text.encode()
        assert len(pieces) > 3 and pieces[0][2] == 0 and pieces[-1][3] == len(data)
        joined = data[: pieces[0][3]]
        for (a, b, x, y), (c, d, u, v) in zip(pieces, pieces[1:]):
            assert c == b - overlap and u <= y
            joined += data[y:v]
        assert joined == data
        for a, b, x, y in pieces:
            assert 0 < b - a <= 128 and len(tok.encode(data[x:y].decode())) <= 128


def test_text_without_any_boundary(tok):
    for text in ("a" * 5000, "字" * 3000, "\n" * 5000, "é́" * 2000):
        pieces = split_text(text, tok, 64, 8)
        data = text.encode()
        assert pieces[-1][3] == len(data) and all(len(tok.encode(data[x:y].decode())) <= 64 for _, _, x, y in pieces)


def test_cut_is_the_strongest_and_rightmost():
    s = np.zeros(101, np.int8)
    s[[30, 35, 38]] = [5, 5, 3]
    assert cut_points(s, 40, 4)[0] == (0, 35)
    rng = np.random.default_rng(1)
    v = rng.integers(0, 4, 300)
    table = RightmostMax(v, 64)
    for lo in range(0, 230, 7):
        for hi in (lo, lo + 1, lo + 33, lo + 63):
            part = v[lo : hi + 1]
            assert table.query(lo, hi) == lo + len(part) - 1 - int(np.argmax(part[::-1]))


def test_strengths_rank_paragraph_over_sentence_over_word():
    data = b"One. Two three\n\nFour"
    s = boundary_strengths(data, np.array([0, 4, 8, 14, 16, 20]))
    assert s[3] > s[1] > s[2] - 1 and s[4] == s[3]


def test_split_frame(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "short", "c"), (3, "short", "c"), (4, long_text(1, 60), "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = split_oversized(df, 64, 8).collect()
    assert sum(r.doc_id == 3 for r in out) == 2 and {r.n_tokens for r in out if r.doc_id < 3} == {0}
    assert {r.doc_id for r in split_oversized(df, 64, 8, oversized_only=True).collect()} == {4}
    assert split_oversized(df.limit(0), 64, 8).count() == 0


def test_plan_is_tight_and_complete():
    rng = random.Random(2)
    counts = {}
    for _ in range(20000):
        n = min(2048, max(1, int(rng.lognormvariate(5.5, 1))))
        counts[n] = counts.get(n, 0) + 1
    for tiers in ((256, 512, 1024), (), (300, 700), (2048, 4096, 0)):
        windows, containers = plan_containers(counts, 2048, tiers)
        used, made, placed = {}, {}, {}
        for items, times, fill, tier in zip(windows.items, windows.times, windows.fill, windows.tier):
            assert sum(n * k for n, k in items) == fill <= tier
            assert min(t for t in (*[t for t in tiers if 0 < t < 2048], 2048) if t >= items[0][0]) == tier
            made[fill] = made.get(fill, 0) + times
            for n, k in items:
                used[n] = used.get(n, 0) + k * times
        for items, times, fill in zip(containers.items, containers.times, containers.fill):
            assert sum(n * k for n, k in items) == fill <= 2048
            for n, k in items:
                placed[n] = placed.get(n, 0) + k * times
        assert used == counts and placed == made
        assert sum(f * t for f, t in zip(containers.fill, containers.times)) / (2048 * sum(containers.times)) > (0.98 if 700 in tiers else 0.99)  # odd tiers waste some


def test_tiers_change_the_plan_and_keep_short_texts_together():
    counts = {n: 40 for n in range(20, 1500, 7)}
    with_tiers, without = plan_containers(counts, 2048, (256, 512, 1024))[0], plan_containers(counts, 2048, ())[0]
    assert sorted(map(tuple, with_tiers.items)) != sorted(map(tuple, without.items))
    assert set(with_tiers.tier) == {256, 512, 1024, 2048} and set(without.tier) == {2048}


def test_pack_places_every_piece_once(spark, tok):
    rng = random.Random(8)
    rows = [(i, " ".join(["word"] * rng.randint(1, 90)), 5) for i in range(400)] + [(1000, None, 5), (1001, "", 5), (1002, long_text(3, 100), 5), (1003, "same", 5), (1003, "same", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, container_id int")
    out = pack(df, 128, (16, 32, 64), 4).toPandas()
    real = out.dropna(subset=["container_id"])
    assert (real.groupby("container_id").n_tokens.sum() <= 128).all()
    assert set(out[out.container_id.isna()].doc_id) == {1000, 1001} and (out.doc_id == 1003).sum() == 2
    assert set(out.doc_id) == {r[0] for r in rows}
    assert (out[out.doc_id < 1000].piece_no == 0).all() and (out.doc_id == 1002).sum() > 1
    assert real.n_tokens.sum() == sum(len(tok.encode(t)) for _, t, _ in rows if t)
    fill = real.n_tokens.sum() / (128 * real.container_id.nunique())
    assert fill > 0.97
    report = fill_report(pack(df, 128, (16, 32, 64), 4), 128).toPandas()
    assert report.containers.sum() == real.container_id.nunique() and report.tokens.sum() == real.n_tokens.sum() and report["items"].sum() == len(real)
    assert (report.padding == report.containers * 128 - report.tokens).all()
    steps = real.groupby("step_group").n_tokens.sum()
    assert steps.max() - steps.min() <= 128 * 2
    assert pack(df.limit(0), 128).count() == 0


def test_one_length_for_most_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("five words make this text").alias("text"))
    out = pack(df, 64).toPandas()
    assert len(out) == 5000 and out.groupby("container_id").n_tokens.sum().max() <= 64


def test_mix_reaches_shares_and_reports_what_it_cannot(spark):
    text = "alpha beta gamma delta"
    rows = [(i, text, "A" if i % 2 else " a ") for i in range(600)] + [(600 + i, text, "b-c") for i in range(300)] + [(900 + i, text, "tiny") for i in range(10)] + [(910 + i, text, None) for i in range(90)] + [(2000, None, "a"), (2001, "", "b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b_c", 0.4, 3), ("tiny", 0.1, 4), ("none", 0.0, 2), ("gone", 0.05, 2)], "source string, target_share double, max_repeats int")
    emitted, report = mix(docs, targets)
    rep = {r.source: r for r in report.collect()}
    assert {s for s, r in rep.items() if r.unreachable} == {"tiny", "gone"}
    assert rep["tiny"].rate == 4.0 and rep["tiny"].emitted_docs == 40 and rep["gone"].mixed_tokens == 0
    assert abs(rep["a"].share_of_all - 0.5) < 0.04 and abs(rep["b_c"].share_of_all - 0.4) < 0.04
    most = {r.source: r.n for r in emitted.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("n")).collect()}
    assert most["a"] <= 2 and most["b_c"] <= 3 and most["tiny"] == 4
    again, _ = mix(docs, targets)
    assert again.exceptAll(emitted).count() == 0
    none, rep0 = mix(docs.limit(0), targets)
    assert none.count() == 0 and rep0.count() == 5
