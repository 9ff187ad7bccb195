"""Lexical, dense, phrase and hybrid retrieval for batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions.text import PHRASE_STOP, bigrams, phrase_query, phrase_text, search_tokens, with_normal_forms
from corpusweave.runtime import Staging

#: A side is broadcast only if it has been counted and has no more rows than this.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count bounded by `most` shows that it is small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Query terms known to the driver up to which the postings are read by a pushed filter as well.
PUSHED_TERMS = 2_000


@dataclass
class Bm25:
    """An inverted index as a written table: postings (term, doc_id, tf, dl) in the order of terms.

    The table is cut by ranges of terms, so a query's filter on terms skips all files and row groups without them; the
    length of the document stands in each posting, so scoring joins nothing but the query's own few terms."""

    postings: DataFrame
    n_docs: int
    avgdl: float
    k1: float = 1.5
    b: float = 0.75

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text: Column, pairs: bool = True) -> Bm25:
        """Index words and, with `pairs`, neighbouring pairs of words; only words count toward a document's length."""
        return cls.of_words(docs.select(F.col(id_col).alias("doc_id"), search_tokens(text).alias("words")), pairs)

    @classmethod
    def of_words(cls, tokens: DataFrame, pairs: bool = True) -> Bm25:
        """Index of documents (doc_id, words); documents without a word count too."""
        every = F.concat("words", bigrams(F.col("words"))) if pairs else F.col("words")
        rows = tokens.select("doc_id", F.size("words").alias("dl"), F.explode(every).alias("term"))
        tf = rows.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
        postings = Staging(tokens.sparkSession).write(tf.sortWithinPartitions("term", "doc_id"), "postings")
        size = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("avgdl")).first()
        return cls(postings, size.n, size.avgdl or 0.0)

    def document_frequency(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))

    def scores(self, queries: DataFrame, query_id: str, text: Column, pairs: bool = True) -> DataFrame:
        """(query_id, doc_id, score) of every document that has a term of the query.

        A query's terms count once each. Only postings of query terms are read; how many documents have a term is
        counted from them."""
        q = queries.select(F.col(query_id).alias("query_id"), search_tokens(text).alias("words"))
        every = F.concat("words", bigrams(F.col("words"))) if pairs else F.col("words")
        q = q.select("query_id", F.explode(F.array_distinct(every)).alias("term"))
        terms = [r.term for r in q.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
        few = len(terms) <= PUSHED_TERMS
        hits = self.postings.where(F.col("term").isin(terms)) if few else self.postings.join(q.select("term").distinct(), "term", "left_semi")
        df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        asked = q.join(df, "term")
        idf = F.log(1 + (self.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("dl") / self.avgdl)
        part = idf * F.col("tf") * (self.k1 + 1) / norm
        return hits.join(F.broadcast(asked) if few else asked, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each query with their rank; equal scores by the tie column."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """(query_id, doc_id, score): reciprocal rank fusion of rankings (query_id, doc_id, rank)."""
    every = rankings[0].select("query_id", "doc_id", "rank")
    for r in rankings[1:]:
        every = every.unionAll(r.select("query_id", "doc_id", "rank"))
    return every.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def with_span(df: DataFrame, text: str, words: str) -> DataFrame:
    """df with `span`, the length of the shortest run of a text's tokens that holds all the words; null without one.

    A shortest run begins at one of the words: from each of their places it ends at the latest of the words' next
    places, a run over the tail of the text found by array functions alone. Each step is a column of its own, so that
    none is worked out again for every place."""
    wanted = F.col(words)
    rows = df.withColumn("__tokens", F.split(F.trim(text), r"\s+"))
    rows = rows.withColumn("__at", F.filter(F.transform("__tokens", lambda t, i: F.when(F.array_contains(wanted, t), i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("__kept", F.filter("__tokens", lambda t: F.array_contains(wanted, t))).drop("__tokens")

    def length(k: Column) -> Column:
        ends = F.transform(wanted, lambda w: F.array_position(F.slice("__kept", k + 1, F.size("__kept") - k), w).cast("int"))
        return F.when(F.array_min(ends) > 0, F.get("__at", k + F.array_max(ends) - 1) - F.get("__at", k) + 1)

    every = F.transform(F.sequence(F.lit(0), F.size("__kept") - 1), length)
    return rows.withColumn("span", F.when((F.size(wanted) > 0) & (F.size("__kept") > 0), F.array_min(every))).drop("__at", "__kept")


def phrase_levels(docs: DataFrame, id_col: str, title: str, abstract: str, phrases: list[tuple[int, str]], window: int = 8) -> DataFrame:
    """Phrase levels (see levels_in) of documents with columns `title` and `abstract`, null ones being empty."""
    forms = with_normal_forms(docs.select(F.col(id_col).alias("doc_id"), F.col(title).alias("title"), F.col(abstract).alias("abstract")), ["title", "abstract"])
    d = forms.select("doc_id", phrase_text(F.col("__ascii_title")).alias("t"), phrase_text(F.col("__ascii_abstract")).alias("a"))
    return levels_in(d, phrases, window)


def levels_in(d: DataFrame, phrases: list[tuple[int, str]], window: int = 8) -> DataFrame:
    """(query_id, doc_id, level): 1 phrase in the title, 2 in the abstract, 3 all its content words within a window.

    d (doc_id, t, a) holds phrase texts; phrases (query_id, text), several to a query if it was expanded, are the
    request's own few. Near matches are sought only where every word occurs and no phrase has been found; a phrase of
    one content word has none.
    """
    rows = []
    for qid, text in phrases:
        p = phrase_query(text)
        if p:
            rows.append((qid, p, list(dict.fromkeys(w for w in p.split() if w not in PHRASE_STOP))))
    q = F.broadcast(d.sparkSession.createDataFrame(rows, "query_id long, phrase string, words array<string>"))
    padded = F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))
    in_title, in_text = F.contains(F.col("t"), padded), F.contains(F.col("a"), padded)
    whole = F.concat("t", "a")
    every = F.forall("words", lambda w: F.contains(whole, F.concat(F.lit(" "), w, F.lit(" "))))
    pairs = d.crossJoin(q).where(in_title | in_text | ((F.size("words") >= 2) & every))
    found = pairs.select("query_id", "doc_id", "words", whole.alias("whole"), F.when(in_title, 1).when(in_text, 2).alias("level"))
    near = with_span(found.where("level is null"), "whole", "words").where(F.col("span") <= F.greatest(F.lit(window), F.size("words")))
    every_level = found.where("level is not null").select("query_id", "doc_id", "level").unionAll(near.select("query_id", "doc_id", F.lit(3)))
    return every_level.groupBy("query_id", "doc_id").agg(F.min("level").alias("level"))


def matched_words(words: Column, text: Column) -> Column:
    return F.filter(words, lambda w: F.contains(text, F.concat(F.lit(" "), w, F.lit(" "))))


def knn(queries: DataFrame, items: DataFrame, k: int, exclude_self: bool = True, dim: int = 64, block: int = 4096) -> DataFrame:
    """(id, neighbour_id, sim, rank): exact k nearest by cosine of queries (id, v) among items (id, v).

    Both sides are cut into blocks by a hash of the id; a task multiplies a block of queries with a block of items and
    keeps k a query, so memory is bounded by the block and the second stage ranks k rows a block. The number of block
    pairs is what exact search costs; neither side is broadcast.
    """
    n_items = max(1, -(-items.count() // block))
    n_queries = max(1, -(-queries.count() // block))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = queries.select("id", "v", part(n_queries).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_items - 1))).alias("ib"), F.lit(True).alias("asks"))
    i = items.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("qb"), part(n_items).alias("ib"), F.lit(False).alias("asks"))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        def side(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            x = np.array(p["v"].tolist(), np.float64).reshape(-1, dim)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            return p["id"].to_numpy(), np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

        qi, x = side(pdf[pdf["asks"]])
        ii, y = side(pdf[~pdf["asks"]])
        order = np.argsort(ii)
        ii, y = ii[order], y[order]
        out = []
        for s in range(0, len(qi), 512):
            if not len(ii):
                break
            sim = x[s : s + 512] @ y.T
            if exclude_self:
                sim[qi[s : s + 512, None] == ii[None]] = -np.inf
            m = min(k, len(ii))
            top = np.argsort(-np.round(sim, 9), axis=1, kind="stable")[:, :m]
            got = np.take_along_axis(sim, top, 1)
            out.append(pd.DataFrame({"id": np.repeat(qi[s : s + 512], m), "neighbour_id": ii[top].ravel(), "sim": got.ravel()}))
        got = pd.concat(out) if out else pd.DataFrame({"id": [], "neighbour_id": [], "sim": []}).astype({"id": "int64", "neighbour_id": "int64"})
        return got[got["sim"] > -np.inf]

    near = q.unionByName(i).groupBy("qb", "ib").applyInPandas(nearest, "id long, neighbour_id long, sim double")
    w = Window.partitionBy("id").orderBy(F.desc(F.round("sim", 9)), "neighbour_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@dataclass
class Filters:
    """Conjunctive search filters; those not set do not restrict, and a null value fails a set one."""

    date_from: str | None = None
    date_to: str | None = None
    categories: list[str] = field(default_factory=list)
    min_citations: int = 0
    venue_only: bool = False

    def predicate(self, date: str = "date", category: str = "primary_category", citations: str = "cited_by_count", venue: str = "venue") -> Column:
        ok = F.lit(True)
        if self.date_from:
            ok &= F.col(date) >= F.lit(self.date_from).cast("timestamp_ntz")
        if self.date_to:
            ok &= F.col(date) < F.lit(self.date_to).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
        if self.categories:
            ok &= F.col(category).isin(self.categories)
        if self.min_citations > 0:
            ok &= F.col(citations) >= self.min_citations
        if self.venue_only:
            ok &= F.coalesce(F.col(venue), F.lit("")) != ""
        return F.coalesce(ok, F.lit(False))


def similarity_cutoff(sims: DataFrame, z: float = 2.0, relative: float = 0.5, least_docs: int = 200) -> DataFrame:
    """(query_id, base, cutoff): what a related result must reach, from a query's similarities to all documents.

    It must stand out by `z` population deviations and lie `relative` of the way to the best; collections of fewer
    than `least_docs` have none."""
    s = sims.groupBy("query_id").agg(F.avg("sim").alias("base"), F.stddev_pop("sim").alias("sd"), F.max("sim").alias("best"), F.count(F.lit(1)).alias("n"))
    cut = F.greatest(F.col("base") + z * F.col("sd"), F.col("base") + relative * (F.col("best") - F.col("base")))
    return s.select("query_id", "base", F.when(F.col("n") >= least_docs, cut).alias("cutoff"))


def boosted(ranked: DataFrame, weight: float, reference: Column, date: str = "date", citations: str = "cited_by_count", rrf_k: int = 60) -> DataFrame:
    """Ranking (query_id, doc_id, rank, ...) again by rank and citations per month of age."""
    months = F.greatest(F.lit(1.0), F.date_diff(reference, F.col(date)) / 30.44)
    boost = F.log1p(F.col(citations) / months)
    per = Window.partitionBy("query_id")
    score = 1.0 / (F.col("rank") - 1 + rrf_k) * (1 + weight * F.col("__b") / F.greatest(F.max("__b").over(per), F.lit(1e-9)))
    got = ranked.withColumn("__b", boost).withColumn("boosted_score", score).drop("__b")
    w = per.orderBy(F.desc("boosted_score"), "rank")
    return got.withColumn("boosted_rank", F.row_number().over(w))


SORTS = {"newest": "date", "most_cited": "cited_by_count", "citation_velocity": "citation_velocity"}


def resorted(ranked: DataFrame, sort: str) -> DataFrame:
    """Another order of a result list; the rank so far breaks ties."""
    if sort == "relevance":
        return ranked
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(SORTS[sort]), "rank")
    return ranked.withColumn("rank", F.row_number().over(w))


def dense_scan(docs: DataFrame, query_vectors: list[tuple[int, list[float]]], k: int, vector: str = "v") -> tuple[DataFrame, DataFrame]:
    """((query_id, doc_id, sim), (query_id, n, total, squares, best)) of the k most similar documents of each query and
    of the similarities to all documents (doc_id, v).

    The request's own few vectors go to the tasks; a task multiplies its documents with all of them and hands on its k
    best and its sums alone, from one pass over the documents. Null and all-zero vectors have similarity 0."""
    ids = [i for i, _ in query_vectors]
    q = np.array([v for _, v in query_vectors], np.float64).reshape(len(ids), -1)
    norm = np.linalg.norm(q, axis=1, keepdims=True)
    q = np.divide(q, norm, out=np.zeros_like(q), where=norm > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
        sums = np.zeros((len(ids), 4))
        sums[:, 3] = -np.inf
        for batch in batches:
            docs_here = batch.column("doc_id").to_numpy(zero_copy_only=False)
            x = np.zeros((len(docs_here), q.shape[1]))
            column = batch.column("v")
            usable = np.array(column.is_valid()) & (np.array(pa.compute.list_value_length(column).fill_null(0)) == q.shape[1])
            x[usable] = column.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
            n = np.linalg.norm(x, axis=1, keepdims=True)
            sim = np.divide(x, n, out=np.zeros_like(x), where=n > 0) @ q.T
            for j in range(len(ids)):
                s = sim[:, j]
                sums[j] = [sums[j, 0] + len(s), sums[j, 1] + s.sum(), sums[j, 2] + (s * s).sum(), max(sums[j, 3], s.max(initial=-np.inf))]
                d, c = np.concatenate([best[j][0], docs_here]), np.concatenate([best[j][1], s])
                top = np.lexsort((d, -np.round(c, 9)))[:k]
                best[j] = d[top], c[top]
        for j, i in enumerate(ids):
            d, c = best[j]
            m = len(d) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, i)), pa.array([*d.tolist(), None], pa.int64()), pa.array([*c.tolist(), None], pa.float64()), *(pa.array([None] * (m - 1) + [x], pa.float64()) for x in sums[j])],
                ["query_id", "doc_id", "sim", "n", "total", "squares", "best"],
            )

    schema = "query_id long, doc_id long, sim double, n double, total double, squares double, best double"
    got = Staging(docs.sparkSession).write(docs.select("doc_id", F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, schema), "dense")
    sums = got.where("doc_id is null").groupBy("query_id").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares")), F.max("best").alias("best"))
    return top_k(got.where("doc_id is not null").select("query_id", "doc_id", "sim").withColumn("score", F.round("sim", 9)), k).drop("score"), sums


def cutoff_of(sums: DataFrame, z: float = 2.0, relative: float = 0.5, least_docs: int = 200) -> DataFrame:
    """similarity_cutoff from the sums of a dense scan."""
    mean = F.col("total") / F.col("n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - mean * mean))
    cut = F.greatest(mean + z * sd, mean + relative * (F.col("best") - mean))
    return sums.where("n > 0").select("query_id", mean.alias("base"), F.when(F.col("n") >= least_docs, cut).alias("cutoff"))


@dataclass
class SearchIndex:
    """Documents ready for hybrid search, written once: docs (doc_id, v, t, a, *keep) and their inverted index."""

    docs: DataFrame
    lexical: Bm25

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", title: str = "title", abstract: str = "abstract", vector: str = "v", keep: tuple[str, ...] = ()) -> SearchIndex:
        """Index of documents with a text and a vector; `keep` names the columns that filters and results need."""
        text = lambda c: F.coalesce(F.col(c), F.lit(""))
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(vector).alias("v"), text(title).alias("__title"), text(abstract).alias("__abstract"), *(F.col(c) for c in keep))
        # Written before its two parts, with and without other scripts, are told apart: what makes the rows runs once.
        forms = with_normal_forms(Staging(docs.sparkSession).write(rows, "search_rows"), ["__title", "__abstract"])
        ready = forms.select(
            "doc_id", "v", phrase_text(F.col("__ascii___title")).alias("t"), phrase_text(F.col("__ascii___abstract")).alias("a"),
            search_tokens(F.concat("__title", F.lit(". "), "__abstract")).alias("words"), *(F.col(c) for c in keep),
        )
        ready = Staging(docs.sparkSession).write(ready, "search_docs")
        return cls(ready.drop("words"), Bm25.of_words(ready.select("doc_id", "words")))


def hybrid_search(
    index: SearchIndex, queries: list[tuple[int, str]], query_vectors: list[tuple[int, list[float]]], filters: Column | None = None,
    phrases: list[tuple[int, str]] | None = None, top_exact: int = 100, top_related: int = 50, candidate_k: int = 100, rrf_k: int = 60,
    window: int = 8, mode: str | None = None, cutoff: bool = True, rerank: Callable[[DataFrame], DataFrame] | None = None, head: int = 50,
) -> DataFrame:
    """(query_id, doc_id, section, level, sim, lex, rank) for a batch of queries (query_id, text).

    Phrase matches come first, by level and then by similarity plus half the relative lexical score; then the rest by
    rank fusion of the dense and the lexical list, without those already listed, if they pass the similarity cutoff.
    `mode` ("dense", "lexical", "hybrid") leaves the phrase section and the cutoff out. Filters apply to the documents
    before anything is matched or ranked, except that the best lexical score is that of all documents. `phrases` are
    those of the expanded queries. `rerank` gets the first `head` related results of each query (query_id, doc_id, sim,
    lex) and adds `rerank_score`, by which they are then ordered. Only matches and the best candidates are ever joined:
    similarities of all documents are summed and ranked where they are computed.
    """
    spark, staging = index.docs.sparkSession, Staging(index.docs.sparkSession)
    allowed = index.docs.where(filters) if filters is not None else index.docs
    q = spark.createDataFrame(queries, "query_id long, text string")
    lex_all = staging.write(index.lexical.scores(q, "query_id", F.col("text")), "lexical")
    lex = lex_all.join(allowed.select("doc_id"), "doc_id", "left_semi") if filters is not None else lex_all
    best = F.broadcast(lex_all.groupBy("query_id").agg(F.max("score").alias("max_lex")))
    dense, sums = dense_scan(allowed, query_vectors, candidate_k)
    lexical = top_k(lex.withColumn("score", F.round("score", 9)), candidate_k)
    empty = spark.createDataFrame([], "query_id long, doc_id long, level int")
    levels = staging.write(levels_in(allowed, phrases or queries, window), "levels") if mode is None else empty

    lists = {"dense": [dense], "lexical": [lexical]}.get(mode or "hybrid", [dense, lexical])
    wanted = levels.select("query_id", "doc_id")
    for r in lists:
        wanted = wanted.unionByName(r.select("query_id", "doc_id"))
    wanted = wanted.distinct()
    vectors = F.broadcast(spark.createDataFrame(query_vectors, "query_id long, qv array<double>"))
    scored = wanted.join(vectors, "query_id").join(index.docs.select("doc_id", "v"), "doc_id")
    scored = scored.select("query_id", "doc_id", F.coalesce(dot(unit(F.col("v")), unit(F.col("qv"))), F.lit(0.0)).alias("sim"))
    scored = scored.join(lex, ["query_id", "doc_id"], "left").join(best, "query_id", "left")
    scored = scored.select("query_id", "doc_id", "sim", F.coalesce(F.col("score") / F.col("max_lex"), F.lit(0.0)).alias("lex"))
    scored = staging.write(scored.join(levels, ["query_id", "doc_id"], "left"), "scored")

    w = Window.partitionBy("query_id").orderBy("level", F.desc(F.round(F.col("sim") + 0.5 * F.col("lex"), 9)), "doc_id")
    exact = scored.where("level is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= top_exact).withColumn("section", F.lit("exact"))

    def renumbered(r: DataFrame) -> DataFrame:
        rest = r.select("query_id", "doc_id", "rank").join(levels, ["query_id", "doc_id"], "left_anti")
        return rest.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))

    fused = rrf([renumbered(r) for r in lists], rrf_k)
    related = fused.withColumnRenamed("score", "fused").join(scored, ["query_id", "doc_id"])
    if mode is None and cutoff:
        related = related.join(F.broadcast(cutoff_of(sums)), "query_id").where(F.col("cutoff").isNull() | (F.col("sim") >= F.col("cutoff")))
    per = Window.partitionBy("query_id")
    related = related.withColumn("r", F.row_number().over(per.orderBy(F.desc(F.round("fused", 12)), "doc_id"))).where(F.col("r") <= top_related)
    if rerank is not None:
        again = rerank(related.where(F.col("r") <= head).select("query_id", "doc_id", "sim", "lex")).select("query_id", "doc_id", "rerank_score")
        related = related.join(again, ["query_id", "doc_id"], "left")
        related = related.withColumn("r", F.row_number().over(per.orderBy(F.desc_nulls_last("rerank_score"), "r"))).drop("rerank_score")
    related = related.withColumn("section", F.lit("related"))
    cols = ["query_id", "doc_id", "section", "level", "sim", "lex", "r"]
    both = exact.select(*cols).unionByName(related.select(*cols))
    return both.withColumn("rank", F.row_number().over(per.orderBy("section", "r"))).drop("r")


def cluster_distribution(results: DataFrame, clusters: DataFrame) -> DataFrame:
    """(query_id, cluster_id, n, ambiguous): results per cluster; ambiguous if more than one real cluster has some."""
    counts = results.join(clusters, "doc_id").groupBy("query_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    real = F.sum((F.col("cluster_id") != -1).cast("int")).over(Window.partitionBy("query_id"))
    return counts.withColumn("ambiguous", real > 1)
