"""Federated search: sources asked side by side, their pages kept, and one list of collection, store and live results."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusweave.functions.text import key_of, with_normal_forms
from corpusweave.operators.livestore import federate, record_id, unknown_in
from corpusweave.operators.retrieval import SearchIndex, dense_scan, hybrid_search, levels_in
from corpusweave.sources.files import RECORD, make_records
from corpusweave.sources.rest import RateLimited
from corpusweave.sources.store import Folder

#: A source's search: (phrases, first result, results wanted) -> rows of the common shape as dictionaries.
Search = Callable[[list[str], int, int], Iterable[dict]]


def page_key(phrases: list[str], source: str, cursor: int, limit: int) -> str:
    """Name under which a source's answer is kept: a hash of all that the answer depends on."""
    return hashlib.sha1(json.dumps([sorted(phrases), source, cursor, limit]).encode()).hexdigest()


@dataclass
class Outcome:
    """What became of a source: `status` is ok, cached, late, limited or failed."""

    source: str
    status: str
    rows: list[dict] = field(default_factory=list)
    seconds: float = 0.0
    note: str = ""


def fetch_live(sources: dict[str, Search], phrases: list[str], cursor: int = 0, limit: int = 25, deadline: float = 8.0, cache: Folder | None = None, keep_seconds: float = 86_400, now: float | None = None) -> list[Outcome]:
    """An outcome per source, in the order of the sources: a page of at most `limit` rows of each.

    The sources are asked at once, and none is waited for beyond the deadline; one that fails or is late leaves the others
    as they are. Answers are kept in `cache` for keep_seconds; those kept are not asked for again."""
    at = time.time() if now is None else now
    out: dict[str, Outcome] = {}
    asked: dict[str, Search] = {}
    for name, search in sources.items():
        kept = json.loads((cache.read(f"{page_key(phrases, name, cursor, limit)}.json") if cache else None) or "null")
        if kept and at - kept["at"] < keep_seconds:
            out[name] = Outcome(name, "cached", kept["rows"])
        else:
            asked[name] = search

    def ask(name: str) -> Outcome:
        began = time.monotonic()
        try:
            rows = list(asked[name](phrases, cursor, limit))[:limit]
            return Outcome(name, "ok", rows, time.monotonic() - began)
        except RateLimited as e:
            return Outcome(name, "limited", [], time.monotonic() - began, str(e))
        except Exception as e:  # a source's failure is its outcome
            return Outcome(name, "failed", [], time.monotonic() - began, f"{type(e).__name__}: {e}")

    pool = ThreadPoolExecutor(max(1, len(asked)))
    jobs = {name: pool.submit(ask, name) for name in asked}
    end = time.monotonic() + deadline
    for name, job in jobs.items():
        try:
            out[name] = job.result(max(0.0, end - time.monotonic()))
        except Late:
            out[name] = Outcome(name, "late", [], deadline)
    pool.shutdown(wait=False, cancel_futures=True)
    for name in asked:
        if cache and out[name].status == "ok":
            cache.write(f"{page_key(phrases, name, cursor, limit)}.json", json.dumps({"at": at, "rows": out[name].rows}))
    return [out[name] for name in sources]


def records_of(spark: SparkSession, outcomes: list[Outcome]) -> DataFrame:
    """Records of the common shape of all outcomes, the pages a request has fetched, with their `paper_id`."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    rows = [tuple(o.source if n == "source" else r.get(n) for n in names) for o in outcomes for r in o.rows]
    got = with_normal_forms(make_records(spark.createDataFrame(rows, RECORD)), ["title"])
    name = record_id(F.col("doi"), F.col("arxiv_id"), F.col("source"), F.col("source_id"), key_of(F.col("__ascii_title")))
    return got.withColumn("paper_id", name).drop("__nfkc_title", "__ascii_title")


def federated_search(
    collection: SearchIndex, store: SearchIndex, queries: list[tuple[int, str]], query_vectors: list[tuple[int, list[float]]],
    phrases: list[tuple[int, str]] | None = None, in_collection: DataFrame | None = None, rel_floor: float = 0.5, cap: int = 50, head: int = 100,
) -> DataFrame:
    """(query_id, doc_id, origin, level, sim, rank): results of the collection and of the store of live records in one list.

    The collection's are those of its hybrid search; the store's are its phrase matches and its most similar records, less
    those that the collection holds (in_collection, of column doc_id). Phrase matches lead (see livestore.federate)."""
    own = hybrid_search(collection, queries, query_vectors, phrases=phrases, top_exact=head, top_related=head).select("query_id", "doc_id", "level", "sim")
    docs = store.docs if in_collection is None else store.docs.join(in_collection.select("doc_id"), "doc_id", "left_anti")
    near, _ = dense_scan(docs, query_vectors, head)
    found = levels_in(docs, phrases or queries)
    every = near.select("query_id", "doc_id", "sim").join(found, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", "level", F.coalesce("sim", F.lit(0.0)).alias("sim"))
    return federate(own, every, rel_floor, cap)


def more_like_this(docs: DataFrame, ids: list[int], k: int, vector: str = "v") -> DataFrame:
    """(query_id, doc_id, sim, rank): the k documents (doc_id, v) most like each of the named ones, itself left out; ids
    that are unknown or without a vector have none. The named documents are the request's own few."""
    asked = [(r.doc_id, list(r[vector])) for r in docs.where(F.col("doc_id").isin(ids) & F.col(vector).isNotNull()).select("doc_id", vector).collect()]
    if not asked:
        return docs.sparkSession.createDataFrame([], "query_id long, doc_id long, sim double, rank int")
    near, _ = dense_scan(docs, asked, k + 1, vector)
    w = Window.partitionBy("query_id").orderBy("rank")
    return near.where("query_id <> doc_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fresh_records(records: DataFrame, collection: DataFrame, key: str = "paper_id") -> DataFrame:
    """Live records that the collection does not know by any identity key; one row per key, that of the most citations."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last("cited_by_count"), F.col("title"), F.col("source"))
    one = records.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return unknown_in(one, collection, key)


def find_rows(store: DataFrame, ids: list[str], key: str = "paper_id") -> DataFrame:
    """The store's rows of the named papers; the filter reaches the scan."""
    return store.where(F.col(key).isin(ids))


def available_sorts(results: DataFrame, least: float = 0.1, citations: str = "cited_by_count", velocity: str = "citation_velocity") -> DataFrame:
    """(sort): the orders that the data can carry: by relevance and date always, by citations and their velocity where a
    tenth of the rows have them."""
    share = lambda c: F.coalesce(F.avg((F.coalesce(F.col(c), F.lit(0)) > 0).cast("double")), F.lit(0.0)) if c in results.columns else F.lit(0.0)
    one = results.agg(share(citations).alias("c"), share(velocity).alias("v"))
    pick: list[Column] = [F.lit("relevance"), F.lit("newest"), F.when(F.col("c") >= least, "most_cited"), F.when(F.col("v") >= least, "citation_velocity")]
    return one.select(F.explode(F.array_compact(F.array(*pick))).alias("sort"))
