"""Queries behind views: areas, workspace, readiness, tiles, similar papers and federated results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.operators import areas as A
from corpusweave.operators import federate as E
from corpusweave.operators import growth as W
from corpusweave.operators import retrieval as R
from corpusweave.operators import validation as V
from corpusweave.operators.livestore import federate
from corpusweave.plans.analysis import POINTS, _dated, _points, growth_sql
from corpusweave.plans.registry import Registry
from corpusweave.plans.search import ASKED, COS, DOCS, _LIST, _SIM, _asked_vectors, _docs, _index
from corpusweave.runtime import Staging, table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql


def _papers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "live_store")
    return s.select(F.col("row_id").alias("id"), (F.col("row_id") % 9 - 1).cast("int").alias("cluster_id"), "primary_category", F.col("added_at").alias("date"), "cited_by_count", "title", "abstract", "authors")


_PAPERS = "pp as (select row_id as id, (row_id % 9 - 1)::int as cluster_id, primary_category, added_at as date, cited_by_count, title, abstract, authors from live_store)"


@_R.add("select p_partkey as area, p_name as name from part where contains(lower(concat_ws(' ', p_name, p_brand)), 'brand#1')")
def area_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("area"), F.col("p_name").alias("name"), F.col("p_brand").alias("keywords"))
    return A.area_filter(p, " BRAND#1").drop("keywords")


@_R.add(f"""with {_PAPERS}, f as (select * from pp where cluster_id in (1, 2, 3) and primary_category in ('cs.LG', 'cs.CL'))
  select id, row_number() over (order by cited_by_count desc nulls last, date desc nulls last, id) as place from f order by 2 limit 400""")
def workspace_list(spark: SparkSession, d: str) -> DataFrame:
    return A.workspace(_papers(spark, d), [1, 2, 3], ["cs.LG", "cs.CL"], "cited").select("id", F.col("place").cast("long").alias("place"))


@_R.add(f"""with {_PAPERS}, {growth_sql([6], [0])}, q as (select avg((coalesce(cited_by_count, 0) > 0)::int) as c, avg((cited_by_count is not null)::int) as v from pp)
  select round(c, 6) as citation_coverage, round(v, 6) as velocity_coverage, c >= 0.1 as citations_ready, v >= 0.1 as velocity_ready, (select bool_or(sufficient) from gr) as growth_ready, (select bool_or(gate and cluster_id <> 2) from gr) as growth_reliable from q""")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    p = _papers(spark, d).withColumn("citation_velocity", F.col("cited_by_count"))
    g = W.relative_growth(_dated(spark, d), "date", "cluster_id", [6]).withColumn("stable", F.col("cluster_id") != 2)
    return A.readiness(p, g).withColumns({c: F.round(c, 6) for c in ("citation_coverage", "velocity_coverage")})


@_R.add(f"with {growth_sql([6], [0])} select count(*) as clusters, count(*) filter (gate) as gated_in, count(*) filter (cluster_id = 2) as unstable, count(*) filter (gate and cluster_id <> 2) as reliable from gr where cluster_id >= 0")
def growth_report(spark: SparkSession, d: str) -> DataFrame:
    g = W.relative_growth(_dated(spark, d), "date", "cluster_id", [6])
    return V.growth_report(g, g.select("cluster_id", (F.col("cluster_id") != 2).alias("stable")))


@_R.add("select count(*) as n_papers, count(*) filter (trim(coalesce(authors, '')) <> '') as with_authors, 0 as with_references, count(*) filter (cited_by_count > 0) as with_citations from live_store")
def corpus_coverage(spark: SparkSession, d: str) -> DataFrame:
    return V.coverage(table(spark, d, "live_store"))


@_R.add(f"""with {_PAPERS} select count(*) as n_papers, count(distinct case when cluster_id >= 0 then cluster_id end) as n_areas, strftime(min(date), '%Y-%m-%d') as first_day, strftime(max(date), '%Y-%m-%d') as last_day,
  round(datediff('day', min(date), max(date)) / 30.44, 1) as span_months, round(avg((coalesce(cited_by_count, 0) > 0)::int), 6) as with_citations, datediff('day', max(date)::date, date '2026-01-01') as age_days from pp""")
def dataset_tiles(spark: SparkSession, d: str) -> DataFrame:
    t = A.dataset_tiles(_papers(spark, d), F.lit("2026-01-01").cast("date"))
    return t.withColumns({"first_day": F.col("first_day").cast("string"), "last_day": F.col("last_day").cast("string"), "with_citations": F.round("with_citations", 6)})


@_R.add(f"""with {_PAPERS}, c as (select cluster_id, primary_category, row_number() over (partition by cluster_id order by count(*) desc, primary_category) as r from pp where cluster_id >= 0 and primary_category is not null group by cluster_id, primary_category)
  select cluster_id, array_to_string(list(primary_category order by r), ' ') as categories from c where r <= 3 group by 1""")
def top_categories(spark: SparkSession, d: str) -> DataFrame:
    return A.top_categories(_papers(spark, d)).withColumn("categories", F.array_join("categories", " "))


@_R.add("""with s as (select distinct paper_id from live_store where row_id % 3 = 0), t as (select paper_id from live_store where row_id % 2 = 0 group by 1 having count(*) % 2 = 1)
  select paper_id from s where paper_id not in (select paper_id from t) union select paper_id from t where paper_id not in (select paper_id from s)""")
def reading_list(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "live_store")
    return A.toggled(s.where("row_id % 3 = 0").select("paper_id"), s.where("row_id % 2 = 0").select("paper_id"))


@_R.add("""with r as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as k, count(*) over () as n from orders) select o_orderkey from r, (select unnest(range(0, 5)) as i) where k = round_even(i * (n - 1) / 4, 0)""")
def probe_rows(spark: SparkSession, d: str) -> DataFrame:
    return A.probe_rows(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)


@_R.add(f"with {_PAPERS}, r as (select id from pp where cluster_id >= 0 qualify row_number() over (partition by cluster_id order by id) <= 5) select id, title, length(coalesce(abstract, '')) as chars from r left join pp using (id)")
def representative_texts(spark: SparkSession, d: str) -> DataFrame:
    from corpusweave.operators.ranks import first_of_groups

    p = _papers(spark, d)
    first = first_of_groups(p.where("cluster_id >= 0").select("id", "cluster_id"), ["cluster_id"], [F.col("id")], 5, "id")
    return A.representatives_with_text(first.select("id"), p).select("id", "title", F.length(F.coalesce("abstract", F.lit(""))).alias("chars"))


@_R.add("""select row_id, case when trim(coalesce(arxiv_id, '')) <> '' then 'https://arxiv.org/abs/' || trim(arxiv_id) when trim(coalesce(doi, '')) <> '' then 'https://doi.org/' || trim(doi) when trim(coalesce(url, '')) <> '' then trim(url) end as url from live_store""")
def paper_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "live_store").select("row_id", A.paper_url(F.col("arxiv_id"), F.col("doi"), F.col("url")).alias("url"))


_LIKE = f"""{DOCS}, aq as (select doc_id as query_id, v as qv from docs order by doc_id limit 6), ls as (select query_id, doc_id, {COS.format('v', 'qv')} as sim from docs, aq where doc_id <> query_id)"""


@_R.add(f"with {_LIKE} select query_id, doc_id, round(sim, 6) as sim, rank from (select *, row_number() over (partition by query_id order by round(sim, 9) desc, doc_id) as rank from ls) where rank <= 12")
def more_like_this(spark: SparkSession, d: str) -> DataFrame:
    docs = Staging(spark).write(_docs(spark, d).select("doc_id", "v"), "docs")
    ids = [r.doc_id for r in docs.select("doc_id").orderBy("doc_id").limit(6).collect()]
    return E.more_like_this(docs, ids, 12).select("query_id", "doc_id", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@_R.add()
def federated_results(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the documents as the collection, the others as the store of live records, searched as one."""
    index = _index(spark, d)
    part = lambda where: R.SearchIndex(index.docs.where(where), index.lexical)
    got = E.federated_search(part("doc_id % 3 <> 0"), part("doc_id % 3 = 0"), ASKED, _asked_vectors(index.docs))
    return got.select("query_id", "doc_id", "origin", "level", F.round("sim", 6).alias("sim"), "rank")


@_R.add("""with r as (select o_orderpriority as origin, o_custkey % 5 as query_id, o_orderkey as doc_id, case when o_orderkey % 11 = 0 then 1 + o_orderkey % 3 end as level, o_totalprice / 1000000 as sim from orders where o_orderpriority in ('1-URGENT', '2-HIGH')),
  b as (select *, avg(sim) over w as base, max(sim) over w as best, count(*) over w as n from r window w as (partition by query_id, level is null)),
  k as (select *, row_number() over (partition by query_id order by level nulls last, sim desc, doc_id) as rank from b where level is not null or n < 2 or sim >= base + 0.5 * (best - base))
  select query_id, doc_id, case origin when '1-URGENT' then 'collection' else 'store' end as origin, level, round(sim, 6) as sim, rank from k where rank <= 50""")
def federated_ranking(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderpriority", (F.col("o_custkey") % 5).alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.expr("case when o_orderkey % 11 = 0 then cast(1 + o_orderkey % 3 as int) end").alias("level"), (F.col("o_totalprice") / 1000000).alias("sim"))
    side = lambda p: o.where(F.col("o_orderpriority") == p).drop("o_orderpriority")
    got = federate(side("1-URGENT"), side("2-HIGH"))
    return got.select("query_id", "doc_id", "origin", "level", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@_R.add(f"""with {POINTS}, z as (select count(*) filter (cluster_id = -1) / count(*) as noise from pts)
  select gate, round(value, 6) as value, passed, required from (
    select 'max_noise_fraction' as gate, noise as value, noise <= 0.35 as passed, true as required from z
    union all select 'min_span_months', round(datediff('day', min(o_orderdate), max(o_orderdate)) / 30.44, 1), round(datediff('day', min(o_orderdate), max(o_orderdate)) / 30.44, 1) >= 24, true from orders
    union all select 'min_ann_recall', null, false, false union all select 'quality_checks', 0, true, false)""")
def release_gates(spark: SparkSession, d: str) -> DataFrame:
    from corpusweave.operators.ingest import snapshot_stats

    noise = _points(spark, d).agg(F.avg((F.col("cluster_id") == -1).cast("int")).alias("noise_fraction"))
    stats = snapshot_stats(table(spark, d, "orders"), "o_orderdate", "o_orderpriority").select("span_months")
    metrics = V.metrics_of(noise=noise, stats=stats, quality=spark.sql("select 0 as quality_failures"))
    limits = spark.createDataFrame([("max_noise_fraction", 0.35, True), ("min_span_months", 24.0, True), ("min_ann_recall", 0.95, False)], "gate string, limit double, required boolean")
    return V.evaluate_gates(metrics, limits).select("gate", F.round("value", 6).alias("value"), "passed", "required")


@_R.add(f"""with {DOCS}, {_SIM}, {_LIST.format('dn', 'sim', 'sims', 25)}, gd as (select query_id, doc_id, (labels % 3)::int as grade from docs, (select distinct query_id from sims) where labels >= 0),
  md as (select 'dense' as mode, * from dn union all select 'late', query_id, doc_id, 26 - rank from dn),
  h as (select md.*, coalesce(grade, 0) as grade from md left join gd using (query_id, doc_id)),
  a as (select mode, query_id, sum(case when rank <= 10 then (power(2, grade) - 1) / log2(rank + 1) end) as dcg, avg(case when rank <= 10 then (grade >= 1)::int end) as p, min(case when grade >= 1 then rank end) as f, count(*) filter (grade >= 2) as found from h group by 1, 2),
  i as (select query_id, sum((power(2, grade) - 1) / log2(r + 1)) as idcg from (select *, row_number() over (partition by query_id order by grade desc, doc_id) as r from gd where grade > 0) where r <= 10 group by 1),
  o as (select query_id, count(*) filter (grade >= 2) as pool from gd group by 1)
  select mode, count(*) as n_queries, round(avg(dcg / idcg), 6) as search_ndcg, round(avg(p), 6) as search_precision, round(avg(coalesce(1.0 / f, 0)), 6) as search_mrr, round(avg(case when pool > 0 then found / least(25, pool) end), 6) as search_recall
  from a left join i using (query_id) left join o using (query_id) group by 1""")
def search_report(spark: SparkSession, d: str) -> DataFrame:
    """Two modes of search graded together: the dense ranking and the same read backwards."""
    docs = Staging(spark).write(_docs(spark, d).select("doc_id", "labels", "v"), "docs")
    top, _ = R.dense_scan(docs, _asked_vectors(docs), 25)
    grades = docs.where("labels >= 0").crossJoin(F.broadcast(spark.range(1, 5).withColumnRenamed("id", "query_id"))).select("query_id", "doc_id", (F.col("labels") % 3).cast("int").alias("grade"))
    runs = top.select(F.lit("dense").alias("mode"), "query_id", "doc_id", "rank").unionByName(top.select(F.lit("late").alias("mode"), "query_id", "doc_id", (26 - F.col("rank")).alias("rank")))
    m = V.search_report(runs, grades)
    return m.select("mode", "n_queries", *(F.round(c, 6).alias(c) for c in ("search_ndcg", "search_precision", "search_mrr", "search_recall")))


@_R.add("select paper_id, row_id, title from live_store where paper_id in ('2401.00001', '0708.77205') or paper_id like 'openalex:W700000%'")
def found_records(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "live_store")
    ids = [r.paper_id for r in s.where("paper_id like 'openalex:W700000%'").select("paper_id").distinct().collect()]
    return E.find_rows(s, [*ids, "2401.00001", "0708.77205"]).select("paper_id", "row_id", "title")
