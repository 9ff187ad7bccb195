"""Queries on the graph, clusters, growth and map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusweave.functions.ids import bare_id
from corpusweave.functions.text import SEARCH_STOP
from corpusweave.operators import clusters as C
from corpusweave.operators import graph as G
from corpusweave.operators import growth as W
from corpusweave.operators import leads as L
from corpusweave.operators.ingest import latest
from corpusweave.operators.neighbours import all_nearest
from corpusweave.plans.corpus import BARE
from corpusweave.plans.registry import Registry
from corpusweave.plans.search import COS
from corpusweave.runtime import Staging, table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql

POINTS = "pts as (select vec_id as id, coalesce(labels, -1) as cluster_id, list_transform(embeddings, lambda x: x::double) as v from bundle where len(embeddings) = 64 and list_sum(list_transform(embeddings, lambda x: abs(x))) > 0)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bundle").where((F.size("embeddings") == 64) & F.exists("embeddings", lambda x: x != 0))
    return b.select(F.col("vec_id").alias("id"), F.coalesce("labels", F.lit(-1)).alias("cluster_id"), F.col("embeddings").alias("v"))


EDGES = f"""nn as (select a.id as a, b.id as b, {COS.format('a.v', 'b.v')} as sim from pts a join pts b on a.id <> b.id),
  nb as (select a, b, sim from nn qualify row_number() over (partition by a order by round(sim, 9) desc, b) <= 6),
  ed as (select least(a, b) as src, greatest(a, b) as dst, max(sim) as weight from nb group by all)"""


def _edges(spark: SparkSession, d: str, asked: Column | None = None) -> DataFrame:
    """The edges that the neighbours of all points give, or only those of the points that are asked."""
    return Staging(spark).write(G.undirected(all_nearest(_points(spark, d), 6, asked=asked)), "edges")


@_R.add(f"with {POINTS}, {EDGES} select src, dst, round(weight, 6) as weight from ed")
def paper_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("src", "dst", F.round("weight", 6).alias("weight"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 1000 + 1).alias("id"), (F.col("l_partkey") % 97).alias("ref"))


@_R.add(f"""with {POINTS}, {EDGES}, rf as (select distinct l_orderkey % 1000 + 1 as id, l_partkey % 97 as ref from lineitem),
  co as (select src, dst, count(*) as shared from ed join rf x on x.id = src join rf y on y.id = dst and y.ref = x.ref group by all)
  select src, dst, round(weight + least(0.5, coalesce(shared, 0) * 0.15), 6) as weight, coalesce(shared, 0) as shared from ed left join co using (src, dst)""")
def coupling_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.coupling(_edges(spark, d), _references(spark, d)).select("src", "dst", F.round("weight", 6).alias("weight"), "shared")


@_R.add(f"with {POINTS}, {EDGES} select node, count(*) as degree from (select src as node from ed union all select dst from ed) group by 1")
def node_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.node_degree(_edges(spark, d))


@_R.add(f"""with recursive {POINTS}, {EDGES}, ad as (select src as a, dst as b from ed union select dst, src from ed),
  bfs(node, depth) as (select min(id), 0 from pts union select b, depth + 1 from bfs join ad on a = node where depth < 3)
  select node, min(depth) as depth from bfs group by 1""")
def graph_bfs(spark: SparkSession, d: str) -> DataFrame:
    start = _points(spark, d).agg(F.min("id").alias("node"))
    return G.neighbourhood(_edges(spark, d), start, 3)


@_R.add(f"""with {POINTS}, {EDGES} select least(x.cluster_id, y.cluster_id) as a, greatest(x.cluster_id, y.cluster_id) as b, round(sum(weight), 6) as weight, count(*) as n_edges
  from ed join pts x on x.id = src join pts y on y.id = dst where x.cluster_id <> y.cluster_id and x.cluster_id >= 0 and y.cluster_id >= 0 group by 1, 2""")
def area_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.area_edges(_edges(spark, d), _points(spark, d).select("id", "cluster_id")).withColumn("weight", F.round("weight", 6))


@_R.add(f"with {POINTS}, {EDGES}, kept as (select id from pts where cluster_id between 0 and 3) select src, dst from ed where src in (select id from kept) and dst in (select id from kept)")
def induced_edges(spark: SparkSession, d: str) -> DataFrame:
    kept = F.col("cluster_id").between(0, 3)
    nodes = _points(spark, d).where(kept).select(F.col("id").alias("node"))
    return G.within(_edges(spark, d, kept), nodes).select("src", "dst")  # an edge of two kept nodes is of a neighbour of one of them


_UNIT = "un as (select id, cluster_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from pts where cluster_id >= 0), el as (select id, cluster_id, unnest(u) as x, generate_subscripts(u, 1) as i from un), mn as (select cluster_id, i, avg(x) as m from el group by all), ce as (select cluster_id, list(m order by i) as c from mn group by 1), si as (select id, cluster_id, list_dot_product(u, c) / sqrt(list_dot_product(c, c)) as sim from un join ce using (cluster_id))"


@_R.add(f"with {POINTS}, {_UNIT} select cluster_id, count(*) as size, round(avg(sim), 6) as cohesion from si group by 1")
def centroid_cohesion(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return C.to_centroid(p, C.centroids(p)).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("sim"), 6).alias("cohesion"))


@_R.add(f"with {POINTS}, {_UNIT} select cluster_id, id, rank from (select *, row_number() over (partition by cluster_id order by round(sim, 9) desc, id) as rank from si) where rank <= 5")
def representative_members(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return C.representatives(C.to_centroid(p, C.centroids(p))).select("cluster_id", "id", F.col("rank").cast("long").alias("rank"))


@_R.add(f"with {POINTS} select count(*) as n, count(*) filter (cluster_id = -1) as noise, round(avg((cluster_id = -1)::int), 6) as noise_fraction from pts")
def noise_fraction(spark: SparkSession, d: str) -> DataFrame:
    noise = (F.col("cluster_id") == -1).cast("int")
    return _points(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum(noise).alias("noise"), F.round(F.avg(noise), 6).alias("noise_fraction"))


_STOPS = "[" + ", ".join(f"'{w}'" for w in SEARCH_STOP) + "]"
_TERMS = f"""cd as (select b.vec_id as doc_id, b.labels as cluster_id, lower(concat_ws('. ', p.title, p.abstract)) as t from bundle b
    join (select *, {BARE} as bid, row_number() over (partition by {BARE} order by coalesce(version, 1) desc, row_id) as rn from papers) p on p.bid = b.arxiv_id and p.rn = 1 where b.labels >= 0),
  lw as (select doc_id, cluster_id, list_filter(regexp_extract_all(t, '[a-z0-9_]{{2,}}'), lambda x: not list_contains({_STOPS}, x)) as ws from cd),
  w1 as (select doc_id, cluster_id, unnest(ws) as w, generate_subscripts(ws, 1) as pos from lw),
  dt as (select doc_id, cluster_id, w as term from w1 union all select doc_id, cluster_id, w || ' ' || n from (select *, lead(w) over (partition by doc_id order by pos) as n from w1) where n is not null),
  tf as (select cluster_id, term, count(*) as tf from dt group by all), vo as (select term from tf group by 1 order by sum(tf) desc, term limit 10000), tv as (select * from tf where term in (select term from vo)),
  wc as (select cluster_id, sum(tf) as words from tv group by 1), mw as (select avg(words) as m from wc), dfc as (select term, count(*) as df from tv group by 1),
  sc as (select cluster_id, term, tf / words * ln(1 + m / df) as score from tv join dfc using (term) join wc using (cluster_id), mw),
  kw as (select cluster_id, term, score, row_number() over (partition by cluster_id order by round(score, 12) desc, term) as rank from sc where score > 0 qualify rank <= 8)"""


def _terms(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").withColumn("bid", bare_id(F.col("arxiv_id")))
    p = latest(p, ["bid"], [F.coalesce("version", F.lit(1)).desc(), F.asc("row_id")]).select("bid", F.concat_ws(". ", "title", "abstract").alias("t"))
    docs = table(spark, d, "bundle").where("labels >= 0").select(F.col("vec_id").alias("doc_id"), F.col("labels").alias("cluster_id"), F.col("arxiv_id").alias("bid")).join(p, "bid")
    return C.label_terms(docs, F.col("t"))


@_R.add(f"with {_TERMS} select cluster_id, term, round(score, 6) as score, rank from kw")
def ctfidf_keywords(spark: SparkSession, d: str) -> DataFrame:
    return C.keywords(C.class_tfidf(_terms(spark, d))).select("cluster_id", "term", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@_R.add(f"""with {_TERMS}, nd as (select count(distinct doc_id) as n from dt), pr as (select distinct doc_id, term from dt where term in (select term from kw)), p as (select term, count(*) / n as p from pr, nd group by term, n),
  jt as (select a.term as ta, b.term as tb, count(*) / n as pij from pr a join pr b on a.doc_id = b.doc_id and a.term < b.term, nd group by a.term, b.term, n),
  pa as (select a.cluster_id, a.term as ta, b.term as tb from kw a join kw b on a.cluster_id = b.cluster_id and a.term < b.term)
  select cluster_id, round(avg(case when pij is null then -1.0 when pij >= 1 then 1.0 else ln(pij / (x.p * y.p)) / -ln(pij) end), 6) as npmi from pa left join jt using (ta, tb) left join p x on x.term = ta left join p y on y.term = tb group by 1""")
def npmi_coherence(spark: SparkSession, d: str) -> DataFrame:
    terms = _terms(spark, d)
    n = terms.select("doc_id").distinct().count()
    return C.npmi(terms, C.keywords(C.class_tfidf(terms)), n).select("cluster_id", F.round("npmi", 6).alias("npmi"))


@_R.add(f"with {_TERMS} select count(distinct term) as n_terms, round(count(distinct term) / count(*), 6) as diversity from kw")
def keyword_diversity(spark: SparkSession, d: str) -> DataFrame:
    k = C.keywords(C.class_tfidf(_terms(spark, d)))
    return k.agg(F.countDistinct("term").alias("n_terms"), F.round(F.countDistinct("term") / F.count("term"), 6).alias("diversity"))


@_R.add()
def area_labels(spark: SparkSession, d: str) -> DataFrame:
    return C.area_labels(C.keywords(C.class_tfidf(_terms(spark, d))))


_TWO = "tw as (select vec_id as id, labels as a, case when vec_id % 7 = 0 then (labels + 1) % 5 else labels end as b from bundle where labels is not null)"


def _two(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bundle").where("labels is not null")
    return b.select(F.col("vec_id").alias("id"), F.col("labels").alias("a"), F.expr("case when vec_id % 7 = 0 then (labels + 1) % 5 else labels end").alias("b"))


@_R.add(f"""with {_TWO}, c as (select a, b, count(*) as n from tw group by all), t as (select sum(n * (n - 1) / 2) as ij, sum(n) as t from c),
  x as (select sum(n * (n - 1) / 2) as ai from (select sum(n) as n from c group by a)), y as (select sum(n * (n - 1) / 2) as bj from (select sum(n) as n from c group by b))
  select round((ij - ai * bj / (t * (t - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (t * (t - 1) / 2)), 9) as ari from t, x, y""")
def adjusted_rand(spark: SparkSession, d: str) -> DataFrame:
    return C.adjusted_rand(_two(spark, d), "a", "b").select(F.round("ari", 9).alias("ari"))


@_R.add(f"""with {_TWO}, sa as (select a, count(*) as na from tw where a >= 0 group by 1), sb as (select b, count(*) as nb from tw where b >= 0 group by 1),
  j as (select a, max(n / (na + nb - n)) as j from (select a, b, count(*) as n from tw where a >= 0 and b >= 0 group by all) join sa using (a) join sb using (b) group by 1)
  select a as cluster_id, round(coalesce(j, 0), 9) as best_jaccard, coalesce(j, 0) >= 0.5 as survives from sa left join j using (a)""")
def cluster_survival(spark: SparkSession, d: str) -> DataFrame:
    return C.survival(_two(spark, d), "a", "b").withColumn("best_jaccard", F.round("best_jaccard", 9))


@_R.add(f"""with recursive {POINTS}, sz as (select cluster_id as c, count(*) as n from pts where cluster_id >= 0 group by 1), so as (select labels as c, count(*) as n from bundle where labels >= 0 group by 1)
  select c::int as cluster_id, (c + 10)::int as matched_id from sz""")
def match_clusters(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    old = table(spark, d, "bundle").where("labels is not null").select(F.col("vec_id").alias("id"), F.expr("case when labels >= 0 then labels + 10 else -1 end").alias("old_id"))
    return C.match_clusters(p, old)[0]


@_R.add()
def repacked_clusters(spark: SparkSession, d: str) -> DataFrame:
    return C.repack(_points(spark, d).select("id", "cluster_id"), 40)


SQL["repacked_clusters"] = f"""with {POINTS}, s as (select cluster_id, row_number() over (order by cluster_id) - 1 as n from (select cluster_id from pts where cluster_id >= 0 group by 1 having count(*) >= 40))
  select id, coalesce(n, -1)::int as cluster_id from pts left join s using (cluster_id)"""


@_R.add()
def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    return C.reduce_dims(_points(spark, d), 2).select("id", F.col("r")[0].alias("x"), F.col("r")[1].alias("y"))


@_R.add()
def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    p = C.reduce_dims(_points(spark, d), 8).select("id", F.col("r").alias("v"))
    return C.kmeans(p, [8, 12]).select("id", "cluster_id")


@_R.add(f"""with recursive {POINTS}, nn as (select a.id as a, b.id as b, {COS.format('a.v', 'b.v')} as s from pts a join pts b on a.id <> b.id and sqrt(greatest(0, 2 - 2 * {COS.format('a.v', 'b.v')})) <= 0.9),
  co as (select a as id from nn group by 1 having count(*) + 1 >= 5), ad as (select a, b from nn where a in (select id from co) and b in (select id from co)),
  lb(a, m, k) as (select id, id, 0 from co union all select lb.a, least(min(lb.m), coalesce(min(o.m), min(lb.m))), max(lb.k) + 1 from lb left join ad on ad.a = lb.a left join lb o on o.a = ad.b where lb.k < 12 group by lb.a),
  cl as (select a as id, m as cluster from lb where k = 12),
  ri as (select a as id, arg_max(cluster, s) as cluster from nn join cl on cl.id = nn.b where a not in (select id from co) group by 1), al as (select * from cl union all select * from ri),
  nm as (select cluster, row_number() over (order by cluster) - 1 as n from (select distinct cluster from cl))
  select pts.id, coalesce(n, -1) as cluster_id from pts left join al using (id) left join nm using (cluster)""")
def dbscan_clusters(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).select("id", "v")
    return C.dbscan(p, 0.9, 5, 64)


@_R.add(f"""with {POINTS}, nn as (select a.id, sqrt(greatest(0, 2 - 2 * {COS.format('a.v', 'b.v')})) as kd, row_number() over (partition by a.id order by round({COS.format('a.v', 'b.v')}, 9) desc, b.id) as r from pts a join pts b on a.id <> b.id),
  k as (select kd as y, row_number() over (order by kd) - 1 as x from nn where r = 5), e as (select max(x) as x1, min(y) as y0, max(y) as y1 from k)
  select round(arg_max(y, abs((y1 - y0) * x - x1 * (y - y0))), 6) as knee from k, e""")
def k_distance_knee(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).select("id", "v")
    return C.knee(C.k_distances(p, 5, 64), "kd").select(F.round("knee", 6).alias("knee"))


def _flat(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).select("id", "cluster_id", F.col("v")[0].cast("double").alias("x"), F.col("v")[1].cast("double").alias("y"))


_XY = f"{POINTS}, xy as (select id, cluster_id, v[1] as x, v[2] as y from pts)"


@_R.add(f"""with {_XY}, dn as (select a.id, count(b.id) as density from xy a left join xy b on a.id <> b.id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02 group by 1)
  select id, density from dn where density <= (select quantile_cont(density, 0.2) from dn)""")
def radius_density_percentile(spark: SparkSession, d: str) -> DataFrame:
    return L.low_density(_flat(spark, d), 20, 0.02)


@_R.add(f"with {_XY} select cluster_id, count(*) as n, round(avg(x), 6) as x, round(avg(y), 6) as y from xy where cluster_id >= 0 group by 1")
def area_bubbles(spark: SparkSession, d: str) -> DataFrame:
    return L.area_bubbles(_flat(spark, d)).select("cluster_id", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@_R.add("""with n as (select o_orderpriority, count(*) as n, sum(count(*)) over () as t from orders group by 1), q as (select o_orderpriority, greatest(1, round(500 * n / greatest(500, t)))::int as q from n)
  select o_orderkey from (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as rn from orders) join q using (o_orderpriority) where rn <= q""")
def quota_sample_map(spark: SparkSession, d: str) -> DataFrame:
    return L.quota_sample(table(spark, d, "orders"), 500, "o_orderpriority", "o_totalprice", "o_orderkey").select("o_orderkey")


@_R.add()
def sparse_leads(spark: SparkSession, d: str) -> DataFrame:
    rows = L.sparse_leads(_points(spark, d), 64)
    return spark.createDataFrame([(r["id"], float(r["x"]), float(r["y"]), float(r["robustness"]), r["nearest_cluster"]) for r in rows], "anchor long, x double, y double, robustness double, nearest_cluster int")


def _dated(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderdate").alias("date"), F.substring("o_orderpriority", 1, 1).cast("int").alias("cluster_id"), (1 + F.col("o_orderkey") % 3).cast("double").alias("sample_weight"))


_DATED = "dt as (select o_orderdate as date, left(o_orderpriority, 1)::int as cluster_id, (1 + o_orderkey % 3)::double as w from orders)"


def growth_sql(windows: list[int], back: list[int]) -> str:
    pairs = ", ".join(f"({w}, {b})" for w in windows for b in back)
    return f"""{_DATED}, en as (select max(date) as l, min(date) as f from dt), pl as (select * from (values {pairs}) p(months, back)),
  ra as (select months, back, cluster_id, w, f, date, l - to_months(back) as r0, l - to_months(back + months) as r1, l - to_months(back + 2 * months) as r2 from dt, en, pl),
  ct as (select months, back, cluster_id, count(*) filter (date > r1 and date <= r0) as recent, count(*) filter (date > r2 and date <= r1) as previous,
    coalesce(sum(w) filter (date > r1 and date <= r0), 0.0) as recent_w, coalesce(sum(w) filter (date > r2 and date <= r1), 0.0) as previous_w, any_value(f <= r2) as sufficient from ra group by all),
  al as (select months, back, sum(recent_w) as ca, sum(previous_w) as cb from ct group by all),
  gr as (select ct.*, sufficient and recent >= 10 and previous >= 10 as gate, case when previous_w > 0 then recent_w / previous_w end as raw, case when cb > 0 then ca / cb end as base from ct join al using (months, back))"""


@_R.add(f"with {growth_sql([3, 6, 12], [0])} select cluster_id, months, recent, previous, round(recent_w, 2) as recent_w, round(previous_w, 2) as previous_w, sufficient, gate as passes_gate, round(case when gate then raw end, 6) as raw_growth, round(case when gate and base > 0 then raw / base end, 6) as relative_growth from gr")
def growth_windows(spark: SparkSession, d: str) -> DataFrame:
    g = W.relative_growth(_dated(spark, d), "date", "cluster_id", [3, 6, 12])
    return g.select("cluster_id", "months", "recent", "previous", F.round("recent_w", 2).alias("recent_w"), F.round("previous_w", 2).alias("previous_w"), "sufficient", "passes_gate", F.round("raw_growth", 6).alias("raw_growth"), F.round("relative_growth", 6).alias("relative_growth"))


@_R.add(f"with {_DATED} select cluster_id, strftime(date, '%Y-%m') as year_month, false as whole, count(*) as n, round(sum(w), 2) as weight from dt group by all union all select null, strftime(date, '%Y-%m'), true, count(*), round(sum(w), 2) from dt group by 2")
def monthly_counts(spark: SparkSession, d: str) -> DataFrame:
    return W.monthly_counts(_dated(spark, d), "date", "cluster_id").withColumn("weight", F.round("weight", 2))


@_R.add(f"""with {growth_sql([3, 6, 12], [0, 3, 6])}, r as (select cluster_id, months, back, case when gate and base > 0 then raw / base end as g from gr),
  x as (select cluster_id, case when count(g) >= 2 and avg(g) > 0 then stddev_pop(g) / avg(g) end as cw from r where back = 0 group by 1), y as (select cluster_id, case when count(g) >= 2 and avg(g) > 0 then stddev_pop(g) / avg(g) end as cc from r where months = 6 group by 1)
  select cluster_id, round(cw, 6) as cv_windows, round(cc, 6) as cv_cutoffs, coalesce(cc <= 0.5 and (cw is null or cw <= 0.5), false) as stable from x join y using (cluster_id)""")
def growth_stability_cv(spark: SparkSession, d: str) -> DataFrame:
    s = W.growth_stability(_dated(spark, d), "date", "cluster_id", [3, 6, 12], 6, [3, 6])
    return s.select("cluster_id", F.round("cv_windows", 6).alias("cv_windows"), F.round("cv_cutoffs", 6).alias("cv_cutoffs"), "stable")


@_R.add(f"""with {growth_sql([6], [0])} select count(*) as evaluated, round(avg((recent_w / ca > previous_w / cb)::int), 6) as hit_rate from gr join al using (months, back) where cluster_id in (1, 2, 3) and previous_w > 0 and ca > 0 and cb > 0""")
def growth_backtest(spark: SparkSession, d: str) -> DataFrame:
    flagged = spark.createDataFrame([(1,), (2,), (3,)], "cluster_id int")
    return W.backtest(_dated(spark, d), "date", "cluster_id", 6, flagged).withColumn("hit_rate", F.round("hit_rate", 6))


@_R.add(f"""with {growth_sql([3, 6, 12], [0, 3, 6])}, r as (select cluster_id, months, back, case when gate and base > 0 then raw / base end as g from gr),
  x as (select cluster_id, case when count(g) >= 2 and avg(g) > 0 then stddev_pop(g) / avg(g) end as cw from r where back = 0 group by 1), y as (select cluster_id, case when count(g) >= 2 and avg(g) > 0 then stddev_pop(g) / avg(g) end as cc from r where months = 6 group by 1),
  st as (select cluster_id, coalesce(cc <= 0.5 and (cw is null or cw <= 0.5), false) as stable from x join y using (cluster_id))
  select cluster_id, months, gate as passes_gate, round(g, 6) as growth, stable, coalesce(gate and g is not null and stable, false) as reliable, true as inside from r join gr using (cluster_id, months, back) join st using (cluster_id) where back = 0""")
def growth_overview(spark: SparkSession, d: str) -> DataFrame:
    """Every part of growth in one table; `inside` says that an interval lies around its value and the trend around its own."""
    got = W.growth_overview(_dated(spark, d), "date", "cluster_id", [3, 6, 12])
    around = lambda x, low, high: F.col(low).isNull() | F.col(x).between(F.col(low), F.col(high))
    inside = around("relative_growth", "ci_low", "ci_high") & around("annual_ratio", "trend_low", "trend_high")
    return got.select("cluster_id", "months", "passes_gate", F.round("relative_growth", 6).alias("growth"), "stable", "reliable", inside.alias("inside"))


@_R.add()
def poisson_trend(spark: SparkSession, d: str) -> DataFrame:
    return W.poisson_trends(_dated(spark, d), "date", "cluster_id")


@_R.add()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    g = W.relative_growth(_dated(spark, d), "date", "cluster_id", [6])
    return W.bootstrap_intervals(g).select("cluster_id", "months", "ci_low", "ci_high", "direction")


@_R.add(f"""with {growth_sql([6], [0])}, z as (select cluster_id, count(*) as size, count(*) / sum(count(*)) over () as share from dt group by 1)
  select cluster_id, size, round(share, 6) as share, round(case when gate and base > 0 then raw / base end, 6) as growth, case when not sufficient then 'history too short' when not gate then 'too few papers' else 'measured' end as reason, row_number() over (order by case when gate and base > 0 then raw / base end desc nulls last, size desc, cluster_id) as position from z join gr using (cluster_id)""")
def trend_table(spark: SparkSession, d: str) -> DataFrame:
    df = _dated(spark, d)
    size = df.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    share = size.withColumn("share", F.round(F.col("size") / F.sum("size").over(Window.partitionBy()), 6))
    g = W.relative_growth(df, "date", "cluster_id", [6]).select("cluster_id", F.col("relative_growth").alias("g"), "sufficient", "passes_gate")
    w = Window.orderBy(F.desc_nulls_last("g"), F.desc("size"), "cluster_id")
    reason = F.when(~F.col("sufficient"), "history too short").when(~F.col("passes_gate"), "too few papers").otherwise("measured")
    return share.join(g, "cluster_id").select("cluster_id", "size", "share", F.round("g", 6).alias("growth"), reason.alias("reason"), F.row_number().over(w).cast("long").alias("position"))


@_R.add(f"""with {POINTS}, z as (select cluster_id, count(*) as size from pts where cluster_id >= 0 group by 1) select cluster_id, size, (row_number() over (order by size desc, cluster_id) - 1) % 12 as colour from z""")
def area_table(spark: SparkSession, d: str) -> DataFrame:
    size = _points(spark, d).where("cluster_id >= 0").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return size.withColumn("colour", ((F.row_number().over(Window.orderBy(F.desc("size"), "cluster_id")) - 1) % 12).cast("long"))
