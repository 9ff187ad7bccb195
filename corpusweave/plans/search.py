"""Queries on retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions import text as X
from corpusweave.functions.ids import bare_id
from corpusweave.operators import acronyms as A
from corpusweave.operators import retrieval as R
from corpusweave.operators import validation as V
from corpusweave.operators.ingest import latest
from corpusweave.plans.corpus import BARE, COMPATIBLE
from corpusweave.plans.registry import Registry
from corpusweave.runtime import Staging, table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql

#: The request that the search queries answer.
ASKED = [(1, "spam triage"), (2, "drone navigation"), (3, "gait analysis"), (4, "schema migrations")]
LONGER = [(1, "robust spam triage for mixed workloads"), (2, "drone navigation with a causal event simulator"), (3, "gait analysis under label noise"), (4, "index factorisation")]


def asked_sql(rows: list[tuple[int, str]]) -> str:
    return "(values " + ", ".join(f"({i}, '{t}')" for i, t in rows) + ") as q(query_id, qt)"


#: Whole texts as they are; both sides split them by the same pattern, in any script.
PLAIN = "lower(concat_ws(' ', title, abstract))"
_STOP = "[" + ", ".join(f"'{w}'" for w in X.SEARCH_STOP) + "]"
_TOK = "list_filter(regexp_extract_all({0}, '" + X.TOKEN.replace("{", "{{").replace("}", "}}") + "'), lambda x: not list_contains(" + _STOP + ", x))"


def _plain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select(F.col("row_id").alias("doc_id"), F.concat_ws(" ", "title", "abstract").alias("text"))


def bm25_sql(pairs: bool, rows: list[tuple[int, str]], source: str = f"select row_id as doc_id, {PLAIN} as t from papers") -> str:
    """Tables up to `scored` (query_id, doc_id, score)."""
    more = "union all select doc_id, w || ' ' || w2 as term from (select doc_id, w, lead(w) over (partition by doc_id order by pos) as w2 from ww) where w2 is not null" if pairs else ""
    qmore = "union select query_id, w || ' ' || w2 from (select query_id, w, lead(w) over (partition by query_id order by pos) as w2 from qw) where w2 is not null" if pairs else ""
    return f"""docs as ({source}), tk as (select doc_id, {_TOK.format('t')} as ws from docs), dl as (select doc_id, len(ws) as dl from tk),
  ww as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as pos from tk), terms as (select doc_id, w as term from ww {more}),
  tf as (select term, doc_id, count(*) as tf from terms group by all), df as (select term, count(*) as df from tf group by 1), st as (select count(*) as n, avg(dl) as avgdl from dl),
  qw as (select query_id, unnest(ws) as w, generate_subscripts(ws, 1) as pos from (select query_id, {_TOK.format('lower(qt)')} as ws from {asked_sql(rows)})), qt as (select query_id, w as term from qw {qmore}),
  scored as (select query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from (select distinct * from qt) join tf using (term) join df using (term) join dl using (doc_id), st group by all)"""


def _top_sql(k: int) -> str:
    return f"select query_id::bigint as query_id, doc_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from scored) where rank <= {k}"


def _bm25(spark: SparkSession, d: str, pairs: bool) -> DataFrame:
    index = R.Bm25.build(_plain(spark, d), "doc_id", F.col("text"), pairs)
    q = spark.createDataFrame(LONGER, "query_id long, text string")
    s = index.scores(q, "query_id", F.col("text"), pairs).withColumn("score", F.round("score", 9))
    return R.top_k(s, 10).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@_R.add(f"with {bm25_sql(False, LONGER)} {_top_sql(10)}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, False)


@_R.add(f"with {bm25_sql(True, LONGER)} {_top_sql(10)}")
def bm25_bigram_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, True)


@_R.add(f"with docs as (select row_id as doc_id, {PLAIN} as t from papers), ww as (select doc_id, unnest({_TOK.format('t')}) as w from docs) select w as term, count(distinct doc_id) as df, count(*) as cf from ww group by 1")
def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    return R.Bm25.build(_plain(spark, d), "doc_id", F.col("text"), False).document_frequency()


#: The newest record of each paper that has a usable vector.
DOCS = f"""docs as (select b.vec_id as doc_id, p.title, p.abstract, b.labels, list_transform(b.embeddings, lambda x: x::double) as v from bundle b
  join (select *, {BARE} as bid, row_number() over (partition by {BARE} order by coalesce(version, 1) desc, row_id) as rn from papers) p on p.bid = b.arxiv_id and p.rn = 1
  where len(b.embeddings) = 64 and list_sum(list_transform(b.embeddings, lambda x: abs(x))) > 0)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").withColumn("bid", bare_id(F.col("arxiv_id")))
    p = latest(p, ["bid"], [F.coalesce("version", F.lit(1)).desc(), F.asc("row_id")]).select("bid", "title", "abstract")
    b = table(spark, d, "bundle").where((F.size("embeddings") == 64) & F.exists("embeddings", lambda x: x != 0))
    return b.select(F.col("vec_id").alias("doc_id"), F.col("arxiv_id").alias("bid"), "labels", F.col("embeddings").cast("array<double>").alias("v")).join(p, "bid").drop("bid")


def _asked_vectors(docs: DataFrame) -> list[tuple[int, list[float]]]:
    """Stand-ins for embedded queries: the vectors of the four documents of least id."""
    first = docs.select("doc_id", "v").orderBy("doc_id").limit(len(ASKED)).collect()
    return [(i, list(r.v)) for i, r in enumerate(first, 1)]


COS = "list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0}) * list_dot_product({1}, {1}))"
_SIM = "qv as (select row_number() over (order by doc_id) as query_id, v as qv from docs order by doc_id limit 4), sims as (select query_id, doc_id, " + COS.format("v", "qv") + " as sim from docs, qv)"


@_R.add(f"with {DOCS}, {_SIM} select query_id, doc_id, rank, round(sim, 6) as sim from (select *, row_number() over (partition by query_id order by round(sim, 9) desc, doc_id) as rank from sims) where rank <= 20")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = Staging(spark).write(_docs(spark, d).select("doc_id", "v"), "docs")
    top, _ = R.dense_scan(docs, _asked_vectors(docs), 20)
    return top.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"))


USABLE = "u as (select vec_id, labels, list_transform(embeddings, lambda x: x::double) as v from bundle where len(embeddings) = 64 and list_sum(list_transform(embeddings, lambda x: abs(x))) > 0)"


@_R.add(f"""with {USABLE}, s as (select a.vec_id as id, b.vec_id as neighbour_id, {COS.format('a.v', 'b.v')} as sim from u a join u b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
  select id, neighbour_id, round(sim, 6) as sim, rank from (select *, row_number() over (partition by id order by round(sim, 9) desc, neighbour_id) as rank from s) where rank <= 10""")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bundle").where((F.size("embeddings") == 64) & F.exists("embeddings", lambda x: x != 0)).select(F.col("vec_id").alias("id"), F.col("embeddings").alias("v"))
    near = R.knn(b.where("id % 20 = 0"), b, 10)
    return near.select("id", "neighbour_id", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@_R.add(f"with {DOCS}, {_SIM} select query_id, round(avg(sim), 6) as base, round(case when count(*) >= 200 then greatest(avg(sim) + 2 * stddev_pop(sim), avg(sim) + 0.5 * (max(sim) - avg(sim))) end, 6) as cutoff from sims group by 1")
def similarity_cutoff(spark: SparkSession, d: str) -> DataFrame:
    docs = Staging(spark).write(_docs(spark, d).select("doc_id", "v"), "docs")
    _, sums = R.dense_scan(docs, _asked_vectors(docs), 1)
    return R.cutoff_of(sums).select("query_id", F.round("base", 6).alias("base"), F.round("cutoff", 6).alias("cutoff"))


_FOLD = "regexp_replace(lower(strip_accents(" + COMPATIBLE.format("coalesce({0}, '')") + ")), '[^\\x00-\\x7F]', '', 'g')"
_SING = "case when length(x) <= 3 or regexp_matches(x, '^\\d+$') then x when suffix(x, 'ies') and length(x) > 4 then left(x, length(x) - 3) || 'y' when regexp_matches(x, '(ss|us|is)$') then x when suffix(x, 's') then left(x, length(x) - 1) else x end"


def _tokens_sql(c: str) -> str:
    return f"list_transform(regexp_extract_all({_FOLD.format(c)}, '[a-z0-9]+'), lambda x: {_SING})"


_PHRASE = [(i, X.phrase_query(t)) for i, t in ASKED]
_LEVELS = f"""pt as (select doc_id, {_tokens_sql('title')} as tt, {_tokens_sql('abstract')} as aa from docs),
  ps as (select doc_id, ' ' || array_to_string(tt, ' ') || ' ' as t, ' ' || array_to_string(aa, ' ') || ' ' as a, list_concat(tt, aa) as ws from pt),
  pq as (select query_id, qt as p, string_split(qt, ' ') as qw from {asked_sql(_PHRASE)}),
  pos as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from ps),
  span as (select query_id, x.doc_id, min(abs(x.i - y.i) + 1) as span from pq join pos x on x.w = qw[1] join pos y on y.w = qw[2] and y.doc_id = x.doc_id group by all),
  lv as (select query_id, doc_id, case when contains(t, ' ' || p || ' ') then 1 when contains(a, ' ' || p || ' ') then 2 when span <= 8 then 3 end as level from pq cross join ps left join span using (query_id, doc_id)),
  levels as (select * from lv where level is not null)"""


@_R.add(f"with docs as (select row_id as doc_id, title, abstract from papers), {_LEVELS} select query_id::bigint as query_id, doc_id, level from levels")
def phrase_levels(spark: SparkSession, d: str) -> DataFrame:
    return R.phrase_levels(table(spark, d, "papers"), "row_id", "title", "abstract", ASKED)


@_R.add(f"""with docs as (select row_id as doc_id, title, abstract from papers), {_LEVELS} select query_id::bigint as query_id, doc_id, array_to_string(list_filter(qw, lambda w: contains(t || a, ' ' || w || ' ')), ' ') as words from levels join pq using (query_id) join ps using (doc_id)""")
def matched_terms(spark: SparkSession, d: str) -> DataFrame:
    p = X.with_normal_forms(table(spark, d, "papers").select(F.col("row_id").alias("doc_id"), "title", "abstract"), ["title", "abstract"])
    t = p.select("doc_id", X.phrase_text(F.col("__ascii_title")).alias("t"), X.phrase_text(F.col("__ascii_abstract")).alias("a"))
    t = Staging(spark).write(t, "phrase_texts")
    q = F.broadcast(spark.createDataFrame([(i, X.phrase_query(t).split()) for i, t in ASKED], "query_id long, ws array<string>"))
    found = R.levels_in(t, ASKED).join(q, "query_id").join(t, "doc_id")
    return found.select("query_id", "doc_id", F.array_join(R.matched_words(F.col("ws"), F.concat("t", "a")), " ").alias("words"))


@_R.add(r"""with w as (select row_id, title as t from papers where title is not null)
  select row_id, regexp_replace(t, '(?i)(^|\W)((?:gait|spam|triage)(?:e?s)?)\b', '\1<mark>\2</mark>', 'g') as marked from w where regexp_matches(t, '(?i)\b(gait|spam|triage)(e?s)?\b')""")
def highlighted_titles(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "papers").where("title is not null").select("row_id", "title", X.highlight(F.col("title"), ["spam", "triage", "gait"]).alias("marked"))
    return t.where("marked <> title").select("row_id", "marked")


_LIST = "{0} as (select query_id, doc_id, row_number() over (partition by query_id order by round({1}, 9) desc, doc_id) as rank from {2} qualify rank <= {3})"


_PDOCS = "select doc_id, lower(coalesce(title, '') || '. ' || coalesce(abstract, '')) as t from docs"


def hybrid_sql(lexical: str, where: str = "true") -> str:
    return f"""with {DOCS}, ok as (select doc_id from docs where {where}), {_SIM.replace('from docs, qv', 'from docs join ok using (doc_id), qv')}, {lexical}, mx as (select query_id, max(score) as m from scored group by 1),
  {_LEVELS.replace('levels as (select * from lv where', 'levels as (select lv.* from lv join ok using (doc_id) where')},
  {_LIST.format('dn', 'sim', 'sims', 100)}, {_LIST.format('lx', 'score', '(select scored.* from scored join ok using (doc_id))', 100)},
  al as (select sims.query_id, sims.doc_id, sim, coalesce(score / m, 0) as lex from sims left join scored using (query_id, doc_id) left join mx using (query_id)),
  ex as (select query_id, doc_id, level, sim, lex, row_number() over (partition by query_id order by level, round(sim + 0.5 * lex, 9) desc, doc_id) as r from al join levels using (query_id, doc_id) qualify r <= 100),
  rn as (select query_id, doc_id, row_number() over (partition by src, query_id order by rank) as rank from (select 1 as src, * from dn union all select 2, * from lx) x where not exists (select 1 from levels l where l.query_id = x.query_id and l.doc_id = x.doc_id)),
  fu as (select query_id, doc_id, sum(1.0 / (60 + rank)) as fused from rn group by all),
  ct as (select query_id, case when count(*) >= 200 then greatest(avg(sim) + 2 * stddev_pop(sim), avg(sim) + 0.5 * (max(sim) - avg(sim))) end as cutoff from sims group by 1),
  re as (select query_id, doc_id, null::int as level, sim, lex, row_number() over (partition by query_id order by round(fused, 12) desc, doc_id) as r from fu join al using (query_id, doc_id) join ct using (query_id) where cutoff is null or sim >= cutoff qualify r <= 50)
  select query_id::bigint as query_id, doc_id, section, level, round(sim, 6) as sim, round(lex, 6) as lex, row_number() over (partition by query_id order by section, r) as rank from (select 'exact' as section, * from ex union all select 'related', * from re)"""


def _renamed(pairs: bool) -> str:
    """bm25_sql over the documents with vectors, its own document table under another name."""
    return bm25_sql(pairs, ASKED, _PDOCS).replace("docs as (select doc_id, lower", "pdocs as (select doc_id, lower", 1).replace("as ws from docs)", "as ws from pdocs)", 1)


def _index(spark: SparkSession, d: str, keep: tuple[str, ...] = ()) -> R.SearchIndex:
    return R.SearchIndex.build(_docs(spark, d), keep=keep)


def _rounded(got: DataFrame) -> DataFrame:
    return got.select("query_id", "doc_id", "section", "level", F.round("sim", 6).alias("sim"), F.round("lex", 6).alias("lex"), F.col("rank").cast("long").alias("rank"))


@_R.add(hybrid_sql(_renamed(True)))
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return _rounded(R.hybrid_search(index, ASKED, _asked_vectors(index.docs)))


_FILTER = "labels between 0 and 5"


@_R.add(hybrid_sql(_renamed(True), _FILTER))
def hybrid_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same search with filters, which apply before anything is ranked; the lexical scale stays that of all."""
    index = _index(spark, d, ("labels",))
    return _rounded(R.hybrid_search(index, ASKED, _asked_vectors(index.docs), filters=F.expr(_FILTER)))


@_R.add(f"""with {DOCS}, {_SIM}, {_renamed(True)}, {_LIST.format('dn', 'sim', 'sims', 50)}, {_LIST.format('lx', 'score', 'scored', 50)}
  select query_id::bigint as query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) as score from (select * from dn union all select * from lx) group by all""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    dense, _ = R.dense_scan(index.docs, _asked_vectors(index.docs), 50)
    lex = index.lexical.scores(spark.createDataFrame(ASKED, "query_id long, text string"), "query_id", F.col("text")).withColumn("score", F.round("score", 9))
    return R.rrf([dense, R.top_k(lex, 50)]).select("query_id", "doc_id", F.round("score", 9).alias("score"))


@_R.add("""select row_id from live_store where added_at >= timestamp '2024-01-01' and added_at < timestamp '2025-01-01' and primary_category in ('cs.LG', 'cs.CL', 'cs.DB') and cited_by_count >= 1 and coalesce(venue, '') <> ''""")
def search_filters(spark: SparkSession, d: str) -> DataFrame:
    f = R.Filters("2024-01-01", "2024-12-31", ["cs.LG", "cs.CL", "cs.DB"], 1, True)
    return table(spark, d, "live_store").where(f.predicate("added_at")).select("row_id")


_RANKED = "r as (select c_custkey % 7 as query_id, o_orderkey as doc_id, o_orderdate as date, cast(floor(o_totalprice / 1000) as int) as cited_by_count, row_number() over (partition by c_custkey % 7 order by o_totalprice desc, o_orderkey) as rank from orders join customer on o_custkey = c_custkey qualify rank <= 50)"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select((F.col("c_custkey") % 7).alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("score"), F.floor(F.col("o_totalprice") / 1000).cast("int").alias("cited_by_count"))
    return R.top_k(o, 50).drop("score")


@_R.add(f"""with {_RANKED}, m as (select max(o_orderdate) as d from orders),
  b as (select r.*, ln(1 + cited_by_count / greatest(1.0, datediff('day', date, d) / 30.44)) as b from r, m),
  s as (select query_id, doc_id, rank, 1.0 / (rank - 1 + 60) * (1 + 0.3 * b / greatest(max(b) over (partition by query_id), 1e-9)) as s from b)
  select query_id, doc_id, row_number() over (partition by query_id order by round(s, 12) desc, rank) as boosted_rank, round(s, 9) as boosted_score from s""")
def citation_boost_rank(spark: SparkSession, d: str) -> DataFrame:
    last = F.lit(table(spark, d, "orders").agg(F.max("o_orderdate")).first()[0])
    got = R.boosted(_ranked(spark, d), 0.3, last)
    return got.select("query_id", "doc_id", F.col("boosted_rank").cast("long").alias("boosted_rank"), F.round("boosted_score", 9).alias("boosted_score"))


@_R.add(f"with {_RANKED} select query_id, doc_id, row_number() over (partition by query_id order by date desc nulls last, rank) as rank from r")
def newest_order(spark: SparkSession, d: str) -> DataFrame:
    return R.resorted(_ranked(spark, d), "newest").select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@_R.add(f"with {_RANKED} select query_id, doc_id, rank from r where rank between 26 and 40")
def result_page(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).where("rank between 26 and 40").select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


_GRADES = "g as (select query_id, doc_id, grade from (select q.query_id, row_id as doc_id, (starts_with(coalesce(primary_category, ''), 'cs.'))::int + (contains(lower(coalesce(abstract, '')), qt))::int as grade from papers, " + asked_sql(LONGER[2:3] + [(1, "spam triage"), (2, "drone navigation"), (4, "index factorisation")]) + "))"


@_R.add(f"""with {bm25_sql(True, LONGER)}, k as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from scored qualify rank <= 25), {_GRADES},
  h as (select k.*, coalesce(grade, 0) as grade from k left join g using (query_id, doc_id)),
  a as (select query_id, sum(case when rank <= 10 then (power(2, grade) - 1) / log2(rank + 1) end) as dcg, avg(case when rank <= 10 then (grade >= 1)::int end) as p, min(case when grade >= 1 then rank end) as f, count(*) filter (grade >= 2) as found from h group by 1),
  i as (select query_id, sum((power(2, grade) - 1) / log2(r + 1)) as idcg from (select *, row_number() over (partition by query_id order by grade desc, doc_id) as r from g where grade > 0) where r <= 10 group by 1),
  o as (select query_id, count(*) filter (grade >= 2) as pool from g group by 1)
  select query_id::bigint as query_id, round(dcg / idcg, 6) as ndcg, round(p, 6) as precision, round(coalesce(1.0 / f, 0), 6) as mrr, round(case when pool > 0 then found / least(25, pool) end, 6) as recall from a left join i using (query_id) left join o using (query_id)""")
def search_metrics(spark: SparkSession, d: str) -> DataFrame:
    index = R.Bm25.build(_plain(spark, d), "doc_id", F.col("text"))
    q = spark.createDataFrame(LONGER, "query_id long, text string")
    ranked = R.top_k(index.scores(q, "query_id", F.col("text")).withColumn("score", F.round("score", 9)), 25)
    p = table(spark, d, "papers")
    grades = None
    for qid, word in ((1, "spam triage"), (2, "drone navigation"), (3, LONGER[2][1]), (4, "index factorisation")):
        one = p.select(F.lit(qid).cast("long").alias("query_id"), F.col("row_id").alias("doc_id"), V.heuristic_grade(F.col("primary_category"), F.col("abstract"), ["cs."], [word]).alias("grade"))
        grades = one if grades is None else grades.unionByName(one)
    m = V.search_metrics(ranked, grades)
    return m.select("query_id", *(F.round(c, 6).alias(c) for c in ("ndcg", "precision", "mrr", "recall")))


#: Each title's first words as a definition, their initials in brackets; it is one if it does not begin with a stop word.
_DEFINED = "dn as (select regexp_extract_all(lower(title), '[a-z]+')[1:5] as ws from papers where title is not null)"
_PSTOP = "[" + ", ".join(f"'{w}'" for w in X.PHRASE_STOP) + "]"


def _defining_texts(spark: SparkSession, d: str) -> DataFrame:
    words = F.slice(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), 0), 1, 5)
    p = table(spark, d, "papers").where("title is not null").select(words.alias("ws"), "abstract").where("size(ws) >= 2")
    name = F.upper(F.array_join(F.transform("ws", lambda w: F.substring(w, 1, 1)), ""))
    return p.select(F.concat(F.coalesce("abstract", F.lit("")), F.lit(". "), F.array_join("ws", " "), F.lit(" ("), name, F.lit(") follows (so).")).alias("text"))


@_R.add(f"""with {_DEFINED}, nm as (select array_to_string(ws, ' ') as long_form, array_to_string(list_transform(ws, lambda w: w[1]), '') as name from dn where len(ws) >= 2 and not list_contains({_PSTOP}, ws[1]))
  select list_transform([name], lambda x: {_SING})[1] as acronym, long_form, count(*) as n from nm group by 1, 2""")
def acronym_counts(spark: SparkSession, d: str) -> DataFrame:
    """Definitions made of all titles, each in its paper's abstract, found again."""
    return A.mine(_defining_texts(spark, d), "text")


@_R.add()
def expanded_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every title's first words as a query, expanded by the definitions of all titles and by synonyms."""
    t = table(spark, d, "papers").where("title is not null").select(F.col("row_id").alias("query_id"), F.col("title").alias("text"))
    synonyms = spark.createDataFrame([("gait analysis", "walking pattern study"), ("spam triage", "mail sorting")], "term string, other string")
    return A.expand(t, A.mine(_defining_texts(spark, d), "text"), synonyms)
