"""Queries on ingestion, cleaning, sampling, quality and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions import text as X
from corpusweave.functions.ids import BARE_ID, PAPER_ID, bare_id, id_version, normalize_doi, parse_time
from corpusweave.operators import enrich, ingest
from corpusweave.plans.registry import Registry
from corpusweave.runtime import table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql

#: SQL of the bare id and of the id's version.
_ID = PAPER_ID
BARE = rf"nullif(regexp_extract(arxiv_id, '{BARE_ID}', 1), '')"
VERSION = rf"try_cast(nullif(regexp_extract(arxiv_id, '(?:{_ID})v(\d+)\s*$', 1), '') as int)"
#: SQL that puts the compatibility forms the tables hold (hard space, ellipsis, ligature, wide comma) into NFKC.
COMPATIBLE = "replace(replace(replace(replace({0}, chr(160), ' '), chr(8230), '...'), chr(64257), 'fi'), chr(65292), ',')"


def sql_time(c: str) -> str:
    return (
        f"coalesce(try_strptime({c}, '%Y-%m-%dT%H:%M:%SZ'), try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%Y-%m-%d %H:%M:%S'), "
        f"try_strptime({c}, '%a, %d %b %Y %H:%M:%S GMT'), case when {c} like '%+__:__' then try_strptime(left({c}, 19), '%Y-%m-%dT%H:%M:%S') "
        f"- to_hours(try_cast(right({c}, 5)[1:2] as int)) - to_minutes(try_cast(right({c}, 2) as int)) when {c} like '%-__:__' and length({c}) = 25 then "
        f"try_strptime(left({c}, 19), '%Y-%m-%dT%H:%M:%S') + to_hours(try_cast(right({c}, 5)[1:2] as int)) + to_minutes(try_cast(right({c}, 2) as int)) end)"
    )


@_R.add(f"""select row_id, {BARE} as bare_id, coalesce(version, {VERSION}, 1) as version,
  strftime({sql_time('first_submitted')}, '%Y-%m-%d %H:%M:%S') as submitted, strftime({sql_time('last_updated')}, '%Y-%m-%d %H:%M:%S') as updated
  from papers""")
def parse_ids_and_times(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers")
    t = lambda c: F.date_format(parse_time(F.col(c)), "yyyy-MM-dd HH:mm:ss")
    v = F.coalesce("version", id_version(F.col("arxiv_id")), F.lit(1))
    return p.select("row_id", bare_id(F.col("arxiv_id")).alias("bare_id"), v.alias("version"), t("first_submitted").alias("submitted"), t("last_updated").alias("updated"))


_UNWRAP = r"\\(?:emph|textbf|textit|texttt|mathrm|mathbf|mathcal|text|textsc|url|cite|ref)\s*\{([^{}]*)\}"


def sql_clean(c: str) -> str:
    """Normalised text in SQL."""
    text = COMPATIBLE.format(f"coalesce({c}, '')")
    s = rf"regexp_replace(nfc_normalize({text}), '\$\$?([^$]*)\$\$?', ' \1 ', 'g')"
    for _ in range(3):
        s = f"regexp_replace({s}, '{_UNWRAP}', '\\1', 'g')"
    s = rf"regexp_replace({s}, '\\[a-zA-Z]+\*?', ' ', 'g')"
    s = rf"regexp_replace(regexp_replace({s}, '[{{}}]', '', 'g'), '[~\\]', ' ', 'g')"
    return rf"trim(regexp_replace({s}, '\s+', ' ', 'g'))"


def sql_key(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({c})), '[^\x00-\x7F]', '', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@_R.add(f"with t as (select row_id, {sql_clean('title')} as t from papers) select row_id, {sql_key('t')} as title_key from t")
def title_keys(spark: SparkSession, d: str) -> DataFrame:
    p = X.with_normal_forms(table(spark, d, "papers").select("row_id", "title"), ["title"])
    return p.select("row_id", X.key_of(F.col("__ascii_title")).alias("title_key"))


_ENGLISH = "[" + ", ".join(f"'{w}'" for w in X.ENGLISH) + "]"
_CLEAN = f"""with r as (select *, {BARE} as bid, coalesce(version, {VERSION}, 1) as v, {sql_time('first_submitted')} as d, {sql_time('last_updated')} as u0
    from papers where arxiv_id is not null and title is not null and abstract is not null
    and len(list_filter(string_split_regex(trim(coalesce(categories, '')), '\\s+'), lambda c: starts_with(c, 'cs.'))) > 0),
  n as (select row_id, bid, v, d, coalesce(u0, d) as u, {sql_clean('title')} as t, {sql_clean('abstract')} as a, categories, primary_category, authors, doi, journal_ref, license
    from r where bid is not null and d >= timestamp '2010-01-01' and d < timestamp '2025-07-01'),
  e as (select *, regexp_extract_all(lower(a), '[a-z]+') as w, {sql_key('t')} as k from n where length(a) >= 50 and t <> ''),
  f as (select * from e where length(regexp_replace(a, '[^\\x00-\\x7F]', '', 'g')) / length(a) >= 0.8
    and len(w) > 0 and len(list_filter(w, lambda x: list_contains({_ENGLISH}, x))) / len(w) >= 0.08),
  o as (select * from (select *, row_number() over (partition by bid order by v desc, u desc, row_id desc) as rn from f) where rn = 1),
  p as (select * from (select *, row_number() over (partition by k order by v desc, u desc, row_id desc) as rk from o) where rk = 1)
  select bid as arxiv_id, v as version, t as title, a as abstract, coalesce(authors, '') as authors, categories, case when coalesce(primary_category, '') = '' then string_split(categories, ' ')[1] else primary_category end as primary_category,
    strftime(d, '%Y-%m-%d %H:%M:%S') as submitted, strftime(u, '%Y-%m-%d %H:%M:%S') as updated, coalesce(doi, '') as doi, coalesce(journal_ref, '') as journal_ref, coalesce(license, '') as license, strftime(d, '%Y-%m') as year_month from p"""


@_R.add(_CLEAN)
def clean_papers(spark: SparkSession, d: str) -> DataFrame:
    c = ingest.clean_records(table(spark, d, "papers"), "cs.", "2010-01-01", "2025-06-30")
    at = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return c.select("arxiv_id", "version", "title", "abstract", "authors", "categories", "primary_category", at("date").alias("submitted"), at("last_updated").alias("updated"), "doi", "journal_ref", "license", "year_month")


@_R.add(f"""with p as (select row_id, {BARE} as bid, coalesce(version, {VERSION}, 1) as v, {sql_time('last_updated')} as u from papers)
  select bid as arxiv_id, row_id, v as version from (select *, row_number() over (partition by bid order by v desc, u desc nulls last, row_id) as rn from p where bid is not null) where rn = 1""")
def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").select("row_id", bare_id(F.col("arxiv_id")).alias("arxiv_id"), F.coalesce("version", id_version(F.col("arxiv_id")), F.lit(1)).alias("version"), parse_time(F.col("last_updated")).alias("u"))
    return ingest.latest(p.where("arxiv_id is not null"), ["arxiv_id"], [F.desc("version"), F.desc_nulls_last("u"), F.asc("row_id")]).select("arxiv_id", "row_id", "version")


@_R.add("select primary_category, count(*) as n from papers group by 1 order by n desc, primary_category nulls first limit 20")
def category_counts_topn(spark: SparkSession, d: str) -> DataFrame:
    return ingest.value_counts(table(spark, d, "papers"), "primary_category", 20)


@_R.add("""select count(*) as n_rows, count(distinct strftime(o_orderdate, '%Y-%m')) as n_months, count(distinct o_orderpriority) as n_categories,
  min(o_orderdate) as first_date, max(o_orderdate) as last_date, round(datediff('day', min(o_orderdate), max(o_orderdate)) / 30.44, 1) as span_months from orders""")
def snapshot_stats(spark: SparkSession, d: str) -> DataFrame:
    return ingest.snapshot_stats(table(spark, d, "orders"), "o_orderdate", "o_orderpriority")


@_R.add("""with m as (select date_trunc('month', o_orderdate)::date as month, count(*) as n from orders where o_orderdate is not null group by 1),
  s as (select unnest(generate_series(min(month)::timestamp, max(month)::timestamp, interval 1 month))::date as month from m)
  select s.month, coalesce(n, 0) as n from s left join m using (month)""")
def monthly_spine(spark: SparkSession, d: str) -> DataFrame:
    return ingest.monthly_spine(table(spark, d, "orders"), "o_orderdate")


@_R.add("""with l as (select max(o_orderdate) as x from orders), q as (select date_trunc('month', x)::date as lm, day(x) < day(last_day(x)) - 3 as part from l),
  m as (select date_trunc('month', o_orderdate)::date as month, count(*) as n from orders group by 1),
  s as (select unnest(generate_series(min(month)::timestamp, max(month)::timestamp, interval 1 month))::date as month from m),
  f as (select s.month, coalesce(n, 0) as n, count(*) over () as k from s left join m using (month))
  select (select count(*) from orders) as n_rows, (select round(datediff('day', min(o_orderdate), max(o_orderdate)) / 30.44, 1) from orders) as span_months,
  (select avg(case when coalesce(o_orderstatus, '') = '' then 1.0 else 0.0 end) from orders) as missing_rate, (select count(o_orderkey) - count(distinct o_orderkey) from orders) as duplicate_keys,
  (select min(n) from f, q where not (part and month = lm and k > 1)) as min_month,
  (select round(max(n) / sum(n), 9) from (select count(*) as n from orders group by o_orderpriority)) as max_category_share""")
def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    q = ingest.quality_checks(table(spark, d, "orders"), "o_orderdate", "o_orderpriority", "o_orderstatus", "o_orderkey").drop("row_change")
    return q.withColumn("max_category_share", F.round("max_category_share", 9))


def _months(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("year_month", F.date_format("o_orderdate", "yyyy-MM"))


@_R.add("""with o as (select *, strftime(o_orderdate, '%Y-%m') as year_month from orders),
  n as (select o_orderpriority, year_month, count(*) as n from o group by all),
  lv as (select max(q) as q from (select q, (select sum(least(n, q)) from n) as s from (select unnest(range(0, (select max(n) + 1 from n))) as q)) where s <= 2000),
  b as (select *, least(n, q) as b, n - least(n, q) as rest from n, lv),
  r as (select *, row_number() over (order by rest desc, o_orderpriority, year_month) as i, 2000 - sum(b) over () as spare from b),
  p as (select *, b + case when i <= spare and rest > 0 then 1 else 0 end as quota from r)
  select o_orderpriority, year_month, count(*) as n, round(sum(w), 6) as weight, min(o_orderkey) as least_key from
  (select o.*, p.quota, p.n / p.quota as w, row_number() over (partition by o.o_orderpriority, o.year_month order by md5(o_orderkey::varchar), o_orderkey) as rn from o join p using (o_orderpriority, year_month))
  where rn <= quota group by all""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    s = ingest.stratified_sample(_months(spark, d), ["o_orderpriority", "year_month"], "o_orderkey", 2000)
    return s.groupBy("o_orderpriority", "year_month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sample_weight"), 6).alias("weight"), F.min("o_orderkey").alias("least_key"))


@_R.add("""with t as (select *, row_number() over (partition by p_brand order by p_partkey) as turn, min(p_partkey) over (partition by p_brand) as f from part)
  select p_partkey, p_brand, turn from t order by turn, f limit 60""")
def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    return ingest.round_robin(table(spark, d, "part"), "p_brand", ["p_partkey"], 60).select("p_partkey", "p_brand", F.col("turn").cast("long").alias("turn"))


@_R.add("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 100")
def newest_sample(spark: SparkSession, d: str) -> DataFrame:
    return ingest.newest(table(spark, d, "orders"), "o_orderdate", "o_orderkey", 100).select("o_orderkey", "o_orderdate")


@_R.add("""with h as (select user_id, ts::date as day, max(value) as v from events group by all), m as (select max(day) as d from h),
  r as (select h.* from h, m where datediff('day', day, d) <= 20),
  g as (select user_id, arg_min(v, day) as a, arg_max(v, day) as b, count(*) as n, datediff('day', min(day), max(day)) as days from r group by 1)
  select user_id, round(greatest(0.0, (b - a) * 30.0 / days), 3) as velocity from g where n >= 2 and days > 0""")
def citation_velocity(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("v"))
    return enrich.citation_velocity(h, "user_id", "day", "v", 20)


@_R.add("""with b as (select (doi is not null and doi <> '')::int as m, strftime(added_at, '%Y-%m') as year_month, primary_category as category from live_store),
  c as (select category, avg(m) as rate, count(*) as n, row_number() over (order by count(*) desc, category nulls first) as r from b group by 1),
  o as (select k.kind, round(avg((doi is not null and doi <> '')::int), 6) as rate, count(*) as n from live_store, (select max(added_at) as t from live_store), (values (3, 'older_3m'), (6, 'older_6m')) k(months, kind) where added_at < (t - to_months(k.months))::date group by 1)
  select kind, '' as value, rate, n from o union all select 'all' as kind, '' as value, round(avg(m), 6) as rate, count(*) as n from b
  union all select 'month', year_month, round(avg(m), 6), count(*) from b group by year_month
  union all select 'category', category, round(rate, 6), n from c where r <= 40""")
def match_stats_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "live_store")
    return enrich.match_stats(s, F.col("doi").isNotNull() & (F.col("doi") != ""), "added_at", "primary_category")


@_R.add(f"""with s as (select record_id, {sql_key(sql_clean('title'))} as k from source_records), l as (select {sql_key(sql_clean('title'))} as k, min(row_id) as row_id from live_store group by 1)
  select record_id, row_id from s join l using (k) where length(k) >= 12""")
def title_fallback(spark: SparkSession, d: str) -> DataFrame:
    return enrich.by_title(table(spark, d, "source_records"), table(spark, d, "live_store"), "record_id", "row_id")


@_R.add("""with l as (select * from (select *, row_number() over (partition by paper_id order by added_at desc, row_id desc) as rn from live_store) where rn = 1)
  select b.vec_id, coalesce(l.cited_by_count, 0) as cited_by_count, coalesce(l.venue, '') as venue from bundle b left join l on l.paper_id = b.arxiv_id""")
def enrich_join(spark: SparkSession, d: str) -> DataFrame:
    rec = ingest.latest(table(spark, d, "live_store"), ["paper_id"], [F.desc("added_at"), F.desc("row_id")]).select(F.col("paper_id").alias("arxiv_id"), "cited_by_count", "venue")
    return enrich.with_records(table(spark, d, "bundle").select("vec_id", "arxiv_id"), rec, "arxiv_id", {"cited_by_count": 0, "venue": ""}).drop("arxiv_id")


@_R.add("""select row_id, case when since is null then true when not has_vec then since >= 14 when age < 91 then since >= 7 when age < 730 then since >= 30 else since >= 90 end as stale from
  (select row_id, has_vec, datediff('day', added_at::date, date '2025-06-01') as since, datediff('day', coalesce(try_cast(date as date), try_cast(date || '-01' as date), try_cast(date || '-01-01' as date)), date '2025-06-01') as age from live_store)""")
def stale_records(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the store.

    A year or a month counts from its first day; a row without a readable date is refreshed as the oldest are."""
    today = F.lit("2025-06-01").cast("date")
    age = F.date_diff(today, F.col("date").try_cast("date"))
    return table(spark, d, "live_store").select("row_id", enrich.is_stale(F.to_date("added_at"), today, age, F.col("has_vec"), F.lit(1), 1).alias("stale"))


@_R.add(r"""select row_id, case when regexp_matches(d, '(^|[/: ])10\.\d{4,9}/[^\s]+$') and not regexp_matches(d, '(^|[/: ])10\.0+/[^\s]+$') then regexp_extract(d, '(?:^|[/: ])(10\.\d{4,9}/[^\s]+)$', 1) end as doi
  from (select row_id, lower(trim(regexp_replace(doi, '\s+', ' ', 'g'))) as d from live_store)""")
def normalized_dois(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "live_store").select("row_id", normalize_doi(F.col("doi")).alias("doi"))


_STOP = "[" + ", ".join(f"'{w}'" for w in X.ENGLISH) + "]"


@_R.add(f"""select doc_id, round(case when len(w) > 0 then len(list_filter(w, lambda x: list_contains({_STOP}, x))) / len(w) else 0 end, 9) as score,
  coalesce(length(t) > 0 and length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) / nullif(length(t), 0) >= 0.8 and len(w) > 0 and len(list_filter(w, lambda x: list_contains({_STOP}, x))) / nullif(len(w), 0) >= 0.08, false) as english
  from (select doc_id, coalesce(text, '') as t, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') as w from documents)""")
def english_documents(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.round(X.english_score(t), 9).alias("score"), X.is_english(t).alias("english"))


@_R.add("select doc_id, left(sha1(coalesce(text, '')), 16) as hash from documents")
def text_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.text_hash(F.col("text")).alias("hash"))


@_R.add()
def inverted_index_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Round trip of a text through its inverted index; the result must be the collapsed text itself."""
    docs = table(spark, d, "papers").where("abstract is not null").select("row_id", X.collapse(F.col("abstract")).alias("t"))
    words = docs.select("row_id", F.posexplode(F.split("t", " ")).alias("p", "w"))
    index = words.groupBy("row_id", "w").agg(F.sort_array(F.collect_list("p")).alias("ps")).groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return index.select("row_id", enrich.inverted_text(F.col("m")).alias("text"))


SQL["inverted_index_to_text"] = r"select row_id, trim(regexp_replace(replace(abstract, chr(160), ' '), '\s+', ' ', 'g')) as text from papers where abstract is not null"
