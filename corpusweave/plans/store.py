"""Queries on stores, live records, sources, releases and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions import text as X
from corpusweave.functions.ids import PAPER_ID
from corpusweave.operators import livestore as S
from corpusweave.operators.ingest import latest
from corpusweave.plans.corpus import BARE, sql_key, sql_clean
from corpusweave.plans.registry import Registry
from corpusweave.runtime import Staging, table
from corpusweave.sources import files
from corpusweave.sources.store import PaperStore, conform, dedup_history, load_bundle, release_diff, save_bundle
from corpusweave.streaming import streams

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql


@_R.add("select user_id, ts::date as day, value, event_id from (select *, row_number() over (partition by user_id, ts::date order by event_id desc) as rn from events) where rn = 1")
def history_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return dedup_history(e, "user_id", "day", "event_id").select("user_id", "day", "value", "event_id")


@_R.add("""with a as (select *, 0 as b from orders where o_orderkey % 3 <> 0 union all select o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1, o_orderdate, o_orderpriority, 1 from orders where o_orderkey % 2 = 0)
  select o_orderkey, o_totalprice, o_orderdate from (select *, row_number() over (partition by o_orderkey order by b desc) as rn from a) where rn = 1""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Two deliveries upserted into a partitioned store, which is then read."""
    import uuid

    o = table(spark, d, "orders").withColumn("year_month", F.date_format("o_orderdate", "yyyy-MM"))
    store = PaperStore(spark, f"{Staging(spark).root}/store-{uuid.uuid4().hex[:8]}", "o_orderkey")
    store.upsert(o.where("o_orderkey % 3 <> 0"))
    store.upsert(o.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1))
    return store.read().select("o_orderkey", "o_totalprice", "o_orderdate")


@_R.add(f"""with a as (select distinct {BARE} as k from papers where source = 'bulk'), b as (select distinct {BARE} as k from papers where source = 'oai')
  select k as bare, 'added' as change from a where k not in (select k from b where k is not null) union all select k, 'removed' from b where k not in (select k from a where k is not null)""")
def release_changes(spark: SparkSession, d: str) -> DataFrame:
    from corpusweave.functions.ids import bare_id

    p = table(spark, d, "papers").withColumn("bare", bare_id(F.col("arxiv_id")))
    return release_diff(p.where("source = 'bulk'"), p.where("source = 'oai'"), "bare")


_DOI = r"""case when regexp_matches(lower(trim(regexp_replace(doi, '\s+', ' ', 'g'))), '(^|[/: ])10\.\d{4,9}/[^\s]+$') and not regexp_matches(lower(trim(regexp_replace(doi, '\s+', ' ', 'g'))), '(^|[/: ])10\.0+/[^\s]+$')
  then regexp_extract(lower(trim(regexp_replace(doi, '\s+', ' ', 'g'))), '(?:^|[/: ])(10\.\d{4,9}/[^\s]+)$', 1) end"""


def keys_sql(src: str, key: str, wide: bool) -> str:
    years = "unnest([0, -1, 1])" if wide else "0"
    return f"""select {key}, 'doi:' || doi as k from (select {key}, {_DOI} as doi from {src}) where doi is not null
    union select {key}, 'arxiv:' || coalesce(a, x) from (select {key}, {BARE} as a, nullif(regexp_extract({_DOI}, '^10\\.48550/arxiv\\.(\\d{{4}}\\.\\d{{4,5}})(?:v\\d+)?$', 1), '') as x from {src}) where coalesce(a, x) is not null
    union select {key}, 'title:' || t || '|' || coalesce((year + dy)::varchar, '') from (select {key}, {sql_key(sql_clean('title'))} as t, year, {years} as dy from {src}) where length(t) >= 12 and (year is not null or dy = 0)"""


@_R.add(f"""with s as ({keys_sql('source_records', 'record_id', True)}), l as ({keys_sql('live_store', 'row_id', False)})
  select record_id from source_records where record_id not in (select record_id from s where k in (select k from l))""")
def anti_join_collection(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "source_records").select("record_id", "doi", "arxiv_id", "title", "year")
    return S.unknown_in(r, table(spark, d, "live_store").select("doi", "arxiv_id", "title", "year"), "record_id").select("record_id")


@_R.add(f"select row_id, k as key from ({keys_sql('live_store', 'row_id', True)})")
def identity_keys(spark: SparkSession, d: str) -> DataFrame:
    return S.with_keys(table(spark, d, "live_store"), True).select("row_id", F.explode("keys").alias("key"))


@_R.add(r"""with f as (select *, list_sort(list_distinct(list_filter(list_transform(string_split(lower(coalesce(sources, '')), ';'), lambda x: trim(x)), lambda x: x <> ''))) as ss from live_store)
  select paper_id, arg_min(venue, row_id) filter (trim(coalesce(venue, '')) <> '') as venue, arg_max(abstract, length(abstract) * 10000000 - row_id) as abstract, max(cited_by_count) as cited_by_count,
  array_to_string(list_sort(list_distinct(flatten(list(ss)))), ';') as sources from f group by 1""")
def live_store_merge(spark: SparkSession, d: str) -> DataFrame:
    return S.enrich_groups(table(spark, d, "live_store"), "paper_id", "row_id", ["venue"], ["abstract"], ["cited_by_count"], ["sources"])


@_R.add(f"""with recursive o as ({keys_sql('source_records', 'record_id', False)}), w as ({keys_sql('source_records', 'record_id', True)}),
  e as (select distinct a.record_id as a, b.record_id as b from o a join w b using (k)), g as (select a, b from e union select b, a from e),
  r(a, b) as (select a, b from g union select r.a, g.b from r join g on r.b = g.a)
  select record_id, least(record_id, coalesce(min(b), record_id)) as entity from source_records left join r on a = record_id group by record_id""")
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of all fetched records over their identity keys."""
    r = table(spark, d, "source_records").select("record_id", "doi", "arxiv_id", "title", "year")
    return S.resolve(r, "record_id")


_NORMAL = f"""with d as (select *, {_DOI} as nd from source_records), t as (select *, nullif(regexp_extract(nd, '^10\\.48550/arxiv\\.(\\d{{4}}\\.\\d{{4,5}})(?:v\\d+)?$', 1), '') as x from d)
  select source, source_id, trim(coalesce(title, '')) as title, trim(coalesce(abstract, '')) as abstract, trim(coalesce(authors, '')) as authors, trim(coalesce(date, '')) as date,
  coalesce(year, try_cast(case when regexp_matches(trim(coalesce(date, '')), '^\\d{{4}}') then left(trim(date), 4) end as int)) as year, coalesce(nd, '') as doi, coalesce({BARE}, x, '') as arxiv_id,
  trim(coalesce(venue, '')) as venue, trim(coalesce(primary_category, '')) as primary_category, coalesce(cited_by_count, 0) as cited_by_count, trim(coalesce(url, '')) as url from t"""


@_R.add(_NORMAL)
def normalized_records(spark: SparkSession, d: str) -> DataFrame:
    return files.make_records(table(spark, d, "source_records"))


@_R.add(r"""with f as (select regexp_replace(paper_id, '[^A-Za-z0-9]+', '_', 'g') as k, regexp_replace(coalesce(title, ''), '[{}]', '', 'g') as t,
  array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce(authors, ''), '[{}]', '', 'g'), ';'), lambda x: trim(x)), lambda x: x <> ''), ' and ') as a, coalesce(year::varchar, '') as y, regexp_replace(coalesce(url, ''), '[{}]', '', 'g') as u from live_store)
  select '@article{' || k || ',' || chr(10) || array_to_string(list_filter([case when t <> '' then '  title = {' || t || '}' end, case when a <> '' then '  author = {' || a || '}' end, case when y <> '' then '  year = {' || y || '}' end,
  case when u <> '' then '  url = {' || u || '}' end], lambda x: x is not null), ',' || chr(10)) || chr(10) || '}' as entry from f""")
def bibtex_export(spark: SparkSession, d: str) -> DataFrame:
    return files.bibtex(table(spark, d, "live_store"))


@_R.add(rf"""select coalesce(regexp_extract(trim(arxiv_id), '((?:{PAPER_ID})(?:v\d+)?)\s*$', 1), '') as arxiv_id,
  trim(regexp_replace(replace(coalesce(title, ''), chr(160), ' '), '\s+', ' ', 'g')) as title, trim(regexp_replace(replace(coalesce(abstract, ''), chr(160), ' '), '\s+', ' ', 'g')) as abstract from papers where arxiv_id is not null""")
def atom_records(spark: SparkSession, d: str) -> DataFrame:
    """Papers written as Atom entries and parsed again."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "&", "&amp;"), "<", "&lt;")
    page = F.concat(F.lit("<feed><entry><id>http://preprints.example/abs/"), F.trim("arxiv_id"), F.lit("</id><title>"), esc("title"), F.lit("</title><summary>"), esc("abstract"), F.lit("</summary></entry></feed>"))
    return files.atom_entries(table(spark, d, "papers").select(page.alias("xml")), "xml").select("arxiv_id", "title", "abstract")


@_R.add("select row_id, case when length(abstract) <= 230 then abstract else regexp_replace(left(abstract, 230), '\\s+\\S*$', '') || '…' end as snippet from papers where abstract is not null")
def abstract_snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").where("abstract is not null").select("row_id", X.truncate_words(F.col("abstract"), 230).alias("snippet"))


@_R.add("""with n as (select row_id, list_filter(list_transform(string_split(coalesce(authors, ''), ';'), lambda x: trim(x)), lambda x: x <> '') as a from papers)
  select row_id, array_to_string(a[1:3], ', ') || case when len(a) > 3 then ' +' || (len(a) - 3) else '' end as line from n""")
def author_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("row_id", X.author_line(F.col("authors")).alias("line"))


def _streamed(spark: SparkSession, d: str, job, mode: str) -> DataFrame:
    """What a streaming job over the events has emitted after all input, from a table in the shared folder."""
    import uuid

    name = f"s{uuid.uuid4().hex[:12]}"
    root = f"{Staging(spark).root}/{name}"
    schema = table(spark, d, "events").schema
    rows = job(spark.readStream.schema(schema).parquet(f"{d}/events.parquet*"))
    out: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{root}/out/{number}"
        batch.write.mode("overwrite").parquet(path)
        out.append(path)

    rows.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(*(out[-1:] if mode == "complete" else out))


@_R.add("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    got = _streamed(spark, d, lambda s: streams.tumbling_counts(s, "ts", "event_type"), "complete")
    return got.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@_R.add("""with g as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 30 minutes then 1 else 0 end as first from events window w as (partition by user_id order by ts)),
  s as (select user_id, ts, sum(first) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, count(*) as n from s group by user_id, s""")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    got = _streamed(spark, d, lambda s: streams.session_counts(s, "ts", "user_id"), "complete")
    return got.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@_R.add("select distinct event_id from events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, lambda s: streams.deduplicated(s, "ts", ["event_id"]).select("event_id"), "append")


def _with_state_store(spark: SparkSession):
    """Sets the state store that keyed state needs; undone when the query has run."""
    from contextlib import contextmanager

    @contextmanager
    def held():
        name = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(name, None)
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            yield
        finally:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)

    return held()


@_R.add("""with f as (select paper_id, cited_by_count, abstract, list_filter(list_transform(string_split(lower(coalesce(sources, '')), ';'), lambda x: trim(x)), lambda x: x <> '') as ss from live_store where paper_id is not null)
  select paper_id, max(coalesce(cited_by_count, 0)) as cited_by_count, array_to_string(list_sort(list_distinct(flatten(list(ss)))), ';') as sources, max(length(coalesce(abstract, ''))) as abstract_chars, count(*) as seen from f group by 1""")
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """Live records as the keyed state of a stream has merged them, each paper's last state."""
    import uuid

    root = f"{Staging(spark).root}/s{uuid.uuid4().hex[:12]}"
    rows = spark.readStream.schema(table(spark, d, "live_store").schema).parquet(f"{d}/live_store.parquet*").where("paper_id is not null")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/{number}")

    with _with_state_store(spark):
        live = streams.live_records(rows.select("paper_id", *streams.LiveRecord.FIELDS, "cited_by_count"))
        live.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = latest(spark.read.parquet(f"{root}/out/*"), ["paper_id"], [F.desc("batch")])
    return last.select("paper_id", "cited_by_count", "sources", F.length("abstract").alias("abstract_chars"), "seen")


@_R.add("""select row_id, paper_id, coalesce(year, 0) as year, 'unknown' as language, null::double as score from live_store""")
def bundle_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The store saved as a bundle of an older shape and loaded in today's, in which columns are new, other or gone."""
    import uuid

    root = f"{Staging(spark).root}/bundle-{uuid.uuid4().hex[:8]}"
    save_bundle(spark, root, {"papers": table(spark, d, "live_store").select("row_id", "paper_id", F.col("year").cast("string").alias("year"), "title")}, {"made": "by a query"})
    today = spark.createDataFrame([], "row_id long, paper_id string, year int, language string, score double").schema
    tables, meta = load_bundle(spark, root, {"papers": today, "notes": today}, {"papers": {"year": 0, "language": "unknown"}})
    return tables["papers"].unionByName(tables["notes"])


@_R.add("select row_id, paper_id, try_cast(year as int) as year, 7 as extra from live_store")
def conformed_rows(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.createDataFrame([], "row_id long, paper_id string, year int, extra int").schema
    return conform(table(spark, d, "live_store"), schema, {"extra": 7})


@_R.add("""with r as (select source, paper_id, added_at, row_number() over (partition by source, paper_id order by added_at desc) as k from (select trim(lower(string_split(coalesce(sources, ''), ';')[1])) as source, * exclude (sources) from live_store)),
  t as (select source, paper_id, added_at, row_number() over (partition by source order by added_at desc nulls last, paper_id) as rn from r where k = 1) select source, paper_id, added_at from t where rn <= 25""")
def harvest_latest(spark: SparkSession, d: str) -> DataFrame:
    from corpusweave.sources.harvest import latest_per_query

    s = table(spark, d, "live_store").select(F.trim(F.lower(F.split(F.coalesce("sources", F.lit("")), ";")[0])).alias("source"), "paper_id", "added_at")
    return latest_per_query(s, "source", "added_at", "paper_id", 25).select("source", "paper_id", "added_at")


@_R.add("""with k as (select paper_id, max(authors) as a from live_store group by 1)
  select row_id, coalesce(case when trim(coalesce(authors, '')) <> '' then authors end, a, '') as authors from live_store left join k using (paper_id)""")
def backfilled_authors(spark: SparkSession, d: str) -> DataFrame:
    from corpusweave.sources.harvest import backfilled

    s = table(spark, d, "live_store")
    return backfilled(s.select("row_id", "paper_id", "authors"), s, "paper_id", "authors").select("row_id", "authors")
