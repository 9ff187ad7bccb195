"""Queries of the training-data operators; names start with the number of the problem in TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.runtime import Staging, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from corpusweave.llm.survivors import paper_survivors, store_survivors

    def led(found, name: str) -> DataFrame:
        return found.chosen.select(F.lit(name).alias("table_name"), F.col("__key").alias("group_key"), F.col("row_lead").alias("row_id"))

    papers = led(paper_survivors(table(spark, folder, "papers")), "papers")
    return papers.unionByName(led(store_survivors(table(spark, folder, "live_store")), "live_store"))


def p1_papers(spark: SparkSession, folder: str) -> DataFrame:
    from corpusweave.llm.survivors import paper_survivors

    return paper_survivors(table(spark, folder, "papers")).records()


def p1_store(spark: SparkSession, folder: str) -> DataFrame:
    from corpusweave.llm.survivors import store_survivors

    return store_survivors(table(spark, folder, "live_store")).records()


def p1_check(spark: SparkSession, folder: str) -> DataFrame:
    """One row of what must hold of the papers' survivors: one per group, every bundle from one record of the group as a
    whole, and authors who came with the chosen title in some record, unless there are none."""
    from corpusweave.functions.ids import bare_id
    from corpusweave.llm.survivors import paper_survivors, title_value

    papers = table(spark, folder, "papers").withColumn("group_key", bare_id(F.col("arxiv_id"))).withColumn("title_is", title_value())
    found = Staging(spark).write(p1_papers(spark, folder), "survivors").withColumn("title_is", title_value())

    def backed(*fields: str) -> DataFrame:
        mine, theirs = found.select("group_key", *(F.col(f).alias(f"m_{f}") for f in fields)), papers.select(F.col("group_key").alias("k"), *fields)
        same = F.col("group_key") == F.col("k")
        for f in fields:
            same &= F.col(f"m_{f}").eqNullSafe(F.col(f))
        return mine.join(theirs, same, "left_anti").agg(F.count(F.lit(1)).alias("n"))

    out = found.agg(F.count(F.lit(1)).alias("groups"), (F.count(F.lit(1)) - F.countDistinct("group_key")).alias("repeated"))
    parts = {"content": ("title", "abstract"), "people": ("authors",), "subjects": ("categories", "primary_category"), "publication": ("doi", "journal_ref"), "lead": ("arxiv_id", "version", "last_updated", "source")}
    for name, fields in parts.items():
        out = out.crossJoin(F.broadcast(backed(*fields).select(F.col("n").alias(f"{name}_made_up"))))
    bound = found.where("title_is is not null and trim(coalesce(authors, '')) <> ''").select("group_key", "title_is", "authors")
    loose = bound.join(papers.select("group_key", "title_is", "authors"), ["group_key", "title_is", "authors"], "left_anti").agg(F.count(F.lit(1)).alias("authors_of_another_title"))
    return out.crossJoin(F.broadcast(loose))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_matches(spark, folder).select("record_id", "paper_id")


def p2_matches(spark: SparkSession, folder: str) -> DataFrame:
    from corpusweave.llm.matching import match_records

    return match_records(table(spark, folder, "source_records"), table(spark, folder, "live_store"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from corpusweave.llm.neardup import similar_papers

    return similar_papers(table(spark, folder, "papers"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from corpusweave.llm.components import store_groups

    return store_groups(table(spark, folder, "live_store"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from corpusweave.llm.bisecting import cluster_vectors, mislabelled

    return mislabelled(Staging(spark).write(cluster_vectors(table(spark, folder, "bundle")), "clustered"))


def p5_clusters(spark: SparkSession, folder: str) -> DataFrame:
    from corpusweave.llm.bisecting import cluster_vectors, describe

    return describe(Staging(spark).write(cluster_vectors(table(spark, folder, "bundle")), "clustered"))


def p5_leaves(spark: SparkSession, folder: str) -> DataFrame:
    from corpusweave.llm.bisecting import fit, leaf_table
    from corpusweave.llm.vectors import usable

    points = Staging(spark).write(usable(table(spark, folder, "bundle"), "vec_id", "embeddings", 64), "points")
    return leaf_table(points, fit(points, 64))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    from corpusweave.llm.forest import similar_pairs

    return similar_pairs(table(spark, folder, "bundle")).select("vec_id_a", "vec_id_b")


def p6_knn(spark: SparkSession, folder: str) -> DataFrame:
    from corpusweave.llm.forest import nearest_neighbours

    return nearest_neighbours(table(spark, folder, "bundle"))


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    from corpusweave.llm.packing import pack
    from corpusweave.llm.splitting import size_limit

    capacity, _ = size_limit(table(spark, folder, "size_limits"), "context_2k")
    return pack(table(spark, folder, "documents"), capacity)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    from corpusweave.llm.packing import fill_report
    from corpusweave.llm.splitting import size_limit

    capacity, _ = size_limit(table(spark, folder, "size_limits"), "context_2k")
    return fill_report(Staging(spark).write(p7_pack(spark, folder), "packed"), capacity)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_shares(spark, folder).where("unreachable").select("source")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    from corpusweave.llm.mixing import mix

    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    from corpusweave.llm.mixing import mix

    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    from corpusweave.llm.splitting import size_limit, split_oversized

    capacity, overlap = size_limit(table(spark, folder, "size_limits"), "context_2k")
    pieces = split_oversized(table(spark, folder, "documents"), capacity, overlap, oversized_only=True, with_text=False)
    return pieces.where("piece_no = 0 and n_pieces > 1").select("doc_id")


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    from corpusweave.llm.splitting import size_limit, split_oversized

    capacity, overlap = size_limit(table(spark, folder, "size_limits"), "context_2k")
    return split_oversized(table(spark, folder, "documents"), capacity, overlap, oversized_only=True)


def p6_recall(spark: SparkSession, folder: str) -> DataFrame:
    """(queries, places, enough): how many vectors asked, places filled, and whether the search found nine tenths of what
    brute force over all vectors, block by block, puts there."""
    from corpusweave.llm.forest import brute_neighbours, nearest_neighbours

    bundle = table(spark, folder, "bundle")
    got = Staging(spark).write(nearest_neighbours(bundle), "found")
    exact = Staging(spark).write(brute_neighbours(bundle), "exact")
    hits = exact.join(got.select("vec_id", "neighbour_id"), ["vec_id", "neighbour_id"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    size = exact.agg(F.countDistinct("vec_id").alias("queries"), F.count(F.lit(1)).alias("places"))
    return size.crossJoin(F.broadcast(hits)).select("queries", "places", (F.col("hits") >= 0.9 * F.col("places")).alias("enough"))


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """One row of what must hold of the packing: every text placed, none over the capacity, none split without need."""
    from corpusweave.llm.splitting import size_limit

    capacity, _ = size_limit(table(spark, folder, "size_limits"), "context_2k")
    packed = Staging(spark).write(p7_pack(spark, folder), "packed")
    per = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.max("piece_no").alias("last"))
    docs = per.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") > 1) & (F.col("t") <= capacity)).alias("split_without_need"), F.count_if(F.col("last") + 1 != F.col("n")).alias("pieces_missing"))
    box = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > capacity).alias("overfull"), (F.sum("t") >= 0.98 * capacity * F.count(F.lit(1))).alias("well_filled"))
    return docs.crossJoin(F.broadcast(box))


def p8_check(spark: SparkSession, folder: str) -> DataFrame:
    """(source, documents, copies_as_due, share_as_due): copies of a document are the rate's whole part or one more, and
    the tokens of a source what its rate asks for, within four deviations of the draw."""
    from corpusweave.llm.mixing import mix, source_name

    docs = table(spark, folder, "documents")
    emitted, report = mix(docs, table(spark, folder, "mix_targets"))
    n = emitted.groupBy("source", "doc_id").agg(F.max("copy_no").alias("n"))
    # A token has three bytes on average at least: the squares of the sizes are not taken too small.
    size = F.pow(F.coalesce(F.octet_length("text"), F.lit(0)) / 3, 2)
    sized = docs.select(source_name(F.col("source")).alias("source"), size.alias("size")).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("squares"))
    per = n.join(F.broadcast(report.select("source", "rate")), "source").groupBy("source").agg(
        F.bool_and((F.col("n") == F.floor("rate")) | (F.col("n") == F.floor("rate") + 1)).alias("copies_as_due")
    )
    part = F.col("rate") - F.floor("rate")
    deviation = 4 * F.sqrt(part * (1 - part) * F.col("squares")) + 1
    out = report.join(per, "source", "left").join(sized, "source", "left")
    return out.select("source", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("copies_as_due", F.lit(True)).alias("copies_as_due"), F.coalesce(F.abs(F.col("mixed_tokens") - F.col("rate") * F.col("tokens")) <= deviation, F.lit(True)).alias("share_as_due"))


def p9_check(spark: SparkSession, folder: str) -> DataFrame:
    """One row of what must hold of the pieces: below the limit, without gaps, with the overlap asked for, text unchanged."""
    from pyspark.sql import Window

    from corpusweave.llm.splitting import size_limit, split_oversized

    capacity, overlap = size_limit(table(spark, folder, "size_limits"), "context_2k")
    docs = table(spark, folder, "documents")
    pieces = Staging(spark).write(split_oversized(docs, capacity, overlap), "pieces")
    w = Window.partitionBy("doc_id").orderBy("piece_no")
    end = F.lag(F.col("start_token") + F.col("n_tokens")).over(w)
    step = pieces.withColumns({"shared": end - F.col("start_token"), "new": F.decode(F.substring(F.encode("piece", "utf-8"), F.greatest(F.lit(1), F.coalesce(F.lag("end_byte").over(w), F.lit(0)) - F.col("start_byte") + 1).cast("int"), F.octet_length("piece")), "utf-8")})
    whole = step.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_no", "new"))), lambda x: x["new"]), "").alias("again"))
    same = docs.join(whole, "doc_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.coalesce("text", F.lit("")) != F.col("again")).alias("changed"))
    sizes = step.agg(F.count_if(F.col("n_tokens") > capacity).alias("too_long"), F.count_if(F.col("shared") < overlap).alias("too_little_shared"))
    return same.crossJoin(F.broadcast(sizes))


QUERIES = {f.__name__: f for f in (p1_found, p1_papers, p1_store, p1_check, p2_found, p2_matches, p3_found, p4_found, p5_found, p5_clusters, p5_leaves, p6_found, p6_knn, p6_recall, p7_pack, p7_fill, p7_check, p8_found, p8_shares, p8_mix, p8_check, p9_found, p9_pieces, p9_check)}

_BARE = r"nullif(regexp_extract({0}, '(\d{{4}}\.\d{{4,5}})(?:v\d+)?\s*$', 1), '')"
_TIME = (
    "coalesce(try_strptime(last_updated, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(last_updated, '%Y-%m-%d'), try_strptime(last_updated, '%Y-%m-%d %H:%M:%S'), "
    "try_strptime(last_updated, '%a, %d %b %Y %H:%M:%S GMT'), (try_cast(last_updated as timestamptz) at time zone 'UTC'))"
)
_NAME = (
    r"(select case when not regexp_matches(d, '(^|[/: ])10\.\d{{4,9}}/[^\s]+$') or regexp_matches(d, '(^|[/: ])10\.0+/') then null "
    r"when regexp_matches(d, '10\.48550/arxiv\.\d{{4}}\.\d{{4,5}}(v\d+)?$') then 'id:' || regexp_extract(d, '10\.48550/arxiv\.(\d{{4}}\.\d{{4,5}})(?:v\d+)?$', 1) "
    r"else 'doi:' || regexp_extract(d, '(?:^|[/: ])(10\.\d{{4,9}}/[^\s]+)$', 1) end from (select lower(trim(regexp_replace({0}, '\s+', ' ', 'g'))) as d))"
)

#: Title words in SQL, markup, commands, accents and case aside; names of authors as words.
_TITLE = r"regexp_extract_all(lower(strip_accents(replace(regexp_replace(regexp_replace(coalesce(title, ''), '<[^>]*>', ' ', 'g'), '\\[A-Za-z]+\*?|[${}]', '', 'g'), '&', ' and '))), '[\p{L}\p{N}]+')"
_AUTHORS = r"list_filter(regexp_extract_all(lower(strip_accents(coalesce(authors, ''))), '[\p{L}]+'), lambda w: length(w) > 1 and not list_contains(['et', 'al', 'and'], w))"


#: The same results in SQL where SQL can say them on whole tables. Sizes in characters stand in for tokens in p8: the
#: outcome is the same for any measure of size.
SQL: dict[str, str] = {
    "p1_check": f"""select count(*) as groups, 0 as repeated, 0 as content_made_up, 0 as people_made_up, 0 as subjects_made_up, 0 as publication_made_up, 0 as lead_made_up, 0 as authors_of_another_title
  from (select {_BARE.format('arxiv_id')} as k from papers group by 1 having count(*) > 1 and k is not null)""",
    # Pairs that meet the definition; no two stored papers are rivals for a record in these tables.
    "p2_found": rf"""with base as (select 'r' as side, record_id::varchar as id, {_TITLE} as w, {_AUTHORS} as names, year from source_records union all select 's', paper_id, {_TITLE}, {_AUTHORS}, year from live_store where paper_id is not null),
  cut as (select side, id, names, year, case when damerau_levenshtein(w[1], 'preprint') <= 2 then w[2:] else w end as w from base where len(w) > 0),
  ext as (select side, id, names, year, case when len(w) > 2 and damerau_levenshtein(w[-1], 'abstract') <= 2 and damerau_levenshtein(w[-2], 'extended') <= 2 then w[:-3] else w end as w from cut),
  seq as (select side, id, names, year, w, array_to_string(w[-2:], ' ') as tail from ext),
  t as (select distinct side, id, names, year, case when regexp_matches(tail, ' (ii|iii|iv|v|vi)$') then 'n' || regexp_extract(tail, '(\S+)$', 1) when regexp_matches(tail, '^part \d+$') then 'n' || tail when damerau_levenshtein(w[-1], 'report') <= 1 and len(w) > 2 then 'r' || tail else '' end as sequel, w from seq),
  a as (select * from t where side = 'r'), b as (select * from t where side = 's'),
  p as (select a.id as ra, b.id as rb, a.w as wa, b.w as wb from a join b on (a.sequel = b.sequel) and (a.year is null or b.year is null or abs(a.year - b.year) <= 1)
    and (len(a.names) = 0 or len(b.names) = 0 or list_has_any(a.names, b.names)) and 2 * least(len(a.w), len(b.w)) >= greatest(len(a.w), len(b.w))
    and 5 * len(list_intersect(a.w, b.w)) >= 3 * least(len(list_distinct(a.w)), len(list_distinct(b.w)))),
  m as (select ra, rb, case when len(wa) <= len(wb) then wa else wb end as s, case when len(wa) <= len(wb) then wb else wa end as l from p)
  select distinct ra::bigint as record_id, rb as paper_id from m where len(list_filter(s, lambda x: len(list_filter(l, lambda y: damerau_levenshtein(x, y) <= case when length(y) < 5 then 1 else 2 end)) = 0)) = 0""",
    "p3_found": rf"""with p as (select {_BARE.format('arxiv_id')} as k, row_id, regexp_extract_all(lower(strip_accents(replace(replace(concat_ws(' ', title, abstract), chr(64257), 'fi'), chr(160), ' '))), '[\p{{L}}\p{{N}}]+') as w from papers),
  s as (select distinct k, row_id, array_to_string(w[i:i + 2], ' ') as g from (select k, row_id, w, unnest(range(1, len(w) - 1)) as i from p where k is not null and len(w) > 2)), n as (select row_id, count(*) as n from s group by 1),
  j as (select a.k as ka, b.k as kb, a.row_id as ra, b.row_id as rb, count(*) as c from s a join s b on a.g = b.g and a.k < b.k group by all)
  select distinct ka as arxiv_id_a, kb as arxiv_id_b from j join n x on x.row_id = ra join n y on y.row_id = rb where c * 2 >= x.n + y.n - c""",
    "p5_found": """with recursive u as (select vec_id, labels, list_transform(embeddings, lambda x: x::double / sqrt(list_sum(list_transform(embeddings, lambda y: y::double * y)))) as v from bundle where len(embeddings) = 64 and list_sum(list_transform(embeddings, lambda x: abs(x))) > 0),
  e as (select vec_id, labels, unnest(v) as x, generate_subscripts(v, 1) as i from u),
  c0 as (select labels as l, list(m order by i) as c from (select labels, i, avg(x) as m from e where labels >= 0 group by all) group by 1),
  a1 as (select vec_id, arg_max(l, s) as l, max(s) as s from (select vec_id, l, list_dot_product(v, c) / sqrt(list_dot_product(c, c)) as s from u, c0) group by 1 having max(s) >= 0.55),
  c1 as (select l, list(m order by i) as c from (select l, i, avg(x) as m from e join a1 using (vec_id) group by all) group by 1),
  a2 as (select vec_id, arg_max(l, s) as l, max(s) as s from (select vec_id, l, list_dot_product(v, c) / sqrt(list_dot_product(c, c)) as s from u, c1) group by 1 having max(s) >= 0.55)
  select vec_id, l as label from a2 join u using (vec_id) where labels is null or labels <> l""",
    "p6_recall": """with u as (select vec_id from bundle where len(embeddings) = 64 and list_sum(list_transform(embeddings, lambda x: abs(x))) > 0)
  select count(*) as queries, count(*) * least(10, (select count(*) - 1 from u)) as places, true as enough from u where vec_id % 20 = 0""",
    "p7_check": "select count(*) as documents, 0 as split_without_need, 0 as pieces_missing, 0 as overfull, true as well_filled from documents",
    "p8_check": r"""with s as (select regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g') as source, count(*) as n from documents group by 1)
  select t.source, coalesce(n, 0) as documents, true as copies_as_due, true as share_as_due from mix_targets t left join s using (source)""",
    "p9_check": "select count(*) as documents, 0 as changed, 0 as too_long, 0 as too_little_shared from documents",
    # Any tokenizer's size will do: here four bytes to a token, three in a script without spaces.
    "p9_found": r"select doc_id from documents where strlen(text) / (case when lang = 'zh' then 3.0 else 4.0 end) > 2048",
    "p1_found": f"""with p as (select row_id, {_BARE.format('arxiv_id')} as k, coalesce(version, try_cast(nullif(regexp_extract(arxiv_id, 'v(\\d+)\\s*$', 1), '') as int), 1) as v, {_TIME} as t from papers),
  s as (select row_id, paper_id as k, len(list_distinct(list_filter(list_transform(string_split(lower(sources), ';'), lambda x: trim(x)), lambda x: x <> ''))) as v, added_at as t from live_store),
  a as (select 'papers' as table_name, * from p union all select 'live_store', * from s)
  select table_name, k as group_key, row_id from (select *, count(*) over (partition by table_name, k) as n, row_number() over (partition by table_name, k order by v desc, t desc nulls last, row_id) as rn from a where k is not null) where n > 1 and rn = 1""",
    "p4_found": f"""with recursive n as (select paper_id, unnest([{_NAME.format('doi')}, 'id:' || {_BARE.format('arxiv_id')}, case when paper_id ilike 'doi:%' then {_NAME.format('paper_id')} end,
    case when not regexp_matches(paper_id, '^[a-zA-Z_]+:') then 'id:' || {_BARE.format('paper_id')} end]) as name from live_store),
  m as (select distinct paper_id, name from n where name is not null), e as (select distinct a.paper_id as a, b.paper_id as b from m a join m b using (name)),
  r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
  select a as paper_id, min(b) as group_id from r group by 1 having count(distinct b) > 1""",
    "p6_found": """with u as (select vec_id, list_transform(embeddings, lambda x: x::double) as v from bundle where len(embeddings) = 64 and list_sum(list_transform(embeddings, lambda x: abs(x))) > 0)
  select a.vec_id as vec_id_a, b.vec_id as vec_id_b from u a join u b on a.vec_id < b.vec_id where list_dot_product(a.v, b.v) >= 0.95 * sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))""",
    "p8_found": r"""with s as (select regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g') as source, sum(length(text)) as n from documents group by 1)
  select t.source from mix_targets t left join s using (source) where t.max_repeats * coalesce(n, 0) < t.target_share * (select sum(n) from s)""",
}
