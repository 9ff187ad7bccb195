"""Enrichment: joins of citation data, velocity, match statistics, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions.text import key_of, with_normal_forms


def with_records(corpus: DataFrame, records: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """corpus with the columns of records by key, defaults where there is no record. Records are unique by key."""
    got = corpus.join(records.select(key, *(F.col(c).alias(f"__{c}") for c in defaults)), key, "left")
    return got.select(*corpus.columns, *(F.coalesce(F.col(f"__{c}"), F.lit(v)).alias(c) for c, v in defaults.items()))


def citation_velocity(history: DataFrame, key: str, date: str, count: str, horizon_days: int = 90) -> DataFrame:
    """(key, velocity): citations gained per 30 days between a key's first and last snapshot of the horizon before the
    last snapshot of all; keys with a single snapshot in it have none."""
    last = history.agg(F.max(date).alias("__last"))
    recent = history.crossJoin(F.broadcast(last)).where(F.date_diff("__last", date) <= horizon_days)
    got = recent.groupBy(key).agg(
        F.min_by(count, date).alias("a"), F.max_by(count, date).alias("b"), F.count(F.lit(1)).alias("n"),
        F.date_diff(F.max(date), F.min(date)).alias("days"),
    ).where("n >= 2 and days > 0")
    return got.select(key, F.round(F.greatest(F.lit(0.0), (F.col("b") - F.col("a")) * 30.0 / F.col("days")), 3).alias("velocity"))


def match_stats(df: DataFrame, matched: Column, date: str, category: str, top: int = 40, today: Column | None = None) -> DataFrame:
    """Match rates overall, of rows more than 3 and 6 months older than `today` (the latest date if not said), by month
    and of the most frequent categories; one pass of grouping sets, in which a row's age counts beside its month."""
    last = df.agg(F.max(date).alias("__last"))
    day = F.col("__last") if today is None else today
    base = df.crossJoin(F.broadcast(last)).select(
        matched.cast("int").alias("m"), F.date_format(date, "yyyy-MM").alias("year_month"), F.col(category).alias("category"),
        F.when(F.col(date) < F.add_months(day, -6), "older_6m").when(F.col(date) < F.add_months(day, -3), "older_3m").otherwise("newer").alias("age"),
    )
    sets = base.groupingSets([[], ["age"], ["year_month"], ["category"]], "age", "year_month", "category").agg(
        F.grouping_id("age", "year_month", "category").alias("g"), F.sum("m").alias("hits"), F.count(F.lit(1)).alias("n")
    )
    # What is older than 6 months is older than 3 as well.
    old = sets.where("g = 3 and age <> 'newer'").select(F.explode(F.when(F.col("age") == "older_6m", F.array(F.lit("older_3m"), F.lit("older_6m"))).otherwise(F.array("age"))).alias("kind"), "hits", "n")
    aged = old.groupBy("kind").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).select("kind", F.lit("").alias("value"), "hits", "n")
    kind = F.when(F.col("g") == 7, "all").when(F.col("g") == 5, "month").otherwise("category")
    w = Window.partitionBy("g").orderBy(F.desc("n"), "category")
    ranked = sets.where("g <> 3").withColumn("r", F.row_number().over(w)).where((F.col("g") != 6) | (F.col("r") <= top))
    value = F.when(F.col("g") == 5, F.col("year_month")).when(F.col("g") == 6, F.col("category")).otherwise(F.lit(""))
    rows = ranked.select(kind.alias("kind"), value.alias("value"), "hits", "n").unionByName(aged)
    return rows.select("kind", "value", F.round(F.col("hits") / F.col("n"), 6).alias("rate"), "n")


def by_title(papers: DataFrame, works: DataFrame, paper: str, work: str, least: int = 12, limit: int | None = None) -> DataFrame:
    """(paper, work): of papers without a record, the work whose title key is the same; a shorter key than `least` names
    nothing, of several works the least id counts. `limit` bounds how many papers are looked up, the least ids first."""
    mine = with_normal_forms(papers.select(paper, "title"), ["title"]).select(paper, key_of(F.col("__ascii_title")).alias("key")).where(F.length("key") >= least)
    if limit is not None:
        mine = mine.orderBy(paper).limit(limit)
    theirs = with_normal_forms(works.select(work, "title"), ["title"]).select(work, key_of(F.col("__ascii_title")).alias("key"))
    return mine.join(theirs.groupBy("key").agg(F.min(work).alias(work)), "key").select(paper, work)


def refresh_days(age: Column) -> Column:
    """Days after which cached enrichment of a paper of this age is fetched again."""
    return F.when(age < 91, 7).when(age < 730, 30).otherwise(90)


def is_stale(fetched: Column, today: Column, age: Column, has_record: Column, version: Column, current: int, retry_days: int = 14) -> Column:
    """Whether a cache entry is to be fetched: never fetched, of an older record version, or due by the paper's age."""
    since = F.date_diff(today, fetched)
    return (
        F.when(fetched.isNull(), True)
        .when(~has_record, since >= retry_days)
        .when(F.coalesce(version, F.lit(0)) < current, True)
        .otherwise(since >= refresh_days(age))
    )


def richest_work(works: DataFrame, key: str, references: str, cited: str, tie: str) -> DataFrame:
    """Of several works of one key the one with the most references, then citations."""
    w = Window.partitionBy(key).orderBy(F.desc(F.size(references)), F.desc(cited), tie)
    return works.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def inverted_text(col: Column) -> Column:
    """Text of a word -> positions map."""
    pairs = F.flatten(F.transform(F.map_entries(col), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def disagreeing_counts(a: DataFrame, b: DataFrame, key: str, count: str) -> DataFrame:
    """Rows whose two counts differ by more than 10 and by more than half of the larger."""
    both = a.select(key, F.col(count).alias("a")).join(b.select(key, F.col(count).alias("b")), key)
    return both.where(F.abs(F.col("a") - F.col("b")) > F.greatest(F.lit(10.0), 0.5 * F.greatest("a", "b")))
