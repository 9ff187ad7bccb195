"""Cleaning, de-duplication, sampling and quality checks of paper records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions.ids import bare_id, id_version, parse_time
from corpusweave.operators.ranks import first_of_groups
from corpusweave.functions.text import cleaned, has_category, is_english, key_of, with_normal_forms

#: Columns of a cleaned corpus.
CORPUS = [
    "arxiv_id", "version", "title", "abstract", "authors", "categories", "primary_category", "first_submitted", "last_updated",
    "doi", "journal_ref", "license", "date", "year_month",
]


def in_window(col: Column, start: str | None, end: str | None) -> Column:
    """start <= col < end + 1 day; an open side does not restrict."""
    ok = F.lit(True)
    if start:
        ok &= col >= F.lit(start).cast("timestamp_ntz")
    if end:
        ok &= col < F.lit(end).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    return ok


def latest(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The last row of each key by `order`, which must be total for a defined result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def clean_records(
    df: DataFrame, prefix: str = "cs.", start: str | None = None, end: str | None = None, min_chars: int = 50,
    english: bool = True, whitelist: list[str] | None = None,
) -> DataFrame:
    """Cleaned corpus of raw paper rows.

    Rows without id, title or abstract, of other categories, outside the window, with a short or non-English abstract
    go. Of one id the highest version stays, then of one title key the latest; ties go to the larger `row_id`. Cheap
    built-in predicates come first, and of the rows they leave Python sees those that are not ASCII, once. Empty input
    gives an empty result; extra columns are dropped.
    """
    def ntz(col: Column) -> Column:
        return F.to_timestamp_ntz(F.date_format(col, "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss"))

    rows = df.where(F.col("arxiv_id").isNotNull() & F.col("title").isNotNull() & F.col("abstract").isNotNull())
    rows = rows.where(has_category(F.col("categories"), prefix, whitelist))
    rows = rows.withColumns({
        "__id": bare_id(F.col("arxiv_id")),
        "__v": F.coalesce(F.col("version"), id_version(F.col("arxiv_id")), F.lit(1)),
        "date": ntz(parse_time(F.col("first_submitted"))),
        "__u": ntz(parse_time(F.col("last_updated"))),
    }).where("__id is not null and date is not null")
    rows = rows.where(in_window(F.col("date"), start, end))
    rows = with_normal_forms(rows, ["title", "abstract"])
    rows = rows.withColumns({"title": cleaned(F.col("__nfkc_title")), "abstract": cleaned(F.col("__nfkc_abstract"))})
    rows = rows.where((F.length("abstract") >= min_chars) & (F.col("title") != ""))
    if english:
        rows = rows.where(is_english(F.col("abstract")))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = rows.withColumns({
        "__u": F.coalesce("__u", "date"),
        "__p": F.when(blank("primary_category") == "", F.split("categories", " ")[0]).otherwise(F.col("primary_category")),
        "__key": key_of(F.col("__ascii_title")),
    })
    one = latest(rows, ["__id"], [F.desc("__v"), F.desc("__u"), F.desc("row_id")])
    one = latest(one, ["__key"], [F.desc("__v"), F.desc("__u"), F.desc("row_id")])
    return one.select(
        F.col("__id").alias("arxiv_id"), F.col("__v").alias("version"), "title", "abstract", blank("authors").alias("authors"),
        "categories", F.col("__p").alias("primary_category"), F.col("date").alias("first_submitted"), F.col("__u").alias("last_updated"),
        blank("doi").alias("doi"), blank("journal_ref").alias("journal_ref"), blank("license").alias("license"), "date",
        F.date_format("date", "yyyy-MM").alias("year_month"),
    )


def value_counts(df: DataFrame, col: str, n: int) -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first(col)).limit(n)


def snapshot_stats(df: DataFrame, date: str, category: str) -> DataFrame:
    """One row: rows, distinct months and categories, first and last date, span in months."""
    span = F.date_diff(F.max(date), F.min(date)) / 30.44
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.date_format(date, "yyyy-MM")).alias("n_months"),
        F.countDistinct(category).alias("n_categories"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.round(span, 1).alias("span_months"),
    )


def monthly_spine(df: DataFrame, date: str) -> DataFrame:
    """(month, n) of every month between the first and the last, empty months included. The spine has one row a month."""
    counts = df.where(F.col(date).isNotNull()).groupBy(F.trunc(date, "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a is not null")
    spine = ends.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return spine.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def quality_checks(df: DataFrame, date: str, category: str, text: str, key: str, previous_rows: int | None = None) -> DataFrame:
    """One row of quality figures: span, least month without the partial last one, category share, missing and repeats.

    The last month is partial if its latest day is more than three days before its end and there are other months.
    """
    last = df.agg(F.max(date).alias("d")).select(
        F.trunc("d", "MM").alias("last_month"), (F.dayofmonth("d") < F.dayofmonth(F.last_day("d")) - 3).alias("partial")
    )
    months = monthly_spine(df, date)
    least = months.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(months.agg(F.count(F.lit(1)).alias("k"))))
    least = least.where(~(F.col("partial") & (F.col("month") == F.col("last_month")) & (F.col("k") > 1))).agg(F.min("n").alias("min_month"))
    share = df.groupBy(category).agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("max_category_share"))
    main = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.date_diff(F.max(date), F.min(date)) / 30.44, 1).alias("span_months"),
        F.avg((F.coalesce(F.col(text), F.lit("")) == "").cast("double")).alias("missing_rate"),
        (F.count(key) - F.countDistinct(key)).alias("duplicate_keys"),
    )
    out = main.crossJoin(F.broadcast(least)).crossJoin(F.broadcast(share))
    change = (F.col("n_rows") - previous_rows) / previous_rows if previous_rows else F.lit(None).cast("double")
    return out.withColumn("row_change", change)


def water_level(sizes: list[int], cap: int) -> int:
    """The largest whole q for which the sum of min(size, q) stays within cap."""
    if sum(sizes) <= cap:
        return max(sizes, default=0)
    low, high = 0, max(sizes)
    while low < high:
        q = (low + high + 1) // 2
        if sum(min(s, q) for s in sizes) <= cap:
            low = q
        else:
            high = q - 1
    return low


def stratified_sample(df: DataFrame, strata: list[str], key: str, cap: int) -> DataFrame:
    """At most `cap` rows, filled evenly over the strata, each with the weight its stratum's rows then stand for.

    What the even level leaves over goes one by one to the strata with the most rows left. Rows are taken in the order
    of a hash of their key, in hashed parts of a stratum first. The strata's sizes, one row per category and month, are
    what the driver sees and what is broadcast.
    """
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    rows = sorted(sizes.collect(), key=lambda r: tuple(map(str, r[: len(strata)])))
    level = water_level([r.n for r in rows], cap)
    quota = [min(r.n, level) for r in rows]
    spare = cap - sum(quota)
    for i in sorted(range(len(rows)), key=lambda i: (-(rows[i].n - quota[i]), i)):
        if spare <= 0 or quota[i] >= rows[i].n:
            break
        quota[i] += 1
        spare -= 1
    plan = df.sparkSession.createDataFrame(
        [(*r[: len(strata)], q, r.n / q if q else 0.0) for r, q in zip(rows, quota)],
        ", ".join(f"{s} {df.select(s).schema[0].dataType.simpleString()}" for s in strata) + ", __quota int, sample_weight double",
    )
    same = df[strata[0]].eqNullSafe(plan[strata[0]])
    for c in strata[1:]:
        same &= df[c].eqNullSafe(plan[c])
    known = df.join(F.broadcast(plan), same).select(*(df[c] for c in df.columns), "__quota", "sample_weight")
    ranked = first_of_groups(known, strata, [F.md5(F.col(key).cast("string")), F.col(key)], F.col("__quota"), key)
    return ranked.select(*df.columns, "sample_weight")


def round_robin(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """n rows taken in turn from the groups, groups in the order of their first row."""
    w = Window.partitionBy(group).orderBy(*order)
    first = df.groupBy(group).agg(F.min(F.struct(*order)).alias("__first"))
    ranked = df.withColumn("__turn", F.row_number().over(w)).join(first, group)
    return ranked.orderBy("__turn", "__first").limit(n).drop("__first").withColumnRenamed("__turn", "turn")


def newest(df: DataFrame, date: str, key: str, cap: int) -> DataFrame:
    return df.orderBy(F.desc(date), key).limit(cap)
