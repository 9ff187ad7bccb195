"""Data behind the views of areas, workspace, leads, reading list and dataset tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def area_filter(areas: DataFrame, text: str, columns: tuple[str, ...] = ("name", "keywords")) -> DataFrame:
    """Areas whose name or keywords hold the text, case set aside; an empty text holds everywhere."""
    return areas.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.strip().lower())))


def workspace(papers: DataFrame, areas: list[int] | None = None, categories: list[str] | None = None, sort: str = "newest", limit: int = 400) -> DataFrame:
    """Papers of the areas and categories, newest or most cited first, then the other way, then by id; with `place`.

    The limit is the length of the list that a view shows."""
    kept = papers
    if areas:
        kept = kept.where(F.col("cluster_id").isin(areas))
    if categories:
        kept = kept.where(F.col("primary_category").isin(categories))
    by = [F.desc_nulls_last("date"), F.desc_nulls_last("cited_by_count")]
    order = [*(by if sort == "newest" else by[::-1]), F.asc("id")]
    top = kept.orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def readiness(papers: DataFrame, growth: DataFrame, least: float = 0.1) -> DataFrame:
    """One row of what the data can carry: shares of papers with citations and with a velocity, whether they reach
    `least`, whether any growth is sufficient and any reliable (growth: sufficient, passes_gate, stable)."""
    share = lambda c: F.coalesce(F.avg((F.coalesce(F.col(c), F.lit(0)) > 0).cast("double")), F.lit(0.0))
    p = papers.agg(share("cited_by_count").alias("citation_coverage"), F.coalesce(F.avg(F.col("citation_velocity").isNotNull().cast("double")), F.lit(0.0)).alias("velocity_coverage"))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = growth.agg(some(F.col("sufficient")).alias("growth_ready"), some(F.col("passes_gate") & F.coalesce("stable", F.lit(False))).alias("growth_reliable"))
    return p.withColumns({"citations_ready": F.col("citation_coverage") >= least, "velocity_ready": F.col("velocity_coverage") >= least}).crossJoin(F.broadcast(g))


def representatives_with_text(representatives: DataFrame, papers: DataFrame) -> DataFrame:
    """Representative papers with title and abstract, null where the paper is not known."""
    return representatives.join(papers.select("id", "title", "abstract"), "id", "left")


def top_categories(papers: DataFrame, n: int = 3) -> DataFrame:
    """(cluster_id, categories): the n most frequent categories of each area, ties by name."""
    counts = papers.where("cluster_id >= 0 and primary_category is not null").groupBy("cluster_id", "primary_category").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "primary_category")
    top = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    listed = top.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("r", "primary_category"))).alias("c"))
    return listed.select("cluster_id", F.transform("c", lambda x: x["primary_category"]).alias("categories"))


def dataset_tiles(papers: DataFrame, today: Column, date: str = "date") -> DataFrame:
    """One row: papers, areas, first and last day, span in months, share with citations, days since the last paper."""
    return papers.agg(
        F.count(F.lit(1)).alias("n_papers"), F.countDistinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_areas"),
        F.to_date(F.min(date)).alias("first_day"), F.to_date(F.max(date)).alias("last_day"), F.round(F.date_diff(F.max(date), F.min(date)) / 30.44, 1).alias("span_months"),
        F.avg((F.coalesce("cited_by_count", F.lit(0)) > 0).cast("double")).alias("with_citations"), F.date_diff(today, F.max(date)).alias("age_days"),
    )


def toggled(saved: DataFrame, changes: DataFrame, key: str = "paper_id") -> DataFrame:
    """A reading list after changes (key): what was in it goes, what was not comes in; an id named twice stays as it was."""
    odd = changes.groupBy(key).agg((F.count(F.lit(1)) % 2).alias("n")).where("n = 1").select(key)
    kept = saved.select(key).distinct()
    return kept.join(odd, key, "left_anti").unionByName(odd.join(kept, key, "left_anti"))


def lead_evidence(leads: DataFrame, n: int = 3) -> DataFrame:
    """Leads with the first n of their evidence."""
    return leads.withColumn("evidence", F.slice("evidence", 1, n))


def probe_rows(df: DataFrame, key: str, n: int = 3) -> DataFrame:
    """n rows spread evenly over the order of the key, the first and the last among them; all rows where there are fewer."""
    from corpusweave.operators.ranks import with_rank

    ranked = with_rank(df.withColumn("__t", F.lit(0)), key, "__t").drop("__t")
    size = ranked.count()
    places = sorted({round(i * (size - 1) / max(1, n - 1)) for i in range(n)}) if size else []
    return ranked.where(F.col("rank").isin(places)).drop("rank")


def paper_url(arxiv_id: Column, doi: Column, url: Column, base: str = "https://arxiv.org/abs/") -> Column:
    """Where a paper is read: its page by id, else its DOI's, else the record's own."""
    text = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))
    return F.coalesce(F.concat(F.lit(base), text(arxiv_id)), F.concat(F.lit("https://doi.org/"), text(doi)), text(url))


def growth_text(growth: Column) -> Column:
    """Relative growth in words; null has none."""
    change = F.round((growth - 1) * 100).cast("long")
    said = F.when(change > 0, F.concat(F.lit("+"), change.cast("string"), F.lit(" %"))).otherwise(F.concat(change.cast("string"), F.lit(" %")))
    return F.when(growth.isNotNull(), F.concat(said, F.lit(" against the corpus")))


def area_name(label: Column, cluster: Column, overrides: dict[int, str] | None = None) -> Column:
    """Name of an area: the one given by hand, else its label, else its number; noise has a name of its own."""
    own = F.lit(None).cast("string")
    for c, name in (overrides or {}).items():
        own = F.when(cluster == c, name).otherwise(own)
    text = F.when(F.trim(F.coalesce(label, F.lit(""))) != "", label)
    return F.when(cluster < 0, "Unclustered").otherwise(F.coalesce(own, text, F.concat(F.lit("Area "), cluster.cast("string"))))


def growth_badge(direction: Column, reliable: Column) -> Column:
    """Word beside an area: its direction if that is reliable, else that it is not known."""
    return F.when(F.coalesce(reliable, F.lit(False)), direction).otherwise("uncertain")
