"""Consolidating pairwise matches: connected components by alternating large-star and small-star rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.ids import bare_id, normalize_doi
from corpusweave.runtime import Staging


def _stars(edges: DataFrame, keep: Column) -> DataFrame:
    """Every neighbour of u that `keep` admits is tied to the least node around u.

    The least neighbour is a partially aggregated minimum; joining it back leaves a hub's edges spread over tasks,
    since adaptive execution splits the skewed side. No neighbourhood is ever held in one place.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("mv")).select("u", F.least("u", "mv").alias("m"))
    return edges.join(least, "u").where(keep).select("u", "v", "m")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    got = _stars(down, F.lit(True))
    tied = got.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        got.select("u", F.col("m").alias("v"))
    )
    return tied.where("u <> v").distinct()


def connected_components(pairs: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): each node of `pairs` with the least node linked to it directly or indirectly.

    Nulls, self loops and repeated pairs tie nothing; an empty input gives an empty result; nodes may be of any
    orderable type, and ties do not arise because the least node is unique. Each round writes the rewritten edges to
    the shared folder, so a lost executor costs a re-read, not the lineage of all rounds.
    """
    staging = Staging(pairs.sparkSession)
    edges = pairs.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").distinct()
    edges = staging.write(edges, "edges")
    seen = None
    while True:
        after = staging.write(small_star(large_star(edges)), "edges")
        now = after.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))
        ).first()
        staging.drop(edges)
        edges = after
        if now == seen:
            break
        seen = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def name_of(doi: Column) -> Column:
    """Name of what a DOI identifies; the preprint DOI `10.48550/arXiv.X` names paper id X."""
    d = normalize_doi(doi)
    preprint = F.regexp_extract(d, r"^10\.48550/arxiv\.(\d{4}\.\d{4,5})(v\d+)?$", 1)
    return F.when(preprint != "", F.concat(F.lit("id:"), preprint)).otherwise(F.concat(F.lit("doi:"), d))


def identifier_links(store: DataFrame) -> DataFrame:
    """(src, dst) between paper ids that name the same DOI or bare id; one star per identifier, never all pairs.

    Placeholders, empty and null identifiers tie nothing. Rows without a `paper_id` are left out.
    """
    pid = F.col("paper_id")
    names = F.array_compact(
        F.array(
            name_of(F.col("doi")),
            F.concat(F.lit("id:"), bare_id(F.col("arxiv_id"))),
            F.when(pid.rlike(r"(?i)^\s*doi:"), name_of(pid)),
            F.concat(F.lit("id:"), bare_id(F.when(~pid.rlike(r"(?i)^\s*[a-z_]+:") | pid.rlike(r"(?i)^\s*arxiv:"), pid))),
        )
    )
    named = store.where(pid.isNotNull()).select("paper_id", F.explode(F.array_distinct(names)).alias("name")).distinct()
    centre = named.groupBy("name").agg(F.min("paper_id").alias("src"))
    return named.join(centre, "name").where("src <> paper_id").select("src", F.col("paper_id").alias("dst"))


def store_groups(store: DataFrame) -> DataFrame:
    """(paper_id, group_id) of every paper id tied to at least one other; group_id is the least of its group."""
    return connected_components(identifier_links(store)).select(
        F.col("node").alias("paper_id"), F.col("component").alias("group_id")
    )
