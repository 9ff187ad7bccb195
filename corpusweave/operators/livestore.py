"""Live records: identity keys, merging, membership in a collection, federated results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.ids import bare_id, normalize_doi, preprint_id
from corpusweave.functions.text import key_of, with_normal_forms
from corpusweave.operators.graph import components

#: A shorter title identifies nothing.
LEAST_TITLE = 12


def identity_keys(doi: Column, arxiv_id: Column, title_key: Column, year: Column, neighbours: bool) -> Column:
    """Keys that identify a record: DOI, paper id, and title with year; with `neighbours` also the years beside it."""
    d = normalize_doi(doi)
    paper = F.coalesce(bare_id(arxiv_id), preprint_id(d))
    titled = F.when(F.length(title_key) >= LEAST_TITLE, title_key)
    at = lambda k: F.concat(F.lit("title:"), titled, F.lit("|"), F.coalesce((year + k).cast("string"), F.lit("")))
    every = [F.concat(F.lit("doi:"), d), F.concat(F.lit("arxiv:"), paper), at(0)]
    if neighbours:
        every += [F.when(year.isNotNull(), at(-1)), F.when(year.isNotNull(), at(1))]
    return F.array_distinct(F.array_compact(F.array(*every)))


def record_id(doi: Column, arxiv_id: Column, source: Column, source_id: Column, title_key: Column) -> Column:
    """Paper id, else `doi:`, else the source's own id, else a hash of the title's key."""
    own = F.when(F.coalesce(source_id, F.lit("")) != "", F.concat(source, F.lit(":"), source_id))
    hashed = F.concat(F.lit("title:"), F.substring(F.sha1(title_key), 1, 16))
    return F.coalesce(bare_id(arxiv_id), F.concat(F.lit("doi:"), normalize_doi(doi)), own, hashed)


def with_keys(df: DataFrame, neighbours: bool = False) -> DataFrame:
    """df with its identity `keys`; only titles that are not ASCII reach Python."""
    forms = with_normal_forms(df, ["title"])
    keys = identity_keys(F.col("doi"), F.col("arxiv_id"), key_of(F.col("__ascii_title")), F.col("year"), neighbours)
    return forms.withColumn("keys", keys).select(*df.columns, "keys")


def known_in(records: DataFrame, collection: DataFrame, record: str, neighbours: bool = True) -> DataFrame:
    """Records that share any identity key with the collection, as (record)."""
    mine = with_keys(records, neighbours).select(record, F.explode("keys").alias("key"))
    theirs = with_keys(collection).select(F.explode("keys").alias("key")).distinct()
    return mine.join(theirs, "key", "left_semi").select(record).distinct()


def unknown_in(records: DataFrame, collection: DataFrame, record: str) -> DataFrame:
    """Records that share no identity key with the collection."""
    return records.join(known_in(records, collection, record), record, "left_anti")


def enrich_groups(df: DataFrame, key: str, seq: str, first: list[str], longest: list[str], largest: list[str], lists: list[str]) -> DataFrame:
    """One row per key: first non-empty values by `seq`, longest texts, largest numbers, unions of `;` lists.

    First and longest values are minima and maxima of structs, lists are sets of their few names: all of it is
    aggregated partially before the shuffle."""
    filled = lambda c: F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", F.col(c))
    names = lambda c: F.filter(F.transform(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return df.groupBy(key).agg(
        *(F.min_by(filled(c), F.when(filled(c).isNotNull(), F.col(seq))).alias(c) for c in first),
        *(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.length(c), -F.col(seq)))).alias(c) for c in longest),
        *(F.max(c).alias(c) for c in largest),
        *(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(names(c))))), ";").alias(c) for c in lists),
    )


def resolve(records: DataFrame, seq: str) -> DataFrame:
    """(seq, entity): every record with the least seq of the records it is linked to, directly or not.

    Records are linked that share a DOI or a paper id, or a title in the same year or in years side by side. The records
    of a key in their own year form a star, and those of the years beside it are tied to its centre, so edges stay
    fewer than keys; years two apart are linked only through a record between them.
    """
    own = with_keys(records, False).select(seq, F.explode("keys").alias("key"))
    wide = with_keys(records, True).select(seq, F.explode("keys").alias("key"))
    centre = own.groupBy("key").agg(F.min(seq).alias("src"))
    ties = wide.join(centre, "key").where(F.col(seq) != F.col("src")).select("src", F.col(seq).alias("dst"))
    comp = components(ties).select(F.col("node").alias(seq), "component")
    return records.select(seq).join(comp, seq, "left").select(seq, F.coalesce("component", seq).alias("entity"))


def merge_in_order(records: DataFrame, batch: str, seq: str) -> DataFrame:
    """(batch, seq, entity): records of one fetched batch merged greedily in order, as `entity`, its first record's seq.

    A record joins the first entity that knows any of its keys, a title also in the years beside, and adds its own keys
    to it; so a chain can stay in two entities. Batches are a search's own pages, of bounded size, and independent.
    """
    keyed = with_keys(with_keys(records, True).withColumnRenamed("keys", "wide"), False)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict[str, int] = {}
        out = []
        for r in pdf.sort_values(seq).itertuples():
            s = int(getattr(r, seq))
            entity = next((known[k] for k in r.wide if k in known), s)
            for k in r.keys:
                known.setdefault(k, entity)
            out.append(entity)
        return pdf.sort_values(seq)[[batch, seq]].assign(entity=out)

    kinds = {f.name: f.dataType.simpleString() for f in records.schema}
    return keyed.select(batch, seq, "keys", "wide").groupBy(batch).applyInPandas(merge, f"{batch} {kinds[batch]}, {seq} {kinds[seq]}, entity long")


def federate(collection: DataFrame, store: DataFrame, rel_floor: float = 0.5, cap: int = 50) -> DataFrame:
    """Results of the collection and the live store in one list (query_id, doc_id, origin, level, sim, rank).

    Phrase matches lead, by level and similarity; of the rest those survive that reach `rel_floor` of the way from the
    mean to the best similarity, where there are at least two."""
    from pyspark.sql import Window

    both = collection.withColumn("origin", F.lit("collection")).unionByName(store.withColumn("origin", F.lit("store")))
    rest = Window.partitionBy("query_id", F.col("level").isNull())
    base, best, n = F.avg("sim").over(rest), F.max("sim").over(rest), F.count(F.lit(1)).over(rest)
    kept = both.withColumn("__ok", F.col("level").isNotNull() | (n < 2) | (F.col("sim") >= base + rel_floor * (best - base))).where("__ok").drop("__ok")
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("level"), F.desc("sim"), "doc_id")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)
