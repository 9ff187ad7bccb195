"""Best representative of each duplicate group: consistent bundles chosen by branch and bound."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.ids import bare_id, id_version, parse_time
from corpusweave.runtime import Staging


@dataclass(frozen=True)
class Bundle:
    """Fields taken together from one record. `trust` is a BIGINT of at least 0; a bundle without any value has 0."""

    name: str
    fields: tuple[str, ...]
    trust: Column


@dataclass(frozen=True)
class Dependency:
    """The value `lhs`, a part of bundle `of`, determines bundle `on`: both chosen, some record must hold them together.
    It binds nothing where `lhs` is null or the chosen bundle is empty. `of` comes before `on` in the bundles."""

    of: str
    lhs: Column
    on: str


@dataclass
class Survivors:
    """chosen (key, row_lead, row_<bundle>..., trust): the row that leads each group and the row each bundle is from."""

    chosen: DataFrame
    rows: DataFrame
    key: str
    bundles: list[Bundle]
    anchor_fields: tuple[str, ...]

    def records(self) -> DataFrame:
        """One record per group, its fields filled from the chosen rows: one join for all bundles and one aggregate."""
        parts = [("__lead", "row_lead", self.anchor_fields), *((b.name, f"row_{b.name}", b.fields) for b in self.bundles)]
        wanted = self.chosen.select(
            F.col("__key").alias("__k"),
            F.explode(F.array(*(F.struct(F.lit(n).alias("part"), F.col(c).alias("row_id")) for n, c, _ in parts))).alias("w"),
        ).select("__k", "w.part", "w.row_id")
        fields = [f for _, _, fs in parts for f in fs]
        full = self.rows.select("row_id", *(F.col(f).alias(f"__f_{f}") for f in fields))
        picked = wanted.join(full, "row_id")
        return picked.groupBy(F.col("__k").alias(self.key)).agg(
            F.max(F.when(F.col("part") == "__lead", F.col("row_id"))).alias("row_id"),
            *(F.max(F.when(F.col("part") == n, F.col(f"__f_{f}"))).alias(f) for n, _, fs in parts for f in fs if f != "row_id"),
        )


def survivors(
    rows: DataFrame, key: Column, anchor: list[Column], bundles: list[Bundle], dependencies: list[Dependency],
    anchor_fields: tuple[str, ...] = (), key_name: str = "group_key",
) -> Survivors:
    """One survivor per group of two or more rows of one non-null key; `rows` has a unique `row_id`.

    The choice is the greatest by the lead, which is the row greatest by `anchor` (nulls least), then of the least
    row_id, and after it by the total trust of the other bundles that the dependencies admit. Branch and bound, a bundle
    at a level and all groups at once, the lead at the first:
    * bound: the best lead and the best total of a single row are reachable, so a lead below the best is cut, as is a
      candidate whose trust, with the best of all other bundles, stays below the total, and a partial choice likewise at
      each level;
    * dominance: of partial choices that the remaining dependencies cannot tell apart only the best is kept.
    Ties go to the lesser row ids, in the order of the bundles. A level is a join and an aggregate: a choice that binds a
    bundle meets the candidates of its own value, one that does not, or an empty bundle, those of the group. The bounds
    come from partial aggregates, so no group is ever gathered in a task, however many rows it has.
    """
    names = [b.name for b in bundles]
    staging = Staging(rows.sparkSession)
    ident = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(anchor)), (-F.col("row_id")).alias("row"))
    base = rows.select(
        key.alias("__key"), F.col("row_id").alias("__row"), ident.alias("__ident"),
        *(F.coalesce(b.trust, F.lit(0)).cast("long").alias(f"t_{b.name}") for b in bundles),
        *(F.when(d.lhs.isNotNull(), F.xxhash64(d.lhs)).alias(f"x_{i}") for i, d in enumerate(dependencies)),
    ).where("__key is not null")
    total = reduce(lambda a, b: a + b, (F.col(f"t_{n}") for n in names))
    groups = base.groupBy("__key").agg(
        F.count(F.lit(1)).alias("n"), F.max("__ident").alias("ident"), F.max(total).alias("reachable"),
        *(F.max(f"t_{n}").alias(f"m_{n}") for n in names),
    ).where("n > 1").drop("n")
    groups = staging.write(groups, "groups")

    best = reduce(lambda a, b: a + b, (F.col(f"m_{n}") for n in names))
    bounded = base.join(groups, "__key")
    xs = [F.col(f"x_{i}") for i in range(len(dependencies))]

    def relevant(name: str) -> list[Column]:
        """Of the dependencies' values, those that matter to a bundle; the others must not tell candidates apart."""
        return [F.when(F.lit(name in (d.of, d.on)), x).alias(f"c_{i}") for i, (d, x) in enumerate(zip(dependencies, xs))]

    is_lead = F.col("__ident") == F.col("ident")
    options = F.array(F.when(is_lead, F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("trust"), *relevant(""))), *(
        F.when(
            F.col(f"t_{n}") + best - F.col(f"m_{n}") >= F.col("reachable"),
            F.struct(F.lit(k).alias("level"), F.col(f"t_{n}").alias("trust"), *relevant(n)),
        )
        for k, n in enumerate(names)
    ))
    cand = bounded.select("__key", "__row", F.explode(F.array_compact(options)).alias("o")).select("__key", "__row", "o.*")
    by = ["__key", "level", *(f"c_{i}" for i in range(len(dependencies)))]
    cand = cand.groupBy(*by).agg(F.max(F.struct("trust", (-F.col("__row")).alias("neg"))).alias("b"))
    cand = staging.write(cand.select(*by, F.col("b.trust").alias("trust"), (-F.col("b.neg")).alias("row")), "candidates")

    lead = cand.where("level = -1").select("__key", F.col("row").alias("row_lead"))
    partial = groups.select("__key", "reachable", *(f"m_{n}" for n in names), F.lit(0).cast("long").alias("score")).join(lead, "__key")
    kept = ["row_lead"]
    for k, name in enumerate(names):
        step = cand.where(F.col("level") == k).drop("level")
        binds = [i for i, d in enumerate(dependencies) if d.on == name]
        joined = _bound(partial, step, binds, [i for i, d in enumerate(dependencies) if d.of == name])
        later = reduce(lambda a, b: a + b, (F.col(f"m_{n}") for n in names[k + 1 :]), F.lit(0))
        joined = joined.where(F.col("score") + F.col("trust") + later >= F.col("reachable"))
        joined = joined.withColumn("score", F.col("score") + F.col("trust")).withColumn(f"row_{name}", F.col("row"))
        kept.append(f"row_{name}")
        after = [i for i, d in enumerate(dependencies) if d.of in names[: k + 1] and d.on in names[k + 1 :]]
        joined = joined.withColumns({f"s_{i}": F.col(f"c_{i}") for i in after if dependencies[i].of == name} or {"score": F.col("score")})
        state = ["__key", *(f"s_{i}" for i in after)]
        carried = ["reachable", *(f"m_{n}" for n in names[k + 1 :])]
        best_of = F.max(F.struct("score", *((-F.col(c)).alias(c) for c in kept))).alias("w")
        partial = joined.groupBy(*state).agg(best_of, *(F.first(c).alias(c) for c in carried))
        partial = partial.select(*state, *carried, F.col("w.score").alias("score"), *((-F.col(f"w.{c}")).alias(c) for c in kept))
    chosen = partial.select("__key", *kept, F.col("score").alias("trust"))
    return Survivors(chosen, rows, key_name, bundles, anchor_fields)


def _bound(partial: DataFrame, step: DataFrame, binds: list[int], opens: list[int]) -> DataFrame:
    """Partial choices with the candidates that the dependencies `binds` admit.

    A bound choice meets the candidates of its value by an equi-join and, of the empty ones, the best for each value
    that a later dependency, in `opens`, may ask for; so a group of n values gives of the order of n rows, never n times
    n. Several dependencies on one bundle are met by the first and then tested by the others."""
    if not binds:
        return partial.join(step, "__key")
    i, others = binds[0], binds[1:]
    free = partial.where(F.col(f"s_{i}").isNull()).join(step, "__key")
    tied = partial.where(F.col(f"s_{i}").isNotNull())
    same = tied.join(step.where("trust > 0").withColumn(f"s_{i}", F.col(f"c_{i}")), ["__key", f"s_{i}"])
    kept = [f"c_{j}" for j in opens]
    none = step.where("trust = 0").groupBy("__key", *kept).agg(F.min("row").alias("row")).withColumn("trust", F.lit(0).cast("long"))
    none = none.withColumns({c: F.lit(None).cast("long") for c in step.columns if c not in none.columns} or {"row": F.col("row")})
    out = free.unionByName(same).unionByName(tied.join(none, "__key"))
    for j in others:
        out = out.where(F.col(f"s_{j}").isNull() | (F.col("trust") == 0) | F.col(f"s_{j}").eqNullSafe(F.col(f"c_{j}")))
    return out


def _filled(*fields: str) -> Column:
    return reduce(lambda a, b: a + b, ((F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "").cast("long") for f in fields))


def _trust(complete: Column, rank: Column, recent: Column) -> Column:
    """Completeness first, then the record's rank, then the day; 0 for a bundle without values."""
    day = F.greatest(F.lit(0), F.least(F.lit(99_999), F.coalesce(F.datediff(recent, F.lit("1970-01-01")), F.lit(0))))
    rank = F.greatest(F.lit(0), F.least(F.lit(999), F.coalesce(rank, F.lit(0)))).cast("long")
    return F.when(complete > 0, complete * 1_000_000_000 + rank * 100_000 + day).otherwise(F.lit(0))


def title_value() -> Column:
    t = F.trim(F.regexp_replace(F.lower(F.regexp_replace("title", r"<[^>]*>", "")), r"[^\p{L}\p{N}]+", " "))
    return F.when(t != "", t)


def paper_survivors(papers: DataFrame) -> Survivors:
    """Records of one bare id: the highest version, then the latest update, leads; other fields are the most complete
    and then the most recent bundle. Authors must have come with the chosen title in some record."""
    version = F.coalesce(F.col("version"), id_version(F.col("arxiv_id")), F.lit(1))
    updated = parse_time(F.col("last_updated"))
    empty = F.col("abstract").rlike(r"(?i)withdrawn") & (F.length("abstract") < 200)
    text = _filled("title") + F.when(empty, F.lit(0)).otherwise(_filled("abstract"))
    b = [
        Bundle("content", ("title", "abstract"), _trust(text, version, updated)),
        Bundle("people", ("authors",), _trust(_filled("authors"), version, updated)),
        Bundle("subjects", ("categories", "primary_category"), _trust(_filled("categories", "primary_category"), version, updated)),
        Bundle("publication", ("doi", "journal_ref"), _trust(_filled("doi", "journal_ref"), version, updated)),
        Bundle("filing", ("first_submitted", "year_month", "license"), _trust(_filled("first_submitted", "year_month", "license"), version, updated)),
    ]
    deps = [Dependency("content", title_value(), "people")]
    lead = ("arxiv_id", "version", "last_updated", "source", "ingested_at")
    return survivors(papers, bare_id(F.col("arxiv_id")), [version, updated], b, deps, lead)


def source_count(col: Column) -> Column:
    """Distinct names in a `;` list, case and spaces aside."""
    return F.size(F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(col, F.lit(""))), ";"), lambda x: F.trim(x)), lambda x: x != "")))


def store_survivors(store: DataFrame) -> Survivors:
    """Rows of one paper_id: the one naming the most sources, then the latest added, leads; other fields are the most
    complete bundle of the most trusted row. Authors and venue must have come with the chosen title and DOI."""
    n = source_count(F.col("sources"))
    at = F.col("added_at")
    b = [
        Bundle("content", ("title", "abstract"), _trust(_filled("title", "abstract"), n, at)),
        Bundle("identity", ("doi", "arxiv_id"), _trust(_filled("doi", "arxiv_id"), n, at)),
        Bundle("people", ("authors",), _trust(_filled("authors"), n, at)),
        Bundle("place", ("venue", "primary_category", "url"), _trust(_filled("venue", "primary_category", "url"), n, at)),
        Bundle("time", ("date", "year"), _trust(_filled("date", "year"), n, at)),
        Bundle("impact", ("cited_by_count",), _trust(_filled("cited_by_count"), n, at)),
    ]
    doi = F.lower(F.trim("doi"))
    deps = [Dependency("content", title_value(), "people"), Dependency("identity", F.when(doi != "", doi), "place")]
    return survivors(store, F.col("paper_id"), [n, at], b, deps, ("sources", "added_at", "has_vec"), "paper_id")
