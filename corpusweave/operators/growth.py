"""Publication growth of clusters against the corpus, with gates, intervals and stability."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _weight(df: DataFrame) -> Column:
    return F.coalesce(F.col("sample_weight"), F.lit(1.0)) if "sample_weight" in df.columns else F.lit(1.0)


def window_counts(df: DataFrame, date: str, group: str, windows: list[int], back: list[int] | None = None) -> DataFrame:
    """(group, months, back, recent, previous, recent_w, previous_w, sufficient) and the same of the corpus, group null.

    Periods are half open to the left: (ref - w, ref] and (ref - 2w, ref - w], ref being the latest date less `back`
    months. All windows, cutoffs and the corpus come from one aggregate over grouping sets; a row meets only the few
    (window, cutoff) pairs.
    """
    spark = df.sparkSession
    plan = F.broadcast(spark.createDataFrame([(w, b) for w in windows for b in (back or [0])], "months int, back int"))
    ends = F.broadcast(df.agg(F.max(date).alias("last"), F.min(date).alias("first")))
    at = lambda m: F.expr(f"last - make_ym_interval(0, back + {m})")
    rows = df.select(F.col(group).alias("grp"), F.col(date).alias("d"), _weight(df).alias("w")).where("d is not null").crossJoin(ends).crossJoin(plan)
    rows = rows.withColumns({"r0": at("0"), "r1": at("months"), "r2": at("2 * months")})
    recent = (F.col("d") > F.col("r1")) & (F.col("d") <= F.col("r0"))
    before = (F.col("d") > F.col("r2")) & (F.col("d") <= F.col("r1"))
    rows = rows.select("grp", "months", "back", "w", recent.alias("is_recent"), before.alias("is_before"), (F.col("first") <= F.col("r2")).alias("enough"))
    got = rows.groupingSets([["months", "back", "grp"], ["months", "back"]], "months", "back", "grp").agg(
        F.grouping("grp").alias("whole"), F.count_if("is_recent").alias("recent"), F.count_if("is_before").alias("previous"),
        F.sum(F.when(F.col("is_recent"), F.col("w")).otherwise(0.0)).alias("recent_w"),
        F.sum(F.when(F.col("is_before"), F.col("w")).otherwise(0.0)).alias("previous_w"), F.first("enough").alias("sufficient"),
    )
    return got


def relative_growth(df: DataFrame, date: str, group: str, windows: list[int], least: int = 10, back: list[int] | None = None) -> DataFrame:
    """window_counts with `passes_gate`, `raw_growth` and `relative_growth`: weighted ratio over the corpus's ratio.

    Gates use counts, ratios use weights; what a gate stops is null, never 0. Noise (group -1) counts in the corpus."""
    counts = window_counts(df, date, group, windows, back)
    own = counts.where("whole = 0").drop("whole")
    corpus = counts.where("whole = 1").select("months", "back", F.col("recent_w").alias("corpus_recent"), F.col("previous_w").alias("corpus_previous"))
    both = own.join(F.broadcast(corpus), ["months", "back"])
    gate = F.col("sufficient") & (F.col("recent") >= least) & (F.col("previous") >= least)
    raw = F.when(F.col("previous_w") > 0, F.col("recent_w") / F.col("previous_w"))
    base = F.when(F.col("corpus_previous") > 0, F.col("corpus_recent") / F.col("corpus_previous"))
    return both.select(
        F.col("grp").alias("cluster_id"), "months", "back", "recent", "previous", "recent_w", "previous_w", "corpus_recent", "corpus_previous",
        "sufficient", gate.alias("passes_gate"), F.when(gate, raw).alias("raw_growth"), F.when(gate & (base > 0), raw / base).alias("relative_growth"),
    )


def monthly_counts(df: DataFrame, date: str, group: str) -> DataFrame:
    """(cluster_id, year_month, n, weight) with the corpus's months, cluster_id null, from one rollup."""
    rows = df.select(F.date_format(date, "yyyy-MM").alias("year_month"), F.col(group).alias("cluster_id"), _weight(df).alias("w")).where("year_month is not null")
    got = rows.rollup("year_month", "cluster_id").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"))
    return got.where("g < 3").select("cluster_id", "year_month", (F.col("g") == 1).alias("whole"), "n", "weight")


def variation(values: Column) -> Column:
    """Coefficient of variation of an array's values that are not null; null for fewer than two or a mean not above 0."""
    v = F.filter(values, lambda x: x.isNotNull())
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / n - mean * mean
    return F.when((n >= 2) & (mean > 0), F.sqrt(F.greatest(F.lit(0.0), var)) / mean)


def growth_stability(df: DataFrame, date: str, group: str, windows: list[int], default: int, cutoffs: list[int], least: int = 10, max_cv: float = 0.5) -> DataFrame:
    """(cluster_id, cv_windows, cv_cutoffs, stable): how much relative growth moves over windows and earlier cutoffs."""
    g = relative_growth(df, date, group, sorted({*windows, default}), least, [0, *cutoffs])
    per = g.groupBy("cluster_id").agg(
        F.collect_list(F.when((F.col("back") == 0) & F.col("months").isin(windows), F.col("relative_growth"))).alias("w"),
        F.collect_list(F.when(F.col("months") == default, F.col("relative_growth"))).alias("c"),
    )
    cw, cc = variation(F.col("w")), variation(F.col("c"))
    return per.select("cluster_id", cw.alias("cv_windows"), cc.alias("cv_cutoffs"), F.coalesce((cc <= max_cv) & (cw.isNull() | (cw <= max_cv)), F.lit(False)).alias("stable"))


def bootstrap_intervals(growth: DataFrame, samples: int = 500, level: float = 0.9, seed: int = 42) -> DataFrame:
    """growth with `ci_low`, `ci_high` and `direction`: percentile interval under independent Poisson counts.

    Each row draws from its own generator, seeded by seed, cluster, window and cutoff, so results do not depend on how
    rows are spread."""
    def draw(batches):
        for pdf in batches:
            low, high = [], []
            for r in pdf.itertuples():
                lo = hi = None
                if r.relative_growth == r.relative_growth and r.relative_growth is not None:
                    rng = np.random.default_rng([seed, abs(hash(int(r.cluster_id))) % 2**32, int(r.months), int(r.back)])
                    a, b, c, d = (rng.poisson(x, samples) for x in (r.recent_w, r.previous_w, r.corpus_recent, r.corpus_previous))
                    ok = (b > 0) & (c > 0) & (d > 0)
                    if ok.sum() >= samples / 2:
                        lo, hi = np.quantile(a[ok] / b[ok] / (c[ok] / d[ok]), [(1 - level) / 2, (1 + level) / 2])
                low.append(lo)
                high.append(hi)
            yield pdf.assign(ci_low=pd.Series(low, dtype="float64", index=pdf.index), ci_high=pd.Series(high, dtype="float64", index=pdf.index))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in growth.schema)
    got = growth.mapInPandas(draw, fields + ", ci_low double, ci_high double")
    way = F.when(F.col("ci_low").isNull(), None).when(F.col("ci_low") > 1, "growing").when(F.col("ci_high") < 1, "declining").otherwise("no clear change")
    return got.withColumn("direction", way)


def poisson_trends(df: DataFrame, date: str, group: str, level: float = 0.9) -> DataFrame:
    """(cluster_id, annual_ratio, ci_low, ci_high, months): log-linear Poisson trend with the corpus as offset.

    A group's input is its monthly series, at most one row a month, whatever the number of papers. Series of fewer
    than six months or ten papers have no trend.
    """
    m = monthly_counts(df, date, group)
    corpus = m.where("whole").select("year_month", F.col("weight").alias("n_all"))
    ids = m.where("not whole and cluster_id >= 0").select("cluster_id").distinct()
    own = m.where("not whole").select("cluster_id", "year_month", F.col("weight").alias("y"))
    grid = ids.crossJoin(F.broadcast(corpus)).join(own, ["cluster_id", "year_month"], "left").select("cluster_id", "year_month", "n_all", F.coalesce("y", F.lit(0.0)).alias("y"))
    z = NormalDist().inv_cdf(0.5 + level / 2)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["n_all"] > 0].sort_values("year_month")
        y, off = pdf["y"].to_numpy(float), np.log(pdf["n_all"].to_numpy(float))
        if len(y) < 6 or y.sum() < 10:
            return pd.DataFrame({"cluster_id": [], "annual_ratio": [], "ci_low": [], "ci_high": [], "months": []})
        t = np.arange(len(y)) - (len(y) - 1) / 2
        x = np.stack([np.ones_like(t), t], 1)
        beta = np.array([np.log(y.sum() / np.exp(off).sum()), 0.0])
        for _ in range(50):
            mu = np.exp(x @ beta + off)
            step = np.linalg.solve(x.T @ (x * mu[:, None]), x.T @ (y - mu))
            beta = beta + step
            if np.abs(step).max() < 1e-9:
                break
        mu = np.exp(x @ beta + off)
        se = np.sqrt(np.linalg.inv(x.T @ (x * mu[:, None]))[1, 1])
        b = beta[1] + np.array([0, -z * se, z * se])
        r = np.exp(12 * b)
        return pd.DataFrame({"cluster_id": [int(pdf["cluster_id"].iloc[0])], "annual_ratio": r[:1], "ci_low": r[1:2], "ci_high": r[2:], "months": [len(y)]})

    return grid.groupBy("cluster_id").applyInPandas(fit, "cluster_id long, annual_ratio double, ci_low double, ci_high double, months int")


def backtest(df: DataFrame, date: str, group: str, months: int, flagged: DataFrame) -> DataFrame:
    """One row: of the flagged clusters (cluster_id), how many outgrew the corpus in the `months` up to the latest date."""
    c = window_counts(df, date, group, [months]).select("grp", "whole", "recent_w", "previous_w")
    total = c.where("whole = 1").select(F.col("recent_w").alias("ta"), F.col("previous_w").alias("tb"))
    own = c.where("whole = 0").join(flagged.select(F.col("cluster_id").alias("grp")), "grp", "left_semi").crossJoin(F.broadcast(total))
    hit = F.col("recent_w") / F.col("ta") > F.col("previous_w") / F.col("tb")
    return own.where("previous_w > 0 and ta > 0 and tb > 0").agg(F.count(F.lit(1)).alias("evaluated"), F.avg(hit.cast("double")).alias("hit_rate"))


def growth_overview(
    df: DataFrame, date: str, group: str, windows: list[int], default: int = 6, cutoffs: list[int] | None = None, least: int = 10, max_cv: float = 0.5,
    samples: int = 500, level: float = 0.9, seed: int = 42, require_stable: bool = True,
) -> DataFrame:
    """All there is to say of each cluster's growth, a row per cluster and window: counts, gates, relative growth with its
    interval and direction, how stable it is over windows and cutoffs, its trend, and whether it is reliable: past the
    gates, with an interval, and stable where that is required. The parts are a row per cluster and are joined by it."""
    g = bootstrap_intervals(relative_growth(df, date, group, windows, least), samples, level, seed).drop("back")
    s = growth_stability(df, date, group, windows, default, cutoffs or [3, 6], least, max_cv)
    t = poisson_trends(df, date, group, level).select("cluster_id", "annual_ratio", F.col("ci_low").alias("trend_low"), F.col("ci_high").alias("trend_high"))
    both = g.join(s, "cluster_id", "left").join(t, "cluster_id", "left").withColumn("stable", F.coalesce("stable", F.lit(False)))
    return both.withColumn("reliable", F.col("passes_gate") & F.col("ci_low").isNotNull() & (F.col("stable") | F.lit(not require_stable)))
