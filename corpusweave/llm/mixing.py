"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.tokens import VOCABULARY, token_counts
from corpusweave.runtime import Staging


def source_name(col: Column) -> Column:
    """Source with the spelling set aside: case, outer spaces, and spaces or hyphens for underscores."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s\-]+", "_")


def mix_report(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of targets: its tokens, the repetition rate its target needs, the rate it gets and what it reaches.

    sizes (source, n_tokens) has one row per document. All documents count in the total, those of no or an unknown
    source as well; the mix aims at `target_share` times that total for each source. A source without tokens has rate
    0 and is unreachable unless its target is 0. Sources are few: the aggregate has one row per distinct spelling.
    """
    per = sizes.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum(F.col("n_tokens").cast("long")).alias("tokens"))
    total = per.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"))
    named = targets.select("source", source_name(F.col("source")).alias("__name"), "target_share", "max_repeats")
    out = named.join(per.withColumnRenamed("source", "__name"), "__name", "left").crossJoin(F.broadcast(total))
    tokens = F.coalesce("tokens", F.lit(0))
    goal = F.col("target_share") * F.col("total_tokens")
    need = F.when(tokens > 0, goal / tokens).when(goal > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return out.select(
        "source", "__name", "target_share", "max_repeats", tokens.alias("tokens"), "total_tokens", need.alias("needed_rate"),
        F.when(tokens > 0, F.least(need, F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0)).alias("rate"),
        (F.col("max_repeats") * tokens < goal).alias("unreachable"),
    )


def copies(doc_id: Column, rate: Column, seed: int) -> Column:
    """floor(rate), and one more with a probability equal to the fraction, drawn from a hash of seed and id."""
    u = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) / F.lit(float(1 << 53))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("int")


def mix(docs: DataFrame, targets: DataFrame, seed: int = 17, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(emitted, report). emitted (doc_id, source, n_tokens, copy_no) has a row per copy; report adds the share reached.

    Documents whose source has no target are not emitted; null and empty texts are emitted with 0 tokens. Token
    counts are written once to the shared folder, since both the rates and the copies need them.
    """
    sizes = Staging(docs.sparkSession).write(token_counts(docs, "doc_id", ("source",), path), "token_counts")
    report = mix_report(sizes, targets)
    rates = report.select("__name", F.col("source").alias("__source"), "rate")
    emitted = (
        sizes.withColumn("__name", source_name(F.col("source")))
        .join(rates, "__name")
        .withColumn("__copies", copies(F.col("doc_id"), F.col("rate"), seed))
        .where("__copies > 0")
        .select("doc_id", F.col("__source").alias("source"), "n_tokens", F.explode(F.sequence(F.lit(1), "__copies")).alias("copy_no"))
    )
    got = emitted.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("emitted_docs"))
    all_mixed = F.sum(F.coalesce("mixed_tokens", F.lit(0))).over(_whole())
    shares = report.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "tokens", "total_tokens", "needed_rate", "rate", "unreachable",
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("emitted_docs", F.lit(0)).alias("emitted_docs"),
        (F.coalesce("mixed_tokens", F.lit(0)) / F.col("total_tokens")).alias("share_of_all"),
        (F.coalesce("mixed_tokens", F.lit(0)) / all_mixed).alias("share_of_mix"),
    )
    return emitted, shares


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy()
