"""Staged pipeline: ingest, embed, cluster, label, growth, publish; each stage hands a Parquet table to the next."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.config import Config
from corpusweave.operators import clusters, growth, ingest
from corpusweave.operators.embed import SvdEmbedder
from corpusweave.runtime import Staging
from corpusweave.sources.store import Releases


class Pipeline:
    """Runs stages over `work`, where any stage can be run again from what the stages before it left."""

    def __init__(self, spark: SparkSession, cfg: Config, raw: DataFrame, work: str, releases: str | None = None):
        self.spark, self.cfg, self.raw, self.work, self.releases = spark, cfg, raw, work.rstrip("/"), releases
        self.seconds: dict[str, float] = {}
        self.stages: dict[str, Callable[[], DataFrame]] = {"corpus": self._corpus, "vectors": self._vectors, "clusters": self._clusters, "keywords": self._keywords, "growth": self._growth}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.work}/{name}")

    def run(self, first: str | None = None) -> None:
        names = list(self.stages)
        for name in names[names.index(first) if first else 0 :]:
            began = time.time()
            self.stages[name]().write.mode("overwrite").parquet(f"{self.work}/{name}")
            self.seconds[name] = round(time.time() - began, 3)

    def timings(self) -> DataFrame:
        """(stage, seconds, rows) of the stages run."""
        rows = [(n, t, self.table(n).count()) for n, t in self.seconds.items()]
        return self.spark.createDataFrame(rows, "stage string, seconds double, rows long")

    def publish(self, meta: dict | None = None) -> str:
        return Releases(self.spark, self.releases).publish({n: self.table(n) for n in self.stages}, {"config": self.cfg.hash(), **(meta or {})})

    def _corpus(self) -> DataFrame:
        d = self.cfg.data
        corpus = ingest.clean_records(self.raw, d.category_prefix, d.date_start, None if d.date_end == "auto" else d.date_end, d.min_abstract_chars, d.english_only, d.categories)
        cap = self.cfg.cap()
        if cap is None or d.sampling == "none":
            return corpus.withColumn("sample_weight", F.lit(1.0))
        if d.sampling == "newest":
            return ingest.newest(corpus, "date", "arxiv_id", cap).withColumn("sample_weight", F.lit(1.0))
        return ingest.stratified_sample(corpus, ["primary_category", "year_month"], "arxiv_id", cap)

    def _text(self):
        return F.concat_ws(". ", "title", "abstract")

    def _vectors(self) -> DataFrame:
        docs = self.table("corpus").withColumn("id", F.col("arxiv_id"))
        return SvdEmbedder(dim=32).fit(docs, self._text()).transform(docs, self._text())

    def _clusters(self) -> DataFrame:
        """Clusters by the configured backend; those that match clusters of the current release keep their ids."""
        c = self.cfg.clusters
        low, high = c.k_range
        points = self.table("vectors").select("id", F.col("embedding").alias("v"))
        got, _ = clusters.cluster(points, c.backend, 32, list(range(low, high + 1, 2)), c.min_size_fraction, c.min_samples, self.cfg.seed)
        old = clusters.previous_ids(Releases(self.spark, self.releases), self.spark) if self.releases else None
        if old is None:
            return got
        got = Staging(self.spark).write(got, "new_clusters")
        mapping, self.continuity = clusters.match_clusters(points.join(got, "id"), old, dim=32)
        return got.join(F.broadcast(mapping), "cluster_id", "left").select("id", F.coalesce("matched_id", F.lit(-1)).alias("cluster_id"))

    def _keywords(self) -> DataFrame:
        docs = self.table("corpus").join(self.table("clusters").withColumnRenamed("id", "arxiv_id"), "arxiv_id").withColumn("doc_id", F.col("arxiv_id"))
        return clusters.keywords(clusters.class_tfidf(clusters.label_terms(docs, self._text())))

    def _growth(self) -> DataFrame:
        g = self.cfg.growth
        docs = self.table("corpus").join(self.table("clusters").withColumnRenamed("id", "arxiv_id"), "arxiv_id")
        got = growth.relative_growth(docs, "date", "cluster_id", g.windows_months, g.min_papers_per_period)
        return growth.bootstrap_intervals(got, g.bootstrap_samples, g.ci_level, self.cfg.seed)
