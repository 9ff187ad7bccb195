"""The staged pipeline on a synthetic corpus."""

from pyspark.sql import functions as F

from corpusweave.config import Config
from corpusweave.operators.embed import probe, with_cache
from corpusweave.plans.pipeline import Pipeline
from corpusweave.sources.synthetic import synthetic_papers


def test_pipeline(spark, tmp_path):
    raw = synthetic_papers(spark, 360).selectExpr("*", "null as doi", "null as journal_ref", "null as license")
    cfg = Config(clusters={"k_range": [6, 6]}, data={"english_only": False})
    p = Pipeline(spark, cfg, raw, str(tmp_path / "work"), str(tmp_path / "rel"))
    p.run()
    corpus = p.table("corpus")
    assert corpus.count() > 300 and p.table("vectors").count() == corpus.count()
    got = p.table("clusters").join(corpus.select(F.col("arxiv_id").alias("id"), "primary_category"), "id").where("cluster_id >= 0")
    purity = got.groupBy("cluster_id", "primary_category").count().groupBy("cluster_id").agg(F.max("count").alias("m"), F.sum("count").alias("n")).agg(F.sum("m") / F.sum("n")).first()[0]
    assert purity > 0.8
    assert p.table("keywords").count() >= 6 and p.table("growth").count() > 0
    p.run("growth")
    assert p.publish()
    v = p.table("vectors")
    assert probe(v, v)
    docs = v.select("id").withColumn("t", F.lit("x"))
    cache = v.limit(10).select("id", F.substring(F.sha1(F.lit("x")), 1, 16).alias("hash"), "embedding")
    both, fresh = with_cache(docs, F.col("t"), cache, lambda d: d.select("id").join(v, "id"))
    assert both.count() == v.count() and fresh.count() == v.count() - 10
