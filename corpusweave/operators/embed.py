"""Text embeddings: TF-IDF with truncated SVD, a cache of vectors, and a probe for a changed model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, CountVectorizer
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.text import bigrams, search_tokens, text_hash
from corpusweave.operators.retrieval import dot, unit


class SvdEmbedder:
    """Unit vectors of documents in the leading right singular directions of their TF-IDF matrix.

    The model is the vocabulary and a matrix of vocabulary by dimensions, both bounded by parameters, so it fits the
    driver and the workers whatever the corpus. Other encoders can take its place: an embedder has `transform`."""

    def __init__(self, dim: int = 64, vocabulary: int = 20_000, min_df: int = 2, max_df: float = 0.9):
        self.dim, self.vocabulary, self.min_df, self.max_df = dim, vocabulary, min_df, max_df

    def _tokens(self, docs: DataFrame, text: Column) -> DataFrame:
        words = docs.select("id", search_tokens(text).alias("w"))
        return words.select("id", F.concat("w", bigrams(F.col("w"))).alias("terms"))

    def fit(self, docs: DataFrame, text: Column) -> SvdEmbedder:
        """docs (id, ...); text is an expression on them."""
        tokens = self._tokens(docs, text)
        counts = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=self.vocabulary, minDF=self.min_df, maxDF=self.max_df).fit(tokens)
        tf = counts.transform(tokens)
        self.idf = IDF(inputCol="tf", outputCol="x").fit(tf)
        self.counts = counts
        rows = self.idf.transform(tf).select("x").rdd.map(lambda r: OldVectors.fromML(_scaled(r.x)))
        svd = RowMatrix(rows).computeSVD(min(self.dim, len(counts.vocabulary) - 1))
        v = svd.V.toArray()
        self.v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
        return self

    def transform(self, docs: DataFrame, text: Column) -> DataFrame:
        """(id, embedding): all zero where a text has no known term. A batch of token lists is weighed and projected at
        once by the vocabulary, the weights and the directions, which have the model's fixed size."""
        place = {t: i for i, t in enumerate(self.counts.vocabulary)}
        weight, v = np.asarray(self.idf.idf.toArray()), self.v
        kind = docs.schema["id"].dataType.simpleString()

        def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = np.zeros((len(pdf), v.shape[1]))
                for row, terms in enumerate(pdf["terms"]):
                    known, n = np.unique([place[t] for t in terms if t in place], return_counts=True)
                    if len(known):
                        known = known.astype(int)
                        out[row] = (n * weight[known]) @ v[known]
                norm = np.linalg.norm(out, axis=1, keepdims=True)
                unit_rows = np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype("float32")
                yield pd.DataFrame({"id": pdf["id"], "embedding": list(unit_rows)})

        return self._tokens(docs, text).mapInPandas(project, f"id {kind}, embedding array<float>")


def _scaled(x):
    from pyspark.ml.linalg import SparseVector

    return SparseVector(x.size, x.indices, x.values / max(x.norm(2), 1e-12))


def with_cache(docs: DataFrame, text: Column, cache: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(vectors, fresh): cached vectors (id, hash, embedding) of unchanged texts, and new ones of the others alone."""
    keyed = docs.withColumn("hash", text_hash(text))
    hits = keyed.select("id", "hash").join(cache, ["id", "hash"])
    fresh = embed(keyed.join(cache, ["id", "hash"], "left_anti")).join(keyed.select("id", "hash"), "id").select("id", "hash", "embedding")
    return hits.unionByName(fresh), fresh


def probe(stored: DataFrame, again: DataFrame, least: float = 0.98) -> bool:
    """Whether vectors (id, embedding) made again agree with the stored ones of the same ids."""
    both = stored.join(again.select("id", F.col("embedding").alias("e2")), "id")
    low = both.agg(F.min(dot(unit(F.col("embedding")), unit(F.col("e2"))))).first()[0]
    return low is not None and low >= least
