"""Approximate nearest neighbours: vectors kept by the cell of their nearest centre, searched in the nearest cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusweave.runtime import Staging

#: Vectors the centres are fitted on at most; the most cells; vectors that a task searches at once.
FIT_ROWS, MOST_CELLS, BLOCK = 20_000, 4_096, 4_096


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit_cells(x: np.ndarray, cells: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Unit centres of x by k-means on directions; a centre that loses all its vectors starts again at a random one."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), x[rng.choice(len(x), cells)])
    return c


@dataclass
class NeighborIndex:
    """cells (cell, block, id, v): all vectors, each in the cell of its nearest centre. The centres are fitted on a bounded
    sample, at most FIT_ROWS vectors; every vector is indexed. A cell of many vectors is cut into blocks of about BLOCK,
    so a task's share does not grow with the table."""

    cells: DataFrame
    centres: np.ndarray
    dim: int

    @classmethod
    def build(cls, points: DataFrame, dim: int = 64, cells: int | None = None, seed: int = 11) -> NeighborIndex:
        """Index of points (id, v), v of `dim` values; null and otherwise sized vectors are left out."""
        spark = points.sparkSession
        usable = points.where(F.size("v") == dim).select("id", F.col("v").cast("array<float>").alias("v"))
        n = usable.count()
        some = usable.sample(min(1.0, FIT_ROWS / n), seed).limit(FIT_ROWS) if n else usable
        x = np.array([r.v for r in some.select("v").collect()], np.float64).reshape(-1, dim)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        wanted = cells or max(1, min(MOST_CELLS, round(np.sqrt(n))))
        centres = fit_cells(x, min(wanted, len(x)), seed) if len(x) else np.zeros((0, dim))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = (_matrix(batch.column("v"), dim) @ centres.T).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("id"), batch.column("v")], ["cell", "id", "v"])

        placed = usable.mapInArrow(place, f"cell int, id {usable.schema['id'].dataType.simpleString()}, v array<float>")
        placed = Staging(spark).write(placed, "cells")
        return cls(cls._blocked(placed), centres, dim)

    @staticmethod
    def _blocked(placed: DataFrame) -> DataFrame:
        sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        return placed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exclude_self: bool = True) -> DataFrame:
        """(id, neighbour_id, sim, rank) of queries (id, v): the k nearest among the vectors of the `probes` nearest cells,
        an eighth of all cells and eight at least if not said; all cells make the search exact."""
        dim, centres = self.dim, self.centres
        probes = min(len(centres), probes or max(8, -(-len(centres) // 8)))
        kind = queries.schema["id"].dataType.simpleString()

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sim = _matrix(batch.column("v"), dim) @ centres.T
                near = np.argpartition(-sim, probes - 1, axis=1)[:, :probes].astype(np.int32)
                row = pa.array(np.repeat(np.arange(batch.num_rows), probes))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), batch.column("id").take(row), batch.column("v").take(row)], ["cell", "id", "v"])

        def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
            def side(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
                x = np.array(p["v"].tolist(), np.float64).reshape(-1, dim)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                return p["id"].to_numpy(), np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

            qi, x = side(pdf[pdf["asks"]])
            ii, y = side(pdf[~pdf["asks"]])
            out = [pd.DataFrame({"id": qi[:0], "neighbour_id": ii[:0], "sim": np.zeros(0)})]
            order = np.argsort(ii)
            ii, y = ii[order], y[order]
            for s in range(0, len(qi) if len(ii) else 0, 512):
                sim = x[s : s + 512] @ y.T
                if exclude_self:
                    sim[qi[s : s + 512, None] == ii[None]] = -np.inf
                top = np.argsort(-np.round(sim, 9), axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({"id": np.repeat(qi[s : s + 512], top.shape[1]), "neighbour_id": ii[top].ravel(), "sim": np.take_along_axis(sim, top, 1).ravel()}))
            got = pd.concat(out)
            return got[got["sim"] > -np.inf]

        if not probes:
            return queries.sparkSession.createDataFrame([], f"id {kind}, neighbour_id {kind}, sim double, rank int")
        usable = queries.where(F.size("v") == dim).select("id", F.col("v").cast("array<float>").alias("v"))
        blocks = self.cells.select("cell", "block").distinct()
        asked = usable.mapInArrow(ask, f"cell int, id {kind}, v array<float>").join(F.broadcast(blocks), "cell").withColumn("asks", F.lit(True))
        items = self.cells.select("cell", "id", "v", "block").withColumn("asks", F.lit(False))
        # The queries of a block are cut as well, so that neither side of a task grows.
        n = max(1, -(-usable.count() * probes // max(1, len(centres)) // BLOCK))
        asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
        items = items.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        near = asked.select("cell", "block", "part", "id", "v", "asks").unionByName(items).groupBy("cell", "block", "part").applyInPandas(nearest, f"id {kind}, neighbour_id {kind}, sim double")
        w = Window.partitionBy("id").orderBy(F.desc(F.round("sim", 9)), "neighbour_id")
        return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def recall_at_k(self, queries: DataFrame, k: int, probes: int | None = None) -> float | None:
        """Share of the exact k nearest of the queries that the search finds."""
        exact = self.search(queries, k, len(self.centres)).select("id", "neighbour_id")
        found = self.search(queries, k, probes).select("id", "neighbour_id", F.lit(1).alias("hit"))
        return exact.join(found, ["id", "neighbour_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]

    def save(self, path: str) -> None:
        self.cells.drop("blocks", "block").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
        spark = self.cells.sparkSession
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centres)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeighborIndex:
        rows = sorted(spark.read.parquet(f"{path}/centres").collect())
        centres = np.array([r.centre for r in rows], np.float64)
        placed = spark.read.parquet(f"{path}/cells").select(F.col("cell").cast("int"), "id", "v")
        return cls(cls._blocked(placed), centres, centres.shape[1])
