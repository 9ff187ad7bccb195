"""Most similar vectors for every vector: a forest of sorted hash strings with synchronous ascent."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.bisecting import second_moment
from corpusweave.llm.vectors import matrix, usable
from corpusweave.runtime import Staging

#: Bits of a hash string; bits that one look at the sizes of blocks goes deeper; strings of a block; vectors that a task
#: searches at once; what a cosine of vectors of one byte a value may be off.
BITS, STEP, BLOCK, ITEMS, ROUGH = 48, 12, 8_192, 16_384, 0.02


@dataclass
class Forest:
    """starts[t]: least hash of each block of tree t, a block being all strings of one prefix; levels to ascend by."""

    planes: np.ndarray
    trees: int
    levels: tuple[int, ...]
    starts: list[np.ndarray]

    def hashes(self, x: np.ndarray) -> np.ndarray:
        """The hash strings of unit vectors as integers, a column per tree."""
        bits = (x @ self.planes >= 0).reshape(len(x), self.trees, BITS)
        packed = np.zeros((len(x), self.trees, 8), np.uint8)
        packed[:, :, 2:] = np.packbits(bits, axis=2)
        return packed.view(">u8").reshape(len(x), self.trees).astype(np.int64)

    def blocks(self, hashes: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.starts[t], hashes[:, t], side="right") - 1 for t in range(self.trees)], 1)


def plant(points: DataFrame, n: int, dim: int, trees: int, wanted: int, levels: tuple[int, ...], whiten: bool, seed: int) -> Forest:
    """Draw the planes and cut each tree's sorted array into blocks along prefixes.

    With `whiten`, planes are drawn in the space where all vectors' second moment is the identity, so that strings
    tell the members of a dense cluster apart as soon as those of different clusters. A block has `limit` strings at
    most, or else is cut deeper, unless the strings are equal in all bits; the driver sees only block sizes, a number
    for about BLOCK strings. A block that has to be larger, for the sake of `wanted`, is searched in parts.
    """
    planes = np.random.default_rng(seed).normal(size=(dim, trees * BITS))
    if whiten and n:
        values, vectors = np.linalg.eigh(second_moment(points, dim))
        planes = (vectors / np.sqrt(np.maximum(values, values[-1] * 1e-4))) @ vectors.T @ planes
    limit = max(BLOCK, 2 * wanted // trees)
    forest = Forest(planes, trees, levels, [np.zeros(1, np.int64) for _ in range(trees)])
    large = {(t, 0) for t in range(trees)} if n > limit else set()
    depth = 0
    while large and depth < BITS:
        shift = BITS - depth - STEP
        wanted_blocks = frozenset(large)

        def prefixes(batches: Iterator[pa.RecordBatch], forest=forest, shift=shift, chosen=wanted_blocks) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = forest.hashes(matrix(batch.column("v"), dim))
                b = forest.blocks(h)
                tree = np.repeat(np.arange(forest.trees)[None], len(h), 0)
                pick = np.zeros(h.shape, bool)
                for t in range(forest.trees):
                    pick[:, t] = np.isin(b[:, t], [x for s, x in chosen if s == t])
                got = pd.DataFrame({"tree": tree[pick], "prefix": h[pick] >> shift}).value_counts().reset_index(name="n")
                yield pa.RecordBatch.from_pandas(got.astype({"tree": "int32", "prefix": "int64", "n": "int64"}), preserve_index=False)

        rows = points.mapInArrow(prefixes, "tree int, prefix long, n long").groupBy("tree", "prefix").agg(F.sum("n").alias("n")).collect()
        sizes: list[dict[int, int]] = [{} for _ in range(trees)]
        for r in rows:
            sizes[r.tree][r.prefix] = r.n
        still: list[tuple[int, int]] = []
        for t in range(trees):
            cuts = set(forest.starts[t].tolist())
            level = sizes[t]
            # From the deepest prefixes up: neighbours of one shorter prefix stay together while they fit.
            for up in range(STEP + 1):
                parents: dict[int, int] = {}
                for prefix, c in level.items():
                    parents[prefix >> 1] = parents.get(prefix >> 1, 0) + c
                for prefix in level:
                    if up < STEP and parents[prefix >> 1] > limit:
                        cuts.add(prefix << (shift + up))
                        cuts.add((prefix + 1) << (shift + up))
                level = parents
            forest.starts[t] = np.array(sorted(c for c in cuts if c < 1 << BITS), np.int64)
            still += [(t, prefix << shift) for prefix, c in sizes[t].items() if c > limit]
        depth += STEP
        large = {(t, int(np.searchsorted(forest.starts[t], s, side="right") - 1)) for t, s in still}
    return forest


def _rows(points: DataFrame, forest: Forest, dim: int, query: str, with_vectors: bool) -> DataFrame:
    """(tree, block, hash, id, level[, v]): each vector once a tree, its values as single bytes; level is null where it is
    not a query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            h = forest.hashes(x)
            b = forest.blocks(h)
            rough = np.round(x * (127 / np.abs(x).max(1, keepdims=True))).astype(np.int8)
            ids, level = batch.column("id"), batch.column("level")
            for t in range(forest.trees):
                arrays = [pa.array(np.full(len(x), t, np.int32)), pa.array(b[:, t].astype(np.int32)), pa.array(h[:, t]), ids, level]
                names = ["tree", "block", "hash", "id", "level"]
                if with_vectors:
                    arrays.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim), len(x), [None, pa.py_buffer(rough.tobytes())]).cast(pa.binary()))
                    names.append("v")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "tree int, block int, hash long, id long, level int" + (", v binary" if with_vectors else "")
    return points.select("id", "v", F.expr(query).cast("int").alias("level")).mapInArrow(run, schema)


def _range(hashes: np.ndarray, query: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last place of the strings that share the first `level` bits."""
    shift = BITS - level
    low = (query >> shift) << shift
    return np.searchsorted(hashes, low), np.searchsorted(hashes, low + (np.int64(1) << shift))


def ascend(points: DataFrame, forest: Forest, dim: int, query: str, wanted: int) -> DataFrame:
    """(id, level): per query the deepest level at which all trees together offer at least `wanted` candidates."""
    names = [f"c{x}" for x in forest.levels]

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.sort(pdf["hash"].to_numpy())
        ask = pdf[pdf["level"].notna()]
        out = {"id": ask["id"].to_numpy()}
        for x, name in zip(forest.levels, names):
            low, high = _range(h, ask["hash"].to_numpy(), x)
            out[name] = (high - low).astype(np.int32)
        return pd.DataFrame(out)

    rows = _rows(points, forest, dim, query, False)
    counts = rows.groupBy("tree", "block").applyInPandas(count, "id long, " + ", ".join(f"{n} int" for n in names))
    total = counts.groupBy("id").agg(*(F.sum(n).alias(n) for n in names))
    level: Column = F.lit(forest.levels[0])
    for x, name in zip(forest.levels, names):
        level = F.when(F.col(name) >= wanted, F.lit(x)).otherwise(level)
    return total.select("id", level.alias("level"))


def candidates(points: DataFrame, levels: DataFrame, forest: Forest, dim: int, k: int | None, least: float, parts: int = 1) -> DataFrame:
    """(a, b): of each query a the candidates of its level, the `k` nearest of each tree and part or all of cosine `least`.

    Similarities are those of the vectors as single bytes, so `least` is lowered by ROUGH; the caller looks at the exact
    ones. With several `parts` the strings of a block are spread by a hash of the id and each part is asked by all of
    the block's queries, so that a task's memory does not grow with the block."""
    floor = least - ROUGH

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hash", "id"], kind="stable")
        x = np.frombuffer(b"".join(pdf["v"]), np.int8).reshape(len(pdf), dim).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        here = pdf["here"].to_numpy()
        h, ids, y = pdf["hash"].to_numpy()[here], pdf["id"].to_numpy()[here], x[here]
        ask = np.flatnonzero(pdf["asks"].to_numpy())
        a, b = [], []
        if len(ask) and len(h):
            level, hash_of, id_of = (pdf[c].to_numpy()[ask] for c in ("level", "hash", "id"))
            low, high = _range(h, hash_of, level.astype(np.int64))
            order = np.lexsort((high, low))
            edges = np.flatnonzero(np.diff(low[order]) | np.diff(high[order])) + 1
            for same in np.split(order, edges):
                for some in np.array_split(same, -(-len(same) // 512)):
                    lo, hi = low[some[0]], high[some[0]]
                    if lo == hi:
                        continue
                    cos = x[ask[some]] @ y[lo:hi].T
                    cos[id_of[some][:, None] == ids[None, lo:hi]] = -2
                    if k is not None and hi - lo > k:
                        top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
                        keep = np.zeros(cos.shape, bool)
                        np.put_along_axis(keep, top, True, 1)
                        keep &= cos >= floor
                    else:
                        keep = cos >= max(floor, -1.5)
                    i, j = np.nonzero(keep)
                    a.append(id_of[some[i]])
                    b.append(ids[lo + j])
        cat = lambda z: np.concatenate(z) if z else np.zeros(0, np.int64)
        return pd.DataFrame({"a": cat(a), "b": cat(b)})

    asked = points.join(levels.withColumnRenamed("level", "__level"), "id", "left")
    rows = _rows(asked, forest, dim, "__level", True).withColumn("asks", F.col("level").isNotNull())
    if parts == 1:
        spread = rows.withColumns({"part": F.lit(0), "here": F.lit(True)})
    else:
        own = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts)).cast("int")
        every = F.when(F.col("asks"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(own))
        spread = rows.withColumns({"own": own, "part": F.explode(every)}).withColumn("here", F.col("own") == F.col("part")).drop("own")
    return spread.groupBy("tree", "block", "part").applyInPandas(nearest, "a long, b long").distinct()


def _copies(points: DataFrame, dim: int) -> DataFrame:
    """(id, rep): vectors of the same direction as one of a lesser id, to five decimals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.round(matrix(batch.column("v"), dim), 5) + 0.0
            key = [int.from_bytes(hashlib.blake2b(row.tobytes(), digest_size=8).digest(), "little", signed=True) for row in x]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(key, pa.int64())], ["id", "key"])

    keyed = points.mapInArrow(run, "id long, key long")
    first = keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(first, "key").where("id <> rep").select("id", "rep")


def _cosine(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """pairs (a, b) with their exact cosine."""
    def dot(x: str, y: str) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    left = points.select(F.col("id").alias("a"), F.col("v").alias("va"))
    right = points.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.select("a", "b", (dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb"))).alias("cosine"))


def _prepared(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    staging = Staging(vectors.sparkSession)
    points = usable(vectors, id_col, vector_col, dim)
    copies = staging.write(_copies(points, dim), "copies")
    reps = staging.write(points.join(copies.select("id"), "id", "left_anti"), "points")
    return points, copies, reps, reps.count()


def similar_pairs(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embeddings", dim: int = 64, least: float = 0.95,
    trees: int = 16, wanted: int = 512, seed: int = 5,
) -> DataFrame:
    """(vec_id_a, vec_id_b, cosine): pairs of usable vectors of a cosine of at least `least`; a < b.

    Vectors of the same direction are searched once and then stand for each other. Null, all-zero and otherwise
    dimensioned vectors pair with nothing; an empty table gives an empty result.
    """
    points, copies, reps, n = _prepared(vectors, id_col, vector_col, dim)
    forest = plant(reps, n, dim, trees, wanted, tuple(range(3, 25)), True, seed)
    staging = Staging(vectors.sparkSession)
    levels = staging.write(ascend(reps, forest, dim, "1", wanted), "levels")
    near = candidates(reps, levels, forest, dim, None, least)
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    member = reps.select("id", F.col("id").alias("rep")).unionByName(copies.select("id", "rep"))
    of_a = member.select(F.col("rep").alias("a"), F.col("id").alias("ia"))
    of_b = member.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    across = near.join(of_a, "a").join(of_b, "b").select("ia", "ib")
    of_copy = copies.select("rep").distinct().join(member, "rep")
    within = of_copy.select("rep", F.col("id").alias("ia")).join(of_copy.select("rep", F.col("id").alias("ib")), "rep")
    pairs = across.unionByName(within.select("ia", "ib")).where("ia <> ib")
    pairs = pairs.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct()
    return _cosine(pairs, points).where(F.col("cosine") >= least).select(F.col("a").alias("vec_id_a"), F.col("b").alias("vec_id_b"), "cosine")


def nearest_neighbours(
    vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embeddings", dim: int = 64,
    query: str = "id % 20 = 0", trees: int = 16, share: float = 0.25, seed: int = 5,
) -> DataFrame:
    """(vec_id, neighbour_id, cosine, rank): the `k` most similar other vectors of each query, against all vectors.

    `query` is a predicate on `id`. Candidates are `share` of all vectors, counted over all trees; the accuracy lost
    is what the tests and the README measure against brute force. Equal cosines are ranked by the lesser id. Of a
    group of copies the k of least id stand for the group, which is all that k places can hold.
    """
    points, copies, reps, n = _prepared(vectors, id_col, vector_col, dim)
    wanted = max(32 * k, int(share * n))
    forest = plant(reps, n, dim, trees, wanted, tuple(range(1, 33)), False, seed)
    staging = Staging(vectors.sparkSession)
    asked = points.where(query).select("id").join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    is_asked = asked.select(F.col("rep").alias("id")).distinct().withColumn("asked", F.lit(1))
    marked = staging.write(reps.join(is_asked, "id", "left"), "marked")
    levels = staging.write(ascend(marked, forest, dim, "asked", wanted), "levels")
    near = candidates(reps, levels, forest, dim, 2 * k, -1.5, max(1, -(-2 * wanted // trees // ITEMS)))
    member = reps.select("id", F.col("id").alias("rep")).unionByName(copies.select("id", "rep"))
    few = member.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1)
    of_b = few.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    other = near.join(of_b, "b").select("a", "ib")
    same = is_asked.select(F.col("id").alias("a")).join(few.select(F.col("rep").alias("a"), F.col("id").alias("ib")), "a")
    pairs = other.unionByName(same).join(asked.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a")
    scored = _cosine(pairs.where("ia <> ib").select(F.col("ia").alias("a"), F.col("ib").alias("b")).distinct(), points)
    w = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("a").alias("vec_id"), F.col("b").alias("neighbour_id"), "cosine", "rank")


def brute_neighbours(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embeddings", dim: int = 64, query: str = "id % 20 = 0") -> DataFrame:
    """(vec_id, neighbour_id): the exact k nearest of each query, to measure recall by; queries meet all vectors in blocks
    of both, so the work is queries times vectors and a task's memory that of two blocks."""
    points = usable(vectors, id_col, vector_col, dim)
    n = max(1, -(-points.count() // ITEMS))
    asks = points.where(query)
    m = max(1, -(-asks.count() // BLOCK))
    part = lambda many: F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")
    q = asks.select("id", "v", part(m).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("q"), F.lit(True).alias("asks"))
    i = points.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("p"), part(n).alias("q"), F.lit(False).alias("asks"))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["v"].tolist(), np.float64).reshape(-1, dim)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids, asks_ = pdf["id"].to_numpy(), pdf["asks"].to_numpy()
        order = np.argsort(ids[~asks_])
        qi, ii, y = ids[asks_], ids[~asks_][order], x[~asks_][order]
        cos = x[asks_] @ y.T
        cos[qi[:, None] == ii[None]] = -2
        top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
        got = pd.DataFrame({"vec_id": np.repeat(qi, top.shape[1]), "neighbour_id": ii[top].ravel(), "cosine": np.take_along_axis(cos, top, 1).ravel()})
        return got[got["cosine"] > -2]

    near = q.unionByName(i).groupBy("p", "q").applyInPandas(nearest, "vec_id long, neighbour_id long, cosine double")
    w = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour_id")
    return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("vec_id", "neighbour_id")
