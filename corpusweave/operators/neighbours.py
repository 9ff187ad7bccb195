"""Exact nearest neighbours and density ties of a table with itself, block against block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.operators.index import _matrix, fit_cells
from corpusweave.runtime import Staging

#: Rows of a block; rows and columns of the tile of a product that is held at once; vectors that the order is fitted on; open blocks of a task.
BLOCK, ROWS, COLS, FIT_ROWS, KEPT = 16_384, 512, 2_048, 8_192, 8
#: Products of unit vectors in single precision are off by less than this; products that are equal when rounded differ by less.
SLACK, ROUNDING = 2e-5, 2e-9
#: Entries of a tile of which the exact product is taken one by one.
SPARSE = 1 / 64
#: Rows less near their cell's centre than its median by this are a group; centres nearer than ALIKE say nothing;
#: shares of a group's rows up to which a stretch of it goes; one column in THIN tells the first bounds.
FAR, ALIKE, STRETCHES, THIN = 0.15, 0.99, (1 / 16, 1 / 4, 1), 4
#: The bound of rows of which no neighbours are asked: no product reaches it.
UNASKED = 4.0
PAIRS = "id long, neighbour_id long, sim double"


def _products(x: np.ndarray, y: np.ndarray, least: float | np.ndarray, buffer: np.ndarray, theirs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, value) of the single-precision products of x and y that reach `least` of i or, where it is given, `theirs` of j.

    The greatest product of a row tells whether any of it is looked at, so most tiles are read once."""
    s = buffer[: len(x) * len(y)].reshape(len(x), len(y))
    np.matmul(x, y.T, out=s)
    least = np.broadcast_to(np.asarray(least, np.float32), len(x))
    rows = np.flatnonzero(s.max(1) >= least)
    if 2 * len(rows) > len(x):
        i, j = np.divmod(np.flatnonzero(s >= least[:, None]), len(y))
    else:
        at = np.flatnonzero(s[rows] >= least[rows, None]) if len(rows) else rows
        i, j = rows[at // len(y)], at % len(y)
    if theirs is not None:
        cols = np.flatnonzero(s.max(0) >= np.asarray(theirs, np.float32))
        if len(cols):
            some = s[:, cols]
            at = np.flatnonzero((some >= np.asarray(theirs, np.float32)[cols]) & (some < least[:, None]))
            i, j = np.concatenate([i, at // len(cols)]), np.concatenate([j, cols[at % len(cols)]])
    return i, j, s[i, j]


def _buffer() -> np.ndarray:
    return np.empty(ROWS * COLS, np.float32)


def _sims(x: np.ndarray, rows: np.ndarray, i: np.ndarray, y: np.ndarray, cols: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact products of x and y at the places i of `rows` and j of `cols`; all of the tile at once where they are many."""
    if len(i) > SPARSE * len(rows) * len(cols):
        return (x[rows] @ y[cols].T)[i, j]
    out, i, j = np.empty(len(i)), rows[i], cols[j]
    for s in range(0, len(i), 16_384):
        out[s : s + 16_384] = np.einsum("ij,ij->i", x[i[s : s + 16_384]], y[j[s : s + 16_384]])
    return out


def _taken(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows `at` of x, in order; not copied where they are one stretch."""
    return x[at[0] : at[-1] + 1] if len(at) and at[-1] - at[0] + 1 == len(at) and (np.diff(at) == 1).all() else x[at]


def _first(row: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each row, in the order of rows: the most similar, then the least ids."""
    order = np.lexsort((other, -np.round(sim, 9), row))
    r = row[order]
    return order[np.arange(len(r)) - np.searchsorted(r, r) < k]


def _pairs(row: np.ndarray, other: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(other, pa.int64()), pa.array(sim, pa.float64())], ["id", "neighbour_id", "sim"])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _best(ids: np.ndarray, x: np.ndarray, f: np.ndarray, some: np.ndarray, others: np.ndarray, k: int, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, sim): the exact k best of each of the rows `some` of a block among its rows `others`, in the order of rows.

    A bound of the k-th best is first told from the best of as many parts of some of `others`, then all that reach it are taken."""
    own = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    every = [own]
    thin, theirs = others[:: THIN if len(others) > 2 * COLS else 1], _taken(f, others)
    least_of = f[thin]
    for a in range(0, len(some), ROWS):
        rows = some[a : a + ROWS]
        left, tops = f[rows], []
        for b in range(0, len(thin), COLS):
            cols = thin[b : b + COLS]
            s = left @ least_of[b : b + COLS].T
            at = np.minimum(np.searchsorted(cols, rows), len(cols) - 1)
            inside = np.flatnonzero(cols[at] == rows)
            s[inside, at[inside]] = -4
            width = -(-s.shape[1] // 32)
            tops += [s[:, c : c + width].max(1) for c in range(0, s.shape[1], width)]
        top = np.stack(tops, 1) if tops else np.zeros((len(rows), 0), np.float32)
        bound = np.maximum(np.partition(top, -k, axis=1)[:, -k] - np.float32(SLACK), np.float32(-3)) if top.shape[1] > k else np.full(len(rows), -3, np.float32)
        best = own
        for b in range(0, len(others), COLS):
            cols = others[b : b + COLS]
            i, j, _ = _products(left, theirs[b : b + COLS], bound, buffer)
            keep = rows[i] != cols[j]
            i, j = i[keep], j[keep]
            sim = _sims(x, rows, i, x, cols, j)
            best = [np.concatenate(c) for c in zip(best, (rows[i], cols[j], sim))]
            if len(best[0]) > 4 * k * len(rows):
                first = _first(best[0], ids[best[1]], best[2], k)
                best = [c[first] for c in best]
        first = _first(best[0], ids[best[1]], best[2], k)
        every.append([c[first] for c in best])
    return tuple(np.concatenate(c) for c in zip(*every))


def _within(ids: np.ndarray, x: np.ndarray, k: int, groups: np.ndarray | None = None, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, sim): the exact k best of each row of a block among the others of it, in the order of rows.

    With groups, the rows of a group are first searched among themselves, then among what of the other groups may reach the
    bound that this gives; those far from their cell's centre, which nearly all may reach, are searched among all at once.
    `asked` says of each row, the same of all of a group, whether its neighbours are wanted."""
    f, buffer, n = x.astype(np.float32), _buffer(), len(x)
    if groups is None:
        return _best(ids, x, f, np.arange(n), np.arange(n), k, buffer)
    order = np.argsort(groups, kind="stable")
    runs, centres = _runs(x[order], groups[order])
    members, to = [order[r] for r in runs], x @ centres.T
    every = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for g, rows in enumerate(members):
        if asked is not None and not asked[rows[0]]:
            continue
        if groups[rows[0]] % 2 or len(rows) <= k:
            every.append(_best(ids, x, f, rows, np.arange(n), k, buffer))
            continue
        found = [_best(ids, x, f, rows, rows, k, buffer)]
        least = found[0][2].reshape(len(rows), k)[:, k - 1]
        for h, others in enumerate(members):
            if h == g:
                continue
            cos = float(centres[g] @ centres[h])
            near = [(np.arange(len(rows)), np.arange(len(others)))] if abs(cos) >= ALIKE else _may_reach(to[rows][:, [g, h]], least, to[others][:, [h, g]][:, ::-1], cos)
            for i, j in near:
                found += _reaching(f, x, f, x, rows[i], others[j], least[i], None, buffer)
        row, col, sim = (np.concatenate(c) for c in zip(*[z[:3] for z in found]))
        first = _first(row, ids[col], sim, k)
        every.append((row[first], col[first], sim[first]))
    row, col, sim = (np.concatenate(c) for c in zip(*every))
    first = np.argsort(row, kind="stable")
    return row[first], col[first], sim[first]


def _groups(x: np.ndarray, cell: np.ndarray, far: tuple[int, ...] = ()) -> np.ndarray:
    """Groups of the rows of a block: those of a cell near its centre, and those far from it, as all of the cells `far` are."""
    out = np.zeros(len(x), np.int64)
    for c in np.unique(cell):
        at = np.flatnonzero(cell == c)
        if c in far:
            out[at] = 2 * int(c) + 1
            continue
        near = x[at] @ _unit(x[at].mean(0, keepdims=True))[0]
        out[at] = 2 * int(c) + (near < np.median(near) - FAR)
    return out


def _runs(x: np.ndarray, groups: np.ndarray) -> tuple[list[slice], np.ndarray]:
    """(runs of rows of one group, a unit centre of each)."""
    cuts = np.flatnonzero(np.diff(groups, prepend=-1))
    runs = [slice(a, b) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(groups)])]
    return runs, _unit(np.stack([x[r].mean(0) for r in runs])) if runs else np.zeros((0, x.shape[1]))


def _may_reach(x: np.ndarray, least: np.ndarray, y: np.ndarray, cos: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, rows of y): all pairs whose product may reach the bound `least` of x, in stretches of y.

    x and y are the products of unit vectors with the centre of x's group and that of y's, `cos` that of both centres. In
    the plane of the centres the product is known; outside it is no more than that of the lengths."""
    turn = np.sqrt(1 - cos * cos)
    (p1, p2), (q1, q2) = ((z[:, 0], (z[:, 1] - cos * z[:, 0]) / turn) for z in (x, y))
    p3, q3 = (np.sqrt(np.maximum(0, 1 - u * u - v * v)) for u, v in ((p1, p2), (q1, q2)))

    def reach(i: np.ndarray | slice, j: np.ndarray | slice) -> np.ndarray:
        most = sum(np.maximum(p[i] * q[j].min(), p[i] * q[j].max()) for p, q in ((p1, q1), (p2, q2))) + p3[i] * q3[j].max()
        return np.flatnonzero(most >= least[i] - SLACK)

    may = reach(slice(None), slice(None))  # no stretch has more
    if not len(may):
        return []
    order, out, a = np.argsort(-q1), [], 0
    for share in STRETCHES:
        j = order[a : max(a, int(share * len(order)))]
        a += len(j)
        if len(j):
            i = may[reach(may, j)]
            if len(i):
                out.append((i, np.sort(j)))
    return out


def _reaching(f: np.ndarray, x: np.ndarray, g: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, tl: np.ndarray, tr: np.ndarray | None, buffer: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, sim, to): exact products of the rows `left` of x and `right` of y that reach the bound tl of a row or, where
    it is given, tr of a column, tile by tile; `to` says of which of both: 1, 2 or 3. f and g are x and y in single precision."""
    out, fl, fr = [], _taken(f, left), _taken(g, right)
    low, lower = tl - SLACK, None if tr is None else tr - SLACK
    for a in range(0, len(left), ROWS):
        for b in range(0, len(right), COLS):
            i, j, _ = _products(fl[a : a + ROWS], fr[b : b + COLS], low[a : a + ROWS], buffer, None if lower is None else lower[b : b + COLS])
            if not len(i):
                continue
            la, rb = left[a : a + ROWS], right[b : b + COLS]
            sim = _sims(x, la, i, y, rb, j)
            to = (sim >= tl[a + i] - ROUNDING).astype(np.int8)
            if tr is not None:
                to += 2 * (sim >= tr[b + j] - ROUNDING).astype(np.int8)
            out.append((la[i[to > 0]], rb[j[to > 0]], sim[to > 0], to[to > 0]))
    return out


def _between(ids: list[np.ndarray], x: list[np.ndarray], least: list[np.ndarray], groups: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour id, sim): for each row of either of two blocks its exact k best of the other that reach its bound.

    The rows of a block are in the order of groups and, within one, of bounds. Rows far from their cell's centre have low
    bounds, which nearly all may reach: those of a block are multiplied at once with all of the other. Of two groups of
    other rows only what may reach a bound is multiplied: for either side by itself, or all of both where that is less.
    Nothing reaches rows that are not asked."""
    f, buffer = [z.astype(np.float32) for z in x], _buffer()
    every: list = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]

    def keep(row: np.ndarray, other: np.ndarray, sim: np.ndarray) -> None:
        some = _first(row, other, sim, k)
        for z, of in zip(every, (row[some], other[some], sim[some])):
            z.append(of)

    def multiply(side: int, left: np.ndarray, right: np.ndarray, tl: np.ndarray, tr: np.ndarray | None = None) -> None:
        for i, j, sim, to in _reaching(f[side], x[side], f[1 - side], x[1 - side], left, right, tl, tr, buffer):
            mine, theirs = (to & 1) > 0, (to & 2) > 0
            keep(ids[side][i[mine]], ids[1 - side][j[mine]], sim[mine])
            if tr is not None:
                keep(ids[1 - side][j[theirs]], ids[side][i[theirs]], sim[theirs])

    wide = [(g % 2 == 1) & (t < UNASKED) for g, t in zip(groups, least)]
    near, far = ([np.flatnonzero(z == c) for z in wide] for c in (False, True))
    multiply(0, far[0], np.arange(len(x[1])), least[0][far[0]], least[1])
    multiply(1, far[1], near[0], least[1][far[1]], least[0][near[0]])
    (runs, centres), (runs2, centres2) = (_runs(_taken(z, n), g[n]) for z, n, g in zip(x, near, groups))
    to, to2 = (_taken(z, n) @ np.concatenate([centres, centres2]).T for z, n in zip(x, near))
    for g, one in enumerate(runs):
        for h, two in enumerate(runs2):
            left, right = near[0][one], near[1][two]
            tl, tr, cos = least[0][left], least[1][right], float(centres[g] @ centres2[h])
            if min(tl.min(), tr.min()) >= UNASKED:
                continue
            at = [g, len(runs) + h]
            if abs(cos) < ALIKE:
                mine = _may_reach(to[one][:, at], tl, to2[two][:, at[::-1]][:, ::-1], cos)
                theirs = _may_reach(to2[two][:, at[::-1]], tr, to[one][:, at][:, ::-1], cos)
                if sum(len(i) * len(j) for i, j in mine + theirs) < len(left) * len(right):
                    for i, j in mine:
                        multiply(0, left[i], right[j], tl[i])
                    for j, i in theirs:
                        multiply(1, right[j], left[i], tr[j])
                    continue
            multiply(0, left, right, tl, tr)
    got = [np.concatenate(z) for z in every]
    some = _first(got[0], got[1], got[2], k)
    return tuple(z[some] for z in got)


def _blocks(rows: DataFrame, n: int, by: tuple[str, ...], pack, schema: str, name: str) -> DataFrame:
    """A row for each of about n stretches of rows in the order of `by`, as pack(batches of the stretch) makes it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield pa.RecordBatch.from_pylist([{"block": TaskContext.get().partitionId()} | pack(pa.Table.from_batches(got).combine_chunks().to_batches()[0])], wanted)

    kinds = {"int": pa.int32(), "binary": pa.binary()}
    wanted = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return Staging(rows.sparkSession).write(rows.repartitionByRange(n, *by).mapInArrow(run, schema), name)


def _met(blocks: DataFrame, n: int, opened, run, schema: str, lefts: DataFrame | None = None) -> DataFrame:
    """run(left, right) over all pairs of blocks as `opened` makes them of their rows, left before right, and where it is
    given only those whose left one is of `lefts`.

    A task reads its few blocks from where they are kept: nothing is copied for the sake of pairs, and nothing broadcast.
    Of its pairs a task opens a block once, unless it has more than KEPT."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, object] = {}

        def get(side: str, batch: pa.RecordBatch, row: int) -> object:
            block = batch.column(f"{side}_block")[row].as_py()
            if block not in kept:
                if len(kept) >= KEPT:
                    kept.pop(next(iter(kept)))
                kept[block] = opened({c: batch.column(f"{side}_{c}")[row].as_py() for c in names})
            return kept[block]

        for batch in batches:
            for row in range(batch.num_rows):
                yield run(get("l", batch, row), get("r", batch, row))

    names = [c for c in blocks.columns if c != "block"]
    left = (blocks if lefts is None else lefts).repartitionByRange(n if n <= 24 else -(-n // 2), "block").select([F.col(c).alias(f"l_{c}") for c in blocks.columns])
    right = blocks.repartitionByRange(n if n <= 12 else -(-n // 6), "block").select([F.col(c).alias(f"r_{c}") for c in blocks.columns])
    return left.hint("shuffle_replicate_nl").join(right, F.col("l_block") < F.col("r_block")).mapInArrow(each, schema)


def _placed(points: DataFrame, dim: int, n: int, cells: int) -> tuple[DataFrame, tuple[int, ...]]:
    """(points (id, v, asked) with `cell`, the cells of vectors far from all centres).

    By their cell like vectors come to the same blocks, those that are asked before the others. Vectors far from their centre,
    or of a centre that is itself far from most of its own, have a cell to themselves, so that they meet a block at once. All
    this decides only how much is compared in vain."""
    some = points.select("v").sample(min(1.0, 1.2 * FIT_ROWS / n), 11).limit(FIT_ROWS).toArrow().column("v").combine_chunks()
    x = _matrix(some, dim) if len(some) else np.zeros((0, dim))
    if len(x) <= cells:
        return points.withColumn("cell", F.when(F.col("asked"), 0).otherwise(1)), ()
    centres = fit_cells(x, cells, 11, 6).astype(np.float32)
    to = x.astype(np.float32) @ centres.T
    at, near = to.argmax(1), to.max(1)
    middle = np.array([np.median(near[at == c]) if (at == c).any() else 1.0 for c in range(cells)], np.float32)
    least = np.maximum(middle, np.median(near) - FAR) - np.float32(FAR)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = _matrix(batch.column("v"), dim).astype(np.float32) @ centres.T
            cell = to.argmax(1)
            cell = np.where(to[np.arange(len(to)), cell] < least[cell], cells, cell)
            cell += np.where(batch.column("asked").to_numpy(zero_copy_only=False), 0, cells + 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "v", "asked")), pa.array(cell.astype(np.int32))], ["id", "v", "asked", "cell"])

    return points.mapInArrow(place, "id long, v array<float>, asked boolean, cell int"), (cells, 2 * cells + 1)


def all_nearest(points: DataFrame, k: int, dim: int = 64, block: int = BLOCK, asked: Column | None = None) -> DataFrame:
    """(id, neighbour_id, sim, rank): exact k nearest by cosine of every point (id, v), v of `dim` values, among all others;
    all-zero and repeated vectors are points like any other. With `asked`, a condition on points, those of the points that
    fulfil it, still among all others.

    Vectors are packed into blocks of like ones. A block is first searched by itself, which bounds the k-th similarity of
    each of its rows; then every two blocks meet once: what by the centres of groups of their rows may reach the bound of
    either row is multiplied in single precision, and what then may is taken again in double precision and leaves the task.
    """
    wanted = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    points = points.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v"), wanted.alias("asked"))
    rows = points.count()
    n = max(1, -(-rows // block))
    placed, far = _placed(points, dim, rows, min(256, 3 * n)) if n > 1 else (points.withColumn("cell", F.when(F.col("asked"), 0).otherwise(1)), ())

    def pack(batch: pa.RecordBatch) -> dict:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        order = np.argsort(ids)
        ids, raw = ids[order], batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[order]
        x = _unit(raw)
        groups = _groups(x, batch.column("cell").to_numpy(zero_copy_only=False)[order], far)
        asks = batch.column("asked").to_numpy(zero_copy_only=False)[order]
        row, col, sim = _within(ids, x, k, groups, asks)
        least, count = np.where(asks, -2.0, UNASKED), np.bincount(row, minlength=len(ids))
        last = np.cumsum(count) - 1
        full = count >= k
        least[full] = sim[last[full]]
        by = np.lexsort((-least, groups))
        made = {"ids": ids[by], "v": raw[by].astype(np.float32), "least": least[by], "groups": groups[by], "row": ids[row], "near": ids[col], "sim": sim}
        return {"asks": int(asks.any())} | {c: np.ascontiguousarray(z).tobytes() for c, z in made.items()}

    columns = ("ids", "v", "least", "groups", "row", "near", "sim")
    blocks = _blocks(placed, n, ("cell", "id"), pack, "block int, asks int, " + ", ".join(f"{c} binary" for c in columns), "blocks")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, c, s in zip(*(batch.column(c) for c in ("row", "near", "sim"))):
                yield _pairs(np.frombuffer(r.as_py(), np.int64), np.frombuffer(c.as_py(), np.int64), np.frombuffer(s.as_py(), np.float64))

    def opened(one: dict) -> tuple[np.ndarray, ...]:
        return np.frombuffer(one["ids"], np.int64), _unit(np.frombuffer(one["v"], np.float32).reshape(-1, dim)), np.frombuffer(one["least"], np.float64), np.frombuffer(one["groups"], np.int64)

    def between(left: tuple, right: tuple) -> pa.RecordBatch:
        return _pairs(*_between(*([a, b] for a, b in zip(left, right)), k))

    near = blocks.select("row", "near", "sim").mapInArrow(inside, PAIRS)
    if n > 1:
        met = ("block", "ids", "v", "least", "groups")
        lefts = None if asked is None else blocks.where("asks = 1").select(*met)
        near = near.unionByName(_met(blocks.select(*met), n, opened, between, PAIRS, lefts))
    w = Window.partitionBy("id").orderBy(F.desc(F.round("sim", 9)), "neighbour_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _roots(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _tied(groups: list[np.ndarray], x: list[np.ndarray], eps: float) -> list[tuple[int, int]]:
    """Pairs of groups of which some row of the first block and some of the second are within eps; a spanning forest of them.

    Rows are in the order of groups. Tiles whose rows are all of one tied group are passed over, so what is looked at is
    only what may tie two."""
    parent: dict[int, int] = {}
    out: list[tuple[int, int]] = []
    f, buffer, least = [z.astype(np.float32) for z in x], _buffer(), 1 - eps * eps / 2

    def tie(a: int, b: int) -> None:
        ra, rb = _roots(parent, a), _roots(parent, b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))

    for a in range(0, len(x[0]), ROWS):
        ga = groups[0][a : a + ROWS]
        ua = np.unique(ga)
        for b in range(0, len(x[1]), COLS):
            gb = groups[1][b : b + COLS]
            ub = np.unique(gb)
            if len({_roots(parent, int(g)) for g in (*ua, *ub)}) == 1:
                continue
            i, j, v = _products(f[0][a : a + ROWS], f[1][b : b + COLS], least - SLACK, buffer)
            differ = ga[i] != gb[j]
            i, j, v = i[differ], j[differ], v[differ]
            near = v >= least + SLACK
            for far in np.array_split(np.flatnonzero(~near), max(1, -(-np.count_nonzero(~near) // 65_536))):
                sim = np.einsum("ij,ij->i", x[0][a : a + ROWS][i[far]], x[1][b : b + COLS][j[far]])
                near[far] = np.sqrt(np.maximum(0.0, 2 - 2 * sim)) <= eps
            pairs = np.searchsorted(ua, ga[i[near]]) * len(ub) + np.searchsorted(ub, gb[j[near]])
            for p in np.unique(pairs).tolist():
                tie(int(ua[p // len(ub)]), int(ub[p % len(ub)]))
    return out


def ties_between(points: DataFrame, eps: float, dim: int = 64, block: int = BLOCK) -> DataFrame:
    """(src, dst): ties enough to connect all groups of points (id, v, group) of which two points are within eps.

    Blocks hold groups in order, so that two blocks of one group have nothing to say and are not multiplied."""
    points = points.select(F.col("v").cast("array<float>").alias("v"), F.col("group").cast("long").alias("group"), "id")
    n = max(1, -(-points.count() // block))

    def pack(batch: pa.RecordBatch) -> dict:
        groups = batch.column("group").to_numpy(zero_copy_only=False)
        by = np.argsort(groups, kind="stable")
        raw = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[by]
        return {"groups": np.ascontiguousarray(groups[by]).tobytes(), "v": np.ascontiguousarray(raw).tobytes()}

    blocks = _blocks(points, n, ("group", "id"), pack, "block int, groups binary, v binary", "group_blocks")

    def opened(one: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(one["groups"], np.int64), _unit(np.frombuffer(one["v"], np.float32).reshape(-1, dim))

    def of(left: tuple, right: tuple) -> pa.RecordBatch:
        groups, got = [left[0], right[0]], []
        if groups[0].min() != groups[1].max() or groups[0].max() != groups[1].min():
            got = _tied(groups, [left[1], right[1]], eps)
        return pa.RecordBatch.from_arrays([pa.array([p[c] for p in got], pa.int64()) for c in (0, 1)], ["src", "dst"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, v in zip(batch.column("groups"), batch.column("v")):
                one = opened({"groups": g.as_py(), "v": v.as_py()})
                yield of(one, one)

    ties = blocks.select("groups", "v").mapInArrow(inside, "src long, dst long")
    if n > 1:
        ties = ties.unionByName(_met(blocks, n, opened, of, "src long, dst long"))
    return ties.distinct()
