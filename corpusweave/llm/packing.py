"""Filling fixed-capacity containers: hierarchical packing over tiers of lengths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.splitting import split_oversized
from corpusweave.llm.tokens import VOCABULARY
from corpusweave.runtime import Staging

#: Rows that one ranking task is meant to hold; it decides how a frequent length is spread, nothing else.
RANK_ROWS = 2_000_000


@dataclass
class Windows:
    """Patterns of windows: pattern p is used `times[p]` times, is of tier `tier[p]`, holds lengths `items[p]` (length,
    how often), `fill[p]` in all."""

    items: list[list[tuple[int, int]]] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    fill: list[int] = field(default_factory=list)
    tier: list[int] = field(default_factory=list)


def _patterns(left: np.ndarray, windows: Windows, low: int, size: int) -> None:
    """Use up the lengths in (low, size] of the counts `left` in windows of `size`.

    A window is opened with the longest of them and packed with the longest that fit, shorter ones below `low` last. A
    pattern is used as often as its items last, so each pattern uses up a length and there are no more patterns than
    lengths: the work depends on the sizes, not on the number of items."""
    while True:
        own = np.flatnonzero(left[low + 1 : size + 1])
        if not len(own):
            return
        gap, used = size, {}
        while gap:
            room = left[1 : gap + 1].copy()
            for n, k in used.items():
                if n <= gap:
                    room[n - 1] -= k
            fits = np.flatnonzero(room)
            if not len(fits):
                break
            n = int(fits[-1]) + 1
            k = min(gap // n, int(room[n - 1]))
            used[n] = used.get(n, 0) + k
            gap -= k * n
        times = int(min(left[n] // k for n, k in used.items()))
        for n, k in used.items():
            left[n] -= times * k
        windows.items.append(sorted(used.items(), reverse=True))
        windows.times.append(times)
        windows.fill.append(size - gap)
        windows.tier.append(size)


def plan_containers(counts: dict[int, int], capacity: int, tiers: tuple[int, ...]) -> tuple[Windows, Windows]:
    """(windows, containers) for `counts[n]` items of each length n: windows of items, and containers of windows.

    Each item is routed to the shortest tier that takes it. From the longest tier down, a tier's items are packed into
    windows of the tier's own size, and what is left in a window is filled from the shorter tiers, longest first. Then
    whole windows are packed into containers by their fill: a window stays together, so the items of a short tier lie
    side by side in stretches of that tier's size.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    bounds = [0, *sorted(t for t in set(tiers) if 0 < t < capacity), capacity]
    windows = Windows()
    for low, size in zip(bounds[-2::-1], bounds[:0:-1]):
        _patterns(left, windows, low, size)
    for fill, times in zip(windows.fill, windows.times):
        left[fill] += times
    containers = Windows()
    _patterns(left, containers, 0, capacity)
    return windows, containers


class _Slots:
    """Where the k-th of all items of a length goes: which pattern, and which use of it."""

    def __init__(self, plan: Windows, order: list[int]):
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for p in order:
            for n, k in plan.items[p]:
                rows.setdefault(n, []).append((k * plan.times[p], k, p))
        self.of = {n: (np.cumsum([0, *(c for c, _, _ in r)][:-1]), np.array([k for _, k, _ in r]), np.array([p for _, _, p in r])) for n, r in rows.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pattern, use = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            starts, k, patterns = self.of[int(n)]
            here = length == n
            at = np.searchsorted(starts, rank[here], side="right") - 1
            pattern[here], use[here] = patterns[at], (rank[here] - starts[at]) // k[at]
        return pattern, use


def pack(docs: DataFrame, capacity: int, tiers: tuple[int, ...] = (256, 512, 1024), step_containers: int = 64, path: str = VOCABULARY) -> DataFrame:
    """(container_id, step_group, doc_id, piece_no, tier, window_tier, n_tokens): each text, or piece of an oversized one.

    `tier` is the one a text is routed to, `window_tier` that of the window it lies in (see plan_containers).
    A text is split only if it exceeds the capacity, at natural boundaries and without overlap. Null and empty texts
    take no space: they come with a null container and step group. Containers are numbered by falling fill and dealt
    to step groups of about `step_containers` back and forth, so groups differ little in tokens. Only the counts per
    length, at most `capacity` rows, reach the driver; items are ranked within length and a hash of the id, so that a
    length held by a third of all rows is ranked by many tasks.
    """
    staging = Staging(docs.sparkSession)
    items = split_oversized(docs, capacity, 0, with_text=False, path=path).select("doc_id", "piece_no", "n_tokens", "start_token")
    items = staging.write(items, "items")
    chunks = max(16, -(-items.count() // RANK_ROWS))
    items = items.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(chunks)).cast("int"))
    sized = items.where("n_tokens > 0")
    cells = sized.groupBy("n_tokens", "chunk").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.n_tokens: r.n for r in cells.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    windows, containers = plan_containers(counts, capacity, tiers)
    # Windows of one fill are dealt to the containers' places for that fill one pattern after the other.
    before_of, seen = np.zeros(len(windows.times), np.int64), {}
    for p, (fill, times) in enumerate(zip(windows.fill, windows.times)):
        before_of[p] = seen.get(fill, 0)
        seen[fill] = seen.get(fill, 0) + times
    order = sorted(range(len(containers.times)), key=lambda p: -containers.fill[p])
    first = np.zeros(len(containers.times), np.int64)
    total = 0
    for p in order:
        first[p], total = total, total + containers.times[p]
    groups = max(1, round(total / step_containers))
    in_window, in_container = _Slots(windows, list(range(len(windows.times)))), _Slots(containers, order)
    fill_of, tier_of = np.array(windows.fill, np.int64), np.array(windows.tier, np.int32)

    w = Window.partitionBy("n_tokens").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select("n_tokens", "chunk", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    in_cell = Window.partitionBy("n_tokens", "chunk").orderBy("doc_id", "piece_no", "start_token")
    ranked = sized.withColumn("r", F.row_number().over(in_cell) - 1).join(before, ["n_tokens", "chunk"])
    ranked = ranked.select("doc_id", "piece_no", "n_tokens", (F.col("r") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            window, use = in_window.place(batch.column("n_tokens").to_numpy(), batch.column("rank").to_numpy())
            pattern, at = in_container.place(fill_of[window], before_of[window] + use)
            box = first[pattern] + at
            lap, at = box // groups, box % groups
            step = np.where(lap % 2 == 0, at, groups - 1 - at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(box), pa.array(step), *(batch.column(c) for c in ("doc_id", "piece_no", "n_tokens")), pa.array(tier_of[window])],
                ["container_id", "step_group", "doc_id", "piece_no", "n_tokens", "window_tier"],
            )

    placed = ranked.mapInArrow(place, "container_id long, step_group long, doc_id long, piece_no int, n_tokens int, window_tier int")
    empty = items.where("n_tokens = 0").select(
        F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("long").alias("step_group"), "doc_id", "piece_no", "n_tokens", F.lit(None).cast("int").alias("window_tier")
    )
    tier = F.lit(capacity)
    for t in sorted(tiers, reverse=True):
        if t < capacity:
            tier = F.when(F.col("n_tokens") <= t, F.lit(t)).otherwise(tier)
    return placed.unionByName(empty).withColumn("tier", tier)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(tier, containers, items, tokens, fill, padding, least_step, most_step): per tier of a container's longest text,
    how full its containers are, the padding they need, and the tokens of the lightest and the heaviest step group."""
    box = packed.where("container_id is not null").groupBy("container_id", "step_group").agg(F.max("tier").alias("tier"), F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"))
    steps = box.groupBy("step_group").agg(F.sum("tokens").alias("t")).agg(F.min("t").alias("least_step"), F.max("t").alias("most_step"))
    per = box.groupBy("tier").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))
    room = F.col("containers") * capacity
    return per.select("tier", "containers", "items", "tokens", (F.col("tokens") / room).alias("fill"), (room - F.col("tokens")).alias("padding")).crossJoin(F.broadcast(steps))
