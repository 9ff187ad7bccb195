"""Structured Streaming jobs: upserts, live records, windows, sessions and de-duplication."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusweave.sources.store import PaperStore


def event_time(df: DataFrame, col: str) -> DataFrame:
    """df with a column that a watermark accepts: naive times are read as UTC."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def tumbling_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, key, n, total) per window; late rows beyond the watermark are dropped by the engine."""
    w = event_time(events, time).withWatermark(time, late)
    got = w.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("window_start"), key, "n", "total")


def session_counts(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = event_time(events, time).withWatermark(time, late)
    got = w.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return event_time(events, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Process all input there is, into an in-memory table for inspection; not for large results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def upsert_stream(rows: DataFrame, store: PaperStore, checkpoint: str, clean=None) -> None:
    """Upsert each micro-batch into the store. A batch run again gives the same rows, since the latest version wins."""
    def one(batch: DataFrame, _: int) -> None:
        got = clean(batch) if clean else batch
        if not got.isEmpty():
            store.upsert(got)

    rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class LiveRecord(StatefulProcessor):
    """Keyed state of one paper: first non-empty fields, longest abstract, most citations, all its sources.

    With `ttl_ms` the state of a paper not seen for so long is dropped."""

    FIELDS = ("title", "abstract", "authors", "doi", "sources")

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = "title string, abstract string, authors string, doi string, sources string, cited int, seen int"
        self.state = handle.getValueState("paper", schema, self.ttl_ms) if self.ttl_ms else handle.getValueState("paper", schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        now = list(self.state.get()) if self.state.exists() else ["", "", "", "", "", 0, 0]
        for pdf in rows:
            for r in pdf.itertuples():
                for i, f in enumerate(("title", "abstract", "authors", "doi")):
                    v = getattr(r, f)
                    v = v if isinstance(v, str) else ""
                    if (f == "abstract" and len(v) > len(now[i])) or (not now[i] and v):
                        now[i] = v
                names = {s.strip().lower() for s in f"{now[4]};{r.sources if isinstance(r.sources, str) else ''}".split(";")} - {""}
                now[4] = ";".join(sorted(names))
                now[5] = max(now[5], int(r.cited_by_count) if pd.notna(r.cited_by_count) else 0)
                now[6] += 1
        self.state.update(tuple(now))
        yield pd.DataFrame([[key[0], *now]], columns=["paper_id", *self.FIELDS, "cited_by_count", "seen"])

    def close(self) -> None:
        pass


def live_records(rows: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Merged records as they stand after each micro-batch; needs the RocksDB state store."""
    schema = "paper_id string, title string, abstract string, authors string, doi string, sources string, cited_by_count int, seen int"
    return rows.groupBy("paper_id").transformWithStateInPandas(LiveRecord(ttl_ms), outputStructType=schema, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")


def embed_backlog(rows: DataFrame, known: DataFrame, key: str, priority: str, most: int) -> DataFrame:
    """The next rows to embed: those without a vector, by priority and then key, at most `most`."""
    return rows.join(known.select(key), key, "left_anti").orderBy(F.desc(priority), key).limit(most)
