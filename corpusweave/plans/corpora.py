"""From sources to a corpus: which source is read, and the way of bulk rows through the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.config import Config
from corpusweave.operators.ingest import clean_records, in_window
from corpusweave.sources.store import PaperStore
from corpusweave.sources.synthetic import synthetic_papers


class IngestError(Exception):
    """No source gave a corpus."""


def build_corpus(spark: SparkSession, cfg: Config, sources: dict[str, Callable[[], DataFrame]], synthetic_rows: int = 1_200) -> tuple[DataFrame, dict]:
    """(raw rows, provenance) of the configured source.

    An empty or failing source is an error, unless the configuration is for development and allows the synthetic corpus
    in its place; the provenance then names what it stands for."""
    name = cfg.data.source
    if name != "synthetic":
        if name not in sources:
            raise IngestError(f"no source named {name}; there are {', '.join(sorted(sources)) or 'none'}")
        try:
            rows = sources[name]()
            if not rows.isEmpty():
                return rows, {"source": name, "fallback_from": None, "note": ""}
            note = "the source is empty"
        except Exception as e:  # what the source raises is told in the error or the provenance
            note = f"{type(e).__name__}: {e}"
        if not (cfg.data.allow_synthetic and cfg.environment == "development"):
            raise IngestError(f"{name}: {note}")
        return _synthetic(spark, cfg, synthetic_rows), {"source": "synthetic", "fallback_from": name, "note": note}
    return _synthetic(spark, cfg, synthetic_rows), {"source": "synthetic", "fallback_from": None, "note": ""}


def _synthetic(spark: SparkSession, cfg: Config, n: int) -> DataFrame:
    rows = synthetic_papers(spark, n, cfg.data.date_start, "2025-12-31" if cfg.data.date_end == "auto" else cfg.data.date_end, seed=cfg.seed)
    return rows.withColumns({c: F.lit(None).cast("string") for c in ("doi", "journal_ref", "license")})


def through_store(raw: DataFrame, store: PaperStore, prefix: str = "cs.", start: str | None = None, end: str | None = None, min_chars: int = 50, english: bool = True) -> DataFrame:
    """The cleaned corpus of the window after bulk rows have gone into the store.

    New rows are cleaned, kept by the store beside what earlier harvests brought, and the window read back is cleaned once
    more: papers of one title that came with different harvests become one then."""
    fresh = clean_records(raw, prefix, None, None, min_chars, english)
    store.upsert(fresh.withColumn("row_id", F.xxhash64("arxiv_id", "version")))
    kept = store.read(start, end).withColumn("first_submitted", F.date_format("date", "yyyy-MM-dd HH:mm:ss")).withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss"))
    again = clean_records(kept, prefix, start, end, min_chars, english)
    return again.where(in_window(F.col("date"), start, end))
