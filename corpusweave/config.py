"""Configuration: YAML with inheritance, environment overrides, validation."""

from __future__ import annotations

import hashlib
import json
import logging
import os
from datetime import date
from pathlib import Path

import yaml
from pydantic import BaseModel, ConfigDict, Field


class ConfigError(ValueError):
    pass


class _Section(BaseModel):
    model_config = ConfigDict(extra="forbid")


class Data(_Section):
    source: str = "synthetic"
    category_prefix: str = "cs."
    categories: list[str] | None = None
    date_start: str = "2022-01-01"
    date_end: str = "auto"
    profile: str = Field("dev", pattern="^(dev|standard|full|custom)$")
    max_papers: int | None = Field(None, gt=0)
    sampling: str = Field("stratified", pattern="^(stratified|newest|none)$")
    min_abstract_chars: int = Field(50, ge=0)
    english_only: bool = True
    allow_synthetic: bool = False


class Embedding(_Section):
    backend: str = Field("auto", pattern="^(auto|svd|transformer)$")
    dim: int = Field(64, gt=1)
    batch_size: int = Field(10_000, gt=0)


class Index(_Section):
    backend: str = Field("auto", pattern="^(auto|exact|cells)$")
    exact_rows: int = Field(300_000, gt=0)
    probes: int | None = Field(None, gt=0)


class Reduce(_Section):
    backend: str = Field("auto", pattern="^(auto|pca)$")
    cluster_dims: int = Field(8, gt=1)


class Store(_Section):
    root: str = "data/store"
    month_column: str = "year_month"


class Enrichment(_Section):
    enabled: bool = True
    batch_size: int = Field(50, gt=0)
    title_lookups: int = Field(200, ge=0)
    retry_days: int = Field(14, ge=0)
    horizon_days: int = Field(90, gt=0)


class Graph(_Section):
    neighbours: int = Field(6, gt=0)
    coupling_boost: float = Field(0.15, ge=0)
    most_boost: float = Field(0.5, ge=0)


class Labels(_Section):
    keywords: int = Field(8, gt=0)
    vocabulary: int = Field(10_000, gt=0)
    overrides: dict[str, str] = {}


class Leads(_Section):
    percentile: float = Field(20, gt=0, lt=100)
    neighbours: int = Field(10, gt=0)
    robustness: float = Field(0.6, ge=0, le=1)
    most: int = Field(12, ge=0)


class Live(_Section):
    enabled: bool = False
    sources: list[str] = []
    timeout_seconds: float = Field(8.0, gt=0)
    page_size: int = Field(25, gt=0)
    cache_seconds: float = Field(86_400, ge=0)
    rel_floor: float = Field(0.5, ge=0, le=1)
    most_results: int = Field(50, gt=0)


class Releases(_Section):
    root: str = "data/releases"
    keep: int = Field(5, gt=0)


class Logging(_Section):
    level: str = Field("INFO", pattern="^(DEBUG|INFO|WARNING|ERROR)$")
    json_lines: bool = True


class Search(_Section):
    hybrid: bool = True
    candidate_k: int = Field(100, gt=0)
    rrf_k: int = Field(60, gt=0)
    top_k_exact: int = Field(100, gt=0)
    top_k_related: int = Field(50, ge=0)
    proximity_window: int = Field(8, gt=0)
    max_query_chars: int = Field(300, gt=0)
    synonyms: dict[str, list[str]] = {}


class Growth(_Section):
    windows_months: list[int] = [3, 6, 12]
    default_window: int = 6
    min_papers_per_period: int = Field(10, ge=0)
    ci_level: float = Field(0.9, gt=0, lt=1)
    max_cv: float = Field(0.5, gt=0)
    bootstrap_samples: int = Field(500, ge=0)
    require_stable: bool = True


class Clusters(_Section):
    backend: str = Field("kmeans", pattern="^(kmeans|dbscan)$")
    min_samples: int = Field(5, gt=0)
    k_range: list[int] = [4, 16]
    min_size_fraction: float = Field(0.01, gt=0, lt=1)


class Validation(_Section):
    gates: dict[str, float] = {}
    required_gates: list[str] = []
    enforce_gates: bool = False


class Config(_Section):
    environment: str = Field("development", pattern="^(development|production)$")
    seed: int = 42
    data: Data = Data()
    embedding: Embedding = Embedding()
    index: Index = Index()
    reduce: Reduce = Reduce()
    store: Store = Store()
    enrichment: Enrichment = Enrichment()
    graph: Graph = Graph()
    labels: Labels = Labels()
    leads: Leads = Leads()
    live: Live = Live()
    releases: Releases = Releases()
    logging: Logging = Logging()
    search: Search = Search()
    growth: Growth = Growth()
    clusters: Clusters = Clusters()
    validation: Validation = Validation()

    def cap(self) -> int | None:
        """Corpus size of the profile."""
        return {"dev": 5_000, "standard": 50_000, "full": None, "custom": self.data.max_papers}[self.data.profile]

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(self.model_dump(), sort_keys=True).encode()).hexdigest()[:16]


def _merged(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = _merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _read(path: Path, seen: tuple[Path, ...] = ()) -> dict:
    path = path.resolve()
    if path in seen:
        raise ConfigError(f"configuration extends itself: {path}")
    raw = yaml.safe_load(path.read_text()) or {}
    parent = raw.pop("extends", None)
    return _merged(_read(path.parent / parent, (*seen, path)), raw) if parent else raw


def load_config(path: str, env: dict[str, str] | None = None, prefix: str = "WEAVE_") -> Config:
    """Validated configuration. `WEAVE_DATA__SOURCE=x` overrides data.source; unknown keys fail; production forbids
    synthetic data; `date_end: auto` is today."""
    raw = _read(Path(path))
    for key, value in (os.environ if env is None else env).items():
        if key.startswith(prefix):
            node = raw
            *parents, last = key[len(prefix):].lower().split("__")
            for p in parents:
                node = node.setdefault(p, {})
            node[last] = yaml.safe_load(value)
    try:
        cfg = Config(**raw)
    except ValueError as e:
        raise ConfigError(str(e)) from e
    if cfg.environment == "production" and cfg.data.source == "synthetic":
        raise ConfigError("production does not run on synthetic data")
    if cfg.data.date_end == "auto":
        cfg.data.date_end = date.today().isoformat()
    return cfg


def resolve_backends(cfg: Config, rows: int) -> dict[str, str]:
    """Which way each part is done: what is asked for, or for `auto` what the size calls for. What Spark does itself is
    always there; a transformer needs its library and is refused without it."""
    from importlib.util import find_spec

    if cfg.embedding.backend == "transformer" and find_spec("sentence_transformers") is None:
        raise ConfigError("the transformer backend needs the library sentence_transformers")
    index = cfg.index.backend
    if index == "auto":
        index = "exact" if rows <= cfg.index.exact_rows else "cells"
    return {
        "embedding": "svd" if cfg.embedding.backend == "auto" else cfg.embedding.backend, "index": index,
        "reduce": "pca" if cfg.reduce.backend == "auto" else cfg.reduce.backend, "clusters": cfg.clusters.backend, "store": "parquet",
    }


class JsonLines(logging.Formatter):
    """A log record as one line of JSON, with what `extra` gave it and the error's text."""

    KNOWN = frozenset(logging.LogRecord("", 0, "", 0, "", (), None).__dict__) | {"message", "asctime"}

    def format(self, record: logging.LogRecord) -> str:
        line = {"at": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        line |= {k: v for k, v in record.__dict__.items() if k not in self.KNOWN}
        if record.exc_info:
            line["error"] = self.formatException(record.exc_info)
        return json.dumps(line, default=str)


def configure_logging(cfg: Logging, name: str = "corpusweave") -> logging.Logger:
    """The package's logger, writing to standard error in the configured form."""
    log, handler = logging.getLogger(name), logging.StreamHandler()
    if cfg.json_lines:
        handler.setFormatter(JsonLines())
    log.handlers[:] = [handler]
    log.setLevel(cfg.level)
    return log
