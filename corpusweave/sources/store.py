"""Partitioned paper store with upserts, citation history, and versioned releases."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.operators.ingest import in_window, latest


class PaperStore:
    """Parquet folders `year_month=YYYY-MM`, one row per id in a month; an upsert rewrites the months it touches only."""

    ORDER = ("version", "last_updated")

    def __init__(self, spark: SparkSession, root: str, key: str = "arxiv_id", month: str = "year_month"):
        self.spark, self.root, self.key, self.month = spark, root.rstrip("/"), key, month

    def _exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(path) and any(s.isDirectory() for s in fs.listStatus(path))

    def read(self, start: str | None = None, end: str | None = None, columns: list[str] | None = None, date: str = "date") -> DataFrame:
        """Rows of the window; months outside it are pruned by their folder, then the days by the pushed filter."""
        df = self.spark.read.parquet(self.root)
        if start:
            df = df.where(F.col(self.month) >= start[:7])
        if end:
            df = df.where(F.col(self.month) <= end[:7])
        if start or end:
            df = df.where(in_window(F.col(date), start, end))
        return df.select(*columns) if columns else df

    def upsert(self, new: DataFrame) -> None:
        """Insert new ids and replace older rows of known ids; nulls in the order columns count as oldest.

        The touched months are written aside first and then swapped in by a dynamic partition overwrite, since a plan
        cannot overwrite what it reads.
        """
        new = new.persist()
        order = [F.desc_nulls_last(c) for c in self.ORDER if c in new.columns] + [F.desc("__new")]
        rows = new.withColumn("__new", F.lit(1))
        if self._exists():
            months = [r[0] for r in new.select(self.month).distinct().collect()]
            old = self.spark.read.parquet(self.root).where(F.col(self.month).isin(months)).withColumn("__new", F.lit(0))
            rows = rows.unionByName(old, allowMissingColumns=True)
        merged = latest(rows, [self.key, self.month], order).drop("__new")
        aside = f"{self.root}-{uuid.uuid4().hex[:8]}"
        merged.write.partitionBy(self.month).parquet(aside)
        back = self.spark.read.parquet(aside).withColumn(self.month, F.col(self.month).cast("string"))
        back.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.month).parquet(self.root)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(aside)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        new.unpersist()

    def count(self) -> int:
        return self.spark.read.parquet(self.root).count()

    def latest_date(self, date: str = "date"):
        return self.spark.read.parquet(self.root).agg(F.max(date)).first()[0]

    def query(self, sql: str, **args) -> DataFrame:
        """A parameterised query over the store as table `papers`."""
        self.spark.read.parquet(self.root).createOrReplaceTempView("papers")
        return self.spark.sql(sql, args=args)


def dedup_history(history: DataFrame, key: str, date: str, batch: str) -> DataFrame:
    """One row per key and date, the last delivered."""
    return latest(history, [key, date], [F.desc(batch)])


def release_diff(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """(key, change): ids added to or removed from a release."""
    a = new.select(key).distinct().join(old.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    return a.unionByName(old.select(key).distinct().join(new.select(key), key, "left_anti").withColumn("change", F.lit("removed")))


class Folder:
    """A folder of the file system that its path names, local or shared by a cluster."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def folders(self) -> list[str]:
        if not self.exists(""):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")) if s.isDirectory())

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replace a file as a whole: the text goes to another name, which then takes its place."""
        aside = f"{name}.{uuid.uuid4().hex[:8]}.tmp"
        stream = self._fs.create(self._path(aside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.delete(self._path(name), False)
        self._fs.rename(self._path(aside), self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


class Releases:
    """Immutable release folders with a pointer to the current one, a list of pinned ones and a log of changes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)

    def list(self) -> list[str]:
        return [n for n in self.folder.folders() if self.folder.exists(f"{n}/manifest.json")]

    def manifest(self, name: str) -> dict:
        return json.loads(self.folder.read(f"{name}/manifest.json"))

    def tables(self, name: str) -> list[str]:
        return self.manifest(name)["tables"]

    def current(self) -> str | None:
        name = (self.folder.read("CURRENT") or "").strip()
        return name if name in self.list() else None

    def publish(self, tables: dict[str, DataFrame], meta: dict, gates: dict | None = None, force: bool = False) -> str:
        """Write a release and point to it; a release whose required gates failed is refused unless forced."""
        if gates and not gates.get("passed") and not force:
            raise ValueError(f"required gates failed: {gates.get('failed_required')}")
        day = time.strftime("%Y.%m.%d.")
        last = max((int(n[len(day) :]) for n in self.folder.folders() if n.startswith(day) and n[len(day) :].isdigit()), default=0)
        name = f"{day}{last + 1}"
        for table, df in tables.items():
            df.write.parquet(f"{self.folder.root}/{name}/{table}")
        self.folder.write(f"{name}/manifest.json", json.dumps({"id": name, "tables": sorted(tables), "gates": gates, **meta}, default=str))
        self._log(name, "published", {t: df.count() for t, df in ((t, self.read(self.spark, t, name)) for t in tables)})
        self.set_current(name)
        return name

    def _log(self, name: str, what: str, more: dict | None = None) -> None:
        line = json.dumps({"release": name, "change": what, "at": time.strftime("%Y-%m-%dT%H:%M:%S"), **({"rows": more} if more else {})})
        self.folder.write("changes.jsonl", (self.folder.read("changes.jsonl") or "") + line + "\n")

    def changes(self) -> list[dict]:
        return [json.loads(x) for x in (self.folder.read("changes.jsonl") or "").splitlines()]

    def set_current(self, name: str) -> None:
        if name not in self.list():
            raise ValueError(f"no release {name}")
        self.folder.write("CURRENT", name)
        self._log(name, "current")

    def pinned(self) -> set[str]:
        return set(json.loads(self.folder.read("PINNED") or "[]"))

    def pin(self, name: str, keep: bool = True) -> None:
        if name not in self.list():
            raise ValueError(f"no release {name}")
        self.folder.write("PINNED", json.dumps(sorted(self.pinned() | {name} if keep else self.pinned() - {name})))

    def prune(self, keep: int, pinned: set[str] = frozenset()) -> list[str]:
        """Remove the oldest releases beyond `keep`; the current one and pinned ones stay."""
        names = sorted(self.list(), key=lambda n: [int(x) if x.isdigit() else 0 for x in n.split(".")])
        gone = [r for r in names[: max(0, len(names) - keep)] if r != self.current() and r not in pinned | self.pinned()]
        for r in gone:
            self.folder.delete(r)
            self._log(r, "removed")
        return gone

    def read(self, spark: SparkSession, table: str, name: str | None = None) -> DataFrame:
        return spark.read.parquet(f"{self.folder.root}/{name or self.current()}/{table}")


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """df with exactly the columns of schema: missing ones by default or null, others cast, further ones dropped."""
    def column(f: T.StructField):
        default = (defaults or {}).get(f.name)
        if f.name not in df.columns:
            return F.lit(default).cast(f.dataType).alias(f.name)
        got = F.col(f.name).try_cast(f.dataType) if not isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) else F.col(f.name).cast(f.dataType)
        return (F.coalesce(got, F.lit(default).cast(f.dataType)) if default is not None else got).alias(f.name)

    return df.select(*(column(f) for f in schema.fields))


def save_bundle(spark: SparkSession, root: str, tables: dict[str, DataFrame], meta: dict, csv_rows: int = 20_000) -> None:
    """Tables as Parquet and a manifest; a table of plain columns and at most `csv_rows` rows as CSV beside it."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        flat = not any(isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) for f in df.schema.fields)
        if flat and spark.read.parquet(f"{root}/{name}").limit(csv_rows + 1).count() <= csv_rows:
            df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/{name}.csv")
    Folder(spark, root).write("meta.json", json.dumps({"tables": sorted(tables), **meta}, default=str))


def load_bundle(spark: SparkSession, root: str, schemas: dict[str, T.StructType], defaults: dict[str, dict] | None = None) -> tuple[dict[str, DataFrame], dict]:
    """(tables, meta) of a saved bundle in the shape of today's schemas, from CSV where there is no Parquet; tables that
    an older bundle lacks are empty."""
    folder, out = Folder(spark, root), {}
    for name, schema in schemas.items():
        if folder.exists(name):
            df = spark.read.option("mergeSchema", True).parquet(f"{root}/{name}")
        elif folder.exists(f"{name}.csv"):
            df = spark.read.option("header", True).csv(f"{root}/{name}.csv")
        else:
            df = spark.createDataFrame([], schema)
        out[name] = conform(df, schema, (defaults or {}).get(name))
    return out, json.loads(folder.read("meta.json") or "{}")
