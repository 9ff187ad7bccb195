"""Harvests that go on where they stopped: slices by month, pages by token, and a source's own record of what it has."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusweave.sources.files import month_slices, oai_records, resumption_token, snapshot_state
from corpusweave.sources.rest import SourceUnavailable
from corpusweave.sources.store import Folder


class HarvestError(Exception):
    """A harvest that brought nothing, or a source that answered with an error."""


def snapshot_changed(spark: SparkSession, path: str, folder: Folder, window: tuple[str | None, str | None], categories: list[str] | None) -> bool:
    """Whether a snapshot has other files, sizes or times than when it was last read, or is read by another window or other
    categories. `remember_snapshot` keeps what was read."""
    return folder.read("snapshot.json") != _snapshot(spark, path, window, categories)


def _snapshot(spark: SparkSession, path: str, window: tuple[str | None, str | None], categories: list[str] | None) -> str:
    files = sorted((r.file, r.size, str(r.modified)) for r in snapshot_state(spark, path).collect())
    return json.dumps({"files": files, "window": list(window), "categories": sorted(categories) if categories else None})


def remember_snapshot(spark: SparkSession, path: str, folder: Folder, window: tuple[str | None, str | None], categories: list[str] | None) -> None:
    folder.write("snapshot.json", _snapshot(spark, path, window, categories))


#: Fetches a slice: (query, first day, last day, rows wanted, first row) -> rows as dictionaries.
FetchPage = Callable[[str, str, str, int, int], list[dict]]


def fetch_slice(fetch: FetchPage, query: str, start: str, end: str, quota: int, page: int = 100, empty_tries: int = 3) -> list[dict]:
    """Rows of a slice up to its quota, page by page; an empty page before the end is asked for again a few times."""
    rows: list[dict] = []
    empty = 0
    while len(rows) < quota:
        got = fetch(query, start, end, min(page, quota - len(rows)), len(rows))
        if not got:
            empty += 1
            if empty >= empty_tries:
                break
            continue
        empty = 0
        rows += got
        if len(got) < min(page, quota):
            break
    return rows[:quota]


def harvest_months(
    spark: SparkSession, fetch: FetchPage, folder: Folder, schema: str, start: str, end: str, queries: list[str], cap: int, today: date, settled_days: int = 3,
) -> tuple[DataFrame, list[dict]]:
    """(rows, slices): the rows of every query and month, and what became of each slice: kept, fetched or failed.

    Slices that ended `settled_days` ago are written once and not fetched again; others change still. A slice that fails
    leaves the rest as it is and is fetched the next time; if none brings a row, that is an error. The slices of a plan,
    a row for each query and month, are what the driver goes through."""
    plan = month_slices(spark, start, end, queries, cap).orderBy("query", "month_start").collect()
    paths, fresh, report = [], [], []
    for s in plan:
        name = f"slices/{re.sub(r'[^A-Za-z0-9.]+', '_', s.query)}-{s.month_start}-{s.month_end}-{s.quota}"
        note = {"query": s.query, "month": str(s.month_start)[:7], "rows": None}
        if folder.exists(f"{name}/_SUCCESS"):
            paths.append(f"{folder.root}/{name}")
            report.append({**note, "status": "kept"})
            continue
        try:
            rows = fetch_slice(fetch, s.query, str(s.month_start), str(s.month_end), s.quota)
        except (SourceUnavailable, OSError) as e:
            report.append({**note, "status": "failed", "note": str(e)})
            continue
        df = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in rows], schema)
        if s.month_end + timedelta(days=settled_days) <= today:
            df.coalesce(1).write.mode("overwrite").parquet(f"{folder.root}/{name}")
            paths.append(f"{folder.root}/{name}")
        else:
            fresh.append(df)
        report.append({**note, "status": "fetched", "rows": len(rows)})
    every = ([spark.read.schema(schema).parquet(*paths)] if paths else []) + fresh
    if not every:
        raise HarvestError("no slice brought any rows")
    out = every[0]
    for df in every[1:]:
        out = out.unionByName(df)
    if out.isEmpty():
        raise HarvestError("no slice brought any rows")
    return out, report


def latest_per_query(rows: DataFrame, query: str, date_col: str, key: str, n: int) -> DataFrame:
    """The n newest rows of each query, an id once a query; ties by id."""
    one = rows.groupBy(query, key).agg(F.max_by(F.struct(*rows.columns), date_col).alias("r")).select("r.*")
    w = Window.partitionBy(query).orderBy(F.desc_nulls_last(date_col), key)
    return one.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def backfilled(rows: DataFrame, known: DataFrame, key: str, column: str) -> DataFrame:
    """rows with empty values of a column taken from known rows of the same key."""
    mine = F.when(F.trim(F.coalesce(F.col(column), F.lit(""))) != "", F.col(column))
    other = known.groupBy(key).agg(F.max(column).alias("__known"))
    return rows.join(other, key, "left").withColumn(column, F.coalesce(mine, "__known", F.lit(""))).select(*rows.columns)


def harvest_pages(spark: SparkSession, fetch: Callable[[str | None, str | None], str], folder: Folder, until: str, most_pages: int = 100_000) -> DataFrame:
    """Records of a paged source that hands out resumption tokens, from where the last harvest was complete.

    fetch (token, from day) answers with a page. Each page is kept before the token goes on, so a harvest that stops goes
    on at its token; when the last page is in, the day `until` is what the next harvest begins at. An answer that there
    are no records ends it without rows; any other error is raised. Pages are asked for one after the other, since each
    names the next, and parsed together."""
    state = json.loads(folder.read("state.json") or "{}")
    token, page = state.get("token"), state.get("page", 0)
    for _ in range(most_pages):
        body = fetch(token, state.get("complete"))
        error = re.search(r'<error[^>]*code="(\w+)"[^>]*>([^<]*)', body)
        if error and error[1] != "noRecordsMatch":
            raise HarvestError(f"{error[1]}: {error[2].strip()}")
        if not error:
            folder.write(f"pages/{page:08d}.xml", body)
            page += 1
        token = None if error else resumption_token(body)
        if token is None:
            break
        folder.write("state.json", json.dumps({**state, "token": token, "page": page}))
    else:
        raise HarvestError("the source has more pages than expected")
    folder.write("state.json", json.dumps({"complete": until, "page": page}))
    if not folder.exists("pages"):
        return oai_records(spark.createDataFrame([], "value string"), "value")
    return oai_records(spark.read.option("wholetext", True).text(f"{folder.root}/pages"), "value")
