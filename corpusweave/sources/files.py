"""File sources: JSON lines, Atom and OAI-PMH XML, and source pages of REST searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.functions.ids import BARE_ID, PAPER_ID, bare_id, normalize_doi, preprint_id
from corpusweave.functions.text import collapse, has_category

SNAPSHOT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("abstract", T.StringType()),
    T.StructField("categories", T.StringType()), T.StructField("doi", T.StringType()), T.StructField("journal-ref", T.StringType()),
    T.StructField("license", T.StringType()), T.StructField("update_date", T.StringType()),
    T.StructField("authors_parsed", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("versions", T.ArrayType(T.StructType([T.StructField("created", T.StringType())]))),
])


def mail_time(col: Column) -> Column:
    """Timestamp of RFC 822 text; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(col), r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss z"))


def read_snapshot(spark: SparkSession, path: str, prefix: str = "cs.", start: str | None = None, end: str | None = None) -> DataFrame:
    """Raw rows of a JSON-lines snapshot; only the listed columns are parsed, broken lines are skipped.

    The first version's time decides the window, the last one's is the update, their number the version."""
    raw = spark.read.schema(SNAPSHOT).option("mode", "DROPMALFORMED").json(path).where(has_category(F.col("categories"), prefix))
    first = F.coalesce(mail_time(F.try_element_at("versions", F.lit(1))["created"]), F.try_to_timestamp("update_date"))
    last = F.coalesce(mail_time(F.try_element_at("versions", F.lit(-1))["created"]), F.try_to_timestamp("update_date"))
    names = F.array_join(F.transform("authors_parsed", lambda a: F.trim(F.concat_ws(" ", F.get(a, F.lit(1)), F.get(a, F.lit(0))))), "; ")
    n = F.greatest(F.lit(1), F.size("versions"))
    rows = raw.withColumns({"__f": first, "__l": last})
    if start:
        rows = rows.where(F.col("__f") >= F.lit(start).cast("timestamp"))
    if end:
        rows = rows.where(F.col("__f") < F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    text = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    return rows.select(
        F.concat("id", F.lit("v"), n.cast("string")).alias("arxiv_id"), n.alias("version"), "title", "abstract", names.alias("authors"), "categories",
        F.split("categories", " ")[0].alias("primary_category"), text(F.col("__f")).alias("first_submitted"), text(F.col("__l")).alias("last_updated"),
        F.coalesce("doi", F.lit("")).alias("doi"), F.coalesce("journal-ref", F.lit("")).alias("journal_ref"), F.coalesce("license", F.lit("")).alias("license"),
    )


def snapshot_state(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, modified) of a source's files, to tell whether it changed since it was last read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


_ATOM = "STRUCT<id: STRING, title: STRING, summary: STRING, published: STRING, updated: STRING, author: ARRAY<STRUCT<name: STRING>>, category: ARRAY<STRUCT<_term: STRING>>, primary_category: STRUCT<_term: STRING>, doi: STRING, journal_ref: STRING>"


def atom_entries(df: DataFrame, xml: str) -> DataFrame:
    """Raw rows of Atom pages in a column: entries are cut out, name-space prefixes dropped, and parsed by Spark's XML."""
    entry = F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<entry\b.*?</entry>"), 0))
    plain = F.regexp_replace(F.col("e"), r"(</?)[A-Za-z]\w*:", "$1")
    parsed = df.select(entry.alias("e")).select(F.from_xml(plain, _ATOM, {"rowTag": "entry"}).alias("x")).select("x.*")
    return parsed.where("id is not null").select(
        F.regexp_extract("id", rf"((?:{PAPER_ID})(?:v\d+)?)\s*$", 1).alias("arxiv_id"), collapse(F.col("title")).alias("title"), collapse(F.col("summary")).alias("abstract"),
        F.array_join(F.transform("author", lambda a: a["name"]), "; ").alias("authors"), F.array_join(F.transform("category", lambda c: c["_term"]), " ").alias("categories"),
        F.coalesce(F.col("primary_category._term"), F.get("category", F.lit(0))["_term"]).alias("primary_category"),
        F.col("published").alias("first_submitted"), F.col("updated").alias("last_updated"), F.coalesce("doi", F.lit("")).alias("doi"), F.coalesce("journal_ref", F.lit("")).alias("journal_ref"),
    )


_OAI = "STRUCT<id: STRING, created: STRING, updated: STRING, title: STRING, abstract: STRING, categories: STRING, doi: STRING, `journal-ref`: STRING, license: STRING, authors: STRUCT<author: ARRAY<STRUCT<keyname: STRING, forenames: STRING>>>>"


def oai_records(df: DataFrame, xml: str) -> DataFrame:
    """Raw rows of OAI-PMH pages in a column; deleted records are skipped."""
    record = F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<record\b.*?</record>"), 0))
    live = df.select(record.alias("r")).where(~F.col("r").rlike(r'<header[^>]*status="deleted"'))
    body = F.regexp_replace(F.regexp_extract("r", r"(?s)<metadata>\s*(.*?)\s*</metadata>", 1), r"(</?)[A-Za-z]\w*:", "$1")
    x = live.select(F.from_xml(body, _OAI, {"rowTag": "arXiv"}).alias("x")).select("x.*").where("id is not null")
    names = F.transform("authors.author", lambda a: F.trim(F.concat_ws(" ", a["forenames"], a["keyname"])))
    return x.select(
        F.col("id").alias("arxiv_id"), collapse(F.col("title")).alias("title"), collapse(F.col("abstract")).alias("abstract"), F.array_join(names, "; ").alias("authors"),
        "categories", F.split("categories", " ")[0].alias("primary_category"), F.col("created").alias("first_submitted"), F.coalesce("updated", "created").alias("last_updated"),
        F.coalesce("doi", F.lit("")).alias("doi"), F.coalesce("journal-ref", F.lit("")).alias("journal_ref"), F.coalesce("license", F.lit("")).alias("license"),
    )


def resumption_token(xml: str) -> str | None:
    """Token of the next page of an OAI-PMH answer; none on the last page."""
    import re

    m = re.search(r"<resumptionToken[^>]*>([^<]+)</resumptionToken>", xml)
    return m[1].strip() if m else None


#: Common shape of what a source's search returns.
RECORD = "source string, source_id string, title string, abstract string, authors string, date string, year int, doi string, arxiv_id string, venue string, primary_category string, cited_by_count int, url string"


def make_records(df: DataFrame) -> DataFrame:
    """Records of the common shape: texts trimmed, DOI normal, paper id taken from a preprint DOI, year from the date."""
    text = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^[\s\u00a0]+|[\s\u00a0]+$", "")
    doi = F.coalesce(normalize_doi(F.col("doi")), F.lit(""))
    year = F.coalesce(F.col("year"), F.when(text("date").rlike(r"^\d{4}"), F.substring(text("date"), 1, 4).cast("int")))
    paper = F.coalesce(bare_id(F.col("arxiv_id")), preprint_id(doi), F.lit(""))
    return df.select(
        "source", "source_id", *(text(c).alias(c) for c in ("title", "abstract", "authors", "date")), year.alias("year"), doi.alias("doi"), paper.alias("arxiv_id"),
        text("venue").alias("venue"), text("primary_category").alias("primary_category"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"), text("url").alias("url"),
    )


_WORK = "id STRING, doi STRING, display_name STRING, publication_date STRING, publication_year INT, cited_by_count INT, abstract_inverted_index MAP<STRING, ARRAY<INT>>, referenced_works ARRAY<STRING>, locations ARRAY<STRUCT<landing_page_url: STRING>>, primary_location STRUCT<source: STRUCT<display_name: STRING>>, authorships ARRAY<STRUCT<author: STRUCT<id: STRING, display_name: STRING>>>"


def parse_works(df: DataFrame, payload: str) -> DataFrame:
    """Works of JSON payloads: text from the inverted index, references, and every paper id among the locations."""
    from corpusweave.operators.enrich import inverted_text

    w = df.select(F.from_json(F.col(payload), _WORK).alias("w")).select("w.*").where("id is not null")
    pages = F.transform(F.coalesce("locations", F.array()), lambda x: F.regexp_extract(F.coalesce(x["landing_page_url"], F.lit("")), rf"/(?:abs|pdf)/{BARE_ID}", 1))
    venue = F.coalesce(F.col("primary_location.source.display_name"), F.lit(""))
    return w.select(
        "id", "doi", F.col("display_name").alias("title"), inverted_text(F.col("abstract_inverted_index")).alias("abstract"),
        F.array_join(F.transform("authorships", lambda a: a["author"]["display_name"]), "; ").alias("authors"), F.col("publication_date").alias("date"),
        F.col("publication_year").alias("year"), "cited_by_count", F.coalesce("referenced_works", F.array()).alias("references"),
        F.array_distinct(F.filter(pages, lambda x: x != "")).alias("paper_ids"), F.when(venue.rlike("(?i)^arxiv"), "").otherwise(venue).alias("venue"),
    )


def works_by_paper(works: DataFrame) -> DataFrame:
    """(paper_id, ...): the richest work of each paper id."""
    from corpusweave.operators.enrich import richest_work

    each = works.withColumn("paper_id", F.explode("paper_ids")).drop("paper_ids")
    return richest_work(each, "paper_id", "references", "cited_by_count", "id")


def month_slices(spark: SparkSession, start: str, end: str, queries: list[str], cap: int) -> DataFrame:
    """(query, month_start, month_end, quota): harvest plan, a slice per query and month, each a fair part of the cap."""
    months = spark.range(1).select(F.explode(F.expr(f"sequence(trunc(date'{start}', 'MM'), date'{end}', interval 1 month)")).alias("m"))
    plan = months.select(F.greatest("m", F.lit(start).cast("date")).alias("month_start"), F.least(F.last_day("m"), F.lit(end).cast("date")).alias("month_end"))
    n = plan.count() * max(1, len(queries))
    return plan.crossJoin(spark.createDataFrame([(q,) for q in queries], "query string")).select("query", "month_start", "month_end", F.lit(-(-cap * 5 // (4 * n))).alias("quota"))


def bibtex(df: DataFrame) -> DataFrame:
    """(entry): a BibTeX entry per row of (paper_id, title, authors, year, url)."""
    esc = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[{}]", "")
    key = F.regexp_replace("paper_id", r"[^A-Za-z0-9]+", "_")
    authors = F.array_join(F.filter(F.transform(F.split(esc("authors"), ";"), lambda x: F.trim(x)), lambda x: x != ""), " and ")
    fields = [("title", esc("title")), ("author", authors), ("year", esc("year")), ("url", esc("url"))]
    body = F.concat_ws(",\n", *(F.when(v != "", F.concat(F.lit(f"  {n} = {{"), v, F.lit("}"))) for n, v in fields))
    return df.select(F.concat(F.lit("@article{"), key, F.lit(",\n"), body, F.lit("\n}")).alias("entry"))
