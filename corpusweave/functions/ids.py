"""Identifiers and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A paper id: month and number, or of the older kind an archive, perhaps with a subject class, and seven digits.
PAPER_ID = r"\d{4}\.\d{4,5}|[a-z][a-z-]*(?:\.[A-Z]{2})?/\d{7}"
BARE_ID = rf"({PAPER_ID})(?:v\d+)?\s*$"


def bare_id(col: Column) -> Column:
    """Paper id without prefix, URL, version and spaces; null where no id is found."""
    got = F.regexp_extract(col, BARE_ID, 1)
    return F.when(got != "", got)


def id_version(col: Column) -> Column:
    """Version named by the id's `vN` suffix; null without one."""
    got = F.regexp_extract(col, rf"(?:{PAPER_ID})v(\d+)\s*$", 1)
    return F.when(got != "", got.cast("int"))


def parse_time(col: Column) -> Column:
    """Timestamp from ISO text with `Z`, an offset, a space or a date only, or from RFC 822 text; else null.

    Text without a zone is UTC, whatever the session's zone. Each form is recognised before it is parsed, so no row
    pays for a failed attempt at another form.
    """
    s = F.trim(col)
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(s, F.lit("T00:00:00Z"))))
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"), F.try_to_timestamp(F.concat(s, F.lit("Z"))))
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}[ T]"), F.try_to_timestamp(s))
        .when(
            s.rlike(r"^[A-Za-z]{3}, \d"),
            F.try_to_timestamp(F.regexp_replace(s, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z")),
        )
    )


def normalize_doi(col: Column) -> Column:
    """Lower-case DOI without resolver, scheme and spaces; null where the text is no DOI."""
    s = F.lower(F.trim(F.regexp_replace(col, r"\s+", " ")))
    got = F.regexp_extract(s, r"(?:^|[/: ])(10\.\d{4,9}/[^\s]+)$", 1)
    return F.when((got != "") & ~got.rlike(r"^10\.0+/"), got)


def preprint_id(doi: Column) -> Column:
    """Paper id that a preprint DOI names; null for other DOIs. `doi` is normal, hence of lower case."""
    got = F.regexp_extract(doi, r"^10\.48550/arxiv\.(\d{4}\.\d{4,5}|[a-z][a-z-]*(?:\.[a-z]{2})?/\d{7})(?:v\d+)?$", 1)
    return F.when(got != "", got)
