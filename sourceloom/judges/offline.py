"""Deterministic stand-ins for every step that needs judgment.

Each judge is a function on DataFrames, so a service-backed judge can replace it with a
``mapInPandas`` over the same columns.  Verification code never trusts a judge.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.lets import none_if_blank
from sourceloom.functions.words import file_stem

Judge = Callable[[DataFrame], DataFrame]

# Document type hints, in order.
TYPE_HINTS = [
    ("minutes", "meeting-notes"), ("meeting notes", "meeting-notes"), ("report", "report"), ("kpi", "report"),
    ("metrics", "report"), ("deck", "presentation"), ("pitch", "presentation"), ("roadmap", "product-doc"),
    ("rfc", "product-doc"), ("spec", "product-doc"), ("strategy", "memo"), ("memo", "memo"),
    ("nda", "contract"), ("contract", "contract"), ("invoice", "other"),
]


def document_type(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(*[F.when(low.contains(h), F.lit(t)) for h, t in TYPE_HINTS], F.lit("note"))


def stated_date(name: Column, text: Column) -> Column:
    """First ISO date of the file name and text; a missing day is the first of the month."""
    found = F.regexp_extract(F.concat_ws(" ", name, text),
                             r"(?<![\p{L}\p{N}_])20\d\d-(?:0[1-9]|1[0-2])(?:-(?:0[1-9]|[12]\d|3[01]))?(?![\p{L}\p{N}_])", 0)
    return F.when(found == "", None).when(F.length(found) == 7, F.concat(found, F.lit("-01"))).otherwise(found)


def write_pages(docs: DataFrame) -> DataFrame:
    """Page writer over file_id, name, method, text: title, type, date, representation, body.

    The body is the extracted text itself, so an honest page always verifies.
    """
    body = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    title = none_if_blank(file_stem(F.col("name")))
    return docs.withColumns({
        "skipped": body == "", "title": F.coalesce(title, F.lit("Untitled")), "doc_type": document_type(F.col("name")),
        "date": stated_date(F.col("name"), F.col("text")),
        "representation": F.when(F.col("method") == "sheet", "digest").otherwise("full"),
        "quality": F.lit("usable"), "tier": F.lit(1), "body": body})


# The two defects a misbehaving writer is made to commit once.
INVENTED = "Revenue soared to $99.9M with a 77% margin.\n\n"
MISATTRIBUTED = "Headline: ARR reached 512000 in 2026-01.\n\n"


def write_flawed_pages(docs: DataFrame) -> DataFrame:
    """First attempt of a writer that invents or misattributes figures in some documents."""
    low = F.lower("name")
    flaw = (F.when(low.contains("quarterly report") & ~low.contains("final"), F.lit(INVENTED))
            .when(low.contains("kpi"), F.lit(MISATTRIBUTED)).otherwise(F.lit("")))
    return write_pages(docs).withColumn("body", F.concat(flaw, "body"))


def backend(name: str) -> Judge:
    """Resolve a configured writer; an unknown name fails instead of falling through."""
    writers = {"offline": write_pages, "offline-flawed": write_flawed_pages}
    if name not in writers:
        raise ValueError(f"unknown judge backend {name!r}; use one of {sorted(writers)}")
    return writers[name]
