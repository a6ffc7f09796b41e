"""Markdown pages: rendering, the index row of a page, derived metadata."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.access import declared_acl
from sourceloom.functions.frontmatter import find, item_fields, items, raw_items, scalar_text, split
from sourceloom.functions.lets import none_if_blank
from sourceloom.functions.render import field, inline_list, scalar
from sourceloom.functions.words import SYSTEM_FOOTERS

# Source format names.
SOURCE_FORMATS = {"pdf": "pdf", "sheet": "spreadsheet", "docx": "document", "office": "office", "text": "text"}


def render_pages(pages: DataFrame) -> DataFrame:
    """Adds ``markdown``.

    Columns used: doc_type, title, date, as_of, tags, file_id, source_uri, name, extracted_at,
    representation, quality, method, tier, acl, verdict, numbers_unverified, numbers_unanchored,
    entity (struct), unit, path_period, mentions (array of name/type), body.
    """
    def text(c: str) -> Column:
        return scalar(F.col(c).cast("string"))

    def listed(name: str, values: Column) -> Column:
        return F.when(F.size(values) > 0, field(name, inline_list(values)))

    formats = F.create_map(*[F.lit(x) for kv in SOURCE_FORMATS.items() for x in kv])
    mentions = F.when(F.size("mentions") > 0, F.concat(F.lit("mentions:\n"), F.array_join(F.transform(
        "mentions", lambda m: F.concat(F.lit("  - { name: "), scalar(m["name"]), F.lit(", type: "), m["type"], F.lit(" }"))), "\n")))
    owned = F.coalesce(F.col("entity.slug"), F.lit("")) != ""
    front = F.concat_ws(
        "\n", F.lit("---"), field("type", text("doc_type")), field("title", text("title")), field("date", text("date")),
        field("as_of", text("as_of")), field("tags", inline_list(F.col("tags"))),
        F.concat(F.lit('id: "drive:'), "file_id", F.lit('"')), field("source_file_id", F.col("file_id")),
        field("source_uri", text("source_uri")),
        field("source_kind", F.when(F.col("source_uri").startswith("local://"), "local").otherwise("google-drive")),
        field("source_name", text("name")), F.concat(F.lit('extracted_at: "'), "extracted_at", F.lit('"')),
        field("representation", F.col("representation")), field("extraction_quality", F.col("quality")),
        field("source_format", F.coalesce(F.try_element_at(formats, F.col("method")), F.lit("other"))),
        F.lit("contextual_retrieval: title"), field("tier", F.col("tier").cast("string")),
        field("acl", inline_list(F.col("acl"))), field("verification", F.col("verdict")),
        listed("unverified_numbers", F.col("numbers_unverified")), listed("unanchored_numbers", F.col("numbers_unanchored")),
        F.when(F.col("method") == "sheet", F.lit("detail_in_source: true")),
        F.when(owned, field("entity", F.col("entity.slug"))), F.when(owned, field("entity_kind", F.col("entity.kind"))),
        F.when(owned, field("seq", F.col("entity.seq").cast("string"))), F.when(owned, field("status", F.col("entity.status"))),
        F.when(owned, field("stage", scalar(F.col("entity.stage")))), field("unit", scalar(none_if_blank(F.col("unit")))),
        field("period", F.col("path_period")), mentions, F.lit("---"))
    review = F.when(F.col("quality") == "manual_review", F.lit(
        "> [!WARNING]\n> Incomplete extraction — needs human review "
        "(visual/broken content not captured by deterministic conversion).\n\n")).otherwise("")
    missing, drifting = F.size("numbers_unverified"), F.size("numbers_unanchored")
    detail = F.concat_ws(
        " and ", F.when(missing > 0, F.concat(missing.cast("string"), F.lit(" figure(s) could not be traced back to the source text"))),
        F.when(drifting > 0, F.concat(drifting.cast("string"), F.lit(" figure(s) are tied to a period the source contradicts"))))
    failed = F.when(F.col("verdict") == "failed", F.concat(
        F.lit("> [!WARNING]\n> Verification failed: "), detail,
        F.lit(" — treat numbers with caution and open the original.\n\n"))).otherwise("")
    # the page owns its title; separators inside the body must not read as frontmatter
    own = F.replace(F.regexp_replace("body", r"\A#\s+[^\n]*\n+", ""), F.lit("\n---\n"), F.lit("\n***\n"))
    footer = F.when(F.col("representation").isin("digest", "minimal") & ~own.contains(F.col("source_uri")), F.when(
        F.col("method") == "sheet", F.concat(F.lit(f"\n\n{SYSTEM_FOOTERS[0]} — for exact/current figures, open the original: "), "source_uri"))
        .otherwise(F.concat(F.lit(f"\n\n{SYSTEM_FOOTERS[1]} "), "source_uri"))).otherwise("")
    return pages.withColumn("markdown", F.concat(front, F.lit("\n\n"), review, failed, F.lit("# "), "title", F.lit("\n\n"), own, footer, F.lit("\n")))


def annotate_field(markdown: Column, name: str, value: Column) -> Column:
    """Set one frontmatter field of a rendered page (replaced when present, removed when the value is null)."""
    bare = F.regexp_replace(markdown, rf"(?m)(?<=\n){name}: [^\n]*\n", "")
    return F.when(value.isNull(), bare).otherwise(F.concat(
        F.lit("---\n"), F.regexp_extract(bare, r"(?s)\A---\n(.*?\n)---\n", 1), F.lit(f"{name}: "), value, F.lit("\n---\n"),
        F.regexp_replace(bare, r"(?s)\A---\n.*?\n---\n", "")))


def parse_pages(raw: DataFrame) -> DataFrame:
    """Index rows of Markdown pages (``path``, ``text``, ``mtime``, ``size``).

    Frontmatter is read by the line automaton of :mod:`sourceloom.functions.frontmatter`.  A block that cannot be
    read, an ``acl`` that is not a list of valid labels, or a block that never closes makes the page visible to nobody.
    """
    def entry(name: str) -> Column:
        return find(F.col("_front.done"), name)

    def text(name: str) -> Column:
        return F.coalesce(scalar_text(entry(name)), F.lit(""))

    # an unquoted label that would not read back as text is not a label
    typed = F.exists(raw_items(entry("acl")), lambda p: p.rlike(r"^(?:[\d.:~+\-]+|(?i)(?:true|false|null|yes|no|on|off))$"))
    names = item_fields(entry("mentions"), "name")
    df = raw.withColumn("_t", F.regexp_replace("text", r"\A\x{feff}+", ""))
    df = df.withColumn("_front", split(F.col("_t"))).withColumn("_readable", (F.col("_front.block") != "") & ~F.col("_front.bad"))
    opens = F.col("text").rlike(r"\A\x{feff}?\s*---[ \t]*\r?\n")
    labels = F.when(F.col("_readable") & ~F.coalesce(typed, F.lit(False)), items(entry("acl")))
    body = F.when(F.col("_readable"), F.regexp_replace("_t", r"(?s)\A---\n.*?\n---\n?", "")).otherwise(F.col("_t"))
    fields = {"title": "title", "doc_type": "type", "entity": "entity", "unit": "unit", "period": "period", "as_of": "as_of",
              "date": "date", "verification": "verification", "quality": "extraction_quality", "representation": "representation",
              "superseded_by": "superseded_by", "supersedes": "supersedes", "source_file_id": "source_file_id", "source_uri": "source_uri"}

    def read(column: Column) -> Column:
        return F.when(F.col("_readable"), column)

    return df.select(
        "path", *[F.coalesce(read(text(k)), F.lit("")).alias(c) for c, k in fields.items()],
        F.coalesce(read(text("tier")).try_cast("int"), F.lit(0)).alias("tier"),
        F.coalesce(read(text("detail_in_source")) == "true", F.lit(False)).alias("detail_in_source"),
        declared_acl(F.coalesce(entry("acl").isNotNull(), F.lit(False)), labels, opens & ~F.col("_readable")).alias("acl"),
        F.array_join(F.coalesce(read(items(entry("tags"))), F.array().cast("array<string>")), " ").alias("tags"),
        F.array_join(F.coalesce(read(names), F.array().cast("array<string>")), " ").alias("mentions"),
        body.alias("body"), "mtime", "size")
