"""Per-entity rollups kept in long form, so an entity may own any number of pages.

Members: ``file_id, path, title, entity, as_of, superseded_by, acl, content_hash``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import numbers
from sourceloom.functions.render import inline_list, quoted, scalar
from sourceloom.operators.ownership import shared_audience
from sourceloom.operators.verification import verdict_of

#: Sections of a dossier, in reading order.
HEAD, STATUS, FIGURES, DOCUMENTS = range(4)


def member_print(row_key: Column) -> tuple[Column, Column]:
    """Order-free fingerprint of a set: two sums of 60-bit digests that combine on the map side."""
    digest = F.md5(row_key)

    def half(start: int) -> Column:
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")

    return F.sum(half(1)), F.sum(half(17))


def entity_rollup(members: DataFrame) -> DataFrame:
    """entity, members, current, fingerprint, acl."""
    row_key = F.concat_ws(":", "file_id", "path", F.coalesce("superseded_by", F.lit("")),
                          F.coalesce("content_hash", F.lit("")))
    a, b = member_print(row_key)
    current = F.coalesce("superseded_by", F.lit("")) == ""
    owned = members.filter(F.coalesce("entity", F.lit("")) != "")
    head = owned.groupBy("entity").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(current).alias("current"),
        F.concat_ws(":", F.count(F.lit(1)).cast("string"), a.cast("string"), b.cast("string")).alias("fingerprint"))
    return head.join(shared_audience(owned, "entity"), "entity")


def dossier_changes(rollup: DataFrame, previous: DataFrame) -> DataFrame:
    """write / keep / remove per entity, by fingerprint.  ``previous``: entity, fingerprint."""
    prev = previous.select("entity", F.col("fingerprint").alias("old_print"))
    action = (F.when(F.col("fingerprint").isNull(), "remove")
              .when(F.col("fingerprint").eqNullSafe(F.col("old_print")), "keep").otherwise("write"))
    return rollup.join(prev, "entity", "full_outer").select("entity", action.alias("action"))


def dossier_lines(members: DataFrame, facts: DataFrame) -> DataFrame:
    """Lines of every dossier: entity, section, k1, k2, line.

    Writing the table sorted by its keys gives the document; no entity is gathered into one row.  The lines are stored:
    which entities have no figures is read from them, so the facts are worked out once.
    """
    from sourceloom.session import cut_lineage
    owned = members.filter(F.coalesce("entity", F.lit("")) != "")
    rollup = owned.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("superseded_by", F.lit("")) == "").alias("cur"))
    status = rollup.select("entity", F.lit(1).alias("section"), F.lit("").alias("k1"), F.lit("").alias("k2"), F.concat(
        F.col("n").cast("string"), F.lit(" document(s) on file, "), F.col("cur").cast("string"), F.lit(" current.")).alias("line"))
    stale = owned.filter(F.coalesce("superseded_by", F.lit("")) != "").select("file_id")
    current_facts = (facts.filter(F.col("entity") != "").join(stale, "file_id", "left_anti")
                     .join(rollup.select("entity"), "entity", "left_semi"))
    figures = current_facts.select(
        "entity", F.lit(2).alias("section"),
        F.concat_ws("|", "metric", F.coalesce("period", F.lit(""))).alias("k1"), F.col("source_ref").alias("k2"),
        F.concat(F.lit("- "), "metric", F.lit(" · "), F.coalesce("period", F.lit("-")), F.lit(" = "), "value_raw",
                 F.coalesce(F.concat(F.lit(" "), "unit"), F.lit("")), F.lit(" (source "), "source_ref", F.lit(")")).alias("line"))
    documents = owned.select(
        "entity", F.lit(3).alias("section"), F.col("file_id").alias("k1"), F.lit("").alias("k2"),
        F.concat(F.lit("- "), "title",
                 F.when(F.coalesce("as_of", F.lit("")) != "", F.concat(F.lit(" — as of "), "as_of")).otherwise(""),
                 F.when(F.coalesce("superseded_by", F.lit("")) != "", F.lit(" *(superseded)*")).otherwise("")).alias("line"))
    lines = cut_lineage(status.unionByName(figures).unionByName(documents))
    without = (lines.filter(F.col("section") == STATUS).select("entity")
               .join(lines.filter(F.col("section") == FIGURES).select("entity").distinct(), "entity", "left_anti")
               .select("entity", F.lit(2).alias("section"), F.lit("").alias("k1"), F.lit("").alias("k2"),
                       F.lit("No verified observations in the facts store.").alias("line")))
    return lines.unionByName(cut_lineage(without))


def evidence_lines(members: DataFrame, lines: DataFrame) -> DataFrame:
    """What a dossier may quote: the facts it was given and the names and dates of its documents."""
    owned = members.filter(F.coalesce("entity", F.lit("")) != "")
    named = owned.select("entity", F.concat_ws(" · ", F.concat(F.lit("- "), "path"), "title",
                                               F.when(F.coalesce("as_of", F.lit("")) != "", F.concat(F.lit("as_of "), "as_of"))).alias("line"))
    given = lines.filter((F.col("section") == FIGURES) & F.col("line").startswith("- ")).select("entity", "line")
    return named.unionByName(given)


def shown_figures(lines: DataFrame, evidence: DataFrame) -> DataFrame:
    """entity, display, backed: every figure of a dossier and whether evidence of its entity has its value.

    Rows are (entity, figure) and (entity, value), distinct on the map side, so an entity that owns a third of all
    lines is spread over its values.  Dates and counts stand in many lines; only distinct figures are interpreted.
    """
    shown = (lines.select("entity", F.explode(numbers.figure_tokens(F.col("line"))).alias("token"))
             .filter(~numbers.is_weak(F.col("token")))
             .select("entity", numbers.display_of(F.col("token")).alias("display")).distinct()
             .withColumn("value_keys", numbers.token_keys(F.col("display"))))
    written = evidence.select("entity", F.explode(numbers.figure_tokens(F.col("line"))).alias("token")).distinct()
    grouped = evidence.select("entity", F.explode(numbers.spaced_group_keys(F.col("line"))).alias("value_key"))
    pool = (written.select("entity", F.explode(numbers.token_keys(F.col("token"))).alias("value_key")).unionByName(grouped).distinct()
            .withColumn("held", F.lit(True)))
    # explode_outer: a figure without a readable value stays, and no evidence backs it
    return (shown.select("entity", "display", F.explode_outer("value_keys").alias("value_key"))
            .join(pool, ["entity", "value_key"], "left")
            .groupBy("entity", "display").agg(F.coalesce(F.bool_or("held"), F.lit(False)).alias("backed")))


def verdicts(figures: DataFrame) -> DataFrame:
    """entity, n_figures, n_unverified, verdict of the dossiers that show figures."""
    counted = figures.groupBy("entity").agg(F.count(F.lit(1)).alias("n_figures"), F.count_if(~F.col("backed")).alias("n_unverified"))
    return counted.withColumn("verdict", verdict_of(F.col("n_unverified"), F.col("n_figures")))


def dossier_documents(members: DataFrame, facts: DataFrame, generated_at: str) -> DataFrame:
    """Whole dossiers as ordered lines: entity, section, k1, k2, line.

    Section 0 is the head (members, verdict, shared audience, unverified figures as a line list), the others are
    :func:`dossier_lines` below their headings.  Sorted by its columns an entity's lines are its document; none is
    gathered, so an entity may own any number of pages and figures.
    """
    from sourceloom.session import cut_lineage
    body = dossier_lines(members, facts)          # stored, and read three times: evidence, figures, document
    figures = cut_lineage(shown_figures(body, evidence_lines(members, body)))
    rollup = entity_rollup(members).join(verdicts(figures), "entity", "left")
    doubted = figures.filter(~F.col("backed"))
    verdict = F.coalesce("verdict", F.lit("verified"))
    title = F.concat("entity", F.lit(" — dossier"))
    head = [F.lit("---"), F.lit("type: dossier"), F.concat(F.lit("title: "), scalar(title)), F.concat(F.lit("entity: "), scalar(F.col("entity"))),
            F.lit(f'generated_at: "{generated_at}"'), F.concat(F.lit("members: "), F.col("members").cast("string")),
            F.concat(F.lit("verification: "), verdict), F.concat(F.lit("acl: "), inline_list(F.col("acl"))),
            F.when(F.col("n_unverified") > 0, F.lit("unverified_numbers:"))]
    frame = [(1, F.lit("---")), (2, F.lit("")), (3, F.concat(F.lit("# "), title)), (4, F.lit(""))]
    headings = [(STATUS, "## Status"), (FIGURES, "## Key figures"), (DOCUMENTS, "## Documents")]
    at = [F.struct(F.lit(HEAD).alias("section"), F.lit(f"0{i}").alias("k1"), line.alias("line")) for i, line in enumerate(head)]
    at += [F.struct(F.lit(HEAD).alias("section"), F.lit(f"2{i}").alias("k1"), line.alias("line")) for i, line in frame]
    for section, text in headings:
        if section != STATUS:
            at.append(F.struct(F.lit(section).alias("section"), F.lit("").alias("k1"), F.lit("").alias("line")))
        at.append(F.struct(F.lit(section).alias("section"), F.lit(" ").alias("k1"), F.lit(text).alias("line")))
    fixed = (rollup.select("entity", F.explode(F.array(*at)).alias("x")).filter(F.col("x.line").isNotNull())
             .select("entity", "x.section", "x.k1", F.lit("").alias("k2"), "x.line"))
    listed = doubted.select("entity", F.lit(HEAD).alias("section"), F.lit("1").alias("k1"), F.col("display").alias("k2"),
                            F.concat(F.lit("  - "), quoted(F.col("display"))).alias("line"))
    shown = body.select("entity", "section", F.concat(F.lit("!"), "k1").alias("k1"), "k2", "line")
    return fixed.unionByName(listed).unionByName(shown)


ORDER = ["entity", "section", "k1", "k2", "line"]


def write_dossiers(documents: DataFrame, target: str) -> None:
    """Files of every dossier in ``documents``; dossiers of other entities below ``target`` stay.

    Ranges of the sorted lines are streamed to files named in reading order, so a dossier larger than a task is a
    sequence of files.  Spark's committer moves them into place: a lost executor leaves nothing half-written.
    """
    (documents.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("entity", "line")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("entity").text(target))
