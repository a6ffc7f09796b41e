"""Deterministic verification of figures: presence in the source and agreement of periods."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import numbers, periods
from sourceloom.functions.fold import WS, plain_norm
from sourceloom.functions.lets import let
from sourceloom.functions.numbers import NUMBER, WORD


_SHADOW_WORD = r"\x{e030}-\x{e039}\x{e041}-\x{e05a}\x{e061}-\x{e07a}"
_D2 = r"[\p{Nd}\x{e030}-\x{e039}]"
_SEP2 = r"[.,\x{e02e}\x{e02c}]"
# the figure grammar over text whose period spans are shadowed: sees them, so it can reject them
_MARKED_FIGURE = (rf"(?={_D2})(?<![{WORD}.,{_SHADOW_WORD}\x{{e02e}}\x{{e02c}}])"
                  rf"(?:{_D2}{{1,3}}(?:{_SEP2}{_D2}{{3}})+(?:{_SEP2}{_D2}+)?|{_D2}+(?:{_SEP2}{_D2}+)?)"
                  rf"{WS}?(?:bn|[kKmMbB])?{WS}?%?(?![{WORD}{_SHADOW_WORD}])")


def _join_wrapped_suffix(text: Column) -> Column:
    """A magnitude or percent wrapped to the next line belongs to the figure's own line."""
    wrapped = text.rlike(rf"\n(?:(?:bn|[kKmMbB])(?![{WORD}])|%)")
    start = rf"((?=\p{{Nd}})(?<![{WORD}.,]){NUMBER})"
    first = F.regexp_replace(text, rf"{start}\n((?:bn|[kKmMbB]){WS}?%|(?:bn|[kKmMbB])|%)(?![{WORD}])", "$1 $2\n")
    second = F.regexp_replace(first, rf"{start}({WS}?(?:bn|[kKmMbB]))\n%(?![{WORD}])", "$1$2 %\n")
    return F.when(wrapped, second).otherwise(text)


# a figure, a month, what may stand between a month and its year, or the wrapped suffix of a figure
_TELLING = rf"\p{{Nd}}|{periods.CANDIDATE}|^(?:bn|[kKmMbB])(?![{WORD}])|^%|^(?:{WS}|[,of])*$"


def telling_lines(text: Column) -> Column:
    """The text with every line that cannot hold a part of a figure or of a period reduced to one letter.

    A period that runs over several lines begins with a month or a digit and ends in a year; between them stand
    blanks, commas and "of" only.  So the costly patterns see few characters and find the same.
    """
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.when(line.rlike(_TELLING), line).otherwise("x")), "\n")


def marked_lines(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """One row per line with a figure: ``line`` (unmarked), ``marked`` and its period ``signals``."""
    marked = periods.scan_periods(_join_wrapped_suffix(F.coalesce(text, F.lit(""))))["text"]
    return (df.select(*keys, F.explode(F.split(marked, "\n")).alias("marked"))
            .filter(F.col("marked").rlike(rf"[\p{{Nd}}]|{periods.SHADOWED}"))
            .withColumn("signals", periods.line_signals(F.col("marked"))))


def figures(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Distinct displayed figures per document with first position and value keys."""
    tokens = (df.select(*keys, F.posexplode(numbers.figure_tokens(text)).alias("pos", "token"))
              .filter(~numbers.is_weak(F.col("token")))
              .withColumn("display", numbers.display_of(F.col("token"))))
    return (tokens.groupBy(*keys, "display").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("occurrences"))
            .withColumn("value_keys", numbers.token_keys(F.col("display"))))


def figure_presence(shown: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``present`` to displayed figures; ``evidence`` holds (keys..., value_key) rows."""
    backed = (shown.select(*keys, "display", F.explode("value_keys").alias("value_key"))
              .join(evidence.select(*keys, "value_key"), [*keys, "value_key"], "left_semi")
              .select(*keys, "display").distinct().withColumn("present", F.lit(True)))
    return (shown.join(backed, [*keys, "display"], "left")
            .withColumn("present", F.coalesce("present", F.lit(False))))


def evidence_values(df: DataFrame, keys: list[str], hay: Column) -> DataFrame:
    """Values a source can back, one row each (already distinct within a document)."""
    return df.select(*keys, F.explode(numbers.evidence_keys(hay)).alias("value_key"))


def unanchored_figures(df: DataFrame, keys: list[str], body: Column, hay: Column) -> DataFrame:
    """Figures whose every source occurrence carries a contradicting period.

    Source occurrences are first reduced to one row per (document, value): whether any line is
    silent about periods, and the distinct periods seen.  The calendar bounds that set, so no
    occurrence-by-occurrence pairing happens.
    """
    df = df.select(*keys, telling_lines(body).alias("_body"), telling_lines(hay).alias("_hay"))
    body, hay = F.col("_body"), F.col("_hay")
    body_lines = marked_lines(df, keys, body).filter(F.size("signals") > 0)
    tokens = F.filter(F.regexp_extract_all(F.col("marked"), F.lit(_MARKED_FIGURE), F.lit(0)),
                      lambda t: ~t.rlike(periods.SHADOWED) & ~numbers.is_weak(t))
    asserted = (body_lines.select(*keys, "signals", F.explode(F.array_distinct(tokens)).alias("token"))
                .select(*keys, F.array_sort("signals").alias("asserted"),
                        numbers.display_of(F.col("token")).alias("display"),
                        numbers.token_keys(F.col("token")).alias("value_keys"))
                .distinct()
                .withColumn("value_key", F.explode("value_keys")).drop("value_keys"))
    wanted = asserted.select(*keys, "value_key").distinct()
    line = periods.unshadow(F.col("marked"))
    occurrences = (marked_lines(df, keys, hay)
                   .select(*keys, "signals", F.explode(numbers.evidence_keys(line)).alias("value_key"))
                   .join(wanted, [*keys, "value_key"], "left_semi")
                   .groupBy(*keys, "value_key")
                   .agg(F.max(F.size("signals") == 0).alias("silent"),
                        F.array_distinct(F.flatten(F.collect_set("signals"))).alias("near")))
    judged = (asserted.join(occurrences, [*keys, "value_key"])
              .groupBy(*keys, "display", "asserted")
              .agg(F.max(F.col("silent") | periods.any_compatible(F.col("asserted"), F.col("near"))).alias("anchored")))
    return judged.filter(~F.col("anchored")).select(*keys, "display").distinct()


def verdict_of(problems: Column, total: Column) -> Column:
    return (F.when(problems == 0, F.lit("verified"))
            .when((problems == 1) | (problems <= 0.25 * total), F.lit("partial"))
            .otherwise(F.lit("failed")))


def verdict_rank(verdict: Column) -> Column:
    return F.when(verdict == "verified", 0).when(verdict == "partial", 1).otherwise(2)


def shown_figures(text: Column) -> Column:
    """array<struct<display, keys>>: distinct figures of a text in order of first appearance, with their values."""
    tokens = F.filter(numbers.figure_tokens(text), lambda t: ~numbers.is_weak(t))
    return F.transform(F.array_distinct(F.transform(tokens, numbers.display_of)),
                       lambda d: F.struct(d.alias("display"), numbers.token_keys(d).alias("keys")))


def _lines_with_figures(text: Column) -> Column:
    """array<string>: lines with a figure, period spans shadowed."""
    marked = periods.scan_periods(_join_wrapped_suffix(F.coalesce(text, F.lit(""))))["text"]
    return F.filter(F.split(marked, "\n"), lambda line: line.rlike(rf"[\p{{Nd}}]|{periods.SHADOWED}"))


def asserted_figures(text: Column) -> Column:
    """array<struct<display, keys, signals>>: figures on lines that state a period."""
    def of_line(line: Column) -> Column:
        tokens = F.filter(F.regexp_extract_all(line, F.lit(_MARKED_FIGURE), F.lit(0)),
                          lambda t: ~t.rlike(periods.SHADOWED) & ~numbers.is_weak(t))
        return let(periods.line_signals(line), lambda own: F.transform(
            F.when(F.size(own) > 0, F.array_distinct(tokens)).otherwise(F.array().cast("array<string>")),
            lambda t: F.struct(numbers.display_of(t).alias("display"), numbers.token_keys(t).alias("keys"), own.alias("signals"))))
    return F.flatten(F.transform(_lines_with_figures(text), of_line))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def verify_pages(pages: DataFrame, keys: list[str], body: str = "body", source: str = "source",
                 context: str = "context") -> DataFrame:
    """Verdict per page, with every figure that fails.

    Everything a verdict needs stands in the page's own row, so text and figures never leave it: one scan, no shuffle.
    Each step is a column of its own that later steps read more than once, so none is evaluated inside a lambda.
    """
    hay = F.concat(F.coalesce(F.col(source), F.lit("")), F.lit("\n"), F.coalesce(F.col(context), F.lit("")))
    rows = pages.select(*keys, telling_lines(F.col(body)).alias("_body"), telling_lines(hay).alias("_hay"))
    rows = rows.withColumns({"_shown": shown_figures(F.col("_body")), "_pool": numbers.evidence_keys(F.col("_hay")),
                             "_asserted": asserted_figures(F.col("_body"))})
    rows = rows.withColumn("_wanted", F.array_distinct(F.flatten(F.transform("_asserted", lambda x: x["keys"]))))

    # source lines that hold an asserted value, then the periods they state
    def line_keys(line: Column) -> Column:
        return F.struct(numbers.evidence_keys(periods.unshadow(line)).alias("keys"), line.alias("line"))

    held = F.filter(F.transform(_lines_with_figures(F.col("_hay")), line_keys), lambda x: F.arrays_overlap(x["keys"], F.col("_wanted")))
    rows = rows.withColumn("_held", F.when(F.size("_wanted") > 0, held))
    rows = rows.withColumn("_lines", F.transform("_held", lambda x: F.struct(
        x["keys"].alias("keys"), periods.line_signals(x["line"]).alias("signals"))))

    # a figure drifts when all of its source lines carry a contradicting period
    def contradicted(figure: Column) -> Column:
        own = F.filter("_lines", lambda line: F.arrays_overlap(line["keys"], figure["keys"]))
        return let(own, lambda lines: (F.size(lines) > 0) & ~F.exists(
            lines, lambda line: (F.size(line["signals"]) == 0) | periods.any_compatible(figure["signals"], line["signals"])))

    drifting = F.transform(F.filter("_asserted", contradicted), lambda x: x["display"])
    rows = rows.withColumn("_drifting", F.when(F.size("_lines") > 0, F.array_distinct(drifting)).otherwise(_none("string")))
    known = F.size("_pool") > 0
    backed = F.filter("_shown", lambda x: F.arrays_overlap(x["keys"], F.col("_pool")))
    rows = rows.withColumn("_backed", F.when(known, F.transform(backed, lambda x: x["display"])).otherwise(_none("string")))
    rows = rows.select(*keys, F.transform("_shown", lambda x: x["display"]).alias("_shown"), "_backed", "_drifting")
    rows = rows.select(*keys, F.size("_shown").alias("_total"), F.array_except("_shown", "_backed").alias("_missing"),
                       F.array_intersect("_backed", "_drifting").alias("_drift"))
    missing, drift = F.size("_missing"), F.size("_drift")
    return rows.select(*keys, verdict_of(missing + drift, F.col("_total")).alias("verdict"),
                       F.col("_total").cast("bigint").alias("numbers_total"), missing.cast("bigint").alias("n_unverified"),
                       drift.cast("bigint").alias("n_unanchored"), F.col("_missing").alias("numbers_unverified"),
                       F.col("_drift").alias("numbers_unanchored"))


def figure_spans(df: DataFrame, keys: list[str], body: Column, hay: Column) -> DataFrame:
    """First source span (start, end) of every displayed figure found in the source.

    Offsets are running lengths over one document's own tokens, a group that came from one row.
    """
    from pyspark.sql import Window as W
    order = W.partitionBy(*keys).orderBy("pos")
    pieces = (df.withColumn("_hay", hay)
              .select(*keys, F.posexplode(F.arrays_zip(
                  F.split("_hay", numbers.FIGURE, -1).alias("gap"),
                  numbers.figure_tokens(F.col("_hay")).alias("token"))).alias("pos", "p"))
              .select(*keys, "pos", F.length("p.gap").alias("gap"), F.col("p.token").alias("token")))
    placed = (pieces.withColumn("end", F.sum(F.col("gap") + F.coalesce(F.length("token"), F.lit(0))).over(order))
              .filter(F.col("token").isNotNull())
              .withColumn("start", F.col("end") - F.length("token"))
              .select(*keys, "start", "end", F.explode(numbers.token_keys(F.col("token"))).alias("value_key")))
    grouped = (df.withColumn("_hay", hay)
               .select(*keys, F.posexplode(F.arrays_zip(
                   F.split("_hay", numbers.SPACED_GROUPS, -1).alias("gap"),
                   F.regexp_extract_all("_hay", F.lit(numbers.SPACED_GROUPS), F.lit(0)).alias("token"))
               ).alias("pos", "p"))
               .select(*keys, "pos", F.length("p.gap").alias("gap"), F.col("p.token").alias("token"))
               .withColumn("end", F.sum(F.col("gap") + F.coalesce(F.length("token"), F.lit(0))).over(order))
               .filter(F.col("token").isNotNull())
               .select(*keys, (F.col("end") - F.length("token")).alias("start"), "end",
                       F.explode(numbers.spaced_group_keys(F.col("token"))).alias("value_key")))
    first = (placed.unionByName(grouped).groupBy(*keys, "value_key")
             .agg(F.min(F.struct("start", "end")).alias("span")))
    return (figures(df, keys, body).withColumn("value_key", F.explode("value_keys"))
            .join(first, [*keys, "value_key"])
            .groupBy(*keys, "display").agg(F.min("pos").alias("pos"), F.min("span").alias("span"))
            .select(*keys, "display", "pos", F.col("span.start").alias("start"), F.col("span.end").alias("end")))


def missing_mentions(df: DataFrame, names: Column, source: Column, context: Column) -> DataFrame:
    """Advisory: mentions whose name the source (or its file name and path) never states."""
    hay = plain_norm(F.concat_ws(" ", source, context))
    return df.withColumn("mentions_unverified", let(hay, lambda h: F.filter(
        names, lambda n: ~h.contains(plain_norm(n)))))


def keep_better(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Generator/verifier retry: the second attempt wins only if strictly better."""
    def score(v: str) -> Column:
        return F.struct(verdict_rank(F.col(f"{v}.verdict")).alias("r"),
                        (F.col(f"{v}.n_unverified") + F.col(f"{v}.n_unanchored")).alias("n"))
    a = first.select(*keys, F.struct("*").alias("a"))
    b = second.select(*keys, F.struct("*").alias("b"))
    joined = a.join(b, keys, "left")
    better = F.col("b").isNotNull() & (score("b") < score("a"))
    fields = [c for c in first.columns if c not in keys]
    return joined.select(*keys, better.alias("retry_won"),
                         *[F.when(better, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in fields])


def unverified_in_answer(answer: Column, evidence: Column) -> Column:
    """array<string>: figures of a short answer that the evidence does not back, in order."""
    shown = F.array_distinct(F.transform(
        F.filter(numbers.figure_tokens(answer), lambda t: ~numbers.is_weak(t)), numbers.display_of))
    return let(numbers.evidence_keys(evidence), lambda pool: F.filter(
        shown, lambda d: ~F.arrays_overlap(numbers.token_keys(d), pool)))


def verify_answers(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """Verdict of cited answers.

    ``answers``: answer_id, answer, evidence, refused, citations array<struct<path,quote>>,
    read_paths array<string>.  ``pages``: path, title, body (already scoped to the client).
    """
    from sourceloom.functions.words import normalized_quote
    cited = (answers.filter(~F.col("refused"))
             .select("answer_id", "read_paths", F.posexplode("citations").alias("no", "c"))
             .select("answer_id", "no", F.col("c.path").alias("path"), F.col("c.quote").alias("quote"),
                     F.array_contains("read_paths", F.col("c.path")).alias("surfaced")))
    hay = normalized_quote(F.concat_ws(" ", "title", "body"))
    checked = (cited.join(pages.select("path", hay.alias("hay")), "path", "left")
               .withColumn("problem", F.when(~F.col("surfaced"), F.lit("not-surfaced"))
                           .when(F.col("hay").isNull(), F.lit("unknown-page"))
                           .when((F.col("quote") != "") & ~F.col("hay").contains(normalized_quote(F.col("quote"))),
                                 F.lit("quote-not-found")))
               .groupBy("answer_id").agg(F.count("problem").alias("citation_problems")))
    figures_missing = F.when(F.col("refused"), F.array().cast("array<string>")).otherwise(
        unverified_in_answer(F.col("answer"), F.col("evidence")))
    uncited = (~F.col("refused") & (F.size("citations") == 0) & (F.trim("answer") != "")).cast("bigint")
    return (answers.join(checked, "answer_id", "left")
            .withColumn("unverified_figures", figures_missing)
            .withColumn("citation_problems", F.coalesce("citation_problems", F.lit(0)) + uncited)
            .withColumn("_n", F.size("unverified_figures") + F.col("citation_problems"))
            .withColumn("verdict", F.when(F.col("refused") | (F.col("_n") == 0), F.lit("verified"))
                        .when(F.col("_n") == 1, F.lit("partial")).otherwise(F.lit("failed")))
            .select("answer_id", "verdict", "unverified_figures", "citation_problems"))
