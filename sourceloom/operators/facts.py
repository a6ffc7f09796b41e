"""Typed numeric facts: proposals from grids and prose, validation, the store, lookups.

A grid is a table ``file_id, sheet, row, values array<string>`` with 1-based rows.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourceloom.functions import numbers, periods
from sourceloom.functions.access import visible
from sourceloom.functions.fold import WS, cell_norm, collapse_spaces, slug, strip
from sourceloom.functions.lets import let, none_if_blank

SHEET = ["file_id", "sheet"]
# Unit guesses, prose figure pattern and label stop words of the offline mappers.
UNIT_HINTS = [("usd", "usd"), ("eur", "eur"), ("gbp", "gbp"), ("pct", "%"), ("%", "%")]
PROSE_FIGURE = (r"[€$£]\s?\p{Nd}[\p{Nd}.,]*\s?(?:bn|[kKmMbB])?"
                r"|(?<![\p{L}\p{N}_])\p{Nd}[\p{Nd}.,]*\s?(?:bn|[kKmMbB])(?![\p{L}\p{N}_])(?!-)")
PROSE_STOP_WORDS = ["the", "a", "an", "for", "of", "in", "on", "was", "is", "our", "this", "that"]
FACT_COLUMNS = ["file_id", "page_path", "entity", "org_unit", "metric", "metric_raw", "value_raw", "value_num",
                "unit", "period", "dimension", "source_ref", "extracted_at", "verified", "acl"]


def cells(grid: DataFrame) -> DataFrame:
    """Long form of a grid: one row per cell, 1-based coordinates."""
    return (grid.select(*SHEET, "row", F.posexplode("values").alias("_c", "value"))
            .select(*SHEET, "row", (F.col("_c") + 1).alias("col"), "value"))


def _unit(header: Column) -> Column:
    low = F.lower(header)
    return F.coalesce(*[F.when(low.contains(t), F.lit(u)) for t, u in UNIT_HINTS])


def grid_observations(grid: DataFrame) -> DataFrame:
    """Offline grid mapper: header row, a period or a dimension in column 1, numbers elsewhere."""
    def described(h: Column) -> Column:
        return let(strip(h), lambda t: let(slug(t), lambda m: F.struct(
            t.alias("raw"), F.when(m == "", F.lit("metric")).otherwise(m).alias("metric"), _unit(t).alias("unit"))))

    # header cells are named once per sheet, not once per value
    headers = grid.filter(F.col("row") == 1).select(*SHEET, F.transform("values", described).alias("headers"))
    first = strip(F.get("values", F.lit(0)))
    body = (grid.filter(F.col("row") > 1)
            .withColumns({"first": first, "period": periods.parse_period(first)})
            .join(headers, SHEET)
            .select(*SHEET, "row", "period",
                    F.when(F.col("period").isNull() & (F.col("first") != ""), F.col("first")).alias("dimension"),
                    F.posexplode(F.arrays_zip("values", "headers")).alias("_c", "z")))
    header = F.col("z.headers")
    return (body.filter((F.col("_c") >= 1) & (header["raw"] != "") & numbers.parse_num(F.col("z.values")).isNotNull())
            .select(*SHEET, "row", (F.col("_c") + 1).alias("col"), header["metric"].alias("metric"),
                    header["raw"].alias("metric_raw"), strip(F.col("z.values")).alias("value_raw"),
                    header["unit"].alias("unit"), "period", "dimension"))


def validate_grid(proposals: DataFrame, grid: DataFrame, file_names: DataFrame | None = None,
                  max_observations: int | None = None) -> DataFrame:
    """Adds ``reason``: NULL when the grid backs the proposal, else the first check that failed.

    ``proposals`` carries ``proposal_no`` per file; ``file_names`` maps file_id to its name, which
    may also state the period.
    """
    where, column = [*SHEET, "row", "col"], [*SHEET, "col"]
    p = proposals
    if max_observations:
        p = p.filter(F.col("proposal_no") <= max_observations)
    p = p.withColumn("_want", cell_norm(F.col("metric_raw")))
    # a row is normalised and read for periods once and meets its proposals once: its cell, label and period are looked
    # up in it.  Rows that repeat their coordinates travel as one and count as often as each of them would
    rows = (grid.select(*SHEET, "row", F.struct("values", F.transform("values", lambda c: cell_norm(c)).alias("norms"),
                                                F.transform("values", lambda c: periods.parse_period(c)).alias("periods")).alias("r"))
            .groupBy(*SHEET, "row").agg(F.collect_list("r").alias("_rows")))
    at = F.col("col").cast("int") - 1

    def cited(cell: Column, row: Column) -> Column:
        return F.struct(F.get(cell["values"], at).alias("cell"), F.get(cell["norms"], at).alias("norm"), row["norms"].alias("row"))

    single = F.get("_rows", F.lit(0))
    reaching = F.filter("_rows", lambda r: (at >= 0) & (F.size(r["values"]) > at))
    reaching = F.when(F.size(reaching) > 0, reaching).otherwise(F.array(F.get("_rows", F.lit(-1))))
    every = F.flatten(F.transform(reaching, lambda c: F.transform("_rows", lambda r: cited(c, r))))
    claimed, actual = numbers.parse_num(F.col("value_raw")), numbers.parse_num(F.col("_at.cell"))
    value_ok = F.when(cell_norm(F.col("value_raw")) == F.col("_at.norm"), True).otherwise(
        F.coalesce(claimed == actual, F.lit(False)))
    located = (p.join(rows, [*SHEET, "row"], "left")
               .withColumns({"_p1": F.exists("_rows", lambda r: F.array_contains(r["periods"], F.col("period"))),
                             "_at": F.explode(F.when(F.coalesce(F.size("_rows"), F.lit(0)) > 1, every).otherwise(F.array(cited(single, single))))})
               .withColumns({"_coord_ok": F.col("_at.cell").isNotNull(), "_value_ok": value_ok,
                             "_label_row": F.coalesce(F.exists("_at.row", lambda c: c.contains(F.col("_want"))), F.lit(False))})
               .drop("_rows", "_at"))
    # per column the labels found in it, of those proposed there, and the periods readable in it (labels and a calendar)
    wanted = p.groupBy(*column).agg(F.collect_set("_want").alias("_wants"))
    flat = cells(grid).select(*column, cell_norm(F.col("value")).alias("_norm"), periods.parse_period(F.col("value")).alias("_period"))
    hits = F.filter("_wants", lambda w: F.col("_norm").contains(w))
    columns = (flat.join(wanted, column, "left").withColumn("_hits", hits).groupBy(*column)
               .agg(F.flatten(F.collect_set(F.when(F.size("_hits") > 0, F.col("_hits")))).alias("_labels"), F.collect_set("_period").alias("_periods"))
               .withColumn("_title", periods.parse_period(F.col("sheet"))))
    checked = (located.join(columns, column, "left")
               .withColumns({"_label_col": F.array_contains("_labels", F.col("_want")), "_p2": F.array_contains("_periods", F.col("period")),
                             "_p3": F.col("_title") == F.col("period")}))
    if file_names is not None:
        named = file_names.select("file_id", periods.parse_period(F.col("name")).alias("period")).filter(F.col("period").isNotNull())
        checked = checked.join(named.distinct().withColumn("_p4", F.lit(True)), ["file_id", "period"], "left")
    else:
        checked = checked.withColumn("_p4", F.lit(False))
    stated = F.coalesce("_p1", F.lit(False))
    for place in ("_p2", "_p3", "_p4"):
        stated = stated | F.coalesce(place, F.lit(False))
    no_period = F.col("period").isNull() | (F.col("period") == "")
    reason = (F.when(~F.col("_coord_ok"), F.lit("bad-coordinates"))
              .when(~F.col("_value_ok"), F.lit("value-not-in-cell"))
              .when((F.length("_want") < 2) | ~(F.col("_label_row") | F.coalesce("_label_col", F.lit(False))),
                    F.lit("label-not-found"))
              .when(~no_period & ~stated, F.lit("period-not-found")))
    judged = checked.select(*proposals.columns, reason.alias("reason"))
    # of those a cell backs the first stays; rows of a cell are together already
    first = F.min(F.when(F.col("reason").isNull(), F.col("proposal_no"))).over(W.partitionBy(*where))
    return (judged.withColumn("_first", first)
            .withColumn("reason", F.coalesce("reason", F.when(F.col("proposal_no") > F.col("_first"), F.lit("duplicate-cell"))))
            .select(*proposals.columns, "reason"))


def grid_source_ref(file_id: Column, sheet: Column, row: Column, col: Column) -> Column:
    return F.concat(file_id, F.lit("!"), sheet, F.lit("!R"), row.cast("string"), F.lit("C"), col.cast("string"))


# --- prose -------------------------------------------------------------------------------------
def prose_observations(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Offline prose mapper: one observation per sentence with a currency or magnitude figure."""
    keep = keep or ["file_id"]
    sentences = docs.select(*keep, text, F.posexplode(F.split(F.col(text), rf"(?<=[.!?]){WS}+")).alias("no", "sentence"))
    words = F.filter(F.regexp_extract_all("sentence", F.lit("[A-Za-z]+"), F.lit(0)),
                     lambda w: ~F.lower(w).isin(PROSE_STOP_WORDS))
    figure = F.regexp_extract("sentence", PROSE_FIGURE, 0)
    shown = (sentences.withColumns({"_figure": figure}).filter(F.col("_figure") != "")
             .withColumn("_words", words).filter(F.size("_words") >= 2)
             .withColumn("quote", strip(collapse_spaces(F.col("sentence")))))
    label = F.array_join(F.slice("_words", 1, 2), " ")
    return shown.select(
        *keep, text, F.col("no").alias("proposal_no"), F.lower(F.array_join(F.slice("_words", 1, 2), "-")).alias("metric"),
        label.alias("metric_raw"),
        strip(F.regexp_replace("_figure", r"^[€$£ ]+", "")).alias("value_raw"),
        F.when(F.col("_figure").contains("$"), F.lit("usd")).alias("unit"),
        periods.parse_period(F.col("quote")).alias("period"), F.lit(None).cast("string").alias("dimension"), "quote")


def quote_offset(quote: Column, source: Column) -> Column:
    """0-based offset of a quote in a text, tolerant to reflowed whitespace; -1 when absent."""
    escaped = F.regexp_replace(strip(quote), r"([\\\[\](){}.*+?^$|\-])", r"\\$1")
    pattern = F.regexp_replace(escaped, WS + "+", r"\\s+")
    exact = F.instr(source, quote)
    reflowed = F.when(strip(quote) == "", F.lit(0)).otherwise(F.regexp_instr(source, pattern))
    return F.when(exact > 0, exact - 1).otherwise(reflowed - 1)


def value_in_quote(value: Column, quote: Column) -> Column:
    figure = r"[€$£]?\p{Nd}[\p{Nd}.,\s]*\s?(?:bn|[kKmMbB])?%?"
    numeric = let(numbers.parse_num(value), lambda want: F.exists(
        F.regexp_extract_all(quote, F.lit(figure), F.lit(0)), lambda f: numbers.parse_num(f) == want))
    return ((value != "") & quote.contains(value)) | F.coalesce(numeric, F.lit(False))


def validate_prose(proposals: DataFrame, text: str = "text", file_name: str | None = None) -> DataFrame:
    """Adds ``offset`` and ``reason``; the source text travels in the proposal's own row."""
    want, hay = cell_norm(F.col("metric_raw")), cell_norm(F.col("quote"))
    named = periods.parse_period(F.col(file_name)) if file_name else F.lit(None).cast("string")
    period_ok = (F.col("period").isNull() | (F.col("period") == "")
                 | F.coalesce(periods.parse_period(F.col("quote")) == F.col("period"), F.lit(False))
                 | F.coalesce(named == F.col("period"), F.lit(False)))
    judged = (proposals.withColumn("offset", quote_offset(strip(F.col("quote")), F.col(text)))
              .withColumn("reason", F.when(F.col("offset") < 0, F.lit("quote-not-in-source"))
                          .when(~value_in_quote(F.col("value_raw"), F.col("quote")), F.lit("value-not-in-quote"))
                          .when((F.length(want) < 2) | ~hay.contains(want), F.lit("label-not-in-quote"))
                          .when(~period_ok, F.lit("period-not-in-quote")))
              .drop(text))
    key = ["file_id", "metric", "value_raw", "offset"]
    first = (judged.filter(F.col("reason").isNull()).groupBy(*key)
             .agg(F.min("proposal_no").alias("_first"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).drop("_n"))
    return (judged.join(first, key, "left")
            .withColumn("reason", F.coalesce("reason", F.when(F.col("proposal_no") > F.col("_first"), F.lit("duplicate"))))
            .drop("_first"))


def prose_source_ref(file_id: Column, offset: Column) -> Column:
    return F.concat_ws("!", file_id, F.lit("text"), offset.cast("string"))


# --- the store -----------------------------------------------------------------------------------
def store_rows(kept: DataFrame, pages: DataFrame, extracted_at: Column) -> DataFrame:
    """Validated observations as store rows; a fact inherits page, entity, unit and audience.

    ``pages``: file_id, page_path, entity, org_unit, acl array<string>.
    """
    return (kept.join(pages, "file_id", "left")
            .withColumns({"value_num": numbers.parse_num(F.col("value_raw")), "extracted_at": extracted_at,
                          "verified": F.lit(1), "acl": F.array_join("acl", ",")})
            .select(*FACT_COLUMNS))


def replace_facts(store: DataFrame, batch: DataFrame, touched: DataFrame) -> DataFrame:
    """Replace-by-document: every touched file loses its old rows, the batch supplies the new."""
    return store.join(touched.select("file_id").distinct(), "file_id", "left_anti").unionByName(
        batch, allowMissingColumns=True)


def delete_facts(store: DataFrame, removed: DataFrame) -> DataFrame:
    return store.join(removed.select("file_id").distinct(), "file_id", "left_anti")


def in_display_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*[F.asc_nulls_first(c) for c in ("entity", "metric", "period", "source_ref")])


def matching(store: DataFrame, metric: str | None = None, entity: str | None = None,
             period: str | None = None, audiences: Iterable[str] | None = None) -> DataFrame:
    """Verified rows for exact metric/entity and a period or anything finer; scoped to the client."""
    rows = store.filter(F.col("verified") == 1)
    if metric:
        rows = rows.filter(F.col("metric") == metric.strip().lower())
    if entity:
        rows = rows.filter(F.col("entity") == entity.strip().lower())
    if period:
        rows = rows.filter((F.col("period") == period) | F.col("period").startswith(period + "-"))
    if audiences is not None and "acl" not in store.columns:
        return rows.filter(F.lit(False))           # no audience information is not "open"
    return rows.filter(visible(F.filter(F.split("acl", ","), lambda a: a != ""), audiences)) \
        if audiences is not None else rows


def query_facts(store: DataFrame, metric=None, entity=None, period=None, limit: int | None = 100,
                audiences: Iterable[str] | None = None, exclude_pages: DataFrame | None = None) -> DataFrame:
    """Scope and exclusions first, then order, then the limit."""
    rows = matching(store, metric, entity, period, audiences)
    if exclude_pages is not None:
        rows = rows.join(exclude_pages.select(F.col("path").alias("page_path")).distinct(), "page_path", "left_anti")
    ordered = in_display_order(rows)
    return ordered.limit(limit) if limit else ordered


def flag_superseded(rows: DataFrame, superseded: DataFrame) -> DataFrame:
    stale = superseded.select(F.col("path").alias("page_path")).distinct().withColumn("from_superseded_page", F.lit(True))
    return (rows.join(stale, "page_path", "left")
            .withColumn("from_superseded_page", F.coalesce("from_superseded_page", F.lit(False))))


def current_truth(rows: DataFrame, superseded: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of ``keys``: the current rows, or the flagged stale ones when nothing is current."""
    flagged = flag_superseded(rows, superseded)
    # one flag per group, combined on the map side, then one join
    groups = flagged.groupBy(*keys).agg(F.min("from_superseded_page").alias("_all_stale")).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [flagged[k].eqNullSafe(groups[f"_{k}"]) for k in keys]
    return flagged.join(groups, same).filter(~F.col("from_superseded_page") | F.col("_all_stale")).select(*flagged.columns)


def latest_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each group in display order (the latest period)."""
    order = F.struct(F.coalesce("period", F.lit("")).alias("p"), "source_ref")
    payload = F.struct(order.alias("o"), *[F.col(c) for c in rows.columns if c not in keys and c != "source_ref"])
    return (rows.groupBy(*keys).agg(F.max(payload).alias("last"))
            .select(*keys, F.col("last.o.source_ref").alias("source_ref"),
                    *[F.col(f"last.{c}") for c in rows.columns if c not in keys and c != "source_ref"]))


def listing(rows: DataFrame, superseded: DataFrame, limit: int = 30) -> DataFrame:
    """Rows shown to a reader: current ones fill the limit first, display order afterwards."""
    flagged = flag_superseded(rows, superseded).dropDuplicates(["page_path", "source_ref"])
    chosen = flagged.orderBy("from_superseded_page", *[F.asc_nulls_first(c) for c in
                                                       ("entity", "metric", "period", "source_ref")]).limit(limit)
    return in_display_order(chosen)


def known_metrics(store: DataFrame, entity: str | None = None, audiences: Iterable[str] | None = None) -> DataFrame:
    return matching(store, entity=entity, audiences=audiences).select("metric").distinct()


def match_metric(metrics: DataFrame, tokens: list[str]) -> DataFrame:
    """Most specific metric id whose parts all occur among the question tokens."""
    expanded = sorted(set(tokens) | {p for t in tokens for p in t.split("-")})
    parts = F.array_distinct(F.split("metric", "-"))
    return (metrics.withColumn("parts", F.size(F.split("metric", "-")))
            .filter(F.size(F.array_except(parts, F.array(*[F.lit(t) for t in expanded]).cast("array<string>"))) == 0)
            .orderBy(F.desc("parts"), "metric").limit(1).select("metric"))
