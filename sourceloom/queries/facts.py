"""Catalogue: the facts store."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourceloom.operators import facts as ops
from sourceloom.queries.registry import query
from sourceloom.session import cut_lineage
from sourceloom.queries.views import (FACTS_SQL, MONTHLY_SQL, REPORTS_SQL, fact_store, reports, sheets, superseded_pages, table)


@query("grid_cells", f"""WITH {MONTHLY_SQL} SELECT file_id, CAST(r AS BIGINT) AS row_no, col_no, value FROM (
  SELECT file_id, r, unnest([1, 2, 3, 4])::BIGINT AS col_no,
         unnest([ym, CAST(orders AS VARCHAR), CAST(revenue AS VARCHAR), CAST(largest AS VARCHAR) || ' USD']) AS value FROM sheet_rows
  UNION ALL SELECT DISTINCT file_id, 1, unnest([1, 2, 3, 4])::BIGINT, unnest(['month', 'order count', 'Revenue USD', 'largest order']) FROM sheet_rows)""")
def grid_cells(spark, sf):
    return ops.cells(sheets(spark, sf)).select("file_id", F.col("row").cast("bigint").alias("row_no"),
                                               F.col("col").cast("bigint").alias("col_no"), "value")


@query("facts_grid", f"""WITH {FACTS_SQL} SELECT file_id, CAST(row_no AS BIGINT) AS row_no, CAST(col_no AS BIGINT) AS col_no,
  metric, metric_raw, value_raw, unit, period FROM obs""")
def facts_grid(spark, sf):
    return ops.grid_observations(sheets(spark, sf)).select(
        "file_id", F.col("row").cast("bigint").alias("row_no"), F.col("col").cast("bigint").alias("col_no"),
        "metric", "metric_raw", "value_raw", "unit", "period")


_PROPOSED = """
prop0 AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_no, col_no) AS n, o_custkey % 6 AS k FROM obs),
prop AS (SELECT file_id, n, k, row_no, col_no FROM prop0),
reasons AS (
  SELECT file_id, n, CASE WHEN n = 1 AND k = 1 THEN 'bad-coordinates' WHEN n = 1 AND k = 2 THEN 'value-not-in-cell'
     WHEN n = 1 AND k = 3 THEN 'label-not-found' WHEN n = 1 AND k = 4 THEN 'period-not-found' END AS reason FROM prop
  UNION ALL SELECT file_id, n + 100000, CASE WHEN k = 5 THEN 'duplicate-cell' END FROM prop WHERE k = 5 AND n = 1)"""


@query("facts_validate", f"WITH {FACTS_SQL}, {_PROPOSED} SELECT file_id, CAST(n AS BIGINT) AS proposal_no, reason FROM reasons")
def facts_validate(spark, sf):
    """Grid proposals with one seeded defect per customer sheet, of a kind chosen by its number."""
    grid = cut_lineage(sheets(spark, sf))       # a stored table in production
    order = W.partitionBy("file_id").orderBy("row", "col")
    p = ops.grid_observations(grid).withColumns({
        "proposal_no": F.row_number().over(order).cast("bigint"),
        "k": F.substring("file_id", 2, 20).cast("bigint") % 6})
    first = F.col("proposal_no") == 1
    p = (p.withColumn("row", F.when(first & (F.col("k") == 1), F.lit(9999)).otherwise(F.col("row")))
         .withColumn("value_raw", F.when(first & (F.col("k") == 2), F.lit("999999")).otherwise(F.col("value_raw")))
         .withColumn("metric_raw", F.when(first & (F.col("k") == 3), F.lit("net margin")).otherwise(F.col("metric_raw")))
         .withColumn("period", F.when(first & (F.col("k") == 4), F.lit("2099-01")).otherwise(F.col("period"))))
    twice = p.filter(first & (F.col("k") == 5)).withColumn("proposal_no", F.col("proposal_no") + 100000)
    return ops.validate_grid(cut_lineage(p.unionByName(twice)), grid).select("file_id", "proposal_no", "reason")


@query("facts_store", f"""WITH {FACTS_SQL} SELECT file_id, page_path, entity, metric, value_raw, round(value_num, 4) AS value_num,
  unit, period, source_ref, acl FROM facts""")
def facts_store(spark, sf):
    return fact_store(spark, sf).select("file_id", "page_path", "entity", "metric", "value_raw",
                                        F.round("value_num", 4).alias("value_num"), "unit", "period", "source_ref", "acl")


_SHOW = ["file_id", "entity", "metric", "period", "value_raw", "source_ref"]
_COLS = "file_id, entity, metric, period, value_raw, source_ref"
_ORDER = "ORDER BY entity NULLS FIRST, metric NULLS FIRST, period NULLS FIRST, source_ref NULLS FIRST"


@query("facts_query_prefix", f"""WITH {FACTS_SQL} SELECT {_COLS} FROM facts WHERE metric = 'revenue-usd'
  AND (period = '2004' OR starts_with(period, '2004-')) {_ORDER} LIMIT 100""")
def facts_query_prefix(spark, sf):
    return ops.query_facts(fact_store(spark, sf), metric=" Revenue-USD ", period="2004").select(*_SHOW)


@query("facts_query_entity", f"""WITH {FACTS_SQL} SELECT {_COLS} FROM facts WHERE entity = 'nation-3' AND period = '2003-05' {_ORDER}""")
def facts_query_entity(spark, sf):
    return ops.query_facts(fact_store(spark, sf), entity="NATION-3", period="2003-05", limit=None).select(*_SHOW)


@query("facts_query_scoped", f"""WITH {FACTS_SQL} SELECT {_COLS} FROM facts WHERE metric = 'order-count'
  AND (acl IS NULL OR contains(',' || acl || ',', ',eng,')) AND page_path NOT IN (SELECT path FROM stale) {_ORDER} LIMIT 50""")
def facts_query_scoped(spark, sf):
    return ops.query_facts(fact_store(spark, sf), metric="order-count", limit=50, audiences={"eng"},
                           exclude_pages=superseded_pages(spark, sf)).select(*_SHOW)


@query("known_metrics", f"""WITH {FACTS_SQL} SELECT DISTINCT metric FROM facts WHERE entity = 'nation-7' AND (acl IS NULL OR contains(',' || acl || ',', ',sales,'))""")
def known_metrics(spark, sf):
    return ops.known_metrics(fact_store(spark, sf), entity="nation-7", audiences={"sales"})


@query("match_metric", f"""WITH {FACTS_SQL} SELECT metric FROM (SELECT DISTINCT metric, string_split(metric, '-') AS parts FROM facts)
  WHERE list_has_all(['what', 'was', 'the', 'revenue', 'in', 'usd', 'order'], parts) ORDER BY len(parts) DESC, metric LIMIT 1""")
def match_metric(spark, sf):
    return ops.match_metric(ops.known_metrics(fact_store(spark, sf)), ["what", "was", "the", "revenue", "in", "usd", "order"])


@query("superseded_flag", f"""WITH {FACTS_SQL} SELECT source_ref, stale.path IS NOT NULL AS from_superseded_page
  FROM facts LEFT JOIN stale ON stale.path = page_path""")
def superseded_flag(spark, sf):
    return ops.flag_superseded(fact_store(spark, sf), superseded_pages(spark, sf)).select("source_ref", "from_superseded_page")


@query("facts_current_truth", f"""WITH {FACTS_SQL}, f AS (SELECT facts.*, stale.path IS NOT NULL AS old FROM facts LEFT JOIN stale ON stale.path = page_path),
  g AS (SELECT entity, metric, period, bool_and(old) AS all_old FROM f GROUP BY ALL)
SELECT source_ref, old AS from_superseded_page FROM f JOIN g USING (entity, metric, period) WHERE NOT old OR all_old""")
def facts_current_truth(spark, sf):
    return ops.current_truth(fact_store(spark, sf), superseded_pages(spark, sf), ["entity", "metric", "period"]).select(
        "source_ref", "from_superseded_page")


@query("facts_latest", f"""WITH {FACTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY period DESC, source_ref DESC) AS rn
  FROM facts WHERE page_path NOT IN (SELECT path FROM stale)) SELECT entity, metric, period, value_raw, source_ref FROM r WHERE rn = 1""")
def facts_latest(spark, sf):
    current = ops.query_facts(fact_store(spark, sf), limit=None, exclude_pages=superseded_pages(spark, sf))
    rows = current.select("entity", "metric", "period", "value_raw", "source_ref")
    return ops.latest_rows(rows, ["entity", "metric"]).select("entity", "metric", "period", "value_raw", "source_ref")


@query("facts_listing", f"""WITH {FACTS_SQL}, f AS (SELECT facts.*, stale.path IS NOT NULL AS old FROM facts LEFT JOIN stale ON stale.path = page_path
  WHERE entity = 'nation-5' AND metric = 'revenue-usd' AND starts_with(period, '2002'))
SELECT {_COLS}, old AS from_superseded_page FROM f ORDER BY old, {_ORDER[9:]} LIMIT 30""")
def facts_listing(spark, sf):
    rows = ops.matching(fact_store(spark, sf), "revenue-usd", "nation-5").filter(F.col("period").startswith("2002"))
    return ops.listing(rows, superseded_pages(spark, sf)).select(*_SHOW, "from_superseded_page")


@query("facts_replace", f"""WITH {FACTS_SQL}, t AS (SELECT DISTINCT file_id FROM facts WHERE o_custkey % 4 = 1)
SELECT source_ref, value_raw FROM facts WHERE file_id NOT IN (SELECT file_id FROM t)
UNION ALL SELECT source_ref, 'revised ' || value_raw FROM facts WHERE file_id IN (SELECT file_id FROM t) AND metric = 'order-count'""")
def facts_replace(spark, sf):
    store = fact_store(spark, sf)
    touched = store.filter(F.substring("file_id", 2, 20).cast("bigint") % 4 == 1)
    batch = touched.filter(F.col("metric") == "order-count").withColumn("value_raw", F.concat(F.lit("revised "), "value_raw"))
    return ops.replace_facts(store, batch, touched).select("source_ref", "value_raw")


@query("facts_delete", f"""WITH {FACTS_SQL} SELECT source_ref FROM facts WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def facts_delete(spark, sf):
    gone = table(spark, sf, "customer").filter("c_acctbal < 0").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("file_id"))
    return ops.delete_facts(fact_store(spark, sf), gone).select("source_ref")


_PROSE = REPORTS_SQL + r"""
, sent AS (SELECT doc_id, source, unnest(string_split(regexp_replace(source, '([.!?])\s+', '\1§', 'g'), '§')) AS sentence FROM reports),
fig AS (SELECT *, regexp_extract(sentence, '[€$£]\s?[0-9][0-9.,]*\s?(?:bn|[kKmMbB])?|(?:^|[^\p{L}\p{N}_])[0-9][0-9.,]*\s?(?:bn|[kKmMbB])(?:[^\p{L}\p{N}_-]|$)') AS figure,
  list_filter(regexp_extract_all(sentence, '[A-Za-z]+'), lambda w: lower(w) NOT IN ('the', 'a', 'an', 'for', 'of', 'in', 'on', 'was', 'is', 'our', 'this', 'that')) AS words FROM sent)"""


@query("facts_prose", f"""WITH {_PROSE} SELECT doc_id, lower(words[1] || '-' || words[2]) AS metric, words[1] || ' ' || words[2] AS metric_raw,
  trim(regexp_replace(figure, '^[€$£ ]+', '')) AS value_raw, CASE WHEN contains(figure, '$') THEN 'usd' END AS unit,
  trim(regexp_replace(sentence, '\\s+', ' ', 'g')) AS quote
FROM fig WHERE figure <> '' AND len(words) >= 2""")
def facts_prose(spark, sf):
    d = reports(spark, sf).withColumn("file_id", F.col("doc_id"))
    return ops.prose_observations(d, "source").select(
        F.col("file_id").alias("doc_id"), "metric", "metric_raw", "value_raw", "unit", "quote")


@query("prose_validate", f"""WITH {_PROSE},
p AS (SELECT doc_id, source, doc_id % 6 AS k FROM reports)
SELECT doc_id, CASE k WHEN 1 THEN 'quote-not-in-source' WHEN 2 THEN 'value-not-in-quote' WHEN 3 THEN 'label-not-in-quote' WHEN 4 THEN 'period-not-in-quote' END AS reason,
  CASE WHEN k = 1 THEN CAST(-1 AS BIGINT) ELSE CAST(strpos(source, 'Order revenue in 20') - 1 AS BIGINT) END AS quote_at FROM p""")
def prose_validate(spark, sf):
    """One proposal per report about its order figure, with a seeded defect by number."""
    d = reports(spark, sf)
    k = F.col("doc_id") % 6
    sentence = F.regexp_extract("source", r"(Order revenue in 20\d\d-\d\d reached \$[0-9.]+\.)", 1)
    quote = F.when(k == 5, F.replace(sentence, F.lit(" "), F.lit("\n "))).when(
        k == 1, F.lit("revenue was never stated")).otherwise(sentence)
    p = d.select(
        F.col("doc_id").alias("file_id"), F.lit(1).alias("proposal_no"), F.lit("order-revenue").alias("metric"),
        F.when(k == 3, F.lit("net margin")).otherwise(F.lit("Order revenue")).alias("metric_raw"),
        F.when(k == 2, F.lit("123456789")).otherwise(F.regexp_extract(sentence, r"\$([0-9.]+)\.$", 1)).alias("value_raw"),
        F.when(k == 4, F.lit("2099")).otherwise(F.regexp_extract(sentence, r"in (20\d\d-\d\d)", 1)).alias("period"),
        quote.alias("quote"), F.col("source").alias("text"))
    return ops.validate_prose(p).select(F.col("file_id").alias("doc_id"), "reason", F.col("offset").cast("bigint").alias("quote_at"))
