"""Inputs of the catalogue queries, derived from the given tables.

Every view exists twice: as a Spark plan and as a SQL common table expression for the oracle.
Column expressions that both engines read the same way are shared as text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourceloom.sources.tables import read_table


# tables whose rows carry long text: worth spreading over the cores when they arrive as one split
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", TEXT_KEYS.get(name))


def _sql(fields: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in fields.items())


def _spark(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in fields.items()])


S = "CAST(substr(source, 4) AS INT)"


def s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


# --- a file tree over the documents ----------------------------------------------------------------
_BASE = (f"CASE doc_id % 9 WHEN 0 THEN 'Quarterly Report Q' || {s('1 + doc_id % 4')} || ' ' || {s('2020 + doc_id % 6')} "
         "WHEN 1 THEN 'Board Minutes' WHEN 2 THEN 'Mutual NDA' WHEN 3 THEN 'Invoice' WHEN 4 THEN 'Pitch Deck' "
         "WHEN 5 THEN 'Roadmap' WHEN 6 THEN 'Design Spec' WHEN 7 THEN 'Field Notes' ELSE 'KPI Summary' END")
_MARK = ("CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN ' FINAL' WHEN 2 THEN ' draft' WHEN 3 THEN ' v2' "
         "WHEN 4 THEN ' (1)' ELSE ' copy' END")
_EXT = ("CASE doc_id % 7 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.csv' WHEN 3 THEN '.pdf' "
        "WHEN 4 THEN '.PNG' WHEN 5 THEN '.css' ELSE '.docx' END")
_FOLDER = (f"CASE {S} % 5 WHEN 0 THEN 'Clients/' || {s(f'2020 + {S} % 4')} || '/' || {s(f'{S} + 1')} || '. Company ' || {s(S)} || ' - archived' "
           f"WHEN 1 THEN 'Portfolio/' || {s(f'{S} + 1')} || '. Société ' || {s(S)} "
           f"WHEN 2 THEN 'Pipeline/Evaluating/Prospect ' || {s(S)} || ' (closed)' "
           f"WHEN 3 THEN 'Research/' || lang || '/Company ' || {s(f'{S} - 3')} ELSE 'Ops/' || lang END")
_NAME = f"({_BASE}) || ({_MARK}) || ({_EXT})"
_PATH = (f"CASE WHEN {S} = 19 THEN './r' || {s('doc_id')} || ' ' || {_NAME} "
         f"ELSE './' || ({_FOLDER}) || '/d' || {s('doc_id')} || '/' || {_NAME} END")
FILE_FIELDS = {"file_id": f"'f' || {s('doc_id')}", "doc_id": "doc_id", "path": _PATH, "name": _NAME,
               "size": "n_chars", "hash": "md5(text)", "lang": "lang", "s": S}
FILES_SQL = f"files AS (SELECT {_sql(FILE_FIELDS)} FROM documents)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(table(spark, sf_dir, "documents"), FILE_FIELDS)


# --- an index of pages over the documents ----------------------------------------------------------
PAGE_FIELDS = {
    "path": f"'p/' || lpad({s('doc_id')}, 9, '0') || '.md'", "doc_id": "doc_id", "title": _BASE, "body": "text", "tags": "lang",
    "entity": f"'entity-' || {s(S)}", "mentions": "''",
    "verification": "CASE doc_id % 4 WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' ELSE 'verified' END",
    "quality": "CASE WHEN doc_id % 11 = 0 THEN 'manual_review' ELSE 'usable' END",
    "superseded_by": f"CASE WHEN doc_id % 7 = 0 THEN 'f' || {s('doc_id + 1')} ELSE '' END",
    "as_of": f"{s('2020 + doc_id % 6')} || '-Q' || {s('1 + doc_id % 4')}",
    "period": f"CASE WHEN doc_id % 3 = 0 THEN {s('2020 + doc_id % 6')} ELSE '' END",
    "acl_csv": f"CASE {S} % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'sales,eng' ELSE 'finance' END",
}
INDEX_SQL = f"idx AS (SELECT {_sql(PAGE_FIELDS)} FROM documents)"
QUESTION = f"'current entity-' || {s('item_id % 20')} || ' in 2023 ' || text"


def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sourceloom.functions.access import decode_csv
    return (_spark(table(spark, sf_dir, "documents"), PAGE_FIELDS)
            .withColumn("acl", decode_csv(F.col("acl_csv"))))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").selectExpr("item_id AS question_id", f"{QUESTION} AS question")


# --- reports: a source text and a page written from it, with seeded defects ------------------------
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, body, context: one order figure is added to each document.

    Pages are faithful, carry invented figures, tie the figure to the next month, or both.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_totalprice", "o_orderdate")

    def month(c):
        return F.concat((F.year(c) + 5).cast("string"), F.lit("-"), F.date_format(c, "MM"))

    total = F.format_string("%.2f", "o_totalprice")
    right = F.concat(F.lit("\nOrder revenue in "), month(F.col("o_orderdate")), F.lit(" reached $"), total, F.lit("."))
    wrong = F.concat(F.lit("\nOrder revenue in "), month(F.add_months("o_orderdate", 1)), F.lit(" reached $"), total, F.lit("."))
    invented = F.lit("\nRevenue soared to $99.9M with a 77% margin.")
    source = F.concat("text", right, F.lit("\nHeadcount was 42 people."))
    kind = F.col("doc_id") % 4
    body = F.concat("text", F.when(kind < 2, right).otherwise(wrong),
                    F.when(kind % 2 == 1, invented).otherwise(F.lit("")))
    # a document without an order reports a fixed one
    fixed = {"o_totalprice": F.coalesce("o_totalprice", F.lit(1000.0)), "o_orderdate": F.coalesce("o_orderdate", F.lit("1996-01-15").cast("timestamp"))}
    return d.join(o, "doc_id", "left").withColumns(fixed).select(
        "doc_id", source.alias("source"), body.alias("body"),
        F.concat(F.lit("Report "), F.col("doc_id").cast("string"), F.lit(".md")).alias("context"))


REPORTS_SQL = """
o5 AS (SELECT o_orderkey AS doc_id, printf('%.2f', o_totalprice) AS total,
         CAST(year(o_orderdate) + 5 AS VARCHAR) || '-' || strftime(o_orderdate, '%m') AS m1,
         CAST(year(o_orderdate + INTERVAL 1 MONTH) + 5 AS VARCHAR) || '-' || strftime(o_orderdate + INTERVAL 1 MONTH, '%m') AS m2
       FROM orders),
reports AS (SELECT d.doc_id,
    text || chr(10) || 'Order revenue in ' || m1 || ' reached $' || total || '.' || chr(10) || 'Headcount was 42 people.' AS source,
    text || chr(10) || 'Order revenue in ' || CASE WHEN d.doc_id % 4 < 2 THEN m1 ELSE m2 END || ' reached $' || total || '.'
         || CASE WHEN d.doc_id % 2 = 1 THEN chr(10) || 'Revenue soared to $99.9M with a 77% margin.' ELSE '' END AS body,
    'Report ' || CAST(d.doc_id AS VARCHAR) || '.md' AS context
  FROM (SELECT d.doc_id, text, coalesce(total, '1000.00') AS total, coalesce(m1, '2001-01') AS m1, coalesce(m2, '2001-02') AS m2
        FROM documents d LEFT JOIN o5 ON o5.doc_id = d.doc_id) d)"""


# --- monthly sheets per customer ---------------------------------------------------------------------
def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ym = F.concat((F.year("o_orderdate") + 5).cast("string"), F.lit("-"), F.date_format("o_orderdate", "MM"))
    return o.groupBy("o_custkey", ym.alias("ym")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("revenue"),
        F.max(F.col("o_totalprice").cast("decimal(18,2)")).alias("largest"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid per customer: header row, then one row per month (a bounded calendar)."""
    m = monthly(spark, sf_dir)
    rows = m.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file_id"), F.lit("Sheet1").alias("sheet"),
        (F.row_number().over(W.partitionBy("o_custkey").orderBy("ym")) + 1).alias("row"),
        F.array("ym", F.col("orders").cast("string"), F.col("revenue").cast("string"),
                F.concat(F.col("largest").cast("string"), F.lit(" USD"))).alias("values"))
    header = (m.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file_id")).distinct()
              .select("file_id", F.lit("Sheet1").alias("sheet"), F.lit(1).alias("row"),
                      F.array(*[F.lit(h) for h in ("month", "order count", "Revenue USD", "largest order")]).alias("values")))
    return header.unionByName(rows)


MONTHLY_SQL = """
monthly AS (SELECT o_custkey, CAST(year(o_orderdate) + 5 AS VARCHAR) || '-' || strftime(o_orderdate, '%m') AS ym,
    count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue, max(CAST(o_totalprice AS DECIMAL(18,2))) AS largest
  FROM orders GROUP BY 1, 2),
sheet_rows AS (SELECT *, 'c' || CAST(o_custkey AS VARCHAR) AS file_id,
    row_number() OVER (PARTITION BY o_custkey ORDER BY ym) + 1 AS r FROM monthly)"""

FACTS_SQL = MONTHLY_SQL + """,
obs AS (
  SELECT file_id, o_custkey, r AS row_no, 2 AS col_no, ym AS period, 'order-count' AS metric, 'order count' AS metric_raw,
         CAST(orders AS VARCHAR) AS value_raw, CAST(orders AS DOUBLE) AS value_num, CAST(NULL AS VARCHAR) AS unit FROM sheet_rows
  UNION ALL
  SELECT file_id, o_custkey, r, 3, ym, 'revenue-usd', 'Revenue USD', CAST(revenue AS VARCHAR), CAST(revenue AS DOUBLE), 'usd' FROM sheet_rows
  UNION ALL
  SELECT file_id, o_custkey, r, 4, ym, 'largest-order', 'largest order', CAST(largest AS VARCHAR) || ' USD', CAST(largest AS DOUBLE), NULL FROM sheet_rows),
facts AS (SELECT o.*, 'nation-' || CAST(c_nationkey AS VARCHAR) AS entity, 'units/c' || CAST(o.o_custkey AS VARCHAR) || '.md' AS page_path,
    o.file_id || '!Sheet1!R' || CAST(row_no AS VARCHAR) || 'C' || CAST(col_no AS VARCHAR) AS source_ref,
    CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN '' WHEN 'HOUSEHOLD' THEN 'sales,eng' ELSE 'finance' END AS acl
  FROM obs o JOIN customer c ON c.c_custkey = o.o_custkey),
stale AS (SELECT DISTINCT 'units/c' || CAST(c_custkey AS VARCHAR) || '.md' AS path FROM customer WHERE c_acctbal < 3000)"""


def fact_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sourceloom.operators import facts as ops
    c = table(spark, sf_dir, "customer")
    acl = F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN '' "
                 "WHEN 'HOUSEHOLD' THEN 'sales,eng' ELSE 'finance' END")
    key = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    pages = c.select(key.alias("file_id"), F.concat(F.lit("units/"), key, F.lit(".md")).alias("page_path"),
                     F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("entity"),
                     F.col("c_mktsegment").alias("org_unit"), F.split(acl, ",").alias("acl"))
    kept = ops.grid_observations(sheets(spark, sf_dir)).withColumn(
        "source_ref", ops.grid_source_ref(F.col("file_id"), F.col("sheet"), F.col("row"), F.col("col")))
    return ops.store_rows(kept, pages, F.lit("2026-01-01T00:00:00"))


def superseded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") < 3000)
    return c.select(F.concat(F.lit("units/c"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"))


# --- figures in SQL -------------------------------------------------------------------------------------
def sql_runs(col: str) -> str:
    """Mark the start of every run of word characters, dots and commas (no look-behind in the oracle)."""
    return rf"regexp_replace({col}, '([\p{{L}}\p{{N}}_.,]+)', '¦\1', 'g')"


SQL_NUMBER = r"(?:[0-9]{1,3}(?:[.,][0-9]{3})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?)"
SQL_FIGURE = rf"¦({SQL_NUMBER}(?:\s?¦?(?:bn|[kKmMbB]))?(?:\s?%)?)(?:[^\p{{L}}\p{{N}}_¦]|¦[.,]|$)"


def sql_figures(col: str) -> str:
    return (rf"list_transform(regexp_extract_all({sql_runs(col)}, '{SQL_FIGURE}', 1), "
            r"lambda x: regexp_replace(replace(x, '¦', ''), '\s+', ' ', 'g'))")


def sql_values(num: str) -> str:
    return f"""CASE WHEN contains({num}, '.') AND contains({num}, ',') THEN
        [TRY_CAST(CASE WHEN strpos(reverse({num}), '.') < strpos(reverse({num}), ',') THEN replace({num}, ',', '')
                  ELSE replace(replace({num}, '.', ''), ',', '.') END AS DOUBLE)]
      WHEN regexp_matches({num}, '[.,].*[.,]') THEN [TRY_CAST(regexp_replace({num}, '[.,]', '', 'g') AS DOUBLE)]
      WHEN regexp_matches({num}, '[.,][0-9]{{3}}$') THEN
        [TRY_CAST(regexp_replace({num}, '[.,]', '') AS DOUBLE), TRY_CAST(replace({num}, ',', '.') AS DOUBLE)]
      ELSE [TRY_CAST(replace({num}, ',', '.') AS DOUBLE)] END"""


SQL_MAGNITUDE = ("CASE lower(regexp_extract({0}, '(bn|[kKmMbB])', 1)) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 "
                 "WHEN 'b' THEN 1e9 WHEN 'bn' THEN 1e9 ELSE 1.0 END")


def sql_keys(display: str) -> str:
    """Value keys of one displayed figure, as text at six significant digits."""
    num = f"regexp_extract({display}, '^[0-9.,]+')"
    values = f"list_filter({sql_values(num)}, lambda v: v IS NOT NULL)"
    mag = SQL_MAGNITUDE.format(display)
    return (f"list_distinct(list_concat(list_transform({values}, lambda v: printf('%.5e', v)), "
            f"list_transform({values}, lambda v: printf('%.5e', v * {mag}))))")


def sql_spaced(col: str) -> str:
    """Values of space-grouped thousands (boundaries emulated by splitting at digit runs)."""
    marked = rf"regexp_replace({col}, '([0-9]+)', '¤\1¤', 'g')"
    return (rf"list_transform(regexp_extract_all({marked}, '¤[0-9]{{1,3}}¤(?:[  ]¤[0-9]{{3}}¤)+'), "
            r"lambda x: printf('%.5e', CAST(regexp_replace(x, '[^0-9]', '', 'g') AS DOUBLE)))")
