"""Catalogue: figures, periods, page and answer verification, claims."""
from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.functions import numbers, periods
from sourceloom.functions.words import split_claims
from sourceloom.operators import claims, verification as ops
from sourceloom.queries.registry import query
from sourceloom.queries.views import (REPORTS_SQL, reports, sql_figures, sql_keys, sql_spaced, table)

_WEAK = "regexp_full_match(x, '[0-9]')"


def _shown(view: str, col: str) -> str:
    return (f"SELECT doc_id, display, count(*) AS occurrences FROM (SELECT doc_id, unnest(list_filter({sql_figures(col)}, "
            f"lambda x: NOT {_WEAK})) AS display FROM {view}) GROUP BY ALL")


def _pool(view: str, hay: str) -> str:
    return (f"SELECT DISTINCT doc_id, key FROM (SELECT doc_id, unnest({sql_keys('display')}) AS key FROM "
            f"(SELECT DISTINCT doc_id, unnest({sql_figures(hay)}) AS display FROM {view}) "
            f"UNION ALL SELECT doc_id, unnest({sql_spaced(hay)}) FROM {view})")


@query("figures_tokens", _shown("documents", "text"))
def figures_tokens(spark, sf):
    return ops.figures(table(spark, sf, "documents"), ["doc_id"], F.col("text")).select("doc_id", "display", "occurrences")


@query("figures_values", f"SELECT doc_id, count(*) AS plausible_values FROM ({_pool('documents', 'text')}) GROUP BY doc_id")
def figures_values(spark, sf):
    pool = ops.evidence_values(table(spark, sf, "documents"), ["doc_id"], F.col("text"))
    return pool.groupBy("doc_id").agg(F.count(F.lit(1)).alias("plausible_values"))


_HAY = "source || chr(10) || context"
_PRESENCE = REPORTS_SQL + f""",
shown AS ({_shown('reports', 'body')}),
pool AS ({_pool('reports', _HAY)}),
hits AS (SELECT DISTINCT s.doc_id, s.display FROM (SELECT doc_id, display, unnest({sql_keys('display')}) AS key FROM shown) s
         JOIN pool p ON p.doc_id = s.doc_id AND p.key = s.key)"""


def _hay():
    return F.concat("source", F.lit("\n"), "context")


@query("figures_presence", f"WITH {_PRESENCE} SELECT s.doc_id, s.display, h.display IS NOT NULL AS present "
       "FROM shown s LEFT JOIN hits h ON h.doc_id = s.doc_id AND h.display = s.display")
def figures_presence(spark, sf):
    r = reports(spark, sf)
    shown = ops.figures(r, ["doc_id"], F.col("body"))
    return ops.figure_presence(shown, ops.evidence_values(r, ["doc_id"], _hay()), ["doc_id"]).select(
        "doc_id", "display", "present")


# Periods in SQL.  Non-ASCII letters become "z" so that the ASCII word boundary of the oracle agrees.
_ASCII = "regexp_replace({0}, '[^\\x00-\\x7F]', 'z', 'g')"
_MONTH_RE = (r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sept?(?:ember)?"
             r"|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\b\.?(?:\s*,?\s*20[0-9][0-9]\b)?")
_LINE_SIGNALS = f"""
sig0 AS (SELECT *, regexp_extract_all(l0, '\\b20[0-9][0-9][-/](?:1[0-2]|0?[1-9])\\b') AS ym,
   regexp_replace(l0, '\\b20[0-9][0-9][-/](?:1[0-2]|0?[1-9])\\b', '~', 'g') AS l1 FROM lines),
sig1 AS (SELECT *, regexp_extract_all(l1, '{_MONTH_RE}') AS mo, regexp_replace(l1, '{_MONTH_RE}', '~', 'g') AS l2 FROM sig0),
sig2 AS (SELECT *, regexp_extract_all(l2, '\\bQ[1-4]\\b') AS qu, regexp_extract_all(l2, '\\b20[0-9][0-9]\\b') AS ye FROM sig1),
sig AS (SELECT *, list_distinct(list_concat(
     list_transform(ym, lambda x: {{'y': CAST(substr(x, 1, 4) AS INT), 'q': CAST(NULL AS INT), 'm': CAST(substr(x, 6) AS INT)}}),
     list_transform(mo, lambda x: {{'y': TRY_CAST(regexp_extract(x, '20[0-9][0-9]') AS INT), 'q': CAST(NULL AS INT),
         'm': CAST((strpos('JanFebMarAprMayJunJulAugSepOctNovDec', substr(x, 1, 3)) + 2) // 3 AS INT)}}),
     list_transform(qu, lambda x: {{'y': CAST(NULL AS INT), 'q': CAST(substr(x, 2) AS INT), 'm': CAST(NULL AS INT)}}),
     list_transform(ye, lambda x: {{'y': CAST(x AS INT), 'q': CAST(NULL AS INT), 'm': CAST(NULL AS INT)}}))) AS signals FROM sig2)"""
_PERIOD_TXT = ("CASE WHEN p.y IS NULL THEN NULL WHEN p.m IS NOT NULL THEN p.y || '-' || lpad(CAST(p.m AS VARCHAR), 2, '0') "
               "WHEN p.q IS NOT NULL THEN p.y || '-Q' || p.q ELSE CAST(p.y AS VARCHAR) END")


@query("period_signals", f"""WITH {REPORTS_SQL},
lines AS (SELECT doc_id, {_ASCII.format('body')} AS l0 FROM reports), {_LINE_SIGNALS}
SELECT doc_id, y AS year, q AS quarter, m AS month FROM (SELECT doc_id, unnest(signals, recursive := true) FROM sig)""")
def period_signals(spark, sf):
    return (reports(spark, sf).select("doc_id", F.explode(periods.period_signals(F.col("body"))).alias("p"))
            .select("doc_id", F.col("p.y").alias("year"), F.col("p.q").alias("quarter"), F.col("p.m").alias("month")))


@query("parse_period", f"""WITH {REPORTS_SQL},
lines AS (SELECT doc_id, {_ASCII.format('l')} AS l0 FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS l FROM reports)), {_LINE_SIGNALS}
SELECT doc_id, {_PERIOD_TXT} AS period, count(*) AS lines FROM (SELECT doc_id, signals[1] AS p FROM sig WHERE len(signals) = 1)
WHERE p.y IS NOT NULL GROUP BY ALL""")
def parse_period(spark, sf):
    lines = reports(spark, sf).select("doc_id", F.explode(F.split("body", "\n")).alias("line"))
    return (lines.withColumn("period", periods.parse_period(F.col("line"))).filter(F.col("period").isNotNull())
            .groupBy("doc_id", "period").agg(F.count(F.lit(1)).alias("lines")))


@query("as_of_provable", f"""WITH {REPORTS_SQL}, p AS (SELECT doc_id, source, regexp_extract(source, 'in (20[0-9]{{2}}-[0-9]{{2}}) reached', 1) AS m FROM reports)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN m WHEN 1 THEN substr(m, 1, 4) ELSE NULL END AS as_of FROM p""")
def as_of_provable(spark, sf):
    """Proposed: the right month with a day, another month of the same year, or another year."""
    month = F.regexp_extract("source", r"in (20\d\d-\d\d) reached", 1)
    year = F.substring(month, 1, 4)
    other = F.when(F.substring(month, 6, 2) == "12", F.concat(year, F.lit("-01"))).otherwise(
        F.concat(year, F.lit("-"), F.lpad((F.substring(month, 6, 2).cast("int") + 1).cast("string"), 2, "0")))
    k = F.col("doc_id") % 3
    proposed = F.when(k == 0, F.concat(month, F.lit("-31"))).when(k == 1, other).otherwise(F.lit("2099-01"))
    return reports(spark, sf).select("doc_id", periods.provable_as_of(proposed, F.col("source")).alias("as_of"))


def _line_figures(col: str) -> str:
    return sql_figures(col)


_COMPAT = ("(a.y IS NULL OR b.y IS NULL OR a.y = b.y) AND (a.m IS NULL OR b.m IS NULL OR a.m = b.m) AND "
           "(coalesce(a.q, (a.m + 2) // 3) IS NULL OR coalesce(b.q, (b.m + 2) // 3) IS NULL "
           "OR coalesce(a.q, (a.m + 2) // 3) = coalesce(b.q, (b.m + 2) // 3))")
_DATE_TOKEN = r"regexp_replace({0}, '\b20[0-9][0-9](?:[-/](?:1[0-2]|0?[1-9]))?\b', 'z', 'g')"
_VERIFY = _PRESENCE + f""",
lines AS (SELECT doc_id, side, l, {_ASCII.format('l')} AS l0 FROM (
    SELECT doc_id, 'b' AS side, unnest(string_split(body, chr(10))) AS l FROM reports
    UNION ALL SELECT doc_id, 's', unnest(string_split({_HAY}, chr(10))) FROM reports)), {_LINE_SIGNALS},
asserted AS (SELECT row_number() OVER () AS occ, doc_id, display, signals FROM (
    SELECT doc_id, signals, unnest(list_filter({sql_figures(_DATE_TOKEN.format('l'))}, lambda x: NOT {_WEAK})) AS display
    FROM sig WHERE side = 'b' AND len(signals) > 0)),
src AS (SELECT doc_id, signals, unnest(list_distinct(list_concat(flatten(list_transform({sql_figures('l')}, lambda d: {sql_keys('d')})), {sql_spaced('l')}))) AS key
    FROM sig WHERE side = 's'),
occ AS (SELECT a.occ, a.doc_id, a.display, bool_or(len(s.signals) = 0 OR len(list_filter(a.signals, lambda a: len(list_filter(s.signals, lambda b: {_COMPAT})) > 0)) > 0) AS ok
    FROM (SELECT *, unnest({sql_keys('display')}) AS key FROM asserted) a JOIN src s ON s.doc_id = a.doc_id AND s.key = a.key GROUP BY ALL),
drift AS (SELECT DISTINCT doc_id, display FROM occ WHERE NOT ok),
judged AS (SELECT s.doc_id, count(*) AS numbers_total, count(*) FILTER (h.display IS NULL) AS n_unverified,
    count(*) FILTER (h.display IS NOT NULL AND d.display IS NOT NULL) AS n_unanchored,
    string_agg(CASE WHEN h.display IS NULL THEN s.display END, '; ' ORDER BY s.display) AS unverified
  FROM shown s LEFT JOIN hits h ON h.doc_id = s.doc_id AND h.display = s.display
  LEFT JOIN drift d ON d.doc_id = s.doc_id AND d.display = s.display GROUP BY s.doc_id),
verdicts AS (SELECT doc_id, numbers_total, n_unverified, n_unanchored, coalesce(unverified, '') AS unverified,
    CASE WHEN n_unverified + n_unanchored = 0 THEN 'verified' WHEN n_unverified + n_unanchored = 1
      OR n_unverified + n_unanchored <= 0.25 * numbers_total THEN 'partial' ELSE 'failed' END AS verdict FROM judged)"""


@query("verify_pages", f"WITH {_VERIFY} SELECT * FROM verdicts")
def verify_pages(spark, sf):
    return ops.verify_pages(reports(spark, sf), ["doc_id"]).select(
        "doc_id", "numbers_total", "n_unverified", "n_unanchored",
        F.array_join(F.array_sort("numbers_unverified"), "; ").alias("unverified"), "verdict")


@query("verdict_rollup", f"WITH {_VERIFY} SELECT verdict, count(*) AS pages, CAST(sum(numbers_total) AS BIGINT) AS figures FROM verdicts GROUP BY verdict")
def verdict_rollup(spark, sf):
    v = ops.verify_pages(reports(spark, sf), ["doc_id"])
    return v.groupBy("verdict").agg(F.count(F.lit(1)).alias("pages"), F.sum("numbers_total").alias("figures"))


@query("period_anchor", f"WITH {_VERIFY} SELECT doc_id, display FROM drift")
def period_anchor(spark, sf):
    return ops.unanchored_figures(reports(spark, sf), ["doc_id"], F.col("body"), _hay())


@query("retry_winner", f"""WITH {_VERIFY} SELECT doc_id, n_unverified + n_unanchored > 0 AS retry_won, 'verified' AS verdict,
  CASE WHEN n_unverified + n_unanchored > 0 THEN 0 ELSE n_unverified END AS n_unverified FROM verdicts""")
def retry_winner(spark, sf):
    """The corrective attempt writes the source itself, so it wins exactly where the first failed."""
    first = ops.verify_pages(reports(spark, sf), ["doc_id"])
    second = ops.verify_pages(reports(spark, sf).withColumn("body", F.col("source")), ["doc_id"])
    return ops.keep_better(first, second, ["doc_id"]).select("doc_id", "retry_won", "verdict", "n_unverified")


@query("figure_spans", f"""WITH {_PRESENCE}, hay AS (SELECT doc_id, {_HAY} AS h FROM reports)
SELECT s.doc_id, s.display, strpos(h, '$' || s.display) AS start FROM shown s
JOIN hits USING (doc_id, display) JOIN hay USING (doc_id) WHERE contains(h, 'reached $' || s.display || '.')
  AND regexp_matches(s.display, '^[0-9]+[.][0-9]{{2}}$')""")
def figure_spans(spark, sf):
    """Offsets of the order figures, the ones the oracle can locate by their sentence."""
    r = reports(spark, sf)
    spans = ops.figure_spans(r, ["doc_id"], F.col("body"), _hay())
    located = spans.join(r.select("doc_id", _hay().alias("h")), "doc_id")
    told = F.col("h").contains(F.concat(F.lit("reached $"), "display", F.lit(".")))
    return (located.filter(told & F.col("display").rlike(r"^[0-9]+[.][0-9]{2}$"))
            .select("doc_id", "display", F.col("start").cast("bigint").alias("start")))


@query("mentions_missing", """WITH w AS (SELECT doc_id, lang, source,
    ' ' || regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g') || ' ' || source AS hay FROM documents)
SELECT doc_id, CASE WHEN contains(hay, 'the of') THEN '' ELSE 'The  OF' END || CASE WHEN contains(hay, source) THEN '' ELSE source END
  || CASE WHEN contains(hay, 'schon') THEN '' ELSE '|Schön' END AS missing FROM w""")
def mentions_missing(spark, sf):
    names = F.array(F.lit("The  OF"), F.col("source"), F.lit("Schön"))
    d = ops.missing_mentions(table(spark, sf, "documents"), names, F.col("text"), F.col("source"))
    return d.select("doc_id", F.array_join(F.transform("mentions_unverified", lambda m: F.when(
        m == "Schön", F.concat(F.lit("|"), m)).otherwise(m)), "").alias("missing"))


# --- answers ------------------------------------------------------------------------------------------
@query("verify_answers", f"""WITH {_PRESENCE},
a AS (SELECT r.doc_id, count(*) FILTER (h.display IS NULL AND s.display IS NOT NULL) AS figures
      FROM reports r LEFT JOIN shown s USING (doc_id) LEFT JOIN hits h ON h.doc_id = s.doc_id AND h.display = s.display GROUP BY r.doc_id),
c AS (SELECT doc_id, figures, CASE doc_id % 5 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE 0 END AS cp FROM a),
c2 AS (SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 0 ELSE figures END AS figures, CASE WHEN doc_id % 6 = 5 THEN 0 ELSE cp END AS cp FROM c)
SELECT doc_id AS answer_id, figures AS unverified_figures, CAST(cp AS BIGINT) AS citation_problems,
  CASE figures + cp WHEN 0 THEN 'verified' WHEN 1 THEN 'partial' ELSE 'failed' END AS verdict FROM c2""")
def verify_answers(spark, sf):
    """Answers are the report pages: cited well, unsurfaced, unknown, misquoted or not cited at all."""
    r = reports(spark, sf)
    k, me = F.col("doc_id") % 5, F.concat(F.lit("p"), F.col("doc_id").cast("string"))
    good = F.substring_index(F.col("source"), "\n", -1)

    def cite(path, quote):
        return F.array(F.struct(path.alias("path"), quote.alias("quote")))

    none = F.array().cast("array<struct<path:string,quote:string>>")
    answers = r.select(
        F.col("doc_id").alias("answer_id"), F.col("body").alias("answer"), _hay().alias("evidence"),
        (F.col("doc_id") % 6 == 5).alias("refused"),
        F.when(k == 1, cite(F.lit("elsewhere"), good)).when(k == 2, cite(me, F.lit("never written ¤")))
        .when(k == 3, none).otherwise(cite(me, good)).alias("citations"), F.array(me).alias("read_paths"))
    pages = r.select(me.alias("path"), F.lit("Report").alias("title"), F.col("source").alias("body"))
    v = ops.verify_answers(answers, pages)
    return v.select("answer_id", F.size("unverified_figures").cast("bigint").alias("unverified_figures"),
                    "citation_problems", "verdict")


# --- claims -------------------------------------------------------------------------------------------
_STOP = "[" + ",".join(f"'{w}'" for w in ["the", "and", "for", "with", "that", "this", "from", "was", "were", "are", "our",
                                          "their", "has", "have", "had", "will", "would", "into", "over", "under", "about"]) + "]"


def _words(col: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({col}), '[a-z0-9]{{3,}}')), lambda w: NOT list_contains({_STOP}, w))"


_CLAIMS_SQL = f"""
src AS (SELECT d.doc_id, d.text AS source, b.text AS planted FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
cl AS (SELECT doc_id, unnest(list_filter(list_transform(list_append(string_split(source, chr(10)), replace(planted, chr(10), ' ')),
       lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) >= 40 AND left(x, 1) NOT IN ('#', '|', '>'))) AS claim,
       unnest(generate_series(0, len(list_filter(list_transform(list_append(string_split(source, chr(10)), replace(planted, chr(10), ' ')),
       lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) >= 40 AND left(x, 1) NOT IN ('#', '|', '>'))) - 1)) AS claim_no FROM src),
win AS (SELECT doc_id, start, {_words('substr(source, start + 1, 1200)')} AS words FROM
    (SELECT doc_id, source, unnest(generate_series(0, greatest(length(source) - 600, 1) - 1, 300)) AS start FROM src)),
sc AS (SELECT c.doc_id, c.claim_no, w.start, len(list_intersect(c.want, w.words)) AS held, len(c.want) AS words
    FROM (SELECT *, {_words('claim')} AS want FROM cl) c JOIN win w USING (doc_id)),
best AS (SELECT doc_id, claim_no, max(held) AS held, any_value(words) AS words FROM sc GROUP BY ALL)"""


def _claim_pages(spark, sf):
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    n = b.agg(F.count(F.lit(1))).scalar()
    planted = (d.withColumn("item_id", F.col("doc_id") % n)
               .join(b.select("item_id", F.col("text").alias("planted")), "item_id"))
    lines = F.concat(F.split("text", "\n"), F.array(F.replace(F.col("planted"), F.lit("\n"), F.lit(" "))))
    return planted.select("doc_id", F.col("text").alias("source"), F.array_join(lines, "\n\n").alias("body"))


@query("claims_windows", f"""WITH {_CLAIMS_SQL}
SELECT doc_id, CAST(claim_no AS BIGINT) AS claim_no, CASE WHEN held > 0 THEN min(start) ELSE 0 END AS start,
  round(CASE WHEN words = 0 THEN 0 ELSE held / words END, 6) AS score,
  CASE WHEN words = 0 OR held / words >= 0.7 THEN 'supported' ELSE 'unsupported' END AS verdict
FROM best JOIN sc USING (doc_id, claim_no, held, words) GROUP BY doc_id, claim_no, held, words""")
def claims_windows(spark, sf):
    """Claims are the paragraphs of a document plus one planted sentence from elsewhere."""
    judged = claims.judge_claims(claims.anchor_claims(_claim_pages(spark, sf), ["doc_id"]))
    return judged.select("doc_id", F.col("claim_no").cast("bigint").alias("claim_no"),
                         F.col("start").cast("bigint").alias("start"), F.round("score", 6).alias("score"), "verdict")


@query("claims_audit", f"""WITH {_CLAIMS_SQL},
ruled AS (SELECT doc_id, claim_no, CASE WHEN words = 0 OR held / words >= 0.7 THEN 0 ELSE 1 END AS bad FROM best),
counted AS (SELECT doc_id, count(*) AS checked, sum(bad) AS unsupported FROM ruled GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'no page on record' WHEN doc_id % 13 = 1 THEN 'page missing' WHEN doc_id % 13 = 2 THEN 'source missing'
  ELSE 'checked' END AS outcome, CASE WHEN doc_id % 13 > 2 THEN coalesce(checked, 0) ELSE 0 END AS checked,
  CAST(CASE WHEN doc_id % 13 > 2 THEN coalesce(unsupported, 0) ELSE 0 END AS BIGINT) AS unsupported FROM src LEFT JOIN counted USING (doc_id)""")
def claims_audit(spark, sf):
    """Every document of a state in which some have no page, some lost their page and some their source."""
    own = _claim_pages(spark, sf)
    kind, path = F.col("doc_id") % 13, F.concat(F.lit("p/"), F.col("doc_id").cast("string"))
    file_id = F.col("doc_id").cast("string").alias("file_id")
    state = own.select(file_id, path.alias("path"), F.when(kind == 0, "deleted").otherwise("processed").alias("status"))
    found = claims.audit_claims(state, own.filter(kind != 1).select(path.alias("path"), "body"), own.filter(kind != 2).select(file_id, F.col("source").alias("text")))
    return found.select(F.col("file_id").cast("bigint").alias("doc_id"), "outcome", "checked", "unsupported")


@query("claims_split", """SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)),
   lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) >= 40)) AS claims FROM documents""")
def claims_split(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.size(split_claims(F.regexp_replace("text", "\n", "\n\n"))).cast("bigint").alias("claims"))


@query("parse_numbers", """WITH raw AS (SELECT o_orderkey, CASE o_orderkey % 6
   WHEN 0 THEN '$' || printf('%.2f', o_totalprice) WHEN 1 THEN printf('%.1f', o_totalprice / 1000) || 'k'
   WHEN 2 THEN replace(printf('%.2f', o_totalprice), '.', ',') WHEN 3 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' USD'
   WHEN 4 THEN '1.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '.000' ELSE 'n/a ' || o_orderstatus END AS raw FROM orders)
SELECT o_orderkey, raw, round(CASE o_orderkey % 6 WHEN 1 THEN CAST(replace(raw, 'k', '') AS DOUBLE) * 1000
   WHEN 2 THEN CAST(replace(raw, ',', '.') AS DOUBLE) WHEN 4 THEN CAST(replace(raw, '.', '') AS DOUBLE) WHEN 5 THEN NULL
   ELSE CAST(regexp_replace(raw, '[$ USD]', '', 'g') AS DOUBLE) END, 4) AS value FROM raw""")
def parse_numbers(spark, sf):
    k, price = F.col("o_orderkey") % 6, F.col("o_totalprice")
    raw = (F.when(k == 0, F.concat(F.lit("$"), F.format_string("%.2f", price)))
           # rounds the value itself; format_string rounds its shortest decimal text half up
           .when(k == 1, F.concat(F.call_function("format_number", price / 1000, F.lit("0.0")), F.lit("k")))
           .when(k == 2, F.replace(F.format_string("%.2f", price), F.lit("."), F.lit(",")))
           .when(k == 3, F.concat(F.floor(price).cast("string"), F.lit(" USD")))
           .when(k == 4, F.concat(F.lit("1."), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(".000")))
           .otherwise(F.concat(F.lit("n/a "), "o_orderstatus")))
    return (table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))
            .withColumn("value", F.round(numbers.parse_num(F.col("raw")), 4)))
