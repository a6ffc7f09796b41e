"""Catalogue: full-text search."""
from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.operators import index as stores
from sourceloom.operators import search as ops
from sourceloom.operators.pages import parse_pages
from sourceloom.queries.registry import query
from sourceloom.queries.views import INDEX_SQL, QUESTION, index_pages, questions
from sourceloom.session import cut_lineage, shared_folder

_STOP = "(" + ",".join(f"'{w}'" for w in [
    "the", "a", "an", "in", "on", "of", "for", "and", "or", "to", "is", "are", "was", "were", "what", "which", "who", "how",
    "when", "where", "with", "about", "does", "do", "did", "at", "by", "it", "its", "our", "their", "this", "that", "please"]) + ")"


def _tok(col: str) -> str:
    return rf"regexp_extract_all(lower(strip_accents({col})), '[\p{{L}}\p{{N}}]+')"


_COLS = ["title", "body", "tags", "entity", "mentions"]
_TOKENS = INDEX_SQL + ", toks AS (" + " UNION ALL ".join(
    f"SELECT path, {k} AS c, unnest({_tok(c)}) AS term, generate_subscripts({_tok(c)}, 1) AS pos FROM idx"
    for k, c in enumerate(_COLS)) + ")"
_BM25 = _TOKENS + rf""",
lens AS (SELECT idx.path, count(term) AS len FROM idx LEFT JOIN toks USING (path) GROUP BY idx.path),
tot AS (SELECT count(*) AS n_pages, avg(len) AS avg_len FROM lens),
q AS (SELECT item_id AS question_id, {QUESTION} AS question FROM benchmark),
qw AS (SELECT question_id, unnest(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_''-]*')) AS w FROM q),
qp AS (SELECT DISTINCT question_id, array_to_string({_tok('w')}, ' ') AS phrase FROM qw WHERE length(w) >= 2 AND w NOT IN {_STOP}),
ph AS (SELECT DISTINCT phrase, len(string_split(phrase, ' ')) AS n, unnest(string_split(phrase, ' ')) AS term,
       generate_subscripts(string_split(phrase, ' '), 1) AS k FROM (SELECT DISTINCT phrase FROM qp WHERE phrase <> '')),
hit AS (SELECT phrase, path, count(*) AS f FROM (SELECT phrase, path, c, pos - k AS at, n FROM ph JOIN toks USING (term)
        GROUP BY phrase, path, c, pos - k, n HAVING count(*) = n) GROUP BY phrase, path),
idf AS (SELECT phrase, greatest(ln((n_pages - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM hit, tot GROUP BY phrase, n_pages),
score AS (SELECT question_id, path, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg_len))) AS bm25
  FROM qp JOIN hit USING (phrase) JOIN idf USING (phrase) JOIN lens USING (path), tot GROUP BY ALL)"""
_RANK = _BM25 + r""",
cand AS (SELECT * FROM (SELECT s.*, i.*
   FROM score s JOIN idx i ON i.path = s.path WHERE {scope})),
fin AS (SELECT question_id, path, bm25,
   (CASE WHEN superseded_by <> '' THEN 4.0 ELSE 1.0 END) * (CASE verification WHEN 'failed' THEN 2.5 WHEN 'partial' THEN 1.2 ELSE 1.0 END)
   * (CASE WHEN quality = 'manual_review' THEN 1.5 ELSE 1.0 END)
   * (CASE WHEN entity = 'entity-' || CAST(question_id % 20 AS VARCHAR) THEN 0.5 ELSE 1.0 END)
   * (CASE WHEN starts_with(as_of, '2023-') OR period = '2023' THEN 0.6 ELSE 1.0 END)
   * (CASE WHEN superseded_by = '' THEN 0.7 ELSE 1.0 END) / (1.0 - bm25) AS score FROM cand),
top AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score, path) AS rank FROM fin)"""


def _ranked(scope: str) -> str:
    return _RANK.replace("{scope}", scope)


def _search(spark, sf, **options):
    return ops.search(questions(spark, sf), index_pages(spark, sf), **options)


@query("postings", f"WITH {_TOKENS} SELECT term, path, count(*) AS tf FROM toks GROUP BY ALL")
def postings(spark, sf):
    return ops.build_postings(index_pages(spark, sf), positions=False)


# the pages of an earlier day: some were not there yet, some had another text, some are gone since
_REFRESHED = _TOKENS.replace("FROM documents)", "FROM documents WHERE doc_id % 9 <> 4)")


@query("index_refresh", f"WITH {_REFRESHED} SELECT term, path, count(*) AS tf FROM toks GROUP BY ALL")
def index_refresh(spark, sf):
    """A stored index after three refreshes; the same postings as an index built from nothing."""
    marked = index_pages(spark, sf).withColumns({"mtime": F.lit(1.0), "size": F.lit(1).cast("long"), "day": F.pmod("doc_id", F.lit(9))})
    root = shared_folder(spark, "index")
    old = F.when(F.col("day") == 1, F.lit("an earlier text")).otherwise(F.col("body"))
    stores.refresh(spark, root, marked.filter("day <> 2").withColumns({"body": old, "mtime": F.when(F.col("day") == 1, 0.0).otherwise(F.col("mtime"))}))
    stores.refresh(spark, root, marked.filter("day not in (4, 5)"))
    stores.refresh(spark, root, marked.filter("day <> 4"))
    return stores.open_index(spark, root).postings.select("term", "path", "tf")


@query("page_lengths", f"WITH {_TOKENS} SELECT idx.path, count(term) AS len FROM idx LEFT JOIN toks USING (path) GROUP BY idx.path")
def page_lengths(spark, sf):
    return ops.page_lengths(index_pages(spark, sf))


@query("bm25_scores", f"WITH {_BM25} SELECT question_id, path, round(bm25, 5) + 0.0 AS bm25 FROM score")
def bm25_scores(spark, sf):
    pages = index_pages(spark, sf)
    asked = cut_lineage(ops.ask_terms(questions(spark, sf)))
    hits, lengths = ops.read_phrases(pages, asked.select(F.explode("phrases").alias("phrase")))
    scored = ops.summed(asked, ops.hit_weights(hits, lengths))
    return scored.select("question_id", "path", (F.round("bm25", 5) + 0.0).alias("bm25"))


@query("search_rerank", f"WITH {_ranked('true')} SELECT question_id, rank, path, round(score, 6) AS score FROM top WHERE rank <= 5")
def search_rerank(spark, sf):
    return _search(spark, sf).select("question_id", F.col("rank").cast("bigint").alias("rank"), "path", F.round("score", 6).alias("score"))


_SCOPE = "(acl_csv IS NULL OR contains(',' || acl_csv || ',', ',eng,')) AND superseded_by = ''"


@query("search_scoped", f"WITH {_ranked(_SCOPE)} SELECT question_id, rank, path, round(score, 6) AS score FROM top WHERE rank <= 5")
def search_scoped(spark, sf):
    hits = _search(spark, sf, audiences={"eng"}, include_superseded=False)
    return hits.select("question_id", F.col("rank").cast("bigint").alias("rank"), "path", F.round("score", 6).alias("score"))


_LOW = "lower(body)"


@query("snippets", f"""WITH {_ranked('true')},
qt AS (SELECT DISTINCT question_id, unnest(regexp_extract_all(lower(question), '[a-z0-9][a-z0-9''-]*')) AS t FROM q),
s AS (SELECT question_id, path, body, first(t ORDER BY length(t) DESC, t) FILTER (length(t) >= 3 AND contains({_LOW}, t)) AS best
  FROM top JOIN idx USING (path) JOIN qt USING (question_id) WHERE rank <= 5 GROUP BY ALL)
SELECT question_id, path, trim(regexp_replace(substr(body, CASE WHEN best IS NULL THEN 1 ELSE greatest(strpos({_LOW}, best) - 1 - 80, 0) + 1 END, 240),
  '\\s+', ' ', 'g')) AS snippet FROM s""")
def snippets(spark, sf):
    return ops.with_snippets(_search(spark, sf), index_pages(spark, sf)).select("question_id", "path", "snippet")


# pages whose frontmatter is written in four ways: inline, as line lists, with block scalars, and one that is not readable
_WRITTEN = "doc_id % 5"


@query("frontmatter_fields", rf"""WITH {INDEX_SQL}
SELECT path, CASE WHEN {_WRITTEN} = 4 THEN '' ELSE title END AS title, CASE WHEN {_WRITTEN} = 4 THEN '' ELSE entity END AS entity,
  CASE WHEN {_WRITTEN} = 4 THEN '' ELSE tags || ' page' END AS tags, CASE WHEN {_WRITTEN} = 4 THEN '' ELSE title || ', Inc. ' || entity END AS mentions,
  CASE WHEN {_WRITTEN} = 4 THEN '' ELSE acl_csv END AS acl, CAST(length(body) AS BIGINT) +
  CASE WHEN {_WRITTEN} = 4 THEN length('---' || chr(10) || 'title: [' || title || chr(10) || '---' || chr(10)) ELSE 0 END AS chars FROM idx""")
def frontmatter_fields(spark, sf):
    """Every page's fields read back from its text."""
    pages = index_pages(spark, sf)
    kind, title, entity = F.pmod("doc_id", F.lit(5)), F.col("title"), F.col("entity")

    def lines(*parts):
        return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])

    def said(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    inline = F.when(F.col("acl").isNotNull(), said("acl: [", F.array_join(F.transform("acl", lambda a: said('"', a, '"')), ", "), "]"))
    listed = F.when(F.size("acl") > 0, lines("acl:", F.array_join(F.transform("acl", lambda a: said("  - '", a, "'  # label")), "\n"))).otherwise(inline)
    front = F.when(kind == 0, lines(said("title: ", title), said('entity: "', entity, '"'), said("tags: [", F.col("tags"), ", page]"), inline,
                                    "mentions:", said('  - { name: "', title, ', Inc.", type: company }'), said("  - { name: ", entity, ", type: other }")))
    front = front.when(kind == 1, lines(said("title: '", title, "'  # shown"), "tags:", said("- ", F.col("tags")), '- "page"', listed, said("entity: ", entity),
                                        "mentions:", said("  - name: '", title, ", Inc.'"), "    type: company", "  - type: other", said("    name: ", entity)))
    front = front.when(kind == 2, lines("title: >-", said("  ", F.replace(title, F.lit(" "), F.lit("\n  "))), "", listed, "# tags follow", "tags: [",
                                        said("  ", F.col("tags"), ","), "  page]", "entity: |-", said("    ", entity), "mentions:",
                                        said("- {type: company, name: '", title, ", Inc.'}"), said("- {type: other, name: ", entity, "}")))
    front = front.when(kind == 3, lines(said('title: "', F.replace(title, F.lit(" "), F.lit("\n  ")), '"'), "title_note: |", "  entity: wrong", "", inline,
                                        said("entity:"), "note: ~", said("entity: ", entity, " # last one holds"), "tags:", said("    - ", F.col("tags")), "    - page",
                                        "mentions:", said('  - name: "', title, ', Inc."'), said("  - name: ", entity)))
    written = F.concat(F.lit("---\n"), F.when(kind == 4, said("title: [", title)).otherwise(front), F.lit("\n---\n"), F.col("body"))
    raw = pages.select("path", written.alias("text"), F.lit(1.0).alias("mtime"), F.lit(1).alias("size"))
    return parse_pages(raw).select("path", "title", "entity", "tags", "mentions", F.array_join("acl", ",").alias("acl"),
                                   F.length("body").cast("bigint").alias("chars"))


@query("superseded_paths", f"WITH {INDEX_SQL} SELECT path FROM idx WHERE superseded_by <> ''")
def superseded_paths(spark, sf):
    return index_pages(spark, sf).filter(F.coalesce("superseded_by", F.lit("")) != "").select("path")
