"""Catalogue: versions, dossiers, entity graph, incremental changes, chat, supervision."""
from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.functions import paths
from sourceloom.functions.access import label_ok
from sourceloom.functions.lets import let
from sourceloom.functions.similarity import text_similarity, word_pairs
from sourceloom.functions.words import entity_key, marker_score, version_stem
from sourceloom.operators import changes, chat, connectors, dossiers, graph, operations, versions
from sourceloom.queries.curation import manifest
from sourceloom.queries.registry import query
from sourceloom.sources.connectors import first_field, parent_ids
from sourceloom.queries.views import (FACTS_SQL, FILES_SQL, fact_store, files, sql_figures, sql_keys, sql_spaced, superseded_pages,
                                      table)

# --- versions ---------------------------------------------------------------------------------------
_STEM = (r"lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '\.[^.]*$', ''), "
         r"'(?i)\b(?:final|draft|copy|old|new|updated|revised|v\d+|rev\d*)\b|\(\d+\)', ' ', 'g'), '\s+', ' ', 'g')))")
_SCORE = (r"(CASE WHEN contains(lower(name), 'final') THEN 100 ELSE 0 END - CASE WHEN contains(lower(name), 'draft') THEN 100 ELSE 0 END "
          r"+ coalesce(TRY_CAST(regexp_extract(lower(name), '\bv(\d+)\b', 1) AS INT), 0) "
          r"- CASE WHEN regexp_matches(lower(name), '\bcopy\b|\(\d+\)') THEN 1 ELSE 0 END)")
# documents named after three words of the whole text (its longest, first and last by alphabet): near copies share them
_MARKS = ["", " FINAL", " draft", " v2", " (1)", " copy", " v3"]
_MARK_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MARKS)) + " END"
_DOCS = f"""
named AS (SELECT doc_id, 'f' || CAST(doc_id AS VARCHAR) AS file_id, lang AS grp, CAST(2020 + doc_id % 6 AS VARCHAR) AS as_of, text,
   coalesce(list_max(list_transform(w, lambda x: {{'n': length(x), 'w': x}})).w || ' ' || list_min(w) || ' ' || list_max(w), '') || {_MARK_SQL} || '.md' AS name
   FROM (SELECT *, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents)),
docs AS (SELECT *, {_STEM} AS stem, {_SCORE} AS score FROM named)"""


def version_docs(spark, sf):
    title = let(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.coalesce(F.concat_ws(" ", F.array_max(F.transform(
        w, lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"], F.array_min(w), F.array_max(w)), F.lit("")))
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_id"),
        F.concat(title, F.expr(_MARK_SQL), F.lit(".md")).alias("name"), F.lit("").alias("entity"), F.col("lang").alias("unit"),
        (F.lit(2020) + F.col("doc_id") % 6).cast("string").alias("as_of"), "text")


@query("version_names", f"WITH {_DOCS} SELECT file_id, stem, CAST(score AS BIGINT) AS score FROM docs")
def version_names(spark, sf):
    return version_docs(spark, sf).select("file_id", version_stem(F.col("name")).alias("stem"), marker_score(F.col("name")).alias("score"))


_HEADS = _DOCS + """,
heads AS (SELECT grp, stem, file_id AS head_id, score AS head_score, as_of AS head_as_of FROM (SELECT *,
   row_number() OVER (PARTITION BY grp, stem ORDER BY score DESC, as_of DESC, file_id DESC) AS rn FROM docs) WHERE rn = 1),
same AS (SELECT file_id AS old_id, head_id AS new_id FROM docs JOIN heads USING (grp, stem)
   WHERE head_score > score OR (head_score = score AND head_as_of > as_of))"""
_PAIRS_OF = ("(SELECT list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM "
             "(SELECT list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w))")


@query("version_families", f"WITH {_HEADS} SELECT grp, stem, head_id, (SELECT count(*) FROM docs d WHERE d.grp = heads.grp AND d.stem = heads.stem) AS members FROM heads")
def version_families(spark, sf):
    return versions.family_heads(versions.with_family(version_docs(spark, sf))).select("grp", "stem", "head_id", "members")


@query("version_candidates", f"WITH {_HEADS} SELECT old_id, new_id FROM same")
def version_candidates(spark, sf):
    fam = versions.with_family(version_docs(spark, sf).drop("text"))
    return versions.same_name_links(fam, versions.family_heads(fam))


_PRINTS = r"""
p AS (SELECT file_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))
       ELSE list_distinct(w) END AS pairs FROM (SELECT file_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM docs))"""
_SIMILARITY = """CASE WHEN len(pa.pairs) + len(pb.pairs) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(pa.pairs, pb.pairs)) / (len(pa.pairs) + len(pb.pairs)) END"""
#: Matching blocks of the pairs (a, b) of {0}: the longest common block, earliest in a, then in b; then both sides of it.
_BLOCKS = """
pieces AS (SELECT a, b, a AS x, b AS y, CAST(0 AS BIGINT) AS k FROM {0} UNION ALL
  SELECT a, b, unnest([x[:i - 1], x[i + n:]]), unnest([y[:strpos(y, x[i:i + n - 1]) - 1], y[strpos(y, x[i:i + n - 1]) + n:]]), unnest([n, 0]) FROM (
    SELECT a, b, x, y, best[2] AS i, -best[1] AS n FROM (SELECT a, b, x, y, list_min(list_filter(flatten(list_transform(range(1, length(x) + 1), lambda i:
      list_transform(range(1, length(x) - i + 2), lambda k: [-k, i]))), lambda c: contains(y, x[c[2]:c[2] - c[1] - 1]))) AS best FROM pieces
      WHERE x <> '' AND y <> '') WHERE best IS NOT NULL)),
ratios AS (SELECT a, b, 2.0 * sum(k) / (length(a) + length(b)) AS ratio FROM pieces GROUP BY a, b)"""
# every older member against every newer one, in its own family or in one with a similar name
_LINKS = """
fl AS (SELECT a.file_id AS old_id, b.file_id AS new_id, {1} AS sim, row_number() OVER (PARTITION BY a.file_id ORDER BY b.score DESC, b.as_of DESC, b.file_id DESC) AS rn
   FROM docs a JOIN docs b ON a.grp = b.grp AND ({0}) AND (b.score > a.score OR (b.score = a.score AND b.as_of > a.as_of))
   JOIN p pa ON pa.file_id = a.file_id JOIN p pb ON pb.file_id = b.file_id WHERE {1} >= 0.35)
SELECT old_id, new_id, round(sim, 6) AS similarity FROM fl WHERE rn = 1"""
_NEAR = f"""
pairs AS MATERIALIZED (SELECT DISTINCT x.stem AS a, y.stem AS b FROM docs x JOIN docs y ON x.grp = y.grp AND x.stem < y.stem AND x.stem <> ''
  AND 2.0 * least(length(x.stem), length(y.stem)) >= 0.55 * (length(x.stem) + length(y.stem))),
{_BLOCKS.format('pairs')},
near AS MATERIALIZED (SELECT a, b FROM ratios WHERE ratio >= 0.55 UNION ALL SELECT b, a FROM ratios WHERE ratio >= 0.55)"""
_IN_NEAR = "a.stem = b.stem OR (a.stem, b.stem) IN (SELECT a, b FROM near)"


@query("version_links", f"WITH {_DOCS}, {_PRINTS}, {_LINKS.format('a.stem = b.stem', _SIMILARITY)}")
def version_links(spark, sf):
    docs = version_docs(spark, sf)
    return versions.detect_versions(docs, similar_names=False).select("old_id", "new_id", F.round("similarity", 6).alias("similarity"))


@query("version_links_similar_names", f"WITH RECURSIVE {_DOCS}, {_PRINTS}, {_NEAR}, {_LINKS.format(_IN_NEAR, _SIMILARITY)}")
def version_links_similar_names(spark, sf):
    return versions.detect_versions(version_docs(spark, sf)).select("old_id", "new_id", F.round("similarity", 6).alias("similarity"))


# the state after an update: some texts rewritten, some documents gone, some renamed; all other groups keep their links
_UPDATED = _DOCS.replace("FROM documents)", "FROM documents WHERE doc_id % 17 <> 3)").replace(
    "docs AS (SELECT *,", "docs AS (SELECT * REPLACE (CASE WHEN grp = 'en' AND doc_id % 5 = 1 THEN 'rewritten ' || doc_id ELSE text END AS text),")


@query("versions_after_update", f"WITH RECURSIVE {_UPDATED}, {_PRINTS}, {_NEAR}, {_LINKS.format(_IN_NEAR, _SIMILARITY)}")
def versions_after_update(spark, sf):
    """Links of a first state, brought up to date by difference; the same as links derived from nothing."""
    first = version_docs(spark, sf)
    known = versions.update_links(spark.createDataFrame([], "grp string, old_id string, new_id string, similarity double"), first,
                                  versions.touched_groups(first.limit(0), first, first))
    key = F.col("doc_id")
    second = first.filter(key % 17 != 3).withColumn("text", F.when((F.col("unit") == "en") & (key % 5 == 1), F.concat(
        F.lit("rewritten "), key.cast("string"))).otherwise(F.col("text")))
    touched = first.filter((key % 17 == 3) | ((F.col("unit") == "en") & (key % 5 == 1)))
    links = versions.update_links(known, second, versions.touched_groups(first, second, touched))
    return links.select("old_id", "new_id", F.round("similarity", 6).alias("similarity"))


@query("copies_similarity", f"""WITH docs AS (SELECT doc_id AS file_id, text FROM documents), {_PRINTS}
SELECT pa.file_id AS doc_id, len(pa.pairs) AS word_pairs, round({_SIMILARITY}, 6) AS similarity FROM p pa JOIN p pb ON pb.file_id = pa.file_id + 1""")
def copies_similarity(spark, sf):
    """Every document against the next one: copies and near copies stand beside unrelated texts."""
    prints = table(spark, sf, "documents").select("doc_id", F.transform(word_pairs(F.col("text")), lambda p: F.xxhash64(p)).alias("p"))
    other = prints.select((F.col("doc_id") - 1).alias("doc_id"), F.col("p").alias("q"))
    return prints.join(other, "doc_id").select("doc_id", F.size("p").cast("bigint").alias("word_pairs"),
                                               F.round(text_similarity(F.col("p"), F.col("q")), 6).alias("similarity"))


# --- dossiers -----------------------------------------------------------------------------------------
_MEMBERS = FACTS_SQL + """,
mem AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS file_id, 'units/c' || CAST(c_custkey AS VARCHAR) || '.md' AS path, c_name AS title,
   'nation-' || CAST(c_nationkey AS VARCHAR) AS entity, CAST(2000 + c_custkey % 5 AS VARCHAR) AS as_of,
   CASE WHEN c_acctbal < 3000 THEN 'c' || CAST(c_custkey + 1 AS VARCHAR) ELSE '' END AS superseded_by,
   CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN 'sales' ELSE 'sales,eng' END AS acl, md5(c_name) AS content_hash FROM customer)"""


def members(spark, sf):
    c = table(spark, sf, "customer")
    key = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    acl = F.when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("sales"))).when(
        F.col("c_mktsegment") != "BUILDING", F.array(F.lit("sales"), F.lit("eng")))
    return c.select(key.alias("file_id"), F.concat(F.lit("units/"), key, F.lit(".md")).alias("path"), F.col("c_name").alias("title"),
                    F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("entity"),
                    (2000 + F.col("c_custkey") % 5).cast("string").alias("as_of"),
                    F.when(F.col("c_acctbal") < 3000, F.concat(F.lit("c"), (F.col("c_custkey") + 1).cast("string"))).otherwise("").alias("superseded_by"),
                    acl.alias("acl"), F.md5("c_name").alias("content_hash"))


_PRINT = "file_id || ':' || path || ':' || superseded_by || ':' || content_hash"
_ROLLUP = f"""
roll AS (SELECT entity, count(*) AS members, count(*) FILTER (superseded_by = '') AS current,
   CAST(count(*) AS VARCHAR) || ':' || CAST(CAST(sum(CAST(('0x' || substr(md5({_PRINT}), 1, 15)) AS BIGINT)) AS HUGEINT) AS VARCHAR) || ':'
   || CAST(CAST(sum(CAST(('0x' || substr(md5({_PRINT}), 17, 15)) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS fingerprint FROM mem GROUP BY entity),
labs AS (SELECT entity, lab, count(*) AS k FROM (SELECT entity, unnest(string_split(acl, ',')) AS lab FROM mem WHERE acl IS NOT NULL) GROUP BY 1, 2),
aud AS (SELECT m.entity, CASE WHEN count(m.acl) > 0 THEN coalesce((SELECT string_agg(lab, ',' ORDER BY lab) FROM labs l
   WHERE l.entity = m.entity AND l.k = count(m.acl)), '') END AS acl FROM mem m GROUP BY m.entity)"""


@query("dossier_rollup", f"WITH {_MEMBERS}, {_ROLLUP} SELECT entity, members, current, fingerprint, acl FROM roll JOIN aud USING (entity)")
def dossier_rollup(spark, sf):
    return dossiers.entity_rollup(members(spark, sf)).withColumn("acl", F.array_join("acl", ","))


@query("dossier_changes", f"""WITH {_MEMBERS}, {_ROLLUP}
SELECT entity, CASE WHEN entity IN (SELECT entity FROM mem WHERE title IN (SELECT c_name FROM customer WHERE c_custkey % 97 = 5)) THEN 'write' ELSE 'keep' END AS action FROM roll
UNION ALL SELECT 'gone', 'remove'""")
def dossier_changes(spark, sf):
    """Against a state in which some members had other content, and one entity has disappeared."""
    now = members(spark, sf)
    key = F.substring("file_id", 2, 20).cast("bigint") % 97
    before = now.withColumn("content_hash", F.when(key == 5, F.lit("old")).otherwise(F.col("content_hash")))
    state = dossiers.entity_rollup(before).select("entity", "fingerprint").unionByName(
        now.limit(1).select(F.lit("gone").alias("entity"), F.lit("x").alias("fingerprint")))
    return dossiers.dossier_changes(dossiers.entity_rollup(now), state)


_LINES = """SELECT entity, 1 AS section, CAST(count(*) AS VARCHAR) || ' document(s) on file, ' || CAST(count(*) FILTER (superseded_by = '') AS VARCHAR) || ' current.' AS line FROM mem GROUP BY entity
UNION ALL SELECT entity, 2, '- ' || metric || ' · ' || period || ' = ' || value_raw || coalesce(' ' || unit, '') || ' (source ' || source_ref || ')' FROM facts
  WHERE file_id NOT IN (SELECT file_id FROM mem WHERE superseded_by <> '')
UNION ALL SELECT entity, 2, 'No verified observations in the facts store.' FROM (SELECT DISTINCT entity FROM mem) WHERE entity NOT IN
  (SELECT entity FROM facts WHERE file_id NOT IN (SELECT file_id FROM mem WHERE superseded_by <> ''))
UNION ALL SELECT entity, 3, '- ' || title || ' — as of ' || as_of || CASE WHEN superseded_by <> '' THEN ' *(superseded)*' ELSE '' END FROM mem"""


@query("dossier_lines", f"WITH {_MEMBERS} {_LINES}")
def dossier_lines(spark, sf):
    return dossiers.dossier_lines(members(spark, sf), fact_store(spark, sf)).select("entity", "section", "line")


_DOUBTED = f"""{_ROLLUP}, ln AS ({_LINES}),
ev AS (SELECT entity, '- ' || path || ' · ' || title || ' · as_of ' || as_of AS line FROM mem
       UNION ALL SELECT entity, line FROM ln WHERE section = 2 AND starts_with(line, '- ')),
shown AS (SELECT DISTINCT entity, display FROM (SELECT entity, unnest({sql_figures('line')}) AS display FROM ln) WHERE NOT regexp_full_match(display, '[0-9]')),
pool AS (SELECT DISTINCT entity, key FROM (SELECT entity, unnest({sql_keys('display')}) AS key FROM (SELECT DISTINCT entity, unnest({sql_figures('line')}) AS display FROM ev)
         UNION ALL SELECT entity, unnest({sql_spaced('line')}) FROM ev)),
backed AS (SELECT DISTINCT s.entity, s.display FROM (SELECT *, unnest({sql_keys('display')}) AS key FROM shown) s JOIN pool p ON p.entity = s.entity AND p.key = s.key),
bad AS (SELECT entity, display FROM shown EXCEPT SELECT entity, display FROM backed),
judged AS (SELECT entity, (SELECT count(*) FROM bad b WHERE b.entity = r.entity) AS n, (SELECT count(*) FROM shown s WHERE s.entity = r.entity) AS total FROM roll r)"""


@query("dossier_verified", f"""WITH {_MEMBERS}, {_DOUBTED}
SELECT entity, 0 AS section, unnest(['---', 'type: dossier', 'title: "' || entity || ' — dossier"', 'entity: ' || entity, 'generated_at: "2024-01-01"', 'members: ' || CAST(members AS VARCHAR),
  'verification: ' || CASE WHEN n = 0 THEN 'verified' WHEN n = 1 OR n <= 0.25 * total THEN 'partial' ELSE 'failed' END, '---', '', '# ' || entity || ' — dossier', '']) AS line
  FROM roll JOIN judged USING (entity)
UNION ALL SELECT entity, 0, 'acl: [' || replace(acl, ',', ', ') || ']' FROM aud WHERE acl IS NOT NULL
UNION ALL SELECT DISTINCT entity, 0, 'unverified_numbers:' FROM bad
UNION ALL SELECT entity, 0, '  - "' || display || '"' FROM bad
UNION ALL SELECT entity, s, line FROM roll, (VALUES (1, '## Status'), (2, ''), (2, '## Key figures'), (3, ''), (3, '## Documents')) AS v(s, line)
UNION ALL SELECT * FROM ln""")
def dossier_verified(spark, sf):
    """Whole dossiers: head with shared audience and verdict over the entity's evidence, then the lines."""
    return dossiers.dossier_documents(members(spark, sf), fact_store(spark, sf), "2024-01-01").select("entity", "section", "line")


# --- entity graph -------------------------------------------------------------------------------------
_WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"
_NOT = "(" + ",".join(f"'{w}'" for w in graph.NOT_NAMES) + ")"
_MENTIONS = f"""
men AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS pos FROM (
   SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS}) AS name FROM documents)
   WHERE regexp_full_match(name, '[A-Z][a-zA-Z]{{3,}}') AND name NOT IN {_NOT} GROUP BY ALL) WHERE n >= 3)"""


@query("mentions_guess", f"WITH {_MENTIONS} SELECT doc_id, CAST(pos AS BIGINT) AS pos, name, 'organization' AS type FROM men")
def mentions_guess(spark, sf):
    m = graph.guess_mentions(table(spark, sf, "documents"), "doc_id")
    return m.withColumn("pos", F.col("pos").cast("bigint"))


# Parts as pages: every part mentions its own name (in varied spellings) and its brand.
_PART_MENTIONS = """
men AS (
  SELECT p_partkey AS page, 1 AS pos, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || ', Inc.' ELSE p_name || ' S.L.' END AS name,
         CASE WHEN p_partkey % 3 = 0 THEN 'company' ELSE 'product' END AS type FROM part
  UNION ALL SELECT p_partkey, 2, p_brand, 'organization' FROM part
  UNION ALL SELECT p_partkey, 3, lower(p_brand) || ' ltd.', 'company' FROM part WHERE p_size > 25
  UNION ALL SELECT p_partkey, 4, 'A B', 'person' FROM part WHERE p_size < 3),
keyed AS (SELECT *, trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(name), '[.,()"''/]', ' ', 'g'), '\\s+', ' ', 'g')), '( (inc|s l|ltd))+$', '')) AS key FROM men)""".replace("\\\\", "\\")


def part_mentions(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.upper("p_name")).when(k == 2, F.concat("p_name", F.lit(", Inc."))).otherwise(
        F.concat("p_name", F.lit(" S.L.")))
    kind = F.when(F.col("p_partkey") % 3 == 0, "company").otherwise("product")
    page = F.col("p_partkey").alias("page")
    rows = [p.select(page, F.lit(1).alias("pos"), name.alias("name"), kind.alias("type")),
            p.select(page, F.lit(2).alias("pos"), F.col("p_brand").alias("name"), F.lit("organization").alias("type")),
            p.filter("p_size > 25").select(page, F.lit(3).alias("pos"), F.concat(F.lower("p_brand"), F.lit(" ltd.")).alias("name"), F.lit("company").alias("type")),
            p.filter("p_size < 3").select(page, F.lit(4).alias("pos"), F.lit("A B").alias("name"), F.lit("person").alias("type"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return graph.clean_mentions(out)


@query("mention_counts", f"WITH {_PART_MENTIONS} SELECT name, type, count(*) AS n FROM men GROUP BY ALL")
def mention_counts(spark, sf):
    return graph.mention_counts(part_mentions(spark, sf))


_ENTITIES = _PART_MENTIONS + """,
good AS (SELECT * FROM keyed WHERE length(key) >= 3 AND NOT regexp_full_match(key, '[a-z](\\s+[a-z])*')),
nm AS (SELECT key, name, count(*) AS n FROM good GROUP BY ALL), ty AS (SELECT key, type, count(*) AS n FROM good GROUP BY ALL),
ent AS (SELECT key, (SELECT type FROM ty WHERE ty.key = g.key ORDER BY n DESC, type LIMIT 1) AS type,
   (SELECT name FROM nm WHERE nm.key = g.key ORDER BY (upper(name) = name AND lower(name) <> name), length(name), n DESC, name LIMIT 1) AS title,
   count(*) AS mentions, count(DISTINCT name) AS spellings FROM good g GROUP BY key HAVING count(*) >= 2),
ent2 AS (SELECT *, 'entities/' || type || '/' || trim(regexp_replace(key, '[^a-z0-9]+', '-', 'g'), '-') AS base FROM ent),
ents AS (SELECT *, base || CASE WHEN row_number() OVER (PARTITION BY base ORDER BY key) = 1 THEN '' ELSE '-' || CAST(row_number() OVER (PARTITION BY base ORDER BY key) AS VARCHAR) END AS slug FROM ent2)""".replace("\\\\", "\\")


def entities(spark, sf):
    return graph.build_entities(graph.mention_counts(part_mentions(spark, sf)))


@query("entities_canonical", f"WITH {_ENTITIES} SELECT key, slug, title, type, mentions, spellings FROM ents")
def entities_canonical(spark, sf):
    return entities(spark, sf).select("key", "slug", "title", "type", "mentions", "spellings")


@query("entity_aliases", f"""WITH {_ENTITIES}, r AS (SELECT key, name, n, row_number() OVER (PARTITION BY key ORDER BY n DESC, name) AS rank
  FROM nm JOIN ents USING (key) WHERE name <> title) SELECT key, CAST(rank AS BIGINT) AS rank, name, n FROM r WHERE rank <= 8""")
def entity_aliases(spark, sf):
    counts = graph.mention_counts(part_mentions(spark, sf))
    return graph.node_aliases(counts, graph.build_entities(counts)).withColumn("rank", F.col("rank").cast("bigint"))


@query("related_entities", f"""WITH {_ENTITIES}, f AS (SELECT page, key, min(pos) AS pos, first(name ORDER BY pos) AS name FROM keyed GROUP BY ALL)
SELECT page, CAST(pos AS BIGINT) AS pos, '- [[' || slug || '|' || name || ']]' AS link FROM f JOIN ents USING (key)""")
def related_entities(spark, sf):
    links = graph.related_links(part_mentions(spark, sf), entities(spark, sf))
    return links.withColumn("pos", F.col("pos").cast("bigint"))


@query("linked_pages", f"""WITH {_ENTITIES}, f AS (SELECT page, key, min(pos) AS pos, first(name ORDER BY pos) AS name FROM keyed GROUP BY ALL),
l AS (SELECT page, string_agg('- [[' || slug || '|' || name || ']]', chr(10) ORDER BY pos) AS section FROM f JOIN ents USING (key) GROUP BY page)
SELECT p_partkey AS page, p_name || chr(10) || chr(10) || '## Related entities' || chr(10) || chr(10) || section || chr(10) AS text FROM part JOIN l ON l.page = p_partkey""")
def linked_pages(spark, sf):
    pages = table(spark, sf, "part").select(F.col("p_partkey").alias("page"), F.concat("p_name", F.lit(" \n\n")).alias("text"))
    return graph.linked_pages(pages, graph.related_links(part_mentions(spark, sf), entities(spark, sf)))


_REGISTRY = [("brand-one", "Brand One", "company", ["Brand#1", "BRAND#11"]), ("ring-family", "Rings", "product", ["small ring", "red ring"])]


@query("registry_entities", f"""WITH {_PART_MENTIONS},
k2 AS (SELECT *, CASE WHEN key IN ('brand#1', 'brand#11', 'brand-one', 'brand one') THEN 'brand-one' WHEN key IN ('small ring', 'red ring', 'ring-family', 'rings') THEN 'ring-family' ELSE key END AS id FROM keyed)
SELECT id AS key, CASE id WHEN 'brand-one' THEN 'Brand One' ELSE 'Rings' END AS title, CASE id WHEN 'brand-one' THEN 'company' ELSE 'product' END AS type, count(*) AS mentions
FROM k2 WHERE id IN ('brand-one', 'ring-family') GROUP BY id""")
def registry_entities(spark, sf):
    registry = spark.createDataFrame(_REGISTRY, "entity_id string, name string, type string, aliases array<string>")
    ents = graph.build_entities(graph.mention_counts(part_mentions(spark, sf)), registry)
    return ents.join(registry.select(F.col("entity_id").alias("key")), "key", "left_semi").select("key", "title", "type", "mentions")


_KEYS = """
ks AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS key FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT lower(p_brand) FROM part)"""


def _merge_keys(spark, sf):
    p = table(spark, sf, "part")
    return (p.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("key")).unionByName(p.select(F.col("p_name").alias("key")))
            .unionByName(p.select(F.lower("p_brand").alias("key"))).distinct())


@query("merge_candidates", f"""WITH {_KEYS}, kw AS (SELECT key, string_split(key, ' ') AS w FROM ks)
SELECT x.key AS a, y.key AS b FROM kw x JOIN kw y ON x.key < y.key AND (list_has_all(x.w, y.w) OR list_has_all(y.w, x.w))""")
def merge_candidates(spark, sf):
    return graph.merge_candidates(_merge_keys(spark, sf), with_ratio=False).select("a", "b")


@query("merge_candidates_ratio", f"""WITH RECURSIVE {_KEYS}, kw AS (SELECT key, string_split(key, ' ') AS w FROM ks),
pairs AS MATERIALIZED (SELECT x.key AS a, y.key AS b, list_has_all(x.w, y.w) OR list_has_all(y.w, x.w) AS contained FROM kw x JOIN kw y ON x.key < y.key
  WHERE list_has_all(x.w, y.w) OR list_has_all(y.w, x.w) OR 2.0 * least(length(x.key), length(y.key)) >= 0.75 * (length(x.key) + length(y.key))),
{_BLOCKS.format('pairs')}
SELECT a, b, contained, round(ratio, 6) AS ratio FROM ratios JOIN pairs USING (a, b) WHERE contained OR ratio >= 0.75""")
def merge_candidates_ratio(spark, sf):
    """Adds pairs with a high ratio."""
    return graph.merge_candidates(_merge_keys(spark, sf)).select("a", "b", "contained", F.round("ratio", 6).alias("ratio"))


@query("entity_keys", "SELECT DISTINCT c_name AS name, lower(c_name) AS key FROM customer")
def entity_keys(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), entity_key(F.concat("c_name", F.lit(", Inc. Ltd"))).alias("key")).distinct()


# --- incremental changes --------------------------------------------------------------------------------
_STATE = FILES_SQL + """,
inv AS (SELECT file_id, doc_id, CASE WHEN doc_id % 17 = 4 THEN NULL ELSE hash END AS raw_hash FROM files WHERE doc_id % 10 <> 9),
canon AS (SELECT hash, min(file_id) AS c FROM files GROUP BY hash),
state AS (SELECT file_id, CASE WHEN doc_id % 8 = 2 THEN 'old' ELSE hash END AS raw_hash,
   CASE WHEN c <> file_id THEN 'duplicate' WHEN doc_id % 13 = 1 THEN 'error' WHEN doc_id % 13 = 2 THEN 'requeued' WHEN doc_id % 13 = 3 THEN 'deleted' ELSE 'processed' END AS status,
   CASE WHEN c <> file_id THEN c END AS duplicate_of FROM files JOIN canon USING (hash) WHERE doc_id % 10 <> 0),
pend AS (SELECT coalesce(i.file_id, p.file_id) AS file_id, i.raw_hash, CASE
   WHEN i.file_id IS NULL AND p.status <> 'deleted' THEN 'deleted' WHEN i.file_id IS NULL OR i.raw_hash IS NULL THEN NULL
   WHEN p.file_id IS NULL THEN 'new' WHEN p.raw_hash <> i.raw_hash OR p.status IN ('error', 'requeued', 'deleted')
     OR (p.status = 'duplicate' AND (ci.file_id IS NULL OR coalesce(ci.raw_hash, i.raw_hash) <> i.raw_hash)) THEN 'changed' END AS reason
  FROM inv i FULL OUTER JOIN state p ON p.file_id = i.file_id LEFT JOIN inv ci ON ci.file_id = p.duplicate_of),
pending AS (SELECT * FROM pend WHERE reason IS NOT NULL)"""


def inventory_and_state(spark, sf):
    f = files(spark, sf).select("file_id", "doc_id", "hash")
    k = F.col("doc_id")
    inv = f.filter(k % 10 != 9).select("file_id", F.when(k % 17 != 4, F.col("hash")).alias("raw_hash"))
    canon = f.groupBy("hash").agg(F.min("file_id").alias("c"))
    dup = F.col("c") != F.col("file_id")
    state = f.filter(k % 10 != 0).join(canon, "hash").select(
        "file_id", F.when(k % 8 == 2, F.lit("old")).otherwise(F.col("hash")).alias("raw_hash"),
        F.when(dup, "duplicate").when(k % 13 == 1, "error").when(k % 13 == 2, "requeued").when(k % 13 == 3, "deleted")
        .otherwise("processed").alias("status"), F.when(dup, F.col("c")).alias("duplicate_of"))
    return inv, state


@query("inventory_diff", f"WITH {_STATE} SELECT file_id, raw_hash, reason FROM pending")
def inventory_diff(spark, sf):
    return changes.pending_changes(*inventory_and_state(spark, sf))


@query("dedup_reelect", f"""WITH {_STATE},
live AS (SELECT * FROM pending WHERE reason <> 'deleted'),
serving AS (SELECT raw_hash, min(file_id) AS f FROM state WHERE status = 'processed' AND file_id IN (SELECT file_id FROM inv)
   AND file_id NOT IN (SELECT file_id FROM live) GROUP BY raw_hash),
low AS (SELECT raw_hash, min(file_id) AS f FROM live GROUP BY raw_hash)
SELECT p.file_id, p.reason, CASE WHEN p.reason = 'deleted' THEN p.file_id ELSE coalesce(s.f, l.f) END AS canonical_id
FROM pending p LEFT JOIN serving s ON s.raw_hash = p.raw_hash LEFT JOIN low l ON l.raw_hash = p.raw_hash""")
def dedup_reelect(spark, sf):
    inv, state = inventory_and_state(spark, sf)
    return changes.elect_canonical(changes.pending_changes(inv, state), state, inv).select("file_id", "reason", "canonical_id")


@query("mirror_diff", """WITH l AS (SELECT p_partkey, 'd' || CAST(p_partkey AS VARCHAR) AS file_id, CASE WHEN p_size > 40 THEN 'x' ELSE 'y' END AS fp FROM part WHERE p_partkey % 11 <> 3),
m AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 3 AND p_partkey % 2 = 0 THEN 'slack-' ELSE 'd' END || CAST(p_partkey AS VARCHAR) AS file_id, p_partkey % 5 <> 2 AS on_disk FROM part WHERE p_partkey % 9 <> 1)
SELECT coalesce(l.file_id, m.file_id) AS file_id, CASE WHEN l.file_id IS NULL THEN CASE WHEN starts_with(m.file_id, 'slack-') THEN 'foreign' ELSE 'removed' END
  WHEN m.file_id IS NULL THEN 'added' WHEN l.fp = 'y' AND m.on_disk THEN 'skipped' ELSE 'changed' END AS action FROM l FULL OUTER JOIN m ON m.file_id = l.file_id""")
def mirror_diff(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    name = F.concat(k.cast("string"), F.lit(".md"))
    ident = F.concat(F.lit("d"), k.cast("string"))
    listing = p.filter(k % 11 != 3).select(ident.alias("file_id"), name.alias("local_name"), changes.fingerprint(
        F.when(F.col("p_size") > 40, "x").otherwise("y"), F.lit(None), F.lit(None)).alias("fingerprint"))
    old_id = F.when((k % 11 == 3) & (k % 2 == 0), F.concat(F.lit("slack-"), k.cast("string"))).otherwise(ident)
    old = p.filter(k % 9 != 1).select(old_id.alias("file_id"), F.lit("y||").alias("fingerprint"), F.upper(name).alias("local_name"), (k % 5 != 2).alias("on_disk"))
    return changes.mirror_diff(listing, old)


_CONNECTORS = """
l AS (SELECT 'drive' AS connector, CASE WHEN p_partkey % 13 = 5 THEN 'slack-p' ELSE 'd' END || CAST(p_partkey AS VARCHAR) AS file_id,
        CASE WHEN p_partkey % 17 = 4 THEN NULL WHEN p_size > 40 THEN 'x' ELSE 'y' END AS fingerprint, CAST(p_partkey AS VARCHAR) || '.md' AS local_path FROM part WHERE p_partkey % 11 <> 3
      UNION ALL SELECT 'slack', 'slack-' || CAST(c_custkey AS VARCHAR), md5(c_name), 'slack/' || CAST(c_custkey AS VARCHAR) || '.md' FROM customer WHERE c_custkey % 7 <> 2),
i AS (SELECT 'd' || CAST(p_partkey AS VARCHAR) AS file_id, CASE WHEN p_partkey % 19 = 6 THEN NULL ELSE 'y' END AS fingerprint, CAST(p_partkey AS VARCHAR) || '.MD' AS local_path, p_partkey % 5 <> 2 AS on_disk FROM part WHERE p_partkey % 9 <> 1
      UNION ALL SELECT 'slack-' || CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE md5(c_name) END, 'slack/' || CAST(c_custkey AS VARCHAR) || '.md', true FROM customer WHERE c_custkey % 8 <> 5
      UNION ALL SELECT 'local-' || CAST(s_suppkey AS VARCHAR), 'z', CAST(s_suppkey AS VARCHAR), true FROM supplier),
own AS (SELECT * FROM l WHERE starts_with(file_id, 'slack-') = (connector = 'slack') AND fingerprint IS NOT NULL),
act AS (SELECT file_id, o.fingerprint AS nf, i.fingerprint AS of, i.file_id IS NOT NULL AS had, i.on_disk, lower(o.local_path) AS np, lower(i.local_path) AS op
        FROM (SELECT DISTINCT file_id FROM l) x FULL JOIN i USING (file_id) LEFT JOIN own o USING (file_id)),
done AS (SELECT file_id, CASE WHEN starts_with(file_id, 'slack-') THEN 'slack' WHEN starts_with(file_id, 'local-') THEN 'local' ELSE 'drive' END AS connector,
  CASE WHEN nf IS NOT NULL THEN CASE WHEN NOT had THEN 'added' WHEN nf = of AND np = op AND on_disk THEN 'skipped' ELSE 'changed' END
       WHEN NOT had THEN 'refused' WHEN starts_with(file_id, 'local-') THEN 'held' WHEN of IS NULL THEN 'foreign' ELSE 'removed' END AS action, nf, of FROM act)"""


def connector_tables(spark, sf):
    """Listings of two talking connectors and the inventory of three; the third lists nothing."""
    p, c, s = table(spark, sf, "part"), table(spark, sf, "customer"), table(spark, sf, "supplier")
    k, ck = F.col("p_partkey"), F.col("c_custkey")
    pk, cust = k.cast("string"), ck.cast("string")
    chat_path = F.concat(F.lit("slack/"), cust, F.lit(".md"))
    drive = p.filter(k % 11 != 3).select(
        F.lit("drive").alias("connector"), F.concat(F.when(k % 13 == 5, "slack-p").otherwise("d"), pk).alias("file_id"),
        F.when(k % 17 != 4, F.when(F.col("p_size") > 40, "x").otherwise("y")).alias("fingerprint"), F.concat(pk, F.lit(".md")).alias("local_path"))
    slack = c.filter(ck % 7 != 2).select(F.lit("slack").alias("connector"), F.concat(F.lit("slack-"), cust).alias("file_id"),
                                         F.md5("c_name").alias("fingerprint"), chat_path.alias("local_path"))
    known = (p.filter(k % 9 != 1).select(F.concat(F.lit("d"), pk).alias("file_id"), F.when(k % 19 != 6, F.lit("y")).alias("fingerprint"),
                                         F.concat(pk, F.lit(".MD")).alias("local_path"), (k % 5 != 2).alias("on_disk"))
             .unionByName(c.filter(ck % 8 != 5).select(
                 F.concat(F.lit("slack-"), cust).alias("file_id"), F.when(ck % 3 == 0, "old").otherwise(F.md5("c_name")).alias("fingerprint"),
                 chat_path.alias("local_path"), F.lit(True).alias("on_disk")))
             .unionByName(s.select(F.concat(F.lit("local-"), F.col("s_suppkey").cast("string")).alias("file_id"), F.lit("z").alias("fingerprint"),
                                   F.col("s_suppkey").cast("string").alias("local_path"), F.lit(True).alias("on_disk"))))
    return drive.unionByName(slack), known


@query("connector_union", f"WITH {_CONNECTORS} SELECT file_id, connector, action FROM done")
def connector_union(spark, sf):
    listings, known = connector_tables(spark, sf)
    return connectors.reconcile(listings, known, ["drive", "slack", "local"])


@query("connector_inventory", f"""WITH {_CONNECTORS} SELECT file_id, coalesce(CASE WHEN action IN ('added', 'changed') THEN nf END, of) AS fingerprint FROM done
WHERE action NOT IN ('removed', 'refused')""")
def connector_inventory(spark, sf):
    """The inventory after the actions: nothing of a silent connector or of hand-made entries is lost."""
    listings, known = connector_tables(spark, sf)
    actions = connectors.reconcile(listings, known, ["drive", "slack", "local"])
    return connectors.union_inventory(listings, known, actions).select("file_id", "fingerprint")


@query("index_changes", """SELECT 'p' || CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 7 = 1 THEN 'added' WHEN p_partkey % 7 = 2 THEN 'removed'
  WHEN p_partkey % 7 = 3 THEN 'updated' ELSE 'unchanged' END AS action FROM part""")
def index_changes(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 7
    path = F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path")
    now = p.filter(k != 2).select(path, F.lit(1.0).alias("mtime"), F.when(k == 3, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size"))
    return changes.index_changes(now, p.filter(k != 1).select(path, F.lit(1.0).alias("mtime"), F.col("p_size").alias("size")))


@query("vanished_pages", "SELECT 'p' || CAST(p_partkey AS VARCHAR) AS path FROM part WHERE p_size <= 25")
def vanished_pages(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), "p_size")
    return changes.remove_vanished(p.filter("p_size > 25"), p).select("path")


@query("lineage_paths", """SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS file_id, '/Drive/' || r_name AS path FROM region
UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), '/Drive/' || r_name || '/' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), '/Drive/' || r_name || '/' || n_name || '/' || c_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR), '/Drive/' || r_name || '/' || n_name || '/' || c_name || '/' || o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def lineage_paths(spark, sf):
    def rows(name, prefix, key, label, parent):
        return table(spark, sf, name).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("file_id"), F.col(label).alias("name"),
            parent.alias("parent_id"), F.lit(None).cast("string").alias("explicit_path"))

    def up(prefix, key):
        return F.concat(F.lit(prefix), F.col(key).cast("string"))

    listing = (rows("region", "r", "r_regionkey", "r_name", F.lit("root"))
               .unionByName(rows("nation", "n", "n_nationkey", "n_name", up("r", "n_regionkey")))
               .unionByName(rows("customer", "c", "c_custkey", "c_name", up("n", "c_nationkey")))
               .unionByName(rows("orders", "o", "o_orderkey", "o_orderpriority", up("c", "o_custkey"))))
    return changes.child_paths(listing, "root", "Drive")


# --- chat -------------------------------------------------------------------------------------------------
_CHAT = """
msg AS (SELECT CAST(conv_id AS VARCHAR) AS channel, '2024-01' AS month, 1704067200 + conv_id * 1000 + turn AS ts, role AS usr, conv_id, turn,
   CASE WHEN turn % 3 = 1 THEN 1704067200 + conv_id * 1000 + turn - 1 WHEN turn % 7 = 5 THEN 99 END AS thread, CASE WHEN turn % 2 = 0 THEN text || ' <@U1> <@U9>' ELSE text END AS text FROM conversations),
ln AS (SELECT channel, month, CASE WHEN thread > 99 THEN thread ELSE ts END AS block_ts, CASE WHEN thread = 99 THEN 1 ELSE 0 END AS block_kind,
   CASE WHEN thread > 99 THEN 1 ELSE 0 END AS is_reply, ts,
   CASE WHEN thread = 99 THEN '↳ ' ELSE '' END || CASE WHEN thread > 99 THEN '    ↳ ' ELSE '' END || strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') || ' — ' ||
   CASE usr WHEN 'user' THEN 'Ana' ELSE usr END || ': ' || replace(replace(replace(text, '<@U1>', '@Ana'), '<@U9>', '@U9'), chr(10), chr(10) || CASE WHEN thread > 99 THEN '    ↳ ' ELSE '' END || '  ') AS line FROM msg)"""


def chat_lines(spark, sf):
    c = table(spark, sf, "conversations")
    ts = 1704067200 + F.col("conv_id") * 1000 + F.col("turn")
    thread = F.when(F.col("turn") % 3 == 1, ts - 1).when(F.col("turn") % 7 == 5, F.lit(99))
    messages = c.select(
        F.col("conv_id").cast("string").alias("channel"), F.lit("2024-01").alias("month"), ts.cast("string").alias("ts"),
        F.when(F.col("role") == "user", "U1").otherwise(F.lit("")).alias("user"), F.col("role").alias("username"),
        F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" <@U1> <@U9>"))).otherwise(F.col("text")).alias("text"),
        thread.cast("string").alias("thread_ts"), F.lit(False).alias("has_files"))
    return chat.conversation_lines(messages, spark.createDataFrame([("U1", "Ana")], "id string, display string"))


@query("chat_render", f"WITH {_CHAT} SELECT channel, CAST(block_ts AS DOUBLE) AS block_ts, block_kind, is_reply, CAST(ts AS DOUBLE) AS ts, line FROM ln")
def chat_render(spark, sf):
    return chat_lines(spark, sf).select("channel", "block_ts", "block_kind", "is_reply", "ts", "line")


@query("chat_documents", f"""WITH {_CHAT} SELECT 'slack-' || substr(sha1(channel || '/' || month), 1, 12) AS file_id, channel || ' ' || month || '.md' AS name,
  'slack/' || channel || '/' || month || '.md' AS local_path, 'slack://' || channel || '/' || month AS source_uri, count(*) AS lines FROM ln GROUP BY channel, month""")
def chat_documents(spark, sf):
    return chat.conversation_documents(chat_lines(spark, sf)).select("file_id", "name", "local_path", "source_uri", "lines")


# --- supervision --------------------------------------------------------------------------------------------
_OPS = """
st AS (SELECT event_id, 'e' || CAST(event_id AS VARCHAR) AS file_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'duplicate' WHEN 'view' THEN 'processed' ELSE 'requeued' END AS status,
   CASE WHEN value < 1 THEN 'failed' WHEN value < 3 THEN 'partial' ELSE 'verified' END AS verification,
   CASE WHEN user_id % 9 = 0 THEN 'manual_review' ELSE 'usable' END AS quality, user_id % 5 = 0 AS ocr, user_id % 7 = 0 AS retried, user_id % 11 = 0 AS skipped,
   'timeout while reading ' || props AS error FROM events)"""


def ops_state(spark, sf):
    e, u = table(spark, sf, "events"), F.col("user_id")
    return e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("file_id"), F.col("event_type").alias("name"),
        F.expr("CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'duplicate' WHEN 'view' THEN 'processed' ELSE 'requeued' END").alias("status"),
        F.when(F.col("value") < 1, "failed").when(F.col("value") < 3, "partial").otherwise("verified").alias("verification"),
        F.when(u % 9 == 0, "manual_review").otherwise("usable").alias("quality"), (u % 5 == 0).alias("ocr"),
        (u % 7 == 0).alias("retried"), (u % 11 == 0).alias("skipped"), F.concat(F.lit("timeout while reading "), "props").alias("error"))


@query("ops_status", f"""WITH {_OPS}
SELECT 'status' AS dimension, status AS value, count(*) AS n FROM st GROUP BY ALL
UNION ALL SELECT 'verification', verification, count(*) FROM st WHERE status = 'processed' GROUP BY ALL
UNION ALL SELECT 'quality', quality, count(*) FROM st WHERE status = 'processed' GROUP BY ALL
UNION ALL SELECT 'flag', f, count(*) FROM (SELECT unnest([CASE WHEN ocr THEN 'ocr' END, CASE WHEN retried THEN 'retried' END, CASE WHEN skipped THEN 'skipped' END]) AS f
  FROM st WHERE status = 'processed') WHERE f IS NOT NULL GROUP BY ALL""")
def ops_status(spark, sf):
    return operations.status_counters(ops_state(spark, sf))


@query("ops_top_errors", f"WITH {_OPS} SELECT error, count(*) AS n FROM st WHERE status = 'error' GROUP BY ALL ORDER BY n DESC, error LIMIT 5")
def ops_top_errors(spark, sf):
    return operations.top_errors(ops_state(spark, sf))


@query("ops_problems", f"""WITH {_OPS} SELECT file_id, kind FROM (SELECT file_id, unnest([CASE WHEN verification = 'failed' AND status <> 'duplicate' THEN 'verify_failed' END,
  CASE WHEN verification = 'partial' AND status <> 'duplicate' THEN 'verify_partial' END, CASE WHEN quality = 'manual_review' AND status <> 'duplicate' THEN 'manual_review' END,
  CASE WHEN status IN ('error', 'duplicate') THEN status END]) AS kind FROM st) WHERE kind IS NOT NULL""")
def ops_problems(spark, sf):
    return operations.problems(ops_state(spark, sf)).select("file_id", "kind")


@query("ops_list_problems", f"WITH {_OPS} SELECT file_id FROM st WHERE verification = 'failed' AND status <> 'duplicate' ORDER BY file_id LIMIT 20")
def ops_list_problems(spark, sf):
    return operations.list_problems(ops_state(spark, sf), "verify_failed").select("file_id")


@query("ops_requeue", f"""WITH {_OPS}, c AS (SELECT file_id FROM st WHERE verification = 'failed' AND status NOT IN ('requeued', 'duplicate') ORDER BY file_id LIMIT 20)
SELECT file_id, CASE WHEN file_id IN (SELECT file_id FROM c) THEN 'requeued' ELSE status END AS status, CASE WHEN file_id IN (SELECT file_id FROM c) THEN 'failed figures' END AS requeue_reason FROM st""")
def ops_requeue(spark, sf):
    state = ops_state(spark, sf)
    return operations.requeue(state, state.filter("verification = 'failed'"), "failed figures").select("file_id", "status", "requeue_reason")


@query("ops_health", f"""WITH {_OPS}, s AS (SELECT count(*) FILTER (status = 'error') AS errors, count(*) FILTER (verification = 'failed' AND status <> 'duplicate') AS failed,
  count(*) FILTER (verification = 'partial' AND status <> 'duplicate') AS "partial", count(*) FILTER (quality = 'manual_review' AND status <> 'duplicate') AS manual_review FROM st)
SELECT *, CASE WHEN errors + failed > 0 THEN 'red' WHEN "partial" + manual_review > 0 THEN 'yellow' ELSE 'green' END AS health FROM s""")
def ops_health(spark, sf):
    return operations.health(ops_state(spark, sf))


@query("pass_statistics", f"""WITH {_OPS} SELECT count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'error') AS errors,
  count(*) FILTER (verification = 'verified') AS verify_verified, count(*) FILTER (verification = 'partial') AS verify_partial, count(*) FILTER (verification = 'failed') AS verify_failed,
  CAST(sum(event_id % 5) AS BIGINT) AS facts_kept, CAST(sum(event_id % 2) AS BIGINT) AS facts_rejected, CAST(sum(event_id) AS BIGINT) AS tokens FROM st""")
def pass_statistics(spark, sf):
    n = F.substring("file_id", 2, 20).cast("bigint")
    return operations.pass_statistics(ops_state(spark, sf).withColumns(
        {"verdict": F.col("verification"), "facts_kept": n % 5, "facts_rejected": n % 2, "tokens": n}))


# --- small parts of connectors and access ------------------------------------------------------------------
@query("labels_valid", """WITH l AS (SELECT doc_id, source || CASE doc_id % 5 WHEN 0 THEN ',x' WHEN 1 THEN ' ' WHEN 2 THEN '' ELSE '-' || lang END AS label FROM documents
  UNION ALL SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '  ' END FROM labels)
SELECT doc_id, label, label IS NOT NULL AND NOT contains(label, ',') AND trim(label) <> '' AND trim(label) = label AS ok FROM l""")
def labels_valid(spark, sf):
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", F.concat("source", F.when(k % 5 == 0, ",x").when(k % 5 == 1, " ").when(k % 5 == 2, "").otherwise(
        F.concat(F.lit("-"), "lang"))).alias("label"))
    odd = table(spark, sf, "labels").select("doc_id", F.when(k % 3 == 0, None).when(k % 3 == 1, "").otherwise("  ").alias("label"))
    return d.unionByName(odd).withColumn("ok", label_ok(F.col("label")))


@query("usage_merged", """SELECT e1.user_id, e1.event_type AS kind, n1 + coalesce(n2, 0) AS calls FROM
  (SELECT user_id, event_type, count(*) AS n1 FROM events WHERE value < 50 GROUP BY ALL) e1
  LEFT JOIN (SELECT user_id, event_type, count(*) AS n2 FROM events WHERE value >= 50 GROUP BY ALL) e2 USING (user_id, event_type)
UNION ALL SELECT user_id, event_type, count(*) FROM events WHERE value >= 50 AND (user_id, event_type) NOT IN
  (SELECT (user_id, event_type) FROM events WHERE value < 50) GROUP BY ALL""")
def usage_merged(spark, sf):
    """Usage maps of two halves of the events, summed key by key."""
    e = table(spark, sf, "events")

    def usage(rows, name):
        return (rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id")
                .agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias(name)))

    none = F.create_map().cast("map<string,bigint>")
    both = usage(e.filter("value < 50"), "a").join(usage(e.filter("value >= 50"), "b"), "user_id", "full_outer")
    return both.select("user_id", F.explode(operations.merge_usage(F.coalesce("a", none), F.coalesce("b", none))).alias("kind", "calls"))


@query("listing_fields", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus END AS name,
  CASE o_orderkey % 4 WHEN 0 THEN [CAST(o_custkey AS VARCHAR)] WHEN 1 THEN [CAST(o_custkey AS VARCHAR), 'r'] WHEN 2 THEN [CAST(o_custkey AS VARCHAR)] ELSE [] END AS parents FROM orders""")
def listing_fields(spark, sf):
    """The first non-empty field of several, and parents in all the forms that listings use."""
    k, who = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    record = (F.when(k % 3 == 0, F.create_map(F.lit("name"), F.lit(""), F.lit("title"), F.col("o_orderpriority")))
              .when(k % 3 == 1, F.create_map(F.lit("name"), F.col("o_orderstatus"), F.lit("title"), F.lit("x"))).otherwise(F.create_map(F.lit("other"), F.lit("y"))))
    raw = (F.when(k % 4 == 0, who).when(k % 4 == 1, F.concat(F.lit('["'), who, F.lit('","r"]')))
           .when(k % 4 == 2, F.concat(F.lit('[{"id":"'), who, F.lit('"},{"x":"y"}]'))))
    return table(spark, sf, "orders").select("o_orderkey", first_field(record, ["name", "title"]).alias("name"), parent_ids(raw).alias("parents"))
