"""Catalogue: curation, inventory, ownership and access."""
from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.functions import paths
from sourceloom.functions.access import visible
from sourceloom.operators import curation as ops
from sourceloom.operators import ownership
from sourceloom.queries.registry import query
from sourceloom.queries.views import FILES_SQL, files, index_pages, table, INDEX_SQL

_NORM = "lower(strip_accents({0}))"


def _sql_classify() -> str:
    p, b = _NORM.format("path"), _NORM.format("regexp_extract(path, '[^/]*$')")
    e = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '(\.[^.]*)$', 1))"
    out = []
    for rule in ops.DEFAULT_TAXONOMY["rules"]:
        tests = [f"{e} = '{x}'" for x in rule.get("ext", [])]
        tests += [f"contains({b}, '{x}')" for x in rule.get("basename_any", [])]
        tests += [f"contains({p}, '{x}')" for x in rule.get("path_any", [])]
        tests += [f"regexp_matches({p}, '{x}')" for x in rule.get("path_regex", [])]
        out.append(f"WHEN {' OR '.join(tests)} THEN '{rule['type']}|{rule['verdict']}'")
    return "CASE " + " ".join(out) + " ELSE 'other|MAYBE' END"


_CLASSIFIED = FILES_SQL + f""",
cl0 AS (SELECT *, {_sql_classify()} AS lab FROM files WHERE contains(substr(path, 3), '/')),
cl AS (SELECT file_id, path, name, size, hash, s, split_part(lab, '|', 1) AS type, split_part(lab, '|', 2) AS verdict,
       split_part(substr(path, 3), '/', 1) AS unit FROM cl0)"""
_NOISE = ("(lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN (" + ",".join(f"'{x}'" for x in ops.NON_DOCUMENT_EXTENSIONS)
          + ") OR type IN ('other', 'internal-admin'))")
_CURATED = _CLASSIFIED + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY {_NOISE}, verdict <> 'IN',
    regexp_matches(path, '(?i)(copy|\\(\\d+\\)|_old|_v\\d+\\b|draft|unsigned)'),
    length(path) - length(replace(path, '/', '')), path) AS rn FROM cl WHERE verdict IN ('IN', 'MAYBE') AND size > 0),
manifest AS (SELECT path, type, verdict, unit, hash, size FROM ranked WHERE rn = 1
    UNION ALL SELECT path, type, verdict, unit, hash, size FROM cl WHERE verdict IN ('IN', 'MAYBE') AND size = 0)"""


def classified(spark, sf):
    return ops.classify(files(spark, sf))


def manifest(spark, sf):
    return ops.curate(classified(spark, sf))


@query("file_inventory", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, length(text) AS chars, "
       "'local-' || substr(sha1(source || '/' || CAST(doc_id AS VARCHAR)), 1, 12) AS local_key FROM documents")
def file_inventory(spark, sf):
    rel = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"),
        F.length("text").cast("bigint").alias("chars"), paths.local_key(rel).alias("local_key"))


@query("classify_taxonomy", f"WITH {_CLASSIFIED} SELECT file_id, path, type, verdict, unit, size FROM cl")
def classify_taxonomy(spark, sf):
    return classified(spark, sf).select("file_id", "path", "type", "verdict", "unit", "size")


@query("taxonomy_matrix", f"WITH {_CLASSIFIED} SELECT type, unit, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes "
       "FROM cl GROUP BY ALL")
def taxonomy_matrix(spark, sf):
    return ops.taxonomy_matrix(classified(spark, sf))


@query("taxonomy_examples", f"WITH {_CLASSIFIED} SELECT type, CAST(rank AS BIGINT) AS rank, path FROM "
       "(SELECT type, path, row_number() OVER (PARTITION BY type ORDER BY path) AS rank FROM cl) WHERE rank <= 8")
def taxonomy_examples(spark, sf):
    return ops.taxonomy_examples(classified(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@query("dedup_canonical", f"WITH {_CURATED} SELECT * FROM manifest")
def dedup_canonical(spark, sf):
    return manifest(spark, sf)


@query("dedup_groups", f"WITH {FILES_SQL} SELECT hash, count(*) AS copies, min(path) AS first_path, max(size) AS size, "
       "(count(*) - 1) * max(size) AS redundant_bytes FROM files WHERE size > 0 GROUP BY hash HAVING count(*) > 1")
def dedup_groups(spark, sf):
    return ops.duplicate_groups(files(spark, sf))


@query("trim_manifest", f"WITH {_CURATED} SELECT path, type, verdict, unit, size FROM manifest WHERE NOT {_NOISE}")
def trim_manifest(spark, sf):
    return ops.trim(manifest(spark, sf)).select("path", "type", "verdict", "unit", "size")


_MIME = "CASE lower(regexp_extract(path, '\\.([^./]*)$', 1)) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in ops.MIME_TYPES.items()) + " END"


@query("build_inventory", f"""WITH {_CURATED},
ids AS (SELECT substr(path, 3) AS rel, 'drive' || CAST(doc_id AS VARCHAR) AS fid FROM files WHERE s < 10),
t AS (SELECT m.*, substr(m.path, 3) AS rel FROM manifest m WHERE NOT {_NOISE})
SELECT coalesce(fid, 'local-' || substr(sha1(t.rel), 1, 12)) AS file_id, regexp_extract(t.rel, '[^/]*$') AS name,
  t.rel AS local_path, t.rel AS drive_path,
  CASE WHEN fid IS NULL THEN 'local://' || t.rel ELSE 'https://drive.google.com/file/d/' || fid || '/view' END AS source_uri,
  unit AS org_unit, {_MIME} AS mime_type
FROM t LEFT JOIN ids ON ids.rel = t.rel""")
def build_inventory(spark, sf):
    ids = files(spark, sf).filter("s < 10").select(
        paths.relative(F.col("path")).alias("path"),
        F.concat(F.lit("drive"), F.col("doc_id").cast("string")).alias("file_id"))
    return ops.build_inventory(ops.trim(manifest(spark, sf)), ids)


@query("extraction_routing", f"""WITH {FILES_SQL} SELECT file_id, CASE lower(regexp_extract(path, '(\\.[^./]*)$', 1))
  WHEN '.pdf' THEN 'pdf' WHEN '.csv' THEN 'sheet' WHEN '.docx' THEN 'docx' ELSE 'text' END AS method FROM files""")
def extraction_routing(spark, sf):
    return files(spark, sf).select("file_id", paths.extraction_method(paths.extension(F.col("path"))).alias("method"))


_ENTITIES = FILES_SQL + """,
ent AS (SELECT *, CASE WHEN s = 19 OR s % 5 = 4 THEN NULL WHEN s % 5 IN (0, 3) THEN 'Company ' || CAST(s - s % 5 AS VARCHAR)
      WHEN s % 5 = 1 THEN 'Société ' || CAST(s AS VARCHAR) ELSE 'Prospect ' || CAST(s AS VARCHAR) END AS ename FROM files)"""


@query("path_entities", f"""WITH {_ENTITIES}
SELECT file_id, ename AS entity_name, replace(lower(strip_accents(ename)), ' ', '-') AS entity_slug,
  CASE WHEN ename IS NULL THEN NULL WHEN s % 5 = 2 THEN 'prospect' ELSE 'tracked' END AS kind,
  CASE WHEN ename IS NOT NULL AND s % 5 IN (0, 1) THEN CAST(s + 1 AS BIGINT) END AS seq,
  CASE WHEN ename IS NULL THEN NULL WHEN s % 5 = 0 THEN 'archived' WHEN s % 5 = 2 THEN 'closed' END AS status,
  CASE WHEN ename IS NOT NULL AND s % 5 = 2 THEN 'Evaluating' END AS stage,
  list_max(regexp_extract_all(path, '\\b(20[0-9][0-9])\\b', 1)) AS path_date,
  list_max(regexp_extract_all(path, '\\b(20[0-9][0-9])\\b', 1)) || '-Q' || nullif(regexp_extract(path, '\\bQ\\s?([1-4])\\b', 1), '') AS path_period
FROM ent""")
def path_entities(spark, sf):
    r = ownership.resolve_entities(files(spark, sf).select("file_id", "path"))
    return r.select("file_id", F.col("entity.name").alias("entity_name"), F.col("entity.slug").alias("entity_slug"),
                    "entity.kind", "entity.seq", "entity.status", "entity.stage", "path_date", "path_period")


@query("entity_catalog", f"""WITH {_ENTITIES} SELECT replace(lower(strip_accents(ename)), ' ', '-') AS slug, min(ename) AS name
FROM ent WHERE ename IS NOT NULL AND s % 5 <> 3 GROUP BY 1""")
def entity_catalog(spark, sf):
    return ownership.build_catalog(files(spark, sf))


@query("page_paths", f"""WITH {_ENTITIES}
SELECT file_id, CASE WHEN s = 19 THEN 'general' WHEN s % 5 = 4 THEN 'units/ops' WHEN s % 5 = 2 THEN 'prospects/prospect-' || CAST(s AS VARCHAR)
   ELSE 'entities/' || replace(lower(strip_accents(ename)), ' ', '-') END AS folder,
  lower(trim(regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '[^a-zA-Z0-9]+', '-', 'g'), '-')) || '-' || substr(sha1(file_id), 1, 6) AS slug
FROM ent""")
def page_paths(spark, sf):
    r = ownership.resolve_entities(files(spark, sf).select("file_id", "path", "name"))
    unit = F.when(paths.relative(F.col("path")).contains("/"), paths.top_folder(F.col("path")))
    return r.select("file_id", paths.page_folder(F.col("entity.slug"), F.col("entity.kind"), unit).alias("folder"),
                    paths.page_slug(F.col("name"), F.col("file_id")).alias("slug"))


ACL_CONFIG = {"default": ["all"], "rules": [
    {"path_prefix": "./Clients/2021", "audiences": ["sales", "leadership"]},
    {"path_contains": "minutes", "audiences": ["leadership"]},
    {"unit": "research", "audiences": ["science"]},
    {"entity_kind": "prospect", "audiences": ["sales"]}]}
_ACL_SQL = _ENTITIES + """,
acls AS (SELECT *, CASE WHEN starts_with(lower(path), './clients/2021') THEN 'sales,leadership' WHEN contains(lower(path), 'minutes') THEN 'leadership'
   WHEN split_part(substr(path, 3), '/', 1) = 'Research' THEN 'science' WHEN ename IS NOT NULL AND s % 5 = 2 THEN 'sales' ELSE 'all' END AS acl FROM ent)"""


def with_acl(spark, sf):
    r = ownership.resolve_entities(files(spark, sf).select("file_id", "path"))
    acl = ownership.resolve_acl(ACL_CONFIG, F.col("path"), paths.top_folder(F.col("path")), F.col("entity.kind"))
    return r.select("file_id", "path", F.col("entity.slug").alias("entity"), acl.alias("acl"))


@query("acl_resolve", f"WITH {_ACL_SQL} SELECT file_id, acl FROM acls")
def acl_resolve(spark, sf):
    return with_acl(spark, sf).select("file_id", F.array_join("acl", ",").alias("acl"))


@query("acl_visible", f"WITH {_ACL_SQL} SELECT file_id, path FROM acls WHERE list_has_any(string_split(acl, ','), ['sales', 'science'])")
def acl_visible(spark, sf):
    return with_acl(spark, sf).filter(visible(F.col("acl"), {"sales", "science"})).select("file_id", "path")


@query("acl_visible_index", f"""WITH {INDEX_SQL}
SELECT path, entity FROM idx WHERE acl_csv IS NULL OR contains(',' || acl_csv || ',', ',eng,')""")
def acl_visible_index(spark, sf):
    return index_pages(spark, sf).filter(visible(F.col("acl"), {"eng"})).select("path", "entity")


@query("visible_entities", f"""WITH {INDEX_SQL} SELECT DISTINCT entity FROM idx
WHERE entity <> '' AND (acl_csv IS NULL OR contains(',' || acl_csv || ',', ',finance,'))""")
def visible_entities(spark, sf):
    return index_pages(spark, sf).filter(visible(F.col("acl"), {"finance"}) & (F.col("entity") != "")).select("entity").distinct()


@query("shared_audience", f"""WITH {_ACL_SQL},
m AS (SELECT lang AS grp, CASE WHEN acl = 'all' THEN NULL ELSE acl || ',ops' END AS acl FROM acls),
r AS (SELECT grp, count(acl) AS n FROM m GROUP BY grp),
l AS (SELECT grp, lab, count(*) AS k FROM (SELECT grp, unnest(list_distinct(string_split(acl, ','))) AS lab FROM m WHERE acl IS NOT NULL) GROUP BY 1, 2)
SELECT r.grp, CASE WHEN n > 0 THEN coalesce((SELECT string_agg(lab, ',' ORDER BY lab) FROM l WHERE l.grp = r.grp AND k = n), '') END AS acl FROM r""")
def shared_audience(spark, sf):
    langs = files(spark, sf).select("file_id", F.col("lang").alias("grp"))
    acl = with_acl(spark, sf)
    open_ = F.when(~F.array_contains("acl", "all"), F.concat("acl", F.array(F.lit("ops"))))
    members = acl.join(langs, "file_id").select("grp", open_.alias("acl"))
    return ownership.shared_audience(members, "grp").select("grp", F.array_join("acl", ",").alias("acl"))
