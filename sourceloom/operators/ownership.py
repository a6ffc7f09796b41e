"""Who owns a document and who may read it, both derived from its path."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import paths


def build_catalog(files: DataFrame, conventions: dict | None = None) -> DataFrame:
    """Known entities (pass 1): one name per slug, the first by path."""
    return (files.select("path", paths.anchored_entity(F.col("path"), conventions).alias("e"))
            .filter(F.col("e.slug") != "")
            .groupBy(F.col("e.slug").alias("slug"))
            .agg(F.min(F.struct("path", F.col("e.name").alias("name"))).alias("first"))
            .select("slug", F.col("first.name").alias("name")))


def resolve_entities(files: DataFrame, conventions: dict | None = None, catalog: bool = True) -> DataFrame:
    """Adds an ``entity`` struct, ``path_date`` and ``path_period`` to every file.

    Pass 2 looks folder names up in the catalog.  Folders repeat across files, so the look-up runs
    over *distinct* folders (a directory with a third of all files is one row), and the result is
    joined back on the folder.
    """
    df = files.withColumn("_anchored", paths.anchored_entity(F.col("path"), conventions))
    if catalog:
        folder = F.regexp_replace(F.col("path"), "/[^/]*$", "")
        names = build_catalog(files, conventions)
        candidates = (df.filter(F.col("_anchored").isNull() | (F.col("_anchored.slug") == ""))
                      .select(F.col("path").alias("_whole"), folder.alias("_folder")))
        # the file name itself may also name an entity, but only when it has no known extension
        folders = (candidates.select("_folder").distinct()
                   .select("_folder", F.explode(paths.folder_candidates(F.col("_folder"), conventions)).alias("c")))
        matched = (folders.join(names, folders["c.slug"] == names["slug"])
                   .groupBy("_folder")
                   .agg(F.min(F.struct("c.pos", names["name"], names["slug"], "c.status", "c.seq")).alias("hit"))
                   .select("_folder", _from_catalog(F.col("hit")).alias("_folder_hit")))
        leaves = (candidates.select("_whole", F.explode(paths.folder_candidates(
            paths.base_name(F.col("_whole")), conventions)).alias("c")))
        leaf_hits = (leaves.join(names, leaves["c.slug"] == names["slug"])
                     .select("_whole", _from_catalog(F.struct(
                         "c.pos", names["name"], names["slug"], "c.status", "c.seq")).alias("_leaf_hit")))
        df = (df.withColumn("_folder", folder).join(matched, "_folder", "left")
              .join(leaf_hits.withColumnRenamed("_whole", "path"), "path", "left"))
        entity = (F.when(F.col("_anchored.slug") != "", F.col("_anchored"))
                  .otherwise(F.coalesce("_folder_hit", "_leaf_hit", "_anchored")))
    else:
        entity = F.col("_anchored")
    return (df.withColumns({"entity": entity, "path_date": paths.path_year(F.col("path")),
                            "path_period": paths.path_period(F.col("path"))})
            .drop("_anchored", "_folder", "_folder_hit", "_leaf_hit"))


def _from_catalog(hit: Column) -> Column:
    return F.struct(hit["name"].alias("name"), hit["slug"].alias("slug"), F.lit("tracked").alias("kind"),
                    hit["seq"].alias("seq"), hit["status"].alias("status"),
                    F.lit(None).cast("string").alias("stage"))


def resolve_acl(config: dict | None, path: Column, unit: Column, kind: Column) -> Column:
    """Audience labels of a document: the first matching rule, else the default; NULL without config."""
    if config is None:
        return F.lit(None).cast("array<string>")
    low = F.lower(F.coalesce(path, F.lit("")))

    def labels(names: list[str]) -> Column:
        return F.array(*[F.lit(n) for n in names])

    result = labels(config["default"])
    for rule in reversed(config["rules"]):
        hit = F.lit(False)
        if "path_prefix" in rule:
            hit = hit | low.startswith(str(rule["path_prefix"]).lower())
        if "path_contains" in rule:
            hit = hit | low.contains(str(rule["path_contains"]).lower())
        if "unit" in rule:
            hit = hit | (F.lower(F.coalesce(unit, F.lit(""))) == str(rule["unit"]).lower())
        if "entity_kind" in rule:
            hit = hit | (F.coalesce(kind, F.lit("")) == rule["entity_kind"])
        result = F.when(hit, labels(rule["audiences"])).otherwise(result)
    return result


def shared_audience(members: DataFrame, key: str, acl: str = "acl") -> DataFrame:
    """Per group, the labels every restricted member grants; NULL when no member is restricted.

    One counted row per (group, label): members combine on the map side, and what is gathered per
    group is bounded by the audience vocabulary of the configuration, not by the group.
    """
    # every member contributes a NULL label (restricted or not) plus its distinct labels
    labels = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(F.coalesce(acl, F.array().cast("array<string>"))))
    counted = (members.select(key, F.col(acl).isNotNull().alias("_r"), F.explode(labels).alias("_label"))
               .groupBy(key, "_label").agg(F.count_if("_r").alias("_n")))
    grouped = counted.groupBy(key).agg(
        F.max(F.when(F.col("_label").isNull(), F.col("_n"))).alias("_restricted"),
        F.collect_list(F.when(F.col("_label").isNotNull(), F.struct("_label", "_n"))).alias("_counts"))
    common = F.array_sort(F.transform(F.filter("_counts", lambda c: c["_n"] == F.col("_restricted")), lambda c: c["_label"]))
    return grouped.select(key, F.when(F.col("_restricted") > 0, common).alias("acl"))
