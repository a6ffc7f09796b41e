"""Pages to an entity graph: nodes, links, rewritten pages, stale files."""
from __future__ import annotations

from pyspark.sql import DataFrame

from sourceloom.operators import changes, graph


def build_graph(pages: DataFrame, mentions: DataFrame, registry: DataFrame | None = None, min_mentions: int = 2,
                previous: DataFrame | None = None) -> dict[str, DataFrame]:
    """``pages``: page, text; ``mentions``: page, pos, name, type; ``previous``: path of earlier output."""
    clean = graph.clean_mentions(mentions)
    counts = graph.mention_counts(clean)
    entities = graph.build_entities(counts, registry, min_mentions)
    nodes = graph.render_nodes(entities, graph.node_aliases(counts, entities, registry))
    linked = graph.linked_pages(pages, graph.related_links(clean, entities, registry))
    out = {"entities": entities, "nodes": nodes, "pages": linked}
    if previous is not None:
        written = nodes.select("path").unionByName(linked.selectExpr("page AS path"))
        out["stale"] = changes.remove_vanished(written, previous)
    return out


def propose_merges(mentions: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    counts = graph.mention_counts(graph.clean_mentions(mentions))
    keys = graph.keyed(counts, registry).select("key").distinct()
    return graph.propose_merges(graph.merge_candidates(keys), graph.top_spelling(counts, registry))


def apply_merge(registry: DataFrame, entity_id: str, name: str, entity_type: str, absorbed: list[str]) -> DataFrame:
    """Fold names into one registry entity.

    Another entity whose own id or name is claimed is absorbed; one that merely shares an alias
    gives that alias up and stays.
    """
    from pyspark.sql import functions as F

    from sourceloom.functions.words import entity_key
    spark = registry.sparkSession
    claimed = (spark.createDataFrame([(n,) for n in [entity_id, name, *absorbed]], "n string")
               .select(entity_key(F.col("n")).alias("key")).filter(F.col("key") != "").distinct())
    own = registry.filter(F.col("entity_id") == entity_id)
    others = registry.filter(F.col("entity_id") != entity_id)
    identity = (others.select("entity_id", F.explode(F.array("entity_id", "name")).alias("n"))
                .select("entity_id", entity_key(F.col("n")).alias("key")))
    swallowed = identity.join(claimed, "key", "left_semi").select("entity_id").distinct()
    kept = others.join(swallowed, "entity_id", "left_anti")
    spelled = (kept.select("entity_id", F.explode_outer("aliases").alias("alias"))
               .withColumn("key", entity_key(F.col("alias"))).join(claimed, "key", "left_anti"))
    trimmed = (kept.select("entity_id", "name", "type").join(
        spelled.groupBy("entity_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases")), "entity_id", "left")
        .withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))))
    given = (own.select(F.explode("aliases").alias("a"))
             .unionByName(others.join(swallowed, "entity_id", "left_semi").select(
                 F.explode(F.concat(F.array("entity_id", "name"), "aliases")).alias("a")))
             .unionByName(spark.createDataFrame([(a,) for a in absorbed], "a string")))
    display = F.coalesce(F.first(F.col("_name"), ignorenulls=True), F.lit(name))
    head = own.select(F.col("name").alias("_name"), F.col("type").alias("_type")).agg(
        display.alias("name"), F.coalesce(F.first("_type", ignorenulls=True), F.lit(entity_type)).alias("type"))
    names = given.agg(F.array_sort(F.collect_set("a")).alias("aliases"))
    merged = head.join(F.broadcast(names)).select(
        F.lit(entity_id).alias("entity_id"), "name", "type", F.filter("aliases", lambda a: a != F.col("name")).alias("aliases"))
    return trimmed.unionByName(merged)
