"""Mentions, canonical entities, links between pages and entities, merge proposals.

Mentions: ``page, pos, name, type``.  Registry: ``entity_id, name, type, aliases``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourceloom.functions.fold import node_slug
from sourceloom.functions.words import entity_key, is_noise_key
from sourceloom.operators.naming import add_ratio, close_pairs, contained_pairs
from sourceloom.session import cut_lineage

NODE_ALIASES = 8            # fixed value: aliases listed on a node page
MERGE_RATIO = 0.75          # fixed value: similarity that proposes a merge
# Sentence openers that are not entity names (offline mention guesser).
NOT_NAMES = [
    "This", "That", "These", "Those", "There", "Then", "When", "Where", "What", "While",
    "With", "From", "Into", "Over", "Under", "After", "Before", "About", "Please", "Thanks",
    "Team", "Notes", "Meeting", "Report", "Quarterly", "Monthly", "Annual", "Summary",
    "Revenue", "Total", "Status", "Update", "Draft", "Agenda", "Action", "Next", "Overview",
]


def guess_mentions(docs: DataFrame, key: str, text: str = "text", min_count: int = 3, top: int | None = None) -> DataFrame:
    """Capitalised words a document repeats, by alphabet; ``top`` cuts the list for a display."""
    words = F.regexp_extract_all(
        F.col(text), F.lit(r"(?<![\p{L}\p{N}_])[A-Z][a-zA-Z]{3,}(?![\p{L}\p{N}_])"), F.lit(0))
    counted = (docs.select(key, F.explode(words).alias("name")).filter(~F.col("name").isin(NOT_NAMES))
               .groupBy(key, "name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count))
    ranked = counted.withColumn("pos", F.row_number().over(W.partitionBy(key).orderBy("name")))
    return (ranked if top is None else ranked.filter(F.col("pos") <= top)).select(key, "pos", "name", F.lit("organization").alias("type"))


def clean_mentions(mentions: DataFrame) -> DataFrame:
    """Blank names dropped, a missing type becomes "other"."""
    return (mentions.withColumn("name", F.trim("name")).filter(F.col("name") != "")
            .withColumn("type", F.when(F.coalesce("type", F.lit("")) == "", "other").otherwise(F.col("type"))))


def mention_counts(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"))


def registry_aliases(registry: DataFrame) -> DataFrame:
    """alias_key -> entity_id; of entities that claim a spelling the last one keeps it.

    Last by ``position`` (place in the registry file), or by id where the registry has no such column.
    """
    place = F.col("position") if "position" in registry.columns else F.lit(0)
    spellings = F.explode(F.concat(F.array("entity_id", "name"), F.coalesce("aliases", F.array())))
    return (registry.select("entity_id", place.alias("place"), spellings.alias("spelling"))
            .select(entity_key(F.col("spelling")).alias("alias_key"), "place", "entity_id")
            .filter(F.col("alias_key") != "").groupBy("alias_key").agg(F.max(F.struct("place", "entity_id")).alias("last"))
            .select("alias_key", F.col("last.entity_id").alias("entity_id")))


def keyed(counts: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Adds ``key`` (registry id, else normalised name) and ``registered``."""
    df = counts.withColumn("_norm", entity_key(F.col("name")))
    if registry is None:
        return df.withColumnRenamed("_norm", "key").withColumn("registered", F.lit(False))
    aliases = registry_aliases(registry).withColumnRenamed("alias_key", "_norm")
    return (df.join(aliases, "_norm", "left")
            .withColumns({"key": F.coalesce("entity_id", "_norm"), "registered": F.col("entity_id").isNotNull()})
            .drop("_norm", "entity_id"))


def shouted(name: Column) -> Column:
    return (F.upper(name) == name) & (F.lower(name) != name)


def entity_aliases(counts: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """One row per (key, spelling) with its count, noise removed."""
    named = keyed(counts, registry).filter((F.col("key") != "") & (F.col("registered") | ~is_noise_key(F.col("key"))))
    return named.groupBy("key", "name").agg(F.sum("n").alias("n"))


def build_entities(counts: DataFrame, registry: DataFrame | None = None, min_mentions: int = 2) -> DataFrame:
    """Canonical entities: key, slug, title, type, mentions, spellings.

    Everything is an aggregate over pre-counted spellings, so a name that makes up a third of all
    mentions is a single input row here.
    """
    named = keyed(counts, registry).filter((F.col("key") != "") & (F.col("registered") | ~is_noise_key(F.col("key"))))
    types = named.groupBy("key", "type").agg(F.sum("n").alias("n"))
    best_type = types.groupBy("key").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "type")).alias("t"), F.sum("n").alias("mentions"))
    names = named.groupBy("key", "name").agg(F.sum("n").alias("n"))
    best_name = names.groupBy("key").agg(
        F.min(F.struct(shouted(F.col("name")).alias("u"), F.length("name").alias("l"), (-F.col("n")).alias("n"), "name"))
        .alias("b"), F.count(F.lit(1)).alias("spellings"))
    base = (best_type.filter(F.col("mentions") >= min_mentions).join(best_name, "key")
            .select("key", F.col("t.type").alias("type"), F.col("b.name").alias("title"), "mentions", "spellings"))
    if registry is not None:
        reg = registry.select(F.col("entity_id").alias("key"), F.col("name").alias("_name"), F.col("type").alias("_type"))
        base = (base.join(reg, "key", "left")
                .withColumns({"title": F.coalesce("_name", "title"), "type": F.coalesce("_type", "type")})
                .drop("_name", "_type"))
    return unique_slugs(base.withColumn("base", F.concat(F.lit("entities/"), "type", F.lit("/"), node_slug(F.col("key")))))


def unique_slugs(entities: DataFrame) -> DataFrame:
    """Numbered suffixes for colliding slugs, skipping numbers a real slug already uses.

    The k-th collision takes the k-th number from 2 on that is free.  Below the j-th used number u there are
    u - j - 1 free ones, so the number is k + 1 plus the used numbers with fewer than k free ones below:
    a running count over one ordering, however many entities share a slug.
    """
    ordered = entities.withColumn("_k", F.row_number().over(W.partitionBy("base").orderBy("key")) - 1)
    colliding = ordered.filter(F.col("_k") > 0)
    taken = (entities.filter(F.col("base").rlike(r"-[1-9]\d*$")).select(
        F.regexp_replace("base", r"-[1-9]\d*$", "").alias("base"),
        F.regexp_extract("base", r"-([1-9]\d*)$", 1).try_cast("bigint").alias("_u")).filter(F.col("_u") >= 2).distinct()
        .withColumn("_free", F.col("_u") - F.row_number().over(W.partitionBy("base").orderBy("_u")) - 1))
    line = (colliding.select("base", F.col("_k").cast("bigint").alias("at"), "key", F.lit(0).alias("used"))
            .unionByName(taken.select("base", F.col("_free").alias("at"), F.lit(None).cast("string").alias("key"), F.lit(1).alias("used"))))
    below = F.sum("used").over(W.partitionBy("base").orderBy("at", "used").rowsBetween(W.unboundedPreceding, W.currentRow))
    numbered = (line.withColumn("_below", below).filter(F.col("used") == 0)
                .select("base", "key", (F.col("at") + 1 + F.col("_below")).alias("_number")))
    return (ordered.join(numbered, ["base", "key"], "left")
            .withColumn("slug", F.when(F.col("_k") == 0, F.col("base")).otherwise(
                F.concat("base", F.lit("-"), F.col("_number").cast("string"))))
            .drop("base", "_k", "_number"))


def node_aliases(counts: DataFrame, entities: DataFrame, registry: DataFrame | None = None,
                 top: int = NODE_ALIASES) -> DataFrame:
    """Spellings listed on a node page: most frequent first, the title itself left out."""
    spelled = (entity_aliases(counts, registry).join(entities.select("key", "title"), "key")
               .filter(F.col("name") != F.col("title")))
    ranked = spelled.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("n"), "name")))
    return ranked.filter(F.col("rank") <= top).select("key", "rank", "name", "n")


def related_links(mentions: DataFrame, entities: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Links of each page to surviving entities: first mention of an entity wins, in order."""
    first = (keyed(mentions, registry).groupBy("page", "key")
             .agg(F.min(F.struct("pos", "name")).alias("first")))
    return (first.join(entities.select("key", "slug"), "key")
            .select("page", F.col("first.pos").alias("pos"),
                    F.concat(F.lit("- [["), "slug", F.lit("|"), "first.name", F.lit("]]")).alias("link")))


def linked_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Page text with its "Related entities" section (links of one page only are gathered)."""
    section = (links.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "link"))).alias("l"))
               .select("page", F.array_join(F.transform("l", lambda s: s["link"]), "\n").alias("section")))
    body = F.concat(F.regexp_replace("text", r"\s+$", ""), F.lit("\n"))
    return (pages.join(section, "page", "left")
            .withColumn("text", F.concat(body, F.coalesce(F.concat(
                F.lit("\n## Related entities\n\n"), "section", F.lit("\n")), F.lit("")))).drop("section"))


def render_nodes(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    from sourceloom.functions.render import scalar
    listed = (aliases.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("a"))
              .select("key", F.concat(F.lit("aliases: ["), F.array_join(F.transform("a", lambda s: scalar(s["name"])), ", "),
                                      F.lit("]")).alias("aliases")))
    front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("type: "), scalar(F.col("type"))),
                        F.concat(F.lit("title: "), scalar(F.col("title"))), F.col("aliases"), F.lit("---"))
    return (entities.join(listed, "key", "left")
            .select(F.concat("slug", F.lit(".md")).alias("path"),
                    F.concat(front, F.lit("\n\n# "), "title", F.lit("\n\nEntity of type "), "type", F.lit(".\n")).alias("text")))


# --- merge proposals -------------------------------------------------------------------------------
def merge_candidates(keys: DataFrame, with_ratio: bool = True) -> DataFrame:
    """Entity keys that may name the same thing: token containment or a high ratio; complete at every size."""
    known = keys.filter(F.col("key") != "")
    held = contained_pairs(known, "key", []).withColumn("contained", F.lit(True))
    if not with_ratio:
        return held
    close = cut_lineage(close_pairs(known, "key", [], MERGE_RATIO)).withColumn("contained", F.lit(False))
    held = cut_lineage(held)
    apart = held.join(close.select("a", "b"), ["a", "b"], "left_anti")
    return (close.join(held.select("a", "b", F.col("contained").alias("held")), ["a", "b"], "left")
            .select("a", "b", F.coalesce("held", "contained").alias("contained"), "ratio")
            .unionByName(add_ratio(apart).select("a", "b", "contained", "ratio")))


def propose_merges(candidates: DataFrame, titles: DataFrame) -> DataFrame:
    """Offline judge: only containment proves identity; the longer key gives the display name.

    ``titles``: key, name (the most common spelling of the key).
    """
    same = candidates.filter("contained")
    ta = titles.select(F.col("key").alias("a"), F.col("name").alias("name_a"))
    tb = titles.select(F.col("key").alias("b"), F.col("name").alias("name_b"))
    name = F.when(F.length("a") >= F.length("b"), F.col("name_a")).otherwise(F.col("name_b"))
    return (same.join(ta, "a").join(tb, "b")
            .select("a", "b", name.alias("canonical_name"), node_slug(name).alias("canonical_id")))


def top_spelling(counts: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    spelled = keyed(counts, registry).filter(F.col("key") != "").groupBy("key", "name").agg(F.sum("n").alias("n"))
    return (spelled.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "name")).alias("t"))
            .select("key", F.col("t.name").alias("name")))
