"""Incremental processing: what changed, which copy represents a content, what to delete."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Id prefixes of connectors that own their entries.
FOREIGN_ID_PREFIXES = ["slack-", "local-"]


def pending_changes(inventory: DataFrame, state: DataFrame) -> DataFrame:
    """new / changed / deleted files.

    ``inventory``: file_id, raw_hash (NULL when the file is listed but missing on disk).
    ``state``: file_id, raw_hash, status, duplicate_of.
    """
    inv = inventory.select("file_id", F.col("raw_hash").alias("now_hash"), F.lit(True).alias("listed"))
    prev = state.select("file_id", F.col("raw_hash").alias("prev_hash"), "status", "duplicate_of",
                        F.lit(True).alias("known"))
    joined = inv.join(prev, "file_id", "full_outer")
    # canonical look-up: one row per canonical, so a content with millions of copies stays cheap
    canon = inv.select(F.col("file_id").alias("duplicate_of"), F.col("now_hash").alias("canon_hash"),
                       F.lit(True).alias("canon_listed"))
    is_dup = F.col("status") == "duplicate"
    dups = joined.filter(is_dup).join(canon, "duplicate_of", "left")
    rest = joined.filter(~F.coalesce(is_dup, F.lit(False))).withColumns(
        {"canon_hash": F.lit(None).cast("string"), "canon_listed": F.lit(None).cast("boolean")})
    everything = rest.unionByName(dups)
    orphan = (F.col("status") == "duplicate") & (
        F.col("canon_listed").isNull() | (F.coalesce("canon_hash", "now_hash") != F.col("now_hash")))
    reason = (F.when(F.col("listed").isNull() & (F.col("status") != "deleted"), F.lit("deleted"))
              .when(F.col("listed") & F.col("now_hash").isNull(), None)
              .when(F.col("listed") & F.col("known").isNull(), F.lit("new"))
              .when(F.col("listed") & (~F.col("prev_hash").eqNullSafe(F.col("now_hash"))
                                       | F.col("status").isin("error", "requeued", "deleted") | orphan), F.lit("changed")))
    return (everything.withColumn("reason", reason).filter(F.col("reason").isNotNull())
            .select("file_id", F.col("now_hash").alias("raw_hash"), "reason"))


def elect_canonical(pending: DataFrame, state: DataFrame, inventory: DataFrame) -> DataFrame:
    """Adds ``canonical_id``: the file that serves this content (its own id when it does).

    A processed file that is still listed and not pending wins; otherwise the lowest pending id.
    Both candidates are aggregate minima per hash, so copies combine before the shuffle.
    """
    live = pending.filter((F.col("reason") != "deleted") & F.col("raw_hash").isNotNull())
    serving = (state.filter((F.col("status") == "processed") & F.col("raw_hash").isNotNull())
               .join(inventory.select("file_id"), "file_id", "left_semi")
               .join(live.select("file_id"), "file_id", "left_anti")
               .groupBy("raw_hash").agg(F.min("file_id").alias("served_by")))
    lowest = live.groupBy("raw_hash").agg(F.min("file_id").alias("lowest"))
    winner = (lowest.join(serving, "raw_hash", "left")
              .select("raw_hash", F.coalesce("served_by", "lowest").alias("canonical_id")))
    # rows without a hash (deletions) have no winner: a key of their own keeps them from meeting in one task
    keyed = pending.withColumn("_key", F.coalesce("raw_hash", F.concat(F.lit("-"), "file_id")))
    out = keyed.join(winner.withColumnRenamed("raw_hash", "_key"), "_key", "left").select(*pending.columns, "canonical_id")
    return out.withColumn("canonical_id", F.when(F.col("reason") == "deleted", F.col("file_id"))
                          .otherwise(F.coalesce("canonical_id", "file_id")))


def split_work(elected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to process or delete, files that only duplicate another)."""
    own = F.col("canonical_id") == F.col("file_id")
    return elected.filter(own), elected.filter(~own)


def owns(file_id: Column, fingerprint: Column) -> Column:
    """An entry belongs to the mirroring connector: un-namespaced id and a fingerprint."""
    foreign = F.lit(False)
    for prefix in FOREIGN_ID_PREFIXES:
        foreign = foreign | file_id.startswith(prefix)
    return ~foreign & fingerprint.isNotNull()


def fingerprint(modified: Column, size: Column, md5: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (modified, size, md5)])


def mirror_diff(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """added / changed / skipped / removed / foreign for one connector's listing.

    ``listing``: file_id, fingerprint, local_name; ``manifest``: file_id, fingerprint, local_name,
    on_disk.  Only owned entries can be removed.
    """
    new = listing.select("file_id", F.col("fingerprint").alias("new_fp"), F.col("local_name").alias("new_name"))
    old = manifest.select("file_id", F.col("fingerprint").alias("old_fp"), F.col("local_name").alias("old_name"),
                          "on_disk", F.lit(True).alias("had"))
    joined = new.join(old, "file_id", "full_outer")
    unchanged = ((F.col("new_fp") == F.col("old_fp")) & (F.lower("new_name") == F.lower("old_name")) & F.col("on_disk"))
    action = (F.when(F.col("new_fp").isNull(), F.when(owns(F.col("file_id"), F.col("old_fp")), F.lit("removed"))
                     .otherwise(F.lit("foreign")))
              .when(F.col("had").isNull(), F.lit("added"))
              .when(F.coalesce(unchanged, F.lit(False)), F.lit("skipped"))
              .otherwise(F.lit("changed")))
    return joined.select("file_id", action.alias("action"))


class MassDeletion(RuntimeError):
    """An empty listing over a populated mirror is a broken listing, not a deletion."""


def guard_mass_deletion(listing: DataFrame, manifest: DataFrame) -> None:
    if listing.isEmpty() and not manifest.filter(owns(F.col("file_id"), F.col("fingerprint"))).isEmpty():
        raise MassDeletion("the listing is empty but the mirror owns entries")


def guard_empty_input(inventory: DataFrame, state: DataFrame) -> None:
    """The same brake for a pass: nothing listed while documents are on record."""
    if inventory.isEmpty() and not state.filter(F.col("status") != "deleted").isEmpty():
        raise MassDeletion("no document is listed but the state holds some")


def remove_vanished(current: DataFrame, known: DataFrame, key: str = "path") -> DataFrame:
    """Known entries that are no longer present (derived files to delete)."""
    return known.join(current.select(key).distinct(), key, "left_anti")


def index_changes(pages: DataFrame, index: DataFrame) -> DataFrame:
    """added / updated / unchanged / removed pages, decided by (mtime, size)."""
    new = pages.select("path", F.struct("mtime", "size").alias("new"))
    old = index.select("path", F.struct("mtime", "size").alias("old"))
    action = (F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added")
              .when(F.col("new") == F.col("old"), "unchanged").otherwise("updated"))
    return new.join(old, "path", "full_outer").select("path", action.alias("action"))


def child_paths(listing: DataFrame, root_id: str, root_label: str) -> DataFrame:
    """Folder paths from parent links, of any depth: one join per level, children attached to resolved parents.

    ``listing``: file_id, name, parent_id, explicit_path (NULL unless the source supplies one).
    Unresolvable ancestors and cycles hang below the root.  Each level is stored once, so a lost executor costs
    one level at most.
    """
    from sourceloom.functions.paths import join_path
    from sourceloom.session import cut_lineage
    known = listing.select(F.col("file_id").alias("parent_key")).distinct()
    base = (listing.withColumn("parent_key", F.coalesce("parent_id", F.lit(root_id)))
            .join(known.withColumn("parent_known", F.lit(True)), "parent_key", "left"))
    root = F.lit("/" + root_label)
    at_root = ((F.col("parent_key") == root_id) | F.col("parent_known").isNull()
               | (F.col("parent_key") == F.col("file_id")))
    explicit = F.coalesce(F.col("explicit_path").startswith("/"), F.lit(False))
    frontier = base.filter(explicit | at_root).select(
        "file_id", F.when(explicit, F.col("explicit_path")).otherwise(join_path(root, F.col("name"))).alias("path"))
    below = base.filter(~(explicit | at_root)).select("file_id", "name", "parent_key")
    resolved = frontier
    while True:
        # a row has one parent, so it is reached at most once and cycles are never reached
        parents = frontier.select(F.col("file_id").alias("parent_key"), F.col("path").alias("parent_path"))
        frontier = cut_lineage(below.join(parents, "parent_key")
                               .select("file_id", join_path(F.col("parent_path"), F.col("name")).alias("path")))
        if frontier.isEmpty():
            break
        resolved = resolved.unionByName(frontier)
    cyclic = below.join(resolved.select("file_id"), "file_id", "left_anti")
    return resolved.unionByName(cyclic.select("file_id", join_path(root, F.col("name")).alias("path")))
