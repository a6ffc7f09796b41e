"""Several connectors behind one inventory: each adds, changes and removes entries of its own ids only.

Listings: ``connector, file_id, fingerprint`` and any further columns of the inventory (name, local_path, ...).
Inventory: ``file_id, fingerprint, on_disk`` and the same further columns.  An id belongs to the connector with the
longest matching prefix; the one without a prefix owns what is left, but of the recorded entries only those with a
fingerprint, since the others were put there by hand.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.operators.changes import MassDeletion

# Id prefix of each connector.
PREFIXES = {"drive": "", "slack": "slack-", "local": "local-"}
KEEPS = ("skipped", "held", "foreign", "untouched")


def owner_of(file_id: Column, prefixes: dict[str, str] | None = None) -> Column:
    """Name of the connector an id belongs to; NULL when no prefix fits."""
    owner = F.lit(None).cast("string")
    for name, prefix in sorted((prefixes or PREFIXES).items(), key=lambda x: len(x[1])):
        owner = F.when(file_id.startswith(prefix), F.lit(name)).otherwise(owner)
    return owner


def snapshot(listings: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """One row per id: entries outside their connector's ids are dropped here and shown by :func:`reconcile`.

    An id listed more than once (a file below two folders) keeps its least row, so the order of arrival is no matter.
    """
    own = listings.filter((owner_of(F.col("file_id"), prefixes) == F.col("connector")) & F.col("fingerprint").isNotNull())
    rest = [c for c in listings.columns if c not in ("file_id", "connector")]
    least = own.groupBy("file_id").agg(F.min(F.struct(*rest)).alias("_row"), F.min("connector").alias("connector"))
    return least.select("file_id", "connector", "_row.*")


def reconcile(listings: DataFrame, inventory: DataFrame, synced: list[str], prefixes: dict[str, str] | None = None) -> DataFrame:
    """file_id, connector, action of every id, from one full outer join.

    added / changed / skipped: listed; removed: recorded by a synced connector that no longer lists it; held: the
    same, but the connector lists nothing at all, which is a broken listing and not a deletion; foreign: recorded
    without a fingerprint; untouched: its connector was not synced; refused: listed by a connector it does not
    belong to, or without a fingerprint, and not on record otherwise.
    """
    # one row per configured connector at most
    talking = (listings.filter(owner_of(F.col("file_id"), prefixes) == F.col("connector"))
               .groupBy("connector").agg(F.lit(True).alias("talks")))
    new = snapshot(listings.filter(F.col("connector").isin(synced)), prefixes).select(
        "file_id", F.col("fingerprint").alias("new_fp"), F.lower("local_path").alias("new_path"))
    refused = (listings.filter(F.col("connector").isin(synced)).select("file_id").distinct()
               .withColumn("offered", F.lit(True)))
    old = inventory.select("file_id", F.col("fingerprint").alias("old_fp"), F.lower("local_path").alias("old_path"), "on_disk",
                           F.lit(True).alias("had"))
    offered = refused.join(new, "file_id", "left")
    owner = owner_of(F.col("file_id"), prefixes)
    met = offered.join(old, "file_id", "full_outer").withColumn("connector", owner).join(F.broadcast(talking), "connector", "left")
    same = F.coalesce((F.col("new_fp") == F.col("old_fp")) & F.col("new_path").eqNullSafe(F.col("old_path")) & F.col("on_disk"), F.lit(False))
    bare = F.lit(False)
    for name, prefix in (prefixes or PREFIXES).items():
        if not prefix:
            bare = bare | (F.coalesce("connector", F.lit("")) == name)
    unlisted = (F.when(F.col("connector").isNull() | ~F.col("connector").isin(synced), "untouched")
                .when(bare & F.col("old_fp").isNull(), "foreign")
                .when(F.col("talks").isNull(), "held").otherwise("removed"))
    action = (F.when(F.col("new_fp").isNotNull(), F.when(F.col("had").isNull(), "added").when(same, "skipped").otherwise("changed"))
              .when(F.col("had").isNull(), "refused").otherwise(unlisted))
    return met.select("file_id", "connector", action.alias("action"))


def union_inventory(listings: DataFrame, inventory: DataFrame, actions: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """The inventory after the actions: listed rows replace theirs, removed ones go, everything else stays."""
    kept = inventory.join(actions.filter(F.col("action").isin(*KEEPS)).select("file_id"), "file_id", "left_semi")
    fresh = actions.filter(F.col("action").isin("added", "changed")).select("file_id")
    written = (snapshot(listings, prefixes).join(fresh, "file_id", "left_semi")
               .withColumn("on_disk", F.lit(True)).select(*inventory.columns))
    return kept.unionByName(written)


def guard_held(actions: DataFrame) -> None:
    """For callers that rather stop than keep: raises when a connector listed nothing but owns entries."""
    silent = sorted(r["connector"] for r in actions.filter(F.col("action") == "held").select("connector").distinct().collect())
    if silent:
        raise MassDeletion(f"nothing listed, though entries are on record: {', '.join(silent)}")
