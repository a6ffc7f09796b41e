"""A stored full-text index that is kept up to date by difference.

The index is a set of immutable segments and a list of tombstones.  A refresh compares the pages with what is alive
(by time and size), writes the added and changed ones as a new segment, and buries the removed and changed ones where
they lie.  Segments of a like size are merged when there are too many of them: only postings move, no text is read
again.  The manifest of the new state is written last, so a refresh that is lost half-way leaves the old index in force,
and readers of an older manifest still find its segments.

Tables below the root, one folder for each number: ``segment_pages`` (segment, path, mtime, size, len), ``segment_postings``
(term, path, tf [, positions]), ``manifest`` (segment, pages, buried), ``tombstones`` (segment, path).
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.operators.changes import index_changes
from sourceloom.operators.search import build_postings
from sourceloom.session import cut_lineage
from sourceloom.sinks.tables import passes, publish

#: Segments of one size class (powers of this number) before they are merged; share of buried pages that has a segment rewritten.
FAN, STALE = 4, 0.5
MANIFEST, TOMBSTONES = "segment int, pages long, buried long", "segment int, path string"


@dataclass
class Index:
    """What one manifest shows: pages (path, mtime, size, len), postings, and the segments behind them."""
    pages: DataFrame
    postings: DataFrame
    segments: list[int]
    number: int

    @property
    def lengths(self) -> DataFrame:
        return self.pages.select("path", "len")


def _read(spark: SparkSession, root: str, name: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/pass={number:06d}")


def _alive(spark: SparkSession, root: str, segments: list[int], tombstones: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Pages and postings of segments without what is buried in them; a page that was written again lives in one segment only."""
    pages = postings = None
    for segment in segments:
        buried = tombstones.filter(F.col("segment") == segment).select("path")
        own = _read(spark, root, "segment_pages", segment).join(buried, "path", "left_anti")
        found = _read(spark, root, "segment_postings", segment).join(buried, "path", "left_anti")
        pages = own if pages is None else pages.unionByName(own)
        postings = found if postings is None else postings.unionByName(found)
    return pages, postings


def _tombstones(spark: SparkSession, root: str, number: int) -> DataFrame:
    return _read(spark, root, "tombstones", number) if number else spark.createDataFrame([], TOMBSTONES)


def _manifest(spark: SparkSession, root: str, number: int) -> dict[int, tuple[int, int]]:
    """Pages and buried pages of each segment: a few rows, whatever the size of the index."""
    return {r["segment"]: (r["pages"], r["buried"]) for r in _read(spark, root, "manifest", number).collect()} if number else {}


def open_index(spark: SparkSession, root: str) -> Index | None:
    """The newest complete state."""
    done = passes(spark, root, "manifest")
    if not done:
        return None
    known = _manifest(spark, root, done[-1])
    pages, postings = _alive(spark, root, sorted(known), _tombstones(spark, root, done[-1]))
    return None if pages is None else Index(pages, postings, sorted(known), done[-1])


def due(manifest: dict[int, tuple[int, int]], fan: int = FAN, stale: float = STALE) -> list[int]:
    """Segments to merge: the smallest size class that holds ``fan`` of them, and those that are mostly buried."""
    alive = {s: max(pages - buried, 0) for s, (pages, buried) in manifest.items()}
    classes: dict[int, list[int]] = {}
    for segment, n in alive.items():
        classes.setdefault(int(math.log(max(n, 1), fan) + 1e-9), []).append(segment)
    full = next((own for _, own in sorted(classes.items()) if len(own) >= fan), [])
    worn = [s for s, (pages, buried) in manifest.items() if pages and buried >= stale * pages]
    return sorted({*full, *worn})


def refresh(spark: SparkSession, root: str, pages: DataFrame, columns: list[str] | None = None, fan: int = FAN) -> DataFrame:
    """Bring the index to ``pages`` (path, mtime, size and text columns); returns (path, action) as decided."""
    done = passes(spark, root, "manifest")
    number = done[-1] if done else 0
    known = _manifest(spark, root, number)
    tombstones = _tombstones(spark, root, number)
    held, _ = _alive(spark, root, sorted(known), tombstones)
    held = held if held is not None else spark.createDataFrame([], "segment int, path string, mtime double, size long, len long")
    actions = cut_lineage(index_changes(pages, held))
    counts = {r["action"]: r["n"] for r in actions.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
    gone = cut_lineage(held.join(actions.filter(F.col("action").isin("removed", "updated")), "path").select("segment", "path"))
    for r in gone.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect():
        known[r["segment"]] = (known[r["segment"]][0], known[r["segment"]][1] + r["n"])
    tombstones = tombstones.unionByName(gone)
    fresh = counts.get("added", 0) + counts.get("updated", 0)
    free = max([*passes(spark, root, "segment_pages"), 0]) + 1
    if fresh:
        new = pages.join(actions.filter(F.col("action").isin("added", "updated")).select("path"), "path", "left_semi")
        described = new.select("path", F.col("mtime").cast("double").alias("mtime"), F.col("size").cast("long").alias("size"))
        _write(spark, root, free, described, build_postings(new, columns))
        known[free] = (fresh, 0)
        free += 1
    while merged := due(known, fan):
        own, found = _alive(spark, root, merged, tombstones)
        left = sum(known[s][0] - known[s][1] for s in merged)
        known = {s: v for s, v in known.items() if s not in merged}
        tombstones = tombstones.filter(~F.col("segment").isin(merged))
        if left:
            _write(spark, root, free, own.drop("segment", "len"), found)
            known[free] = (left, 0)
            free += 1
    publish(tombstones, root, "tombstones", number + 1)
    publish(spark.createDataFrame([(s, *v) for s, v in sorted(known.items())], MANIFEST), root, "manifest", number + 1)     # last
    return actions


def _write(spark: SparkSession, root: str, segment: int, pages: DataFrame, postings: DataFrame) -> None:
    """A page is as long as its postings together: lengths are read from what is written, not from the texts again."""
    publish(postings, root, "segment_postings", segment)
    lengths = _read(spark, root, "segment_postings", segment).groupBy("path").agg(F.sum("tf").alias("len"))
    described = pages.join(lengths, "path", "left").select(F.lit(segment).alias("segment"), "path", "mtime", "size", F.coalesce("len", F.lit(0).cast("long")).alias("len"))
    publish(described, root, "segment_pages", segment)
