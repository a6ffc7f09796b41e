"""Near-duplicates by exact Jaccard similarity of word shingles: a prefix filter and verification.

The shingles of a text are put in one order for the whole corpus, rare ones first.  Two texts with Jaccard
similarity t or more share at least a t-th of either one's n shingles, so they share one among the first
n - ceil(t n) + 1 of both, whatever the order is.  Those prefixes are joined by equality and every pair that
meets is verified on the whole shingle sets, so links are neither missed nor wrong; before that, pairs whose
shared part of the prefixes is too small for any shared rest to make up for are dropped.  How common a shingle
is, is estimated from a sample of texts; that decides the order and so the time, never the result.

Texts of equal words meet first and are one node.  A shingle that more than CROWDED nodes have in their
prefixes is not joined with itself: its nodes are compared with the least of them, and then only nodes of
different components, of which one is outside the bucket's largest component.  Two nodes of one component
need no link, so the components are those of all pairs.

Rows: null text is empty; texts without words are equal; a text of fewer words than a shingle is one
shingle; a row without doc_id takes part but never names a component that has a doc_id; repeated rows get
equal results; an empty table gives an empty result.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import batches, rolled, row_key, store, text_of, word_hashes
from sourceloom.llm.components import components
from sourceloom.llm.repeats import SENT, Places, repeated, sender

CROWDED = 32
#: Texts and shingles by which the order of shingles is estimated.
SAMPLE = 20_000
COMMON = 200_000
LEAST_COMMON = 3
_SLACK = 1e-9
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")


def shingles(text: str, size: int) -> tuple[int, np.ndarray]:
    """Hash of the words of a text, and the ascending distinct hashes of its shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    joined = b" ".join(words)
    node = xxhash.xxh64_intdigest(joined)
    if len(words) < size:
        return node, np.array([node] if words else [], np.uint64)
    return node, np.unique(rolled(word_hashes(words), size))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate([*values, np.empty(0, np.uint64)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _common(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of shingles that many sampled texts have, and the number of those texts."""
    every = max(1, texts.count() // SAMPLE)
    picked = texts.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).dropDuplicates(["text"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            for text in batch["text"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, size)[1].view(np.int64))], ["h"])
    found = picked.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= LEAST_COMMON).orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    hashes, counts = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _prefix_rows(size: int, similarity: float, common: tuple[np.ndarray, np.ndarray]):
    known, counts = common

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            nodes, sizes, prefixes = [], [], []
            for text in batch["text"].to_pylist():
                node, own = shingles(text, size)
                if len(known) and len(own):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    order = np.argsort(np.where(known[at] == own, counts[at], 0), kind="stable")
                else:
                    order = np.arange(len(own))
                least = math.ceil(similarity * len(own) - _SLACK)
                nodes.append(node)
                sizes.append(len(own))
                prefixes.append(own[order[:len(own) - least + 1]])
            yield pa.RecordBatch.from_arrays([batch["rid"], _longs(nodes), pa.array(sizes, pa.int32()), _lists(prefixes)],
                                             ["rid", "node", "n", "prefix"])
    return run


def _places(parts: Iterator[pa.RecordBatch]) -> Iterator[Places]:
    for batch in batches(parts):
        counts = batch["prefix"].value_lengths().to_numpy()
        values = batch["prefix"].flatten().to_numpy().view(np.uint64)
        pos = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield values, np.zeros(len(values), np.int32), np.repeat(batch["node"].to_numpy(), counts), pos.astype(np.int32)


def _set_rows(size: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            found = [shingles(text, size) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([_longs([node for node, _ in found]), _lists([own for _, own in found])],
                                             ["node", "own"])
    return run


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b) of the pairs whose shingle sets have the similarity."""
    pairs = store(pairs.distinct())
    # Stored, so that its size is known: few rows are broadcast and the texts stay where they are.
    wanted = store(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select(
        F.col("least").alias("rid")).distinct())
    sets = store(texts.join(wanted, "rid").mapInArrow(_set_rows(size), "node long, own array<long>").dropDuplicates(["node"]))
    a = sets.select(F.col("node").alias("a"), F.col("own").alias("own_a"))
    b = sets.select(F.col("node").alias("b"), F.col("own").alias("own_b"))
    both = F.size(F.array_intersect("own_a", "own_b"))
    either = F.size("own_a") + F.size("own_b") - both
    return store(pairs.join(a, "a").join(b, "b").filter(both >= similarity * either - _SLACK).select("a", "b"))


def links(texts: DataFrame, rows: DataFrame, nodes: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b): links with the same components as all pairs of nodes that have the similarity."""
    found = repeated(rows.mapInArrow(sender(_places, all_known=True), SENT)).withColumnRenamed("rid", "node")
    met = rows.select("node", "n", "prefix").join(found, "node")
    every = store(met.select("node", "n", F.explode("places").alias("at"), "prefix").select(
        F.element_at("prefix", F.col("at") + 1).alias("h"), "node", "n").distinct())
    buckets = store(every.groupBy("h").agg(F.count(F.lit(1)).alias("many"), F.min("node").alias("pivot")))
    small, large = buckets.filter((F.col("many") > 1) & (F.col("many") <= CROWDED)), store(buckets.filter(F.col("many") > CROWDED))
    # Shingles of a node that it can share with another: in all buckets, and in crowded ones.
    most = every.join(large.select("h", F.lit(1).alias("hot")), "h", "left").groupBy("node").agg(
        F.count(F.lit(1)).cast("int").alias("shared"), F.count("hot").cast("int").alias("hot"), F.first("n").alias("n"))
    most = store(most)
    index = every.join(most.select("node", "shared", "hot"), "node")
    if large.isEmpty():
        index = every.withColumns({"shared": F.lit(0), "hot": F.lit(0)})
    index = store(index)
    side = F.struct("n", "shared", "hot")
    left = index.select("h", F.col("node").alias("a"), side.alias("x"))
    right = index.select("h", F.col("node").alias("b"), side.alias("y"))
    n, m = F.col("x.n"), F.col("y.n")
    near = (n >= similarity * m - _SLACK) & (m >= similarity * n - _SLACK)

    def enough(common: Column) -> Column:
        """Whether shared shingles in the prefixes and all behind the longer text's prefix make the similarity."""
        behind = F.ceil(similarity * F.greatest(n, m) - _SLACK) - 1
        return near & (common + behind >= similarity / (1 + similarity) * (n + m) - _SLACK)
    few = small.select("h")
    pairs = left.join(few, "h").join(right, "h").filter((F.col("a") < F.col("b")) & near).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("met"), F.first("x").alias("x"), F.first("y").alias("y"))
    pairs = pairs.filter(enough(F.col("met") + F.least("x.hot", "y.hot"))).select("a", "b")
    if large.isEmpty():
        return _verified(pairs, texts, nodes, size, similarity)
    sizes = most.select(F.col("node").alias("a"), side.alias("x"))
    stars = right.join(large.select("h", F.col("pivot").alias("a")), "h").filter("a <> b").select("a", "b", "y").distinct()
    stars = stars.join(sizes, "a").filter(enough(F.least("x.shared", "y.shared"))).select("a", "b")
    first = _verified(pairs.unionByName(stars), texts, nodes, size, similarity)
    # What crowded buckets hold besides their largest component.
    labels = components(first).withColumnRenamed("root", "label")
    held = store(index.join(large.select("h", "pivot"), "h").join(labels, "node", "left").select(
        "h", "pivot", "node", side.alias("side"), F.coalesce("label", "node").alias("label")))
    kinds = held.groupBy("h", "label").agg(F.count(F.lit(1)).alias("many")).groupBy("h").agg(
        F.max_by("label", F.struct("many", "label")).alias("most"), F.count(F.lit(1)).alias("kinds"))
    mixed = store(kinds.filter("kinds > 1").select("h", "most"))
    if mixed.isEmpty():
        return first
    within = held.join(mixed, "h")
    one = within.filter("label <> most and node <> pivot").select(
        "h", F.col("node").alias("a"), F.col("side").alias("x"), F.col("label").alias("label_a"))
    other = within.filter("node <> pivot").select("h", F.col("node").alias("b"), F.col("side").alias("y"), "label")
    rest = one.join(other, "h").filter((F.col("label_a") != F.col("label")) & enough(F.least("x.shared", "y.shared"))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return first.unionByName(_verified(rest, texts, nodes, size, similarity))


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(rid, node, component) for every row; component: smallest rid reachable over pairs that have the similarity."""
    texts = docs.select(row_key(docs).alias("rid"), text_of(docs).alias("text"))
    rows = store(texts.mapInArrow(_prefix_rows(size, similarity, _common(texts, size)),
                                  "rid long, node long, n int, prefix array<long>"))
    named = store(rows.groupBy("node").agg(F.min("rid").alias("least")))
    roots = components(links(texts, rows, named, size, similarity))
    linked = store(roots.join(named, "node"))
    groups = linked.join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "component")
    of_node = named.join(groups, "node", "left").select("node", F.coalesce("component", "least").alias("component"))
    return rows.select("rid", "node").join(of_node, "node").select("rid", "node", "component")
