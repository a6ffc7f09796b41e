"""SimHash near-duplicates by deletion variants.

A fingerprint is cut into two segments of 32 bits.  Two fingerprints that differ in at most two bits have
a segment in which they differ in at most one.  So every distinct fingerprint is indexed under its
one-wildcard variants (each segment with each bit blanked), variants are joined by equality, and the
remaining bits are verified.  Equal fingerprints meet first and are one node; links between different
fingerprints are never cut: there are at most 2,080 per fingerprint, whatever the size of its group.

Rows: null text is empty; a text without words has fingerprint zero and is linked like any other; a text
of fewer words than a shingle is one shingle; a row without doc_id takes part but never names a component
that has a doc_id; repeated rows get equal results; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm import shingles
from sourceloom.llm.common import batches, free_names, id_of, row_key, store, text_of
from sourceloom.llm.components import components

SEED = 42
SEGMENT = 32
#: A segment value that more distinct fingerprints share is also split by the other segment's parts.
CROWDED = 512
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
_SLICE = 65_536


def simhash(text: str, size: int = 3) -> int:
    """64-bit SimHash over the word shingles of a text, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < size:
        spans = [(0, len(joined))]
    else:
        spans = list(zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist(), strict=True))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), _SLICE):
        part = spans[at:at + _SLICE]
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in part), np.uint64, len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.nonzero(2 * ones > len(spans))[0].tolist())


def _fingerprint_rows(size: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            values = np.array([simhash(t, size) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["rid"], pa.array(values.view(np.int64))], ["rid", "fp"])
    return run


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(rid, fp) of every row."""
    return docs.select(row_key(docs).alias("rid"), text_of(docs).alias("text")).mapInArrow(
        _fingerprint_rows(size), "rid long, fp long")


def near_links(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints ``fp`` that differ in at most two bits, each once."""
    halves = nodes.select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("half")),
        F.struct(F.lit(1).alias("part"), F.shiftrightunsigned("fp", SEGMENT).alias("half")))).alias("s")).select("fp", "s.*")

    def keys(df: DataFrame, *carried: str) -> DataFrame:
        blanked = F.transform(F.sequence(F.lit(0), F.lit(SEGMENT - 1)), lambda bit: F.struct(
            bit.alias("bit"),
            F.shiftleft((F.col("part") * SEGMENT + bit).cast("long"), SEGMENT).bitwiseOR(F.col("half").bitwiseAND(
                F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))).alias("key")))
        return df.select(*carried, "part", F.explode(blanked).alias("v")).select(*carried, "part", "v.bit", "v.key")

    crowded = store(keys(halves.groupBy("part", "half").count().filter(F.col("count") > CROWDED).select("part", "half"))
                    .select("key").distinct())
    variants = keys(halves, "fp")
    if crowded.isEmpty():
        variants = variants.withColumn("cell", F.lit(-1))
        variants = variants.select("fp", "part", "bit", "key", "cell")
    else:
        # In a crowded bucket the other half still differs in at most two bits: one of its three parts is equal.
        other = F.when(F.col("part") == 0, F.shiftrightunsigned("fp", SEGMENT)).otherwise(
            F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
        cells = F.array(*[(F.lit(i << 11) + F.shiftrightunsigned(other, 11 * i).bitwiseAND(F.lit(0x7FF))).cast("int")
                          for i in range(3)])
        marked = variants.join(crowded.withColumn("crowd", F.lit(True)), "key", "left")
        variants = marked.select("fp", "part", "bit", "key", F.explode(
            F.when(F.col("crowd"), cells).otherwise(F.array(F.lit(-1)))).alias("cell"))
    # Sorted, never broadcast: the planner sizes variants as the fingerprints they are made of, 64 times too low.
    a = variants.select(F.col("fp").alias("a"), "part", "bit", "key", "cell").hint("merge")
    b = variants.select(F.col("fp").alias("b"), F.col("key").alias("key_b"), F.col("cell").alias("cell_b")).hint("merge")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    low = F.bit_count(differ.bitwiseAND(F.lit(0xFFFFFFFF)))
    high = F.bit_count(F.shiftrightunsigned(differ, SEGMENT))
    # A pair meets under several keys; it counts under the first one only.
    here = F.when(F.col("part") == 0, low).otherwise(high)
    first = ((here == 1) | ((here == 0) & (F.col("bit") == 0))) & ((F.col("part") == 0) | (low > 1))
    met = a.join(b, (F.col("key") == F.col("key_b")) & (F.col("cell") == F.col("cell_b")) & (F.col("a") < F.col("b"))
                 & (low + high <= 2) & first)
    links = met.select("a", "b")
    return links if crowded.isEmpty() else links.distinct()


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """(rid, fp, component) for every row; component: smallest rid reachable over links of at most two bits."""
    rows = store(fingerprints(docs, size))
    nodes = store(rows.groupBy("fp").agg(F.min("rid").alias("least")))
    roots = components(near_links(nodes))
    linked = store(roots.join(nodes, roots["node"] == nodes["fp"]).select("node", "root", "least"))
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "component")
    of_fp = nodes.join(named, nodes["fp"] == named["node"], "left").select(
        nodes["fp"], F.coalesce("component", "least").alias("component"))
    return rows.join(of_fp, "fp").select("rid", "fp", "component")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(docs)
    return found.select(id_of(F.col("rid")).alias("doc_id"),
                        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        id_of(F.col("component")).alias("component_id"))


def representatives(docs: DataFrame, size: int = 3, similarity: float | None = None) -> DataFrame:
    """One row of each near-duplicate group, with all columns of ``docs``.

    Groups are those of fingerprints, or with ``similarity`` those of texts whose shingle sets have that
    Jaccard similarity; fingerprints are too coarse to decide that at any radius.  The row with the smallest doc_id stays.  Of rows that repeat that doc_id, or of equal texts without one,
    one stays.
    """
    key, rid, copies = free_names(docs, "row_key", "kept_rid", "copies")
    found = near_duplicates(docs, size) if similarity is None else shingles.near_duplicates(docs, size, similarity)
    kept = store(found.filter("rid = component").groupBy("rid").agg(F.count("*").alias(copies)).withColumnRenamed("rid", rid))
    rows = docs.withColumn(key, row_key(docs)).join(kept, F.col(key) == F.col(rid))
    single = rows.filter(F.col(copies) == 1).select(*docs.columns)
    if kept.filter(F.col(copies) > 1).isEmpty():
        return single
    repeated = rows.filter(F.col(copies) > 1).dropDuplicates([key]).select(*docs.columns)
    return single.unionByName(repeated)
