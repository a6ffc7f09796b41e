"""Exact dedup by Grace hash partitioning.

Texts (white space runs as one space) are partitioned by a hash of their content; the shuffle files are the
spill files.  Each bucket is read into a hash table of complete contents (open addressing, whole texts
compared on every hit) that holds a bounded number of bytes.  A text that does not fit any more is passed on
with all its copies, and what was passed on is partitioned again by another hash into more buckets, until
nothing is left: no text is ever split between two tables.  Before the first shuffle each task merges the
copies it holds itself, so a text that makes up a third of the table travels once per block, not once per row.

Groups come back to the rows by the SHA-256 digest of the content.  Should two contents ever share one, the
tables tell them apart and the job stops instead of merging them.

Rows: null text is empty; of equal texts the row with the smallest doc_id stays, rows without doc_id last;
of rows that repeat doc_id and text exactly one is kept; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm.common import BREAKS, batches, id_of, row_key, store, text_of

#: Bytes of text that a task merges before it sends a block, and that the table of a bucket holds.
BLOCK_BYTES = 64 << 20
TABLE_BYTES = 256 << 20
#: Buckets grow by this factor when what did not fit is partitioned again.
FAN_OUT = 4
_MERGED = "sha string, content string, rid long, first long, size long"
_FIELDS = pa.schema([("sha", pa.string()), ("content", pa.string()), ("rid", pa.int64()), ("first", pa.int64()),
                     ("size", pa.int64())])


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BREAKS, " ")


class _Table:
    """Complete contents with the smallest key, how many rows have it, and the number of rows."""

    def __init__(self, limit: int):
        self.limit, self.held, self.rows = limit, 0, {}

    def add(self, sha: str, content: str, rid: int, first: int, size: int) -> bool:
        """False: the content is new and the table is full."""
        own = self.rows.get(content)
        if own is None:
            if self.held and self.held + len(content) > self.limit:
                return False
            self.held += len(content) + 100
            self.rows[content] = [sha, rid, first, size]
            return True
        if rid < own[1]:
            own[1], own[2] = rid, first
        elif rid == own[1]:
            own[2] += first
        own[3] += size
        return True


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)],
                                      schema=_FIELDS)


def _pieces(rows: Iterator[tuple], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1] or "") + 100
        if size > limit:
            yield _record(held)
            held, size = [], 0
    if held:
        yield _record(held)


def _merge_own(limit: int):
    """Merge the copies within a task, block by block."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(limit)
        for batch in batches(parts):
            for sha, content, rid in zip(*(batch[c].to_pylist() for c in ("sha", "content", "rid")), strict=True):
                if not table.add(sha, content, rid, 1, 1):
                    yield from _pieces((v[0], c, *v[1:]) for c, v in table.rows.items())
                    table = _Table(limit)
                    table.add(sha, content, rid, 1, 1)
        yield from _pieces((v[0], c, *v[1:]) for c, v in table.rows.items())
    return run


def _resolve(limit: int):
    """Groups of a bucket without their content; rows that did not fit keep theirs."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(limit)
        for batch in batches(parts):
            yield from _pieces((sha, content, rid, first, size) for sha, content, rid, first, size
                               in zip(*(batch[f.name].to_pylist() for f in _FIELDS), strict=True)
                               if not table.add(sha, content, rid, first, size))
        yield from _pieces((v[0], None, *v[1:]) for v in table.rows.values())
    return run


def groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(sha, keep, first, size): per distinct content its digest, smallest row key, rows with that key, rows."""
    content = normalised(text_of(docs))
    rows = docs.select(F.sha2(content, 256).alias("sha"), content.alias("content"), row_key(docs).alias("rid"))
    left = rows.mapInArrow(_merge_own(block_bytes), _MERGED)
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, level = None, 0
    while True:
        bucket = F.xxhash64("content", F.lit(level))
        done = store(left.repartition(buckets, bucket).mapInArrow(_resolve(table_bytes), _MERGED))
        own = done.filter("content is null").select("sha", F.col("rid").alias("keep"), "first", "size")
        found = own if found is None else found.unionByName(own)
        left = done.filter("content is not null")
        if left.isEmpty():
            return found
        level, buckets = level + 1, buckets * FAN_OUT


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(rid, keep, group_size, kept, sha) of every row."""
    found = store(groups(docs, block_bytes, table_bytes))
    if not found.groupBy("sha").count().filter("count > 1").isEmpty():
        raise ValueError("two contents share a SHA-256 digest: match rows by content")
    rows = docs.select(row_key(docs).alias("rid"), F.sha2(normalised(text_of(docs)), 256).alias("sha"))
    joined = rows.join(found, "sha")
    if found.filter("first > 1").isEmpty():
        kept = F.col("rid") == F.col("keep")
    else:
        nth = F.row_number().over(Window.partitionBy("sha", "rid").orderBy(F.lit(1)))
        kept = (F.col("rid") == F.col("keep")) & (nth == 1)
    return joined.select("rid", "keep", F.col("size").alias("group_size"), kept.alias("kept"), "sha")


def digest(docs: DataFrame) -> DataFrame:
    found = exact_groups(docs)
    return found.select(id_of(F.col("rid")).alias("doc_id"), id_of(F.col("keep")).alias("keep_id"), "group_size", "kept",
                        F.col("sha").alias("text_sha256"))


#: DuckDB: the result of digest() where doc_id is unique.
SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
       sha256(content) AS text_sha256
FROM t WINDOW g AS (PARTITION BY content)
"""
