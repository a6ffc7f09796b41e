"""Which keys occur at more than one place, and which place is the first: shared by line and substring dedup.

Keys are combined where they are made: a block of places sends each key to the shuffle once, with its first
place; the block's other places of that key are known to repeat and travel as one list per document under a
key of their own.  So a key that a third of all rows share arrives once per block, not once per row.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places that a task holds before it sends a block.
BLOCK = 2_000_000
SENT = "route long, tag int, rid long, pos int, known array<int>"
_FIELDS = pa.schema([("route", pa.int64()), ("tag", pa.int32()), ("rid", pa.int64()), ("pos", pa.int32()),
                     ("known", pa.list_(pa.int32()))])

#: What one batch of documents yields: keys, second keys, row keys and positions.
Places = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def lists_by_row(rid: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Distinct row keys and the ascending distinct positions of each."""
    order = np.lexsort((pos, rid))
    rid, pos = rid[order], pos[order]
    if len(rid):
        fresh = np.concatenate(([True], (rid[1:] != rid[:-1]) | (pos[1:] != pos[:-1])))
        rid, pos = rid[fresh], pos[fresh]
    starts = np.flatnonzero(np.concatenate(([True], rid[1:] != rid[:-1]))) if len(rid) else np.empty(0, np.int64)
    offsets = np.concatenate((starts, [len(rid)])).astype(np.int32)
    return rid[starts], pa.ListArray.from_arrays(pa.array(offsets), pa.array(pos.astype(np.int32)))


def _block(places: list[Places], all_known: bool) -> Iterator[pa.RecordBatch]:
    key, tag, rid, pos = (np.concatenate(x) for x in zip(*places, strict=True))
    order = np.lexsort((pos, rid, tag, key))
    key, tag, rid, pos = key[order], tag[order], rid[order], pos[order]
    starts = np.concatenate(([True], (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])))
    first = np.flatnonzero(starts)
    group = np.cumsum(starts) - 1
    later = (rid != rid[first][group]) | (pos != pos[first][group])     # a repeated row is the same place
    if all_known:
        again = np.zeros(len(first), bool)
        again[group[later]] = True
        known = again[group]                                           # every place of a key that repeats here
    else:
        known = later
    first = first[np.lexsort((pos[first], rid[first]))]      # in the order of rows: neighbours share most bytes in the shuffle
    none = pa.nulls(len(first), pa.list_(pa.int32()))
    yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(tag[first]), pa.array(rid[first]),
                                      pa.array(pos[first]), none], schema=_FIELDS)
    if known.any():
        rows, lists = lists_by_row(rid[known], pos[known])
        route = (rows.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(route), pa.nulls(len(rows), pa.int32()), pa.array(rows),
                                          pa.nulls(len(rows), pa.int32()), lists], schema=_FIELDS)


def sender(places: Callable[[Iterator[pa.RecordBatch]], Iterator[Places]], all_known: bool):
    """mapInArrow function that sends the places block by block.

    all_known: every place of a key that occurs twice in the block is known (a key is looked for anywhere);
    otherwise only the places after the first one are (an earlier place is looked for).
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for found in places(parts):
            if len(found[0]):
                held.append(found)
                count += len(found[0])
            if count >= BLOCK:
                yield from _block(held, all_known)
                held, count = [], 0
        if held:
            yield from _block(held, all_known)
    return run


def _by_row(marked: DataFrame) -> DataFrame:
    lists = F.coalesce("known", F.array("pos"))
    return marked.groupBy("rid").agg(F.flatten(F.collect_list(lists)).alias("places"))


def repeated(sent: DataFrame) -> DataFrame:
    """(rid, places): places whose key also occurs elsewhere."""
    same = Window.partitionBy("route", "tag")
    return _by_row(sent.withColumn("many", F.count(F.lit(1)).over(same)).filter("known is not null or many > 1"))


def later(sent: DataFrame) -> DataFrame:
    """(rid, places): places whose key also occurs at an earlier place."""
    same = Window.partitionBy("route", "tag").orderBy("rid", "pos")
    return _by_row(sent.withColumn("nth", F.rank().over(same)).filter("known is not null or nth > 1"))
