"""Delimited files read by many tasks, with the row numbers of a sequential reader.

A quoted field may hold line breaks, so a task that begins in the middle of a file does not know where a row begins.
Each range of bytes is therefore read twice.  The first reading follows the reader's state from every state that it
may begin in, and keeps where each of them ends and where its first row begins.  These functions are composed in
order, a few numbers for each range.  The second reading parses the rows that begin in the range, and reads on to the
end of the last one.  Row numbers are the places in the range plus the rows of all ranges before.
"""
from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourceloom.session import cut_lineage

RANGE = 64 << 20
_BLOCK = 1 << 20
#: States of the reader: a row begins, a field begins, in a plain field, in quotes, after a quote in quotes, after a carriage return.
ROW, FIELD, PLAIN, QUOTED, QUOTE, RETURN = range(6)
_LINE = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n)")


def open_at(path: str, begin: int):
    """A binary stream of a file (local path or URI) from a byte on."""
    if "://" in path:
        from pyarrow.fs import FileSystem
        system, inner = FileSystem.from_uri(path)
        handle = system.open_input_file(inner)
    else:
        handle = open(path, "rb")
    handle.seek(begin)
    return handle


def size_of(path: str) -> int:
    with open_at(path, 0) as handle:
        return handle.seek(0, 2)


def _after(state: int, byte: int, delimiter: int) -> int:
    if state == QUOTED:
        return QUOTE if byte == 34 else QUOTED
    if byte == 34:
        return {ROW: QUOTED, FIELD: QUOTED, RETURN: QUOTED, QUOTE: QUOTED}.get(state, PLAIN)
    return FIELD if byte == delimiter else ROW if byte == 10 else RETURN if byte == 13 else PLAIN


def transitions(data: Iterator[bytes], delimiter: str) -> tuple[list[int], list[int]]:
    """For each state at the begin: the state at the end, and the place at which the first row begins (-1: none).

    States that have met go on together.  The line feed after a carriage return may count as a row of its own: it is blank.
    """
    special = re.compile(rb'["\r\n' + re.escape(delimiter.encode()) + rb"]")
    code = ord(delimiter)
    now, first, at = list(range(6)), [0, -1, -1, -1, -1, 0], 0
    for block in data:
        last = 0
        for found in special.finditer(block):
            i = found.start()
            step = {s: _after(s if i == last or s in (QUOTED, PLAIN) else PLAIN, block[i], code) for s in set(now)}
            now, last = [step[s] for s in now], i + 1
            if block[i] in b"\r\n" and -1 in first:
                first = [at + last if f < 0 and s in (ROW, RETURN) else f for f, s in zip(first, now)]
        if last < len(block):
            now = [s if s in (QUOTED, PLAIN) else PLAIN for s in now]
        at += len(block)
    return now, first


def rows_from(path: str, begin: int, end: int, delimiter: str) -> Iterator[list[str]]:
    """Rows that begin at ``begin`` or later, before ``end``; the last one is read to its own end."""
    place = begin

    def lines(handle) -> Iterator[str]:
        nonlocal place
        rest = b""
        while True:
            block = handle.read(_BLOCK)
            data = rest + block
            # a carriage return at the end of a block may be half of a line end
            stop = len(data) - (1 if block and data.endswith(b"\r") else 0)
            used = 0
            for found in _LINE.finditer(data, 0, stop):
                used = found.end()
                place += used - found.start()
                yield found.group().decode("utf-8", "replace")
            rest = data[used:]
            if not block:
                if rest:
                    place += len(rest)
                    yield rest.decode("utf-8", "replace")
                return

    with open_at(path, begin) as handle:
        reader = csv.reader(lines(handle), delimiter=delimiter)
        while place < end:
            row = next(reader, None)
            if row is None:
                return
            yield row


def _blocks(path: str, begin: int, end: int) -> Iterator[bytes]:
    with open_at(path, begin) as handle:
        while begin < end and (block := handle.read(min(_BLOCK, end - begin))):
            begin += len(block)
            yield block


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(size=[size_of(p) for p in batch["full_path"]])


def _followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [transitions(_blocks(r.full_path, r.begin, r.end), r.delimiter) for r in batch.itertuples()]
        yield batch[["file_id", "k", "begin", "end"]].assign(ends=[e for e, _ in out], firsts=[f for _, f in out])


def _composed(ranges: pd.DataFrame) -> pd.DataFrame:
    """Where the first row of each range begins, from the states of all ranges before."""
    state, places = ROW, []
    ranges = ranges.sort_values("k")
    for r in ranges.itertuples():
        first = r.firsts[state]
        places.append(r.begin + first if 0 <= first else r.end)
        state = r.ends[state]
    return pd.DataFrame({"file_id": ranges["file_id"], "k": ranges["k"], "first": places})


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    csv.field_size_limit(2 ** 31 - 1)
    for batch in batches:
        for r in batch.itertuples():
            kept, n = [], 0
            for cells in rows_from(r.full_path, r.first, r.end, r.delimiter) if r.first < r.end else ():
                if any(c.strip() for c in cells):
                    n += 1
                    kept.append((r.file_id, r.k, n, cells))
                if len(kept) == 10_000:
                    yield pd.DataFrame(kept, columns=["file_id", "k", "n", "values"])
                    kept = []
            yield pd.DataFrame(kept, columns=["file_id", "k", "n", "values"])


def delimited_rows(files: DataFrame, size: int = RANGE) -> DataFrame:
    """file_id, row, values of files (file_id, full_path, delimiter); blank rows are dropped before rows are numbered."""
    sized = cut_lineage(files.select("file_id", "full_path", "delimiter").mapInPandas(
        _ranges, "file_id string, full_path string, delimiter string, size long"))
    ranges = sized.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / size))).alias("k")).select(
        "file_id", "full_path", "delimiter", "k", (F.col("k") * size).alias("begin"), F.least((F.col("k") + 1) * size, "size").alias("end"))
    count = ranges.count()
    spread = cut_lineage(ranges.repartition(max(1, min(count, 10_000)), "file_id", "k"))
    followed = cut_lineage(spread.repartition(max(1, min(count, 10_000)), "file_id", "k").mapInPandas(
        _followed, "file_id string, k long, begin long, end long, ends array<int>, firsts array<long>"))
    firsts = followed.groupBy("file_id").applyInPandas(_composed, "file_id string, k long, first long")
    ready = spread.join(firsts, ["file_id", "k"]).repartition(max(1, min(count, 10_000)), "file_id", "k")
    rows = cut_lineage(ready.mapInPandas(_parsed, "file_id string, k long, n long, values array<string>"))
    before = rows.groupBy("file_id", "k").agg(F.max("n").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(
        W.partitionBy("file_id").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(before.select("file_id", "k", "before"), ["file_id", "k"]).select(
        "file_id", (F.col("n") + F.col("before")).alias("row"), "values")
