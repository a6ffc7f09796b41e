"""Line dedup by winnowing over line hashes.

Each line is hashed (white space at its ends does not count).  Of every two consecutive lines the one with
the smaller hash is a fingerprint, so any repeated run of two lines or more is guaranteed to share one; a
line of MIN_CHARS characters or more is a fingerprint by itself.  Fingerprints that occur at one place only are
dropped.  The places of the others are extended by their neighbours on both sides: a step is two consecutive
lines that also stand together earlier (smaller doc_id, or earlier in the same document), and steps that
overlap make one maximal run, as far as the match reaches.  A single long line that also stands earlier is a run
of one line.

All lines of a run go when its lines have together MIN_CHARS characters or more; the length of no part of a run
matters.  Shorter repeats (a greeting, a blank line) stay.

Rows: null text is empty (one empty line); lines end at \\n only; texts of any length are cut into lines whole;
of lines that are equal the one with the smallest doc_id, then the first in its document, is the earlier; rows that
repeat a doc_id count as the same document; rows without doc_id come after all others; an empty table gives an
empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import batches, free_names, id_of, mixed, rolled, row_key, store, text_of
from sourceloom.llm.repeats import SENT, Places, later, repeated, sender

RUN = 2
MIN_CHARS = 40
_ENDS = " \t\n\x0b\x0c\r"


def _flat(batch: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line hashes and lengths of a batch, the row number of each line and its position."""
    counts = batch["hashes"].value_lengths().to_numpy()
    values = batch["hashes"].flatten().to_numpy().view(np.uint64)
    row = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    return values, batch["sizes"].flatten().to_numpy(), row, pos


def _fingerprints(run: int, min_chars: int):
    def places(parts: Iterator[pa.RecordBatch]) -> Iterator[Places]:
        for batch in batches(parts):
            values, sizes, row, pos = _flat(batch)
            chosen = sizes >= min_chars
            n = len(values) - run + 1
            if n > 0:
                spans = np.lib.stride_tricks.sliding_window_view(values, run)
                whole = row[:n] == row[run - 1:]
                least = np.arange(n) + run - 1 - np.argmin(spans[:, ::-1], axis=1)      # the rightmost minimum
                chosen[least[whole]] = True
            at = np.flatnonzero(chosen)
            yield (mixed(values[at]), np.zeros(len(at), np.int32), batch["rid"].to_numpy()[row[at]],
                   pos[at].astype(np.int32))
    return places


def _steps(run: int, min_chars: int):
    def places(parts: Iterator[pa.RecordBatch]) -> Iterator[Places]:
        for batch in batches(parts):
            values, sizes, row, pos = _flat(batch)
            rid = batch["rid"].to_numpy()
            lists = batch["places"]
            starts = np.searchsorted(row, np.arange(len(lists)))
            hit = np.zeros(len(values) + run, bool)
            at = np.repeat(starts, lists.value_lengths().to_numpy()) + lists.flatten().to_numpy()
            hit[at[at < len(values)]] = True
            alone = np.flatnonzero(hit[:len(values)] & (sizes >= min_chars))
            yield (mixed(values[alone] ^ np.uint64(0x5851F42D4C957F2D)), np.full(len(alone), -1, np.int32),
                   rid[row[alone]], pos[alone].astype(np.int32))
            n = len(values) - run + 1
            if n <= 0:
                continue
            near = np.lib.stride_tricks.sliding_window_view(hit[:len(values)], run).any(axis=1)
            chosen = np.flatnonzero(near & (row[:n] == row[run - 1:]))
            tags = (rolled(values, run, second=True)[chosen] >> np.uint64(33)).astype(np.int32)
            yield rolled(values, run)[chosen], tags, rid[row[chosen]], pos[chosen].astype(np.int32) * 2
    return places


def _alone_odd(parts_fn):
    """Places carry the kind of run in their lowest bit: 1 for a single long line."""
    def places(parts: Iterator[pa.RecordBatch]) -> Iterator[Places]:
        for key, tag, rid, pos in parts_fn(parts):
            yield (key, tag, rid, pos * 2 + 1) if len(tag) and tag[0] == -1 else (key, tag, rid, pos)
    return places


def _gone(lines: list[str], marks: np.ndarray, run: int, min_chars: int) -> np.ndarray:
    """Which lines go: steps joined to maximal runs, each measured whole, and long lines by themselves."""
    marks = np.unique(marks)
    at, single = marks >> 1, (marks & 1).astype(bool)
    gone = np.zeros(len(lines), bool)
    gone[at[single & (at < len(lines))]] = True         # rows that repeat a doc_id share their places
    starts = at[~single & (at + run <= len(lines))]
    if len(starts):
        sizes = np.concatenate(([0], np.cumsum([len(x.strip(_ENDS)) for x in lines])))
        fresh = np.flatnonzero(np.concatenate(([True], starts[1:] > starts[:-1] + run - 1)))
        first, last = starts[fresh], starts[np.concatenate((fresh[1:] - 1, [len(starts) - 1]))] + run
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if sizes[b] - sizes[a] >= min_chars:
                gone[a:b] = True
    return gone


def _delete(run: int, min_chars: int):
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            texts, totals, removed = [], [], []
            for text, places in zip(batch["text"].to_pylist(), batch["places"], strict=True):
                lines = text.split("\n")
                totals.append(len(lines))
                if places.is_valid:
                    gone = _gone(lines, places.values.to_numpy(), run, min_chars)
                    kept = [lines[i] for i in np.flatnonzero(~gone).tolist()]
                    removed.append(len(lines) - len(kept))
                    texts.append("\n".join(kept))
                else:
                    removed.append(0)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch["rid"], pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())],
                ["rid", "kept", "n_lines", "n_removed"])
    return rows


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(rid, hashes, sizes): a narrow table of the corpus, a few bytes a line."""
    lines = F.transform(F.split(text_of(docs), "\n"), lambda x: F.btrim(x, F.lit(_ENDS)))
    held = docs.select(row_key(docs).alias("rid"), lines.alias("lines"))
    return held.select("rid", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"),
                       F.transform("lines", lambda x: F.length(x)).alias("sizes"))


def repeated_runs(docs: DataFrame, run: int = RUN, min_chars: int = MIN_CHARS) -> DataFrame:
    """(rid, places): starts of the steps that also stand earlier, doubled; odd for a single long line."""
    lines = store(hashed_lines(docs))
    found = repeated(lines.mapInArrow(sender(_fingerprints(run, min_chars), all_known=True), SENT))
    steps = lines.join(found, "rid").mapInArrow(sender(_alone_odd(_steps(run, min_chars)), all_known=False), SENT)
    return later(steps)


def delete_repeated(docs: DataFrame, run: int = RUN, min_chars: int = MIN_CHARS) -> DataFrame:
    """(rid, kept, n_lines, n_removed) of every row."""
    texts = docs.select(row_key(docs).alias("rid"), text_of(docs).alias("text"))
    marked = texts.join(repeated_runs(docs, run, min_chars), "rid", "left")
    return marked.mapInArrow(_delete(run, min_chars), "rid long, kept string, n_lines long, n_removed long")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, text without the later repeated runs, n_lines, n_removed."""
    return delete_repeated(docs).select(id_of(F.col("rid")).alias("doc_id"), F.col("kept").alias("text"),
                                        "n_lines", "n_removed")


def without_repeated(docs: DataFrame, run: int = RUN, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated runs deleted and n_chars restated; a text that lost every line goes."""
    key, rid, marked = free_names(docs, "row_key", "marked_rid", "marked_places")
    marks = repeated_runs(docs, run, min_chars).withColumnsRenamed({"rid": rid, "places": marked})
    rows = docs.withColumn(key, row_key(docs)).join(marks, F.col(key) == F.col(rid), "left").select(*docs.columns, marked)
    delete = _delete(run, min_chars)

    def edit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns = dict(zip(part.schema.names, part.columns, strict=True))
            places, old = columns.pop(marked), columns["text"]
            plain = pa.array(["" if t is None else t for t in old.to_pylist()], pa.string())
            inner = pa.RecordBatch.from_arrays([pa.nulls(part.num_rows, pa.int64()), plain, places], ["rid", "text", "places"])
            for done in delete(iter([inner])):
                gone, total = done["n_removed"].to_numpy(), done["n_lines"].to_numpy()
                changed = pa.array(gone > 0)
                columns["text"] = pc.if_else(changed, done["kept"], old)
                if "n_chars" in columns:
                    size = pc.utf8_length(done["kept"]).cast(columns["n_chars"].type)
                    columns["n_chars"] = pc.if_else(changed, size, columns["n_chars"])
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns)).filter(pa.array(gone < total))

    return rows.mapInArrow(edit, docs.schema)


#: DuckDB: the result of digest() where doc_id is unique.
SQL = rf"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
trimmed AS (SELECT doc_id, x, list_transform(x, lambda y: trim(y, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS y FROM t),
places AS (SELECT doc_id, p, y[p] AS a, y[p + 1] AS b FROM trimmed, unnest(generate_series(1, len(y))) AS g(p)),
again AS (SELECT doc_id, p, n FROM (SELECT doc_id, p, n, row_number() OVER (PARTITION BY n, a, b ORDER BY doc_id, p) AS nth FROM (
             SELECT doc_id, p, 1 AS n, a, NULL AS b FROM places WHERE length(a) >= {MIN_CHARS}
             UNION ALL SELECT doc_id, p, 2, a, b FROM places WHERE b IS NOT NULL)) WHERE nth > 1),
covered AS (SELECT DISTINCT doc_id, q, max(CASE WHEN q > p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, q) AS goes_on
            FROM again, unnest([p, p + 1]) AS g(q) WHERE n = 2),
runs AS (SELECT doc_id, q, sum(1 - goes_on) OVER (PARTITION BY doc_id ORDER BY q) AS run FROM covered),
gone AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (
    SELECT doc_id, p AS q FROM again WHERE n = 1
    UNION ALL SELECT r.doc_id, r.q FROM (SELECT r.doc_id, r.q, sum(length(a)) OVER (PARTITION BY r.doc_id, r.run) AS chars
                                         FROM runs r JOIN places t ON t.doc_id = r.doc_id AND t.p = r.q) r WHERE chars >= {MIN_CHARS}) GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string(CASE WHEN gone IS NULL THEN x ELSE (
           SELECT list(x[i] ORDER BY i) FROM (SELECT unnest(generate_series(1, len(x))) AS i) WHERE NOT list_contains(gone, i)) END, chr(10)), '') AS text,
       len(x)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed
FROM t LEFT JOIN gone USING (doc_id)
"""
