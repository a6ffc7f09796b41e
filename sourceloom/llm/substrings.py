"""Substring dedup with difference-cover anchors.

The residues {0, 1, 3, 9} modulo 13 form a difference cover: any two positions become cover positions after
the same shift of at most 12.  So two equal windows of 20 words always share an aligned anchor, a run of 8
words that starts at a cover position of both.  Anchors that occur once in the corpus need no further look.
Around the others the match is extended to whole windows, and a window counts when its word sequence also
starts earlier (smaller doc_id, or earlier in the same document).

Only anchors and the windows around repeated anchors are shuffled besides one shuffle of the texts by row
key, which the three passes over the texts share.  A document whose whole word sequence already occurred is
decided at once: all its windows start earlier.

Rows: null text has no words; shorter texts than a window are never cut; rows that repeat a doc_id count as
the same document (marks found in one hold for all); rows without doc_id come after all others; an empty
table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import BREAKS, batches, id_of, mixed, rolled, row_key, text_of, word_hashes
from sourceloom.llm.repeats import SENT, Places, later, repeated, sender

PERIOD, COVER = 13, (0, 1, 3, 9)
WINDOW = 20
ANCHOR = WINDOW - PERIOD + 1
_BREAKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()          # splits at \x20 and \x09-\x0D only


def _joined(batch: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts of a batch, the row number of each word and its position in its text."""
    words, sizes = [], []
    for text in batch["text"].to_pylist():
        own = words_of(text)
        words += own
        sizes.append(len(own))
    sizes = np.array(sizes, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    pos = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return word_hashes(words), row, pos


def _anchors(parts: Iterator[pa.RecordBatch]) -> Iterator[Places]:
    for batch in batches(parts):
        values, row, pos = _joined(batch)
        keys = rolled(values, ANCHOR)
        n = len(keys)
        whole = row[:n] == row[ANCHOR - 1:ANCHOR - 1 + n]
        at = np.flatnonzero(whole & np.isin(pos[:n] % PERIOD, COVER))
        rid = batch["rid"].to_numpy()
        yield keys[at], np.zeros(len(at), np.int32), rid[row[at]], pos[at].astype(np.int32)


def _windows(parts: Iterator[pa.RecordBatch]) -> Iterator[Places]:
    for batch in batches(parts):
        values, row, pos = _joined(batch)
        n = len(values) - WINDOW + 1
        if n <= 0:
            continue
        lists = batch["places"]
        counts = lists.value_lengths().to_numpy()
        starts = np.searchsorted(row, np.arange(len(lists)))
        hit = np.zeros(len(values) + 1, np.int64)
        at = np.repeat(starts, counts) + lists.flatten().to_numpy()
        hit[at[at < len(values)] + 1] = 1
        seen = np.cumsum(hit)
        near = seen[PERIOD:PERIOD + n] - seen[:n] > 0           # an anchor starts in the first 13 words
        whole = row[:n] == row[WINDOW - 1:]
        chosen = np.flatnonzero(near & whole)
        keys = rolled(values, WINDOW)[chosen]
        tags = (rolled(values, WINDOW, second=True)[chosen] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        rid = batch["rid"].to_numpy()
        yield keys, tags, rid[row[chosen]], pos[chosen].astype(np.int32)


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(parts):
        totals, removed, digests = [], [], []
        for text, copy, places in zip(batch["text"].to_pylist(), batch["copy"].to_pylist(), batch["places"], strict=True):
            words = words_of(text)
            gone = None
            if copy and len(words) >= WINDOW:
                words, gone, total = [], len(words), len(words)
            elif places.is_valid:
                total = len(words)
                edge = np.zeros(total + WINDOW + 1, np.int64)
                at = places.values.to_numpy()
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                covered = np.cumsum(edge)[:total] > 0
                words = [words[i] for i in np.flatnonzero(~covered).tolist()]
            else:
                total = len(words)
            totals.append(total)
            removed.append(total - len(words) if gone is None else gone)
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch["rid"], pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
            ["rid", "n_words", "n_removed", "kept_sha256"])


def cut_repeats(docs: DataFrame) -> DataFrame:
    """(rid, n_words, n_removed, kept_sha256) of every row."""
    texts = docs.select(row_key(docs).alias("rid"), text_of(docs).alias("text"))
    whole = texts.select("rid", F.md5(F.trim(F.regexp_replace("text", BREAKS, " "))).alias("same"))
    firsts = whole.groupBy("same").agg(F.min("rid").alias("rid")).select("rid")
    anchors = texts.join(firsts, "rid").mapInArrow(sender(_anchors, all_known=True), SENT)
    candidates = repeated(anchors)
    windows = texts.join(candidates, "rid").mapInArrow(sender(_windows, all_known=False), SENT)
    marks = firsts.join(later(windows), "rid", "left").withColumn("first", F.lit(True))
    marked = texts.join(marks, "rid", "left").select("rid", "text", F.col("first").isNull().alias("copy"), "places")
    return marked.mapInArrow(_cut, "rid long, n_words long, n_removed long, kept_sha256 string")


def digest(docs: DataFrame) -> DataFrame:
    found = cut_repeats(docs)
    return found.select(id_of(F.col("rid")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


#: DuckDB: the result of digest() where doc_id is unique.
SQL = rf"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT doc_id, p, w[p:p + {WINDOW - 1}] AS s FROM t, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS g(p)),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS nth FROM windows),
gone AS (SELECT doc_id, list(DISTINCT q) AS gone FROM ranked, unnest(generate_series(p, p + {WINDOW - 1})) AS g(q) WHERE nth > 1 GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE (
           SELECT list(w[i] ORDER BY i) FROM (SELECT unnest(generate_series(1, len(w))) AS i) WHERE NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id)
"""
