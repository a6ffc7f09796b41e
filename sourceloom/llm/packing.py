"""Packing documents into fixed-length training sequences with bounded space.

Each task tokenises its documents in one pass and keeps OPEN windows.  Whole sequences are cut off a long
document at once; what is left of it goes into the open window that it fills best.  When none has room, the
fullest window is closed: it takes as much of the document as it has room for (unless that is less than
LEAST_CUT ids), and the rest is placed in the same way.  Windows still open at the end of a task are merged
at last, in groups of MERGE_TASKS tasks, piece by piece and best-fit with the longest first.

Ids are those of the byte-level BPE vocabulary named by ``vocabulary`` (a tokenizers JSON file), each
document followed by END.  They are produced from the same vocabulary in rank form, which gives the same ids
faster; a text that contains a special token's string is left to the JSON tokenizer.

Rows: null text is empty (one id, END); a row without doc_id is packed with a null one; rows that repeat are
packed as often as they occur; texts of any length are tokenised whole; an empty table gives no sequence.
"""
from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import batches, store, text_of

LENGTH = 2048
END = 1
OPEN = 16
LEAST_CUT = 16
MERGE_TASKS = 64
_MERGED = 1 << 62
_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "task int, open boolean")
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task", "open"]
_TYPES = [pa.int64()] * 7 + [pa.int32(), pa.bool_()]


@functools.lru_cache(maxsize=4)
def tokenizer(vocabulary: str | None = None):
    """Function from a text to its ids."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    special = tuple(t.content for t in whole.get_added_tokens_decoder().values())
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if any(s in text for s in special):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)
    return ids


class _Window:
    __slots__ = ("pieces", "used")

    def __init__(self):
        self.pieces, self.used = [], 0

    def put(self, piece: tuple, length: int) -> None:
        self.pieces.append((piece, self.used))
        self.used += length


def _best(windows: list[_Window], size: int, length: int) -> _Window | None:
    """The window that the piece fills best."""
    best, most = None, -1
    for w in windows:
        if most < w.used <= length - size:
            best, most = w, w.used
    return best


class _Packer:
    """Bounded-space packing of one task's documents; close(window) is called once per sequence."""

    def __init__(self, length: int, keep: int, close):
        self.length, self.keep, self.close, self.windows = length, keep, close, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at, total = 0, len(ids)
        while at < total:
            size = min(total - at, self.length)
            window = None if size == self.length else _best(self.windows, size, self.length)
            if window is None and size < self.length and len(self.windows) >= self.keep:
                window = max(self.windows, key=lambda w: w.used)
                room = self.length - window.used
                if room < LEAST_CUT:
                    self._finish(window)
                    window = None
                else:
                    size = room
            if window is None:
                window = _Window()
                self.windows.append(window)
            piece = ids[at:at + size]
            window.put((doc_id, at, size, zlib.crc32(piece.astype("<u4", copy=False).tobytes()), total), size)
            at += size
            if window.used == self.length:
                self._finish(window)

    def _finish(self, window: _Window) -> None:
        self.windows.remove(window)
        self.close(window)


def _pack(length: int, keep: int, vocabulary: str | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer(vocabulary)
        task = TaskContext.get().partitionId()
        rows: list[tuple] = []
        count = 0

        def close(window: _Window, still_open: bool = False) -> None:
            nonlocal count
            rows.extend((*piece, (task << 32) + count, offset, task, still_open) for piece, offset in window.pieces)
            count += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)
            rows.clear()
            return out

        packer = _Packer(length, keep, close)
        for batch in batches(parts):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                packer.add(doc_id, np.array([*ids_of(text), END], np.uint32))
            if rows:
                yield flush()
        for window in packer.windows:
            close(window, still_open=True)
        if rows:
            yield flush()
    return run


def _merge(length: int):
    """Pieces of the windows left open by a group of tasks, packed anew: longest first, best fit."""
    def run(key: tuple, pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        free: dict[int, list[int]] = {}                  # room -> sequences that have it
        sequence, offset, used = [], [], []
        for size in pieces["length"].to_pylist():
            room = min((r for r in free if r >= size), default=None)
            if room is None:
                number = len(used)
                used.append(0)
                room = length
            else:
                number = free[room].pop()
                if not free[room]:
                    del free[room]
            sequence.append(number)
            offset.append(used[number])
            used[number] += size
            if room > size:
                free.setdefault(room - size, []).append(number)
        ids = pa.array([_MERGED + (key[0].as_py() << 32) + n for n in sequence], pa.int64())
        return pieces.select(_NAMES[:5]).append_column("sequence_id", ids).append_column("offset", pa.array(offset, pa.int64()))
    return run


def pack(docs: DataFrame, length: int = LENGTH, keep: int = OPEN, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    placed = store(rows.mapInArrow(_pack(length, keep, vocabulary), _SCHEMA))
    left = placed.filter("open").withColumn("group", F.floor(F.col("task") / MERGE_TASKS))
    merged = left.groupBy("group").applyInArrow(_merge(length), _SCHEMA.removesuffix(", task int, open boolean"))
    return placed.filter("not open").select(*_NAMES[:7]).unionByName(merged)
