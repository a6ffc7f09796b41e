"""Helpers shared by the corpus operators: row keys, stored intermediates, word hashes."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java and a Python character class.
BREAKS = r"[\x20\x09-\x0D]+"
#: Rows without a doc_id get keys above this value, so they never win over a row that has one.
NO_ID = 1 << 62

_MULTIPLIER = 0x9E3779B97F4A7C15
_SECOND = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def prepare(spark: SparkSession) -> SparkSession:
    """Arrow batches of bounded size: documents may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name in taken:
            name += "_"
        taken.add(name)
        names.append(name)
    return names


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """Null text counts as empty."""
    return F.coalesce(docs[column], F.lit(""))


def row_key(docs: DataFrame) -> Column:
    """doc_id; a row without one gets a key derived from its text, larger than any doc_id."""
    return F.coalesce(docs["doc_id"], F.lit(NO_ID) + F.pmod(F.xxhash64(text_of(docs)), F.lit(NO_ID - 1)),
                      F.lit(NO_ID))     # the last one only tells the planner that a key is never null


def id_of(key: Column) -> Column:
    """The doc_id behind a row key, null for rows that have none."""
    return F.when(key < NO_ID, key)


def store(df: DataFrame) -> DataFrame:
    """Write an intermediate once to the folder that all executors share and read it back.

    The folder is ``spark.checkpoint.dir``.  Only a local session without that setting (tests) gets one
    of its own.  Unlike ``checkpoint()`` the plan runs once and the files are columnar.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))
        folder = context.getCheckpointDir()
    path = f"{folder.rstrip('/')}/corpus-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
    for part in parts:
        if part.num_rows:
            yield dict(zip(part.schema.names, part.columns, strict=True))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def rolled(values: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values, built by doubling."""
    if len(values) < size:
        return np.empty(0, np.uint64)
    multiplier = _SECOND if second else _MULTIPLIER
    power, width, block = multiplier, 1, values
    out, done, step = None, 0, multiplier
    left = size
    while left:
        if left & 1:
            count = len(values) - size + 1
            piece = block[done:done + count]
            out = piece.copy() if out is None else out * np.uint64(pow(multiplier, width, 1 << 64)) + piece
            done += width
        left >>= 1
        if left:
            block = block[:-width] * np.uint64(pow(multiplier, width, 1 << 64)) + block[width:]
            width *= 2
    return mixed(out)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))
