"""Records of JSON payloads, one by one: no row and no value holds a whole listing.

A payload is a list of records, an object with such a list in one of its envelope fields, or one record.  Tasks are
dealt files (and members of zip archives) and read them twice in blocks: once to see that the payload is well-formed
and where its records are, once to send them.  What is held is a block and the record that reaches over its end.
"""
from __future__ import annotations

import codecs
import json
import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from fnmatch import fnmatchcase
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.sources.delimited import open_at

BLOCK = 1 << 20
_SPACE = re.compile(r"[ \t\r\n]*")
_DECODER = json.JSONDecoder()
SHAPE = "path string, member string, place long, field string, listed boolean, record string"
_SCHEMA = pa.schema([("path", pa.string()), ("member", pa.string()), ("place", pa.int64()), ("field", pa.string()), ("listed", pa.bool_()), ("record", pa.string())])


class _Text:
    """A sliding window over decoded text."""

    def __init__(self, stream: BinaryIO, block: int):
        self.stream, self.block, self.decode = stream, block, codecs.getincrementaldecoder("utf-8-sig")().decode
        self.held, self.at, self.ended = "", 0, False

    def more(self) -> bool:
        """Reads on; a value that reaches over the end doubles what is read, so long values are scanned few times."""
        if self.ended:
            return False
        data = self.stream.read(max(self.block, len(self.held) - self.at))
        self.ended = not data
        self.held, self.at = self.held[self.at:] + self.decode(data, final=self.ended), 0
        return True

    def peek(self) -> str:
        """The next character that is not white space; empty at the end."""
        while True:
            self.at = _SPACE.match(self.held, self.at).end()
            if self.at < len(self.held):
                return self.held[self.at]
            if not self.more():
                return ""

    def take(self, wanted: str) -> str:
        found = self.peek()
        if not found or found not in wanted:
            raise ValueError(f"{found or 'end'} instead of one of {wanted}")
        self.at += 1
        return found

    def value(self) -> tuple[object, str]:
        """The next value and the text that states it."""
        self.peek()
        while True:
            try:
                value, end = _DECODER.raw_decode(self.held, self.at)
                # a number may go on in the next block, also after its point or exponent
                if self.ended or end < len(self.held) and (not isinstance(value, (int, float)) or self.held[end] in ",]} \t\r\n"):
                    break
            except json.JSONDecodeError:
                if self.ended:
                    raise
            self.more()
        text, self.at = self.held[self.at:end], end
        return value, text


def _items(text: _Text) -> Iterator[str]:
    text.take("[")
    if text.peek() == "]":
        text.take("]")
        return
    while True:
        yield text.value()[1]
        if text.take(",]") == "]":
            return


def walk(stream: BinaryIO, block: int = BLOCK) -> Iterator[tuple[str | None, bool, str]]:
    """(field, listed, text): the elements of a list at the top (no field) or of a field's list, and other fields."""
    text = _Text(stream, block)
    if text.peek() == "[":
        for item in _items(text):
            yield None, True, item
    elif text.peek() == "{":
        text.take("{")
        while text.peek() != "}":
            field, _ = text.value()
            if not isinstance(field, str):
                raise ValueError("a field without a name")
            text.take(":")
            if text.peek() == "[":
                yield field, False, "["                             # that there is a list, even an empty one
                for item in _items(text):
                    yield field, True, item
            else:
                yield field, False, text.value()[1]
            if text.take(",}") == "}":
                break
            if text.peek() == "}":
                raise ValueError("nothing after a comma")
        else:
            text.take("}")
    else:
        raise ValueError("neither a list nor an object")
    if text.peek():
        raise ValueError("more after the payload")


def records_of(reopen, envelopes: list[str], block: int = BLOCK) -> Iterator[tuple[str | None, bool, str]]:
    """(field, listed, text) of every record; ValueError before the first one when the payload is malformed."""
    lists: set[str | None] = set()
    with reopen() as stream:
        for field, listed, text in walk(stream, block):
            if listed and field is None or not listed and text == "[":
                lists.add(field)
            elif not listed and field in envelopes:
                lists.discard(field)                                # of equal names the last one counts
    top = next((e for e in envelopes if e in lists), None)
    with reopen() as stream:
        parts = walk(stream, block)
        if None in lists or top is not None:
            yield from (part for part in parts if part[1] and part[0] == top)
            return
        # one record: its fields are put together again
        whole: dict[str, str | list[str]] = {}
        for field, listed, text in parts:
            if listed:
                whole[field].append(text)
            else:
                whole[field] = [] if text == "[" else text
        if whole:
            yield None, False, "{" + ",".join(f"{json.dumps(k)}:{v if isinstance(v, str) else '[' + ','.join(v) + ']'}" for k, v in whole.items()) + "}"


def _plain(path: str) -> str:
    """Spark names local files by ``file:/``."""
    from urllib.parse import unquote, urlparse
    return unquote(urlparse(path).path) if path.startswith("file:") else path


@contextmanager
def _open(path: str, member: str | None):
    with open_at(_plain(path), 0) as handle:
        if member is None:
            yield handle
        else:
            with zipfile.ZipFile(handle) as archive, archive.open(member) as inner:
                yield inner


def _members(pattern: str):
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path in part["path"].to_pylist():
                with open_at(_plain(path), 0) as handle, zipfile.ZipFile(handle) as archive:
                    names = [n for n in archive.namelist() if fnmatchcase(n, pattern) and n.count("/") == pattern.count("/")]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(names), pa.string()), pa.array(names, pa.string())], ["path", "member"])
    return rows


def _read(envelopes: list[str], strict: bool, block: int, batch: int):
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, member in zip(part["path"].to_pylist(), part["member"].to_pylist(), strict=True):
                held, size = [], 0
                try:
                    for place, (field, listed, text) in enumerate(records_of(lambda: _open(path, member), envelopes, block)):  # noqa: B023
                        held.append((path, member, place, field, listed, text))
                        size += len(text)
                        if size >= batch:
                            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in held], _SCHEMA)
                            held, size = [], 0
                except ValueError as reason:        # also text that is not UTF-8
                    if strict:
                        raise ValueError(f"{path} {member or ''}: {reason}") from reason
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in held], _SCHEMA)
    return rows


def read_records(spark: SparkSession, path: str, envelopes: list[str], members: str | None = None, strict: bool = False,
                 block: int = BLOCK, batch: int = 4 << 20) -> DataFrame:
    """path, member, place, field, listed, record: every record of the payloads that ``path`` names (a glob, or a folder).

    ``members``: ``path`` names zip archives, of which the members that fit this pattern are read where they lie.
    ``place`` counts the records of a payload from 0; ``field`` is the envelope field, NULL for a list at the top or a
    single record (not ``listed``).  A malformed payload has no records; with ``strict`` it is an error.
    """
    names = spark.read.format("binaryFile").load(path).select("path")      # names only: contents are pruned
    if members is None:
        files = names.withColumn("member", F.lit(None).cast("string"))
    else:
        files = names.mapInArrow(_members(members), "path string, member string")
    # one payload is one task's work at most; many small ones are dealt to all tasks
    files = files.repartition(spark.sparkContext.defaultParallelism * 4, "path", "member")
    return files.mapInArrow(_read(envelopes, strict, block, batch), SHAPE)
