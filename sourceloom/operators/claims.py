"""Claim checks: each paragraph against its best source window."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, product
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from sourceloom.functions.words import CLAIM_STOP_WORDS, split_claims, strip_page_chrome

# Window geometry and the support threshold of the offline judge.
WINDOW_CHARS, WINDOW_STEP, SUPPORT = 1200, 300, 0.7

# bytes that belong to words stay, all others become blanks; words of one or two letters say nothing
_BLANKED = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))
_LETTERS = _BLANKED.decode().replace(" ", "")
_UNSPOKEN = {*CLAIM_STOP_WORDS, *_LETTERS, *map("".join, product(_LETTERS, repeat=2))}


def _runs(text: str) -> str:
    """The lower-case text with a blank for every character but a-z and 0-9, so that words are split without a pattern."""
    return text.encode("ascii", "replace").translate(_BLANKED).decode("ascii")


def best_window(bitmaps: list[int]) -> tuple[int, int]:
    """(window, number of bitmaps that hold it) of the window in most of the bitmaps, the earliest of several.

    Mostly one window holds them all.  Otherwise bitmaps are added as columns of bits: plane k holds bit k of every
    window's count.
    """
    among = reduce(and_, bitmaps, -1) if bitmaps else 0
    if among:
        return (among & -among).bit_length() - 1, len(bitmaps)
    planes: list[int] = []
    for carry in bitmaps:
        for k, plane in enumerate(planes):
            planes[k], carry = plane ^ carry, plane & carry
            if not carry:
                break
        if carry:
            planes.append(carry)
    among, held = -1, 0
    for k in reversed(range(len(planes))):
        if among & planes[k]:
            among, held = among & planes[k], held + (1 << k)
    return ((among & -among).bit_length() - 1, held) if held else (0, 0)


def window_words(source: str, spoken: set[str]) -> dict[str, int]:
    """Bitmap of the windows that hold a word, for the words of ``spoken``.

    Windows are whole steps long, so the text is read once, step by step; only a run of letters across the border of
    two steps is cut by the edges of windows, and is looked at window by window.
    """
    windows = (max(len(source) - WINDOW_CHARS // 2, 1) - 1) // WINDOW_STEP + 1
    span = WINDOW_CHARS // WINDOW_STEP
    steps = [source[i:i + WINDOW_STEP].lower() for i in range(0, len(source), WINDOW_STEP)]     # lower case may be longer
    text, ends = _runs("".join(steps)), list(accumulate(map(len, steps)))
    starts = [0, *ends]
    where: dict[str, int] = {}
    done = 0
    for i, end in enumerate(ends):
        if done >= end:
            continue
        cut = end
        if end < len(text) and text[end] != " ":
            cut = max(text.rfind(" ", done, end) + 1, done)
        first, last = max(i - span + 1, 0), min(i, windows - 1)
        bits = (1 << last + 1) - (1 << first)
        for word in spoken.intersection(text[done:cut].split()):
            where[word] = where.get(word, 0) | bits
        done = end
        if cut < end:
            done = text.find(" ", end)
            if done < 0:
                done = len(text)
            for k in range(first, windows):
                if starts[k] >= done:
                    break
                word = text[max(cut, starts[k]):min(done, ends[min(k + span, len(ends)) - 1])]
                if word in spoken:
                    where[word] = where.get(word, 0) | 1 << k
    return where


def _best_windows(source: str, claims: list[str]) -> Iterator[tuple[int, int, int]]:
    """Per claim: its best window, how many of its words are there, how many words it has.

    A page has one map from words to the windows that hold them; each claim adds the bitmaps of its words.
    """
    wanted = [set(_runs(claim.lower()).split()) - _UNSPOKEN for claim in claims]
    where = window_words(source, set().union(*wanted)) if wanted else {}
    for want in wanted:
        yield *best_window(list(filter(None, map(where.get, want)))), len(want)


def _place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per claim."""
    for part in parts:
        keys, row, number, starts, held, words = part.schema.names[:-2], [], [], [], [], []
        claims = part.column("claims")
        for i, (source, own) in enumerate(zip(part.column("text").to_pylist(), claims.to_pylist(), strict=True)):
            for n, (window, most, size) in enumerate(_best_windows(source, own or [])):
                row.append(i)
                number.append(n)
                starts.append(window * WINDOW_STEP)
                held.append(most)
                words.append(size)
        yield pa.RecordBatch.from_arrays(
            [*[part.column(k).take(pa.array(row, pa.int32())) for k in keys], pa.array(number, pa.int32()), claims.flatten(),
             pa.array(starts, pa.int32()), pa.array(held, pa.int32()), pa.array(words, pa.int32())],
            [*keys, "claim_no", "claim", "best", "held", "words"])


def _weigh(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per page: of each of its claims, the words its best window holds and all its words."""
    for part in parts:
        keys, held, words, ends = part.schema.names[:-2], [], [], [0]
        for source, own in zip(part.column("text").to_pylist(), part.column("claims").to_pylist(), strict=True):
            for _, most, size in _best_windows(source, own or []):
                held.append(most)
                words.append(size)
            ends.append(len(held))
        weighed = pa.StructArray.from_arrays([pa.array(held, pa.int32()), pa.array(words, pa.int32())], ["held", "words"])
        yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), weighed)],
                                         [*keys, "claims"])


def anchor_claims(pages: DataFrame, keys: list[str], body: str = "body", source: str = "source",
                  max_claims: int | None = None) -> DataFrame:
    """Per claim: the earliest source window holding the largest share of its content words.

    All work stays in the page's own row.  The claims are found by expressions; the words of the source that they speak
    of become one bitmap of windows for each word, and no claim is compared with a window by itself.
    """
    claims = split_claims(strip_page_chrome(F.col(body)), max_claims=max_claims)
    text = F.coalesce(source, F.lit(""))
    # pages without claims give no rows there; a filter here would split every page twice
    rows = pages.select(*keys, F.length(text).alias("source_len"), text.alias("text"), claims.alias("claims"))
    fields = [f for f in rows.schema.fields if f.name not in ("text", "claims")]
    placed = rows.mapInArrow(_place, StructType([*fields, StructField("claim_no", IntegerType()), StructField("claim", StringType()),
                                                 StructField("best", IntegerType()), StructField("held", IntegerType()),
                                                 StructField("words", IntegerType())]))
    none = (F.col("words") == 0) | (F.col("source_len") == 0)
    score = F.when(none, F.lit(0.0)).otherwise(F.col("held") / F.col("words"))
    start = F.when(score > 0, F.col("best")).otherwise(0)
    return placed.select(*keys, "claim_no", "claim", start.alias("start"), F.least(start + WINDOW_CHARS, "source_len").alias("end"),
                         score.alias("score"), "words")


def _verdict(score: Column, words: Column) -> Column:
    contained = F.when(words == 0, F.lit(1.0)).otherwise(score)
    return F.when(contained >= SUPPORT, "supported").otherwise("unsupported")


def judge_claims(anchored: DataFrame) -> DataFrame:
    """Offline judge: supported when the window holds 70 % of the content words."""
    return anchored.withColumn("verdict", _verdict(F.col("score"), F.col("words")))


def audit_claims(state: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """file_id, outcome, checked, unsupported: the claims of every page on record against its source.

    ``state``: file_id, path, status; ``pages``: path, body; ``sources``: file_id, text (null: unreadable).  A document is
    ``checked``, or the reason why it cannot be: no page on record, its page missing, its source missing.  Once body and
    source stand in the document's row, its claims are counted there: no claim leaves it, and the row is not joined again.
    """
    asked = (state.select("file_id", "path", "status").join(pages.select("path", F.col("body").alias("_body")), "path", "left")
             .join(sources.select("file_id", F.col("text").alias("_source")), "file_id", "left"))
    none = F.coalesce("path", F.lit("")) == ""
    outcome = (F.when(none | (F.col("status") != "processed"), "no page on record").when(F.col("_body").isNull(), "page missing")
               .when(F.col("_source").isNull(), "source missing").otherwise("checked"))
    checked = F.col("outcome") == "checked"
    rows = asked.withColumn("outcome", outcome).select(
        "file_id", "outcome", F.when(checked, F.col("_source")).alias("text"),
        F.when(checked, split_claims(strip_page_chrome(F.col("_body")))).alias("claims"))
    weighed = rows.mapInArrow(_weigh, StructType([*rows.schema.fields[:2], StructField("claims", ArrayType(StructType([
        StructField("held", IntegerType()), StructField("words", IntegerType())])))]))
    unsupported = F.filter("claims", lambda c: _verdict(c["held"] / c["words"], c["words"]) == "unsupported")
    return weighed.select("file_id", "outcome", F.size("claims").cast("bigint").alias("checked"),
                          F.size(unsupported).cast("bigint").alias("unsupported"))
