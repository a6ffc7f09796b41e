"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights; its positions are the terms.  Queries and candidates are dealt to a
grid of cells: every candidate block meets every query block once, and only blocks of bounded size are held
together.  In a cell the candidates become posting lists, one for each term.  A tile of queries owns dense score
arrays, one slot for each candidate; each term of a query scatters its weighted postings into them.  A posting
list that holds more than half of the candidates is kept as a whole column (the weights it lacks are zero), so
its scatter is an addition.  Each tile keeps its best slots by partition selection with all ties at the border,
and the cells of a query are merged by rank.  No score is skipped, approximated or sampled.

Integers are exact: 32 bits where no sum can exceed them, else 64 bits, else Python integers, and a score outside
64 bits is given as the nearest long.

Rows: null vectors and vectors with null or non-finite components take no part; an empty vector scores 0 with
all; vectors of different widths are compared over the terms both have; a row without vec_id is no query, and
as a candidate comes last among equal scores; every row with the query's vec_id counts as the query's own and is
left out; rows that repeat vec_id and vector are one query, but as many candidates as there are; a query with no
other row gives none; empty tables give an empty result; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scale that turns components into weights, results of a query, and which vec_ids are queries.
SCALE, TOP, EVERY = 1024, 10, 100
#: Most rows of a candidate block and of a query block, aimed-at cells for each core, rows under which a block is not divided.
BLOCK, QUERIES, CELLS, LEAST = 65_536, 32_768, 4, 256
#: Queries and candidates that are scored at once.
TILE, SLOTS = 32, 8_192
_FOUND = "query_id long, query_key long, vec_id long, score long"
_FIELDS = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_LAST = np.iinfo(np.int64).max


def finite(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    x = vector.cast("array<double>")
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))


def weights(lists: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of every component that is not zero."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = flat != 0
    flat = flat[kept]
    exact = flat.astype(np.int64) if not len(flat) or np.abs(flat).max() < 2.0 ** 62 else np.array([int(x) for x in flat], object)
    return row[kept], term[kept], exact


def _type(queries: np.ndarray, postings: np.ndarray, terms: int):
    """The narrowest integers that hold every sum."""
    high = max((abs(int(x)) for part in (queries, postings) if len(part) for x in (part.min(), part.max())), default=0)
    most = high * high * terms
    return np.int32 if most < 2 ** 31 - 1 else np.int64 if most < 2 ** 63 - 1 else object


class Postings:
    """Posting lists of a block of candidates: term -> (slots or None for all, weights)."""

    def __init__(self, count: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray, kind):
        self.count, self.kind, self.lists = count, kind, {}
        order = np.argsort(term, kind="stable")
        row, term, weight = row[order], term[order], weight[order].astype(kind)
        edges = np.flatnonzero(np.diff(term, prepend=-1)).tolist() + [len(term)]
        for a, b in zip(edges, edges[1:]):
            if 2 * (b - a) > count:
                whole = np.zeros(count, kind)
                whole[row[a:b]] = weight[a:b]
                self.lists[int(term[a])] = (None, whole)
            else:
                self.lists[int(term[a])] = (row[a:b], weight[a:b])

    def scores(self, rows: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Dense score arrays of ``rows`` queries, one term at a time."""
        out = np.zeros((rows, self.count), self.kind)
        held = np.empty_like(out)
        order = np.argsort(term, kind="stable")
        row, term, weight = row[order], term[order], weight[order].astype(self.kind)
        edges = np.flatnonzero(np.diff(term, prepend=-1)).tolist() + [len(term)]
        for a, b in zip(edges, edges[1:]):
            found = self.lists.get(int(term[a]))
            if found is None:
                continue
            slots, w = found
            asked, q = row[a:b], weight[a:b, None]
            if slots is not None:
                out[np.ix_(asked, slots)] += q * w
            elif len(asked) == rows:
                np.multiply(q, w, out=held)
                out += held
            else:
                out[asked] += q * w
        return out


def _best(scores: np.ndarray, out: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and slot of the k highest scores of each row, earlier slots first among equals; ``out``: slots left out."""
    usable = ~out
    if out.any():
        scores = np.where(out, np.iinfo(scores.dtype).min, scores)
    if scores.shape[1] > k:
        border = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        usable &= scores >= border[:, None]
    q, slot = np.nonzero(usable)
    order = np.lexsort((slot, ~scores[q, slot], q))                 # ~: descending without overflow
    q, slot = q[order], slot[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    return q[nth < k], slot[nth < k]


def _clipped(values: np.ndarray) -> np.ndarray:
    return np.clip(values, -2 ** 63, 2 ** 63 - 1).astype(np.int64)


def _cell(k: int, scale: int):
    def run(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return _FIELDS.empty_table()
        queries, candidates = queries.combine_chunks(), candidates.combine_chunks()
        candidates = candidates.sort_by("vec_id")                       # nulls last: slots are in the order of ties
        ids = candidates["vec_id"].combine_chunks().fill_null(_LAST).to_numpy()
        asked, keys = queries["query_id"].to_numpy(), queries["query_key"].to_numpy()
        qr, qt, qw = weights(queries["vector"].combine_chunks(), scale)
        cr, ct, cw = weights(candidates["vector"].combine_chunks(), scale)
        kind = _type(qw, cw, int(max(qt.max(initial=0), ct.max(initial=0))) + 1)
        best: list[tuple] = []
        for at in range(0, len(ids), SLOTS):
            own = np.arange(*np.searchsorted(cr, (at, at + SLOTS)))
            block = Postings(min(SLOTS, len(ids) - at), cr[own] - at, ct[own], cw[own], kind)
            part = ids[at:at + SLOTS]
            for q in range(0, len(asked), TILE):
                size = min(TILE, len(asked) - q)
                terms = np.arange(*np.searchsorted(qr, (q, q + TILE)))
                scores = block.scores(size, qr[terms] - q, qt[terms], qw[terms])
                if kind is object:
                    scores = _clipped(scores)
                row, slot = _best(scores, part[None, :] == asked[q:q + size, None], k)
                best.append((row + q, slot + at, scores[row, slot]))
        row, slot, score = (np.concatenate(x) for x in zip(*best))
        order = np.lexsort((slot, ~score, row))
        row, slot, score = row[order], slot[order], score[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, slot, score = row[kept], slot[kept], score[kept]
        return pa.Table.from_arrays([pa.array(asked[row]), pa.array(keys[row]), candidates["vec_id"].take(pa.array(slot)),
                                     pa.array(score, pa.int64())], schema=_FIELDS)
    return run


def search(queries: DataFrame, candidates: DataFrame, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query; both sides: vec_id, embedding."""
    spark = candidates.sparkSession
    asked = (queries.filter(finite(queries["embedding"]) & queries["vec_id"].isNotNull())
             .select(queries["vec_id"].cast("long").alias("query_id"), queries["embedding"].alias("vector"))
             .withColumn("query_key", F.xxhash64("query_id", "vector")).dropDuplicates(["query_id", "query_key"]))
    rows = candidates.filter(finite(candidates["embedding"])).select(
        candidates["vec_id"].cast("long").alias("vec_id"), candidates["embedding"].alias("vector"))
    count = candidates.count()                                          # from the files' footers; only numbers reach the driver
    blocks = max(min(CELLS * spark.sparkContext.defaultParallelism, -(-count // LEAST)), -(-count // BLOCK), 1)
    parts = max(-(-queries.count() // QUERIES), 1)
    left = (asked.withColumn("part", F.pmod(F.col("query_key"), F.lit(parts)))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    right = (rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector", F.lit(1)), F.lit(blocks)).cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))))
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_cell(k, scale), _FOUND)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def digest(embeddings: DataFrame) -> DataFrame:
    """The 10 best other rows for each row whose vec_id is divisible by 100."""
    return search(embeddings.filter(embeddings["vec_id"] % EVERY == 0), embeddings)


#: DuckDB: the result of digest() where vec_id is unique and all vectors have one width.
SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= {TOP}
"""
