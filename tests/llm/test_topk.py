"""Exact top-k search against plain sums over all rows."""
import math
import random

import numpy as np
import pytest

from sourceloom.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, k=10, every=100, scale=1024):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)
    held = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if usable(v)]
    out = {}
    for i, q in {(i, tuple(q)): (i, q) for i, q in held if i is not None and i % every == 0}.values():
        scored = [(-min(max(sum(a * b for a, b in zip(q, c)), -2 ** 63), 2 ** 63 - 1), math.inf if j is None else j) for j, c in held if j != i]
        out.setdefault(i, []).extend((r, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k], 1))
    return {i: sorted(v) for i, v in out.items()}


def found(spark, rows, k=10, every=100, extra=()):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    for name in extra:
        df = df.withColumn(name, df["label"])
    out = {}
    for r in topk.search(df.filter(df["vec_id"] % every == 0), df, k).collect():
        out.setdefault(r.query_id, []).append((r["rank"], math.inf if r.vec_id is None else r.vec_id, r.score))
    return {i: sorted(v) for i, v in out.items()}


def dense(r, width=12):
    return [r.uniform(-0.5, 0.5) for _ in range(width)]


def sparse(r, width=40):
    return [r.choice([0.0, 0.0, 0.0, 0.0, r.uniform(-1, 1)]) for _ in range(width)]


@pytest.mark.parametrize("make", [dense, sparse])
def test_matches_plain_sums(spark, make, monkeypatch):
    r = random.Random(4)
    rows = [(i, make(r)) for i in range(700)]
    rows += [(1000 + i, list(rows[7][1])) for i in range(60)]                      # a group of copies: ties
    monkeypatch.setattr(topk, "LEAST", 50)
    monkeypatch.setattr(topk, "QUERIES", 3)                                        # several blocks on both sides
    want = plain(rows)
    assert found(spark, rows, extra=["query_id", "vector", "block", "part", "score", "rank"]) == want
    assert len(want) == 8 and all(len(v) == 10 for v in want.values())


def test_rows_out_of_order(spark):
    rows = [(0, [0.5, 0.25]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (5, []),
            (None, [0.5, 0.25]), (None, None), (6, [0.5, 0.25]), (7, [0.5, 0.25, 9.0]), (8, [-0.0001, 0.0]), (100, []), (200, None)]
    got = found(spark, rows)
    assert got == plain(rows)
    assert [x[1] for x in got[0]] == [6, 7, math.inf, 5, 100, 8]
    assert {x[2] for x in got[100]} == {0}


def test_repeated_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.5])]
    assert found(spark, rows) == plain(rows)


def test_only_row_and_empty_table(spark):
    assert found(spark, [(0, [1.0])]) == {}
    assert found(spark, []) == {}


def test_large_components_are_exact(spark):
    rows = [(0, [3.0e12, 1.0]), (1, [2.5e3, 7.0]), (2, [1e300, 0.0]), (3, [-1e300, 0.0]), (4, [2.0 ** 40, 2.0 ** 40])]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, k=1) == plain(rows, k=1)


def test_postings_and_selection():
    row, term, weight = np.array([0, 1, 2, 0]), np.array([3, 3, 3, 9]), np.array([5, 6, 7, 8])
    block = topk.Postings(3, row, term, weight, np.int64)
    assert block.lists[3][0] is None and block.lists[9][0].tolist() == [0]
    scores = block.scores(2, np.array([0, 1, 1]), np.array([3, 9, 11]), np.array([2, 10, 4]))
    assert scores.tolist() == [[10, 12, 14], [80, 0, 0]]
    q, slot = topk._best(scores, np.zeros_like(scores, bool), 2)
    assert list(zip(q.tolist(), slot.tolist())) == [(0, 2), (0, 1), (1, 0), (1, 1)]
