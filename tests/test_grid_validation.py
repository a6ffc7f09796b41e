"""What validating grid proposals sends, and rows that repeat their coordinates."""
from __future__ import annotations

from sourceloom.operators import facts

GRID = "file_id string, sheet string, row int, values array<string>"
PROPOSED = "file_id string, sheet string, row int, col int, proposal_no long, metric_raw string, value_raw string, period string"


def test_proposals_travel_to_their_row_and_to_their_column(spark):
    """two exchanges of the proposals; row, column and title checks no longer send them again."""
    grid = spark.createDataFrame([("a", "S", 1, ["month", "revenue"]), ("a", "S", 2, ["2024-01", "12"])], GRID)
    p = spark.createDataFrame([("a", "S", 2, 2, 1, "revenue", "12", "2024-01"), ("a", "S", 2, 2, 2, "revenue", "12", "2024-01"),
                               ("a", "S", 2, 2, 3, "margin", "12", "2024-01"), ("a", "S", 2, 2, 4, "revenue", "12", "2025-01"),
                               ("a", "S", 9, 2, 5, "revenue", "12", "2024-01"), ("a", "S", 2, 2, 6, "revenue", "13", "2024-01"),
                               (None, "S", 2, 2, 7, "revenue", "12", None)], PROPOSED)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        judged = facts.validate_grid(p, grid)
        plan = judged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") <= 6
        assert {r.proposal_no: r.reason for r in judged.collect()} == {
            1: None, 2: "duplicate-cell", 3: "label-not-found", 4: "period-not-found", 5: "bad-coordinates", 6: "value-not-in-cell", 7: "bad-coordinates"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_each_of_repeated_rows_counts(spark):
    """Rows that repeat their coordinates: every cell of them against every row of them, as by joins."""
    grid = spark.createDataFrame([("a", "S", 1, ["month", "x"]), ("a", "S", 2, ["revenue", "12"]), ("a", "S", 2, ["2024-01", "13"]),
                                  ("a", "S", 2, ["short"])], GRID)
    p = spark.createDataFrame([("a", "S", 2, 2, 1, "revenue", "12", "2024-01"), ("a", "S", 2, 3, 2, "revenue", "12", "2024-01")], PROPOSED)
    got = sorted((r.proposal_no, r.reason or "") for r in facts.validate_grid(p, grid).collect())
    assert got == sorted([(1, ""), (1, "label-not-found"), (1, "label-not-found")] + 3 * [(1, "value-not-in-cell")] + 3 * [(2, "bad-coordinates")])
