from pyspark.sql import functions as F

from sourceloom.operators import verification as ops

KPI = "| month | users | arr |\n| 2026-01 | 1250 | 480000 |\n| 2026-02 | 1310 | 495000 |\n| 2026-03 | 1400 | 512000 |"


def verdicts(spark, cases):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, body string, source string, context string")
    return [r.asDict() for r in ops.verify_pages(df, ["id"]).orderBy("id").collect()]


def test_presence_and_anchoring(spark):
    out = verdicts(spark, [
        ("Users were 1250 and ARR 480.000", KPI, ""),
        ("ARR was 512000 in January 2026", KPI, ""),
        ("ARR was 512000 in 2026-03", KPI, ""),
        ("ARR was 512000 in Q1 2026", KPI, ""),
        ("It reached $99.9M at a 77% margin, 1250 users", KPI, ""),
        ("no figures, 3 initiatives", KPI, ""),
        ("budget 1200000", "budget of 1 200 000", ""),
        ("In 2025 we had 42 staff", "42 staff", "Report 2025.md"),
        ("Total 12\nk", "12000", ""),
    ])
    assert [o["verdict"] for o in out] == ["verified", "partial", "verified", "verified", "failed", "verified", "verified", "verified", "verified"]
    assert out[1]["numbers_unanchored"] == ["512000"] and out[4]["numbers_unverified"] == ["99.9M", "77%"]
    assert out[0]["numbers_total"] == 2 and out[5]["numbers_total"] == 0


def test_verdict_thresholds(spark):
    df = spark.createDataFrame([(0, 4), (1, 4), (2, 4), (2, 8), (3, 8)], "p int, t int")
    assert [r[0] for r in df.select(ops.verdict_of(F.col("p"), F.col("t"))).collect()] == [
        "verified", "partial", "failed", "partial", "failed"]


def test_spans_point_at_the_source(spark):
    src = "alpha 1250 beta 480000 then 1 200 000"
    df = spark.createDataFrame([(1, "480.000 and 1250 and 1200000", src)], "id int, body string, hay string")
    got = {r["display"]: src[r["start"]:r["end"]].strip() for r in ops.figure_spans(df, ["id"], F.col("body"), F.col("hay")).collect()}
    assert got == {"480.000": "480000", "1250": "1250", "1200000": "1 200 000"}


def test_answers(spark):
    cite = [("p1", "ARR  was 512000")]
    rows = [(1, "ARR is 512000", "- arr = 512000", False, cite, ["p1"]), (2, "ARR is 77000", "- arr = 512000", False, cite, ["p1"]),
            (3, "ARR is 512000", "512000", False, [], ["p1"]), (4, "", "", True, [], []), (5, "x 99000", "", False, [("p9", "q")], ["p1"])]
    answers = spark.createDataFrame(rows, "answer_id int, answer string, evidence string, refused boolean, "
                                    "citations array<struct<path:string,quote:string>>, read_paths array<string>")
    pages = spark.createDataFrame([("p1", "T", "The arr was\n512000 in March")], "path string, title string, body string")
    got = {r["answer_id"]: r["verdict"] for r in ops.verify_answers(answers, pages).collect()}
    assert got == {1: "verified", 2: "partial", 3: "partial", 4: "verified", 5: "failed"}


def test_thousands_are_rounded_by_value(spark, tmp_path):
    """327.95 as a double lies below the tie, 496.25 on it: one decimal of the value itself, ties to even."""
    from sourceloom.queries.verification import parse_numbers
    rows = [(1, 327950.0, "O"), (7, 496250.0, "O"), (13, 1234567.0, "O"), (19, 850.0, "O"), (0, 2.5, "F")]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    found = {r["o_orderkey"]: (r["raw"], r["value"]) for r in parse_numbers(spark, str(tmp_path)).collect()}
    assert found == {1: ("327.9k", 327900.0), 7: ("496.2k", 496200.0), 13: ("1234.6k", 1234600.0), 19: ("0.8k", 800.0), 0: ("$2.50", 2.5)}


def test_only_telling_lines_are_searched(spark, monkeypatch):
    """Lines without a part of a figure or a period shrink to a letter; verdicts stay those of the whole texts."""
    long = "plain words that say nothing, " * 50
    odd = ["ARR was 512000 in Jan\n,\n2026", "In Q1\n of\n\n2026 ARR was 512000", "Revenue was 480\nk in January\n 2026", "It was 480\n% of\nmarket\nk in May",
           "$1 200\n000 and 512000\nmany", "1250\n(foo) 77\n.bar", "May we ask\nof 2026-03, 1310 users\r\nQ2", "", "no figures\nat all"]
    cases = [(f"{long}\n{body}\n{long}\n{more}", f"{long}\n{KPI}\n{source}\n{long}", "x") for body in odd for more in ("", "42%") for source in ("", *odd[:3])]
    assert spark.range(1).select(ops.telling_lines(F.lit(cases[0][0]))).first()[0] == "x\nARR was 512000 in Jan\n,\n2026\nx\n"
    thin = verdicts(spark, cases)
    monkeypatch.setattr(ops, "telling_lines", lambda text: text)
    assert thin == verdicts(spark, cases)
