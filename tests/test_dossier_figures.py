"""Dossiers: facts are worked out once, figures are interpreted once for each entity."""
from sourceloom.operators import dossiers

MEMBER = "file_id string, path string, title string, entity string, as_of string, superseded_by string, acl array<string>, content_hash string"
FACT = "entity string, file_id string, metric string, period string, value_raw string, unit string, source_ref string"


def test_lines_are_stored_before_absent_figures_are_looked_for(spark):
    members = spark.createDataFrame([("f1", "p1", "One", "acme", "2024", "", None, "h"), ("f2", "p2", "Two", "umbra", "", "", None, "h")], MEMBER)
    facts = spark.createDataFrame([("acme", "f1", "revenue", "2024-01", "1200", "usd", "f1!R2C3")], FACT)
    lines = dossiers.dossier_lines(members, facts)
    assert "Join" not in lines._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["entity"], r["line"]) for r in lines.filter("section = 2").collect()) == [
        ("acme", "- revenue · 2024-01 = 1200 usd (source f1!R2C3)"), ("umbra", "No verified observations in the facts store.")]


def test_figures_backed_by_repeated_spaced_and_scaled_evidence(spark):
    lines = spark.createDataFrame([("a", "1,200,000 and 35 and 7.5 and 88"), ("b", "35 and 2.5k"), ("b", "35")], "entity string, line string")
    evidence = spark.createDataFrame([("a", "1 200 000"), ("a", "35"), ("a", "35 in 35"), ("a", "7,5"), ("b", "2500"), ("b", None)], "entity string, line string")
    shown = dossiers.shown_figures(lines, evidence)
    assert sorted(map(tuple, shown.collect())) == [("a", "1,200,000", True), ("a", "35", True), ("a", "7.5", True), ("a", "88", False),
                                                   ("b", "2.5k", True), ("b", "35", False)]
