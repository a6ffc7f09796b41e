"""One inventory of several connectors, and dossiers as whole documents."""
import glob

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import connectors, dossiers
from sourceloom.operators.changes import MassDeletion

LISTED = "connector string, file_id string, fingerprint string, local_path string"
KNOWN = "file_id string, fingerprint string, local_path string, on_disk boolean"


def _known(spark):
    return spark.createDataFrame([
        ("d1", "a", "1.md", True), ("d2", "a", "2.md", True), ("d3", "a", "3.md", False), ("d4", None, "by hand", True),
        ("slack-1", "s", "s1", True), ("slack-2", "s", "s2", True), ("local-1", "l", "l1", True)], KNOWN)


def test_each_connector_acts_on_its_own_ids(spark):
    listed = spark.createDataFrame([
        ("drive", "d1", "a", "1.MD"), ("drive", "d3", "a", "3.md"), ("drive", "d5", "b", "5.md"), ("drive", "d5", "b", "5.md"),
        ("drive", "slack-2", "b", "x"), ("drive", "slack-9", "b", "x"), ("drive", "d6", None, "6.md"), ("slack", "slack-1", "t", "s1")], LISTED)
    actions = connectors.reconcile(listed, _known(spark), ["drive", "slack", "local"])
    assert {r["file_id"]: r["action"] for r in actions.collect()} == {
        "d1": "skipped", "d2": "removed", "d3": "changed", "d4": "foreign", "d5": "added", "d6": "refused",
        "slack-1": "changed", "slack-2": "removed", "slack-9": "refused", "local-1": "held"}
    after = {r["file_id"]: r["fingerprint"] for r in connectors.union_inventory(listed, _known(spark), actions).collect()}
    assert after == {"d1": "a", "d3": "a", "d4": None, "d5": "b", "slack-1": "t", "local-1": "l"}
    with pytest.raises(MassDeletion, match="local"):
        connectors.guard_held(actions)


def test_connectors_that_were_not_synced_keep_everything(spark):
    listed = spark.createDataFrame([("slack", "slack-1", "s", "s1"), ("drive", "d9", "x", "9")], LISTED)
    actions = {r["file_id"]: r["action"] for r in connectors.reconcile(listed, _known(spark), ["slack"]).collect()}
    assert actions == {"d1": "untouched", "d2": "untouched", "d3": "untouched", "d4": "untouched", "local-1": "untouched",
                       "slack-1": "skipped", "slack-2": "removed"}


def test_everything_silent_removes_nothing(spark):
    empty = spark.createDataFrame([], LISTED)
    actions = connectors.reconcile(empty, _known(spark), ["drive", "slack", "local"])
    assert {r["action"] for r in actions.collect()} == {"held", "foreign"}
    assert connectors.union_inventory(empty, _known(spark), actions).count() == 7


def test_dossier_files(spark, tmp_path):
    members = spark.createDataFrame(
        [(f"f{i}", f"p/{i}.md", f"Report {i}", "acme" if i < 400 else "a/b: c", "2024", "" if i % 2 else "f0", None if i % 3 else ["eng", "all"], "h")
         for i in range(402)],
        "file_id string, path string, title string, entity string, as_of string, superseded_by string, acl array<string>, content_hash string")
    facts = spark.createDataFrame([("f1", "acme", "sales", "2024", "1,200", "usd", "f1!R1"), ("f2", "acme", "old", "2024", "77", None, "f2!R1")],
                                  "file_id string, entity string, metric string, period string, value_raw string, unit string, source_ref string")
    documents = dossiers.dossier_documents(members, facts, "2024-05-01")
    target = str(tmp_path / "dossiers")
    dossiers.write_dossiers(documents, target)
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{target}/entity=acme/*.txt")))
    lines = text.splitlines()
    assert lines[:9] == ["---", "type: dossier", 'title: "acme — dossier"', "entity: acme", 'generated_at: "2024-05-01"', "members: 400",
                         "verification: partial", "acl: [all, eng]", "unverified_numbers:"]
    assert lines[9:11] == ['  - "200"', '  - "400"'] or lines[9:10] == ['  - "400"']
    at = lines.index("## Key figures")
    assert lines[at - 2:at] == ["400 document(s) on file, 200 current.", ""]
    assert lines[at + 1:at + 3] == ["- sales · 2024 = 1,200 usd (source f1!R1)", ""] and "77 " not in text.split("## Documents")[0]
    assert sum(x.startswith("- Report ") for x in lines) == 400
    assert len(glob.glob(f"{target}/entity=*")) == 2
    # another pass writes one entity; the other stays
    dossiers.write_dossiers(documents.filter(F.col("entity") == "acme"), target)
    assert len(glob.glob(f"{target}/entity=*")) == 2 and text == "".join(open(f).read() for f in sorted(glob.glob(f"{target}/entity=acme/*.txt")))
