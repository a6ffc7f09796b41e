import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sourceloom.judges.offline import backend
from sourceloom.operators import changes, chat, search
from sourceloom.operators.pages import parse_pages
from sourceloom.plans.answers import Knowledge, answer_questions, ask
from sourceloom.plans.graph import apply_merge, build_graph
from sourceloom.plans.ingest import Settings, run_pass
from sourceloom.sinks.tables import is_fresh, latest, provenance

DOCS = "file_id string, name string, path string, unit string, source_uri string, method string, raw_hash string, text string"
KPI = [["month", "active_users", "arr_usd"], ["2026-01", "1250", "480000"], ["2026-02", "1310", "495000"], ["2026-03", "1400", "512000"]]
TABLE = "\n".join("| " + " | ".join(r) + " |" for r in KPI)
NOTE = "Globex Quarterly Report. Revenue for the quarter was $1.2M in 2026-03. Order intake reached $2.5M in 2026-03. The Globex team grew to 42 people. Globex is fine."


def doc(fid, name, folder, text, method="text"):
    return (fid, name, f"{folder}/{name}", folder.split("/")[0], f"local://{name}", method, hashlib.sha256(text.encode()).hexdigest(), text)


def corpus():
    return [doc("a", "Quarterly Report.md", "Clients/1. Globex", NOTE), doc("b", "Quarterly Report FINAL.md", "Clients/1. Globex", NOTE + " Signed."),
            doc("c", "copy.md", "Other", NOTE), doc("k", "KPI.csv", "Clients/1. Globex", TABLE, "sheet"), doc("n", "minutes.md", "Clients/2. Acme", "Board minutes of Acme.")]


def test_ingest_pass_end_to_end(spark, tmp_path):
    cfg = Settings(str(tmp_path / "t"), "2026-04-01T00:00:00", writer=backend("offline-flawed"),
                   acl={"default": ["all"], "rules": [{"path_contains": "minutes", "audiences": ["leadership"]}]})
    grid = spark.createDataFrame([("k", "Sheet1", i + 1, r) for i, r in enumerate(KPI)], "file_id string, sheet string, row int, values array<string>")
    out = run_pass(spark, spark.createDataFrame(corpus(), DOCS), grid, cfg)
    state = {r["file_id"]: r for r in out["state"].collect()}
    assert state["c"]["status"] == "duplicate" and state["c"]["duplicate_of"] == "a"
    assert {f: state[f]["verification"] for f in "abkn"} == {f: "verified" for f in "abkn"}
    assert state["a"]["retried"] and not state["b"]["retried"] and state["k"]["retried"]
    assert state["a"]["superseded_by"] == "b" and state["b"]["supersedes"] == "a" and state["b"]["superseded_by"] is None
    assert state["n"]["acl"] == ["leadership"] and state["a"]["entity"] == "globex" and state["a"]["as_of"] == "2026-03"
    stored = {(r["metric"], r["period"]): r["value_num"] for r in out["facts"].filter("file_id = 'k'").collect()}
    assert stored[("arr-usd", "2026-03")] == 512000.0 and len(stored) == 6
    # "Revenue quarter" is not a phrase of its sentence, "Order intake" is
    assert {r["metric"]: r["reason"] for r in out["facts_judged"].filter("file_id = 'b'").collect()} == {
        "revenue-quarter": "label-not-in-quote", "order-intake": None}
    assert out["facts"].filter("file_id = 'b'").first()["value_num"] == 2.5e6
    assert {r["entity"]: r["action"] for r in out["dossier_actions"].collect()} == {"globex": "write", "acme": "write"}

    pages = out["pages"]
    parsed = {r["path"]: r for r in parse_pages(pages.select(F.col("page_path").alias("path"), F.col("markdown").alias("text"), F.lit(1.0).alias("mtime"),
                                                             F.lit(1).alias("size"))).collect()}
    minutes = parsed[state["n"]["path"]]
    assert minutes["acl"] == ["leadership"] and minutes["title"] == "minutes" and minutes["entity"] == "acme"

    # second pass: c is now the only holder, n changes, the rest is untouched
    rest = [r for r in corpus() if r[0] not in ("a", "n")] + [doc("n", "minutes.md", "Clients/2. Acme", "Board minutes of Acme: 7000 units.")]
    again = run_pass(spark, spark.createDataFrame(rest, DOCS), None, cfg)
    assert {r["file_id"]: r["reason"] for r in again["pending"].collect()} == {"a": "deleted", "c": "changed", "n": "changed"}
    now = {r["file_id"]: r["status"] for r in again["state"].collect()}
    assert now == {"a": "deleted", "b": "processed", "c": "processed", "k": "processed", "n": "processed"}
    assert again["facts"].filter("file_id = 'a'").count() == 0 and again["facts"].filter("file_id = 'k'").count() == 6
    assert latest(spark, cfg.root, "state").count() == 5
    # the page table holds every pass's pages, with the marks of the present state
    kept = {r["file_id"]: r["markdown"] for r in again["pages"].collect()}
    assert kept.keys() == {"b", "c", "k", "n"} and "7000 units" in kept["n"]
    marked = {r["file_id"]: r["markdown"] for r in pages.collect()}
    assert 'superseded_by: "b"' in marked["a"] and 'supersedes: "a"' in marked["b"] and 'supersedes: "a"' not in kept["b"]
    with pytest.raises(changes.MassDeletion):
        run_pass(spark, spark.createDataFrame([], DOCS), None, cfg)

    # serve it
    index = parse_pages(pages.select(F.col("page_path").alias("path"), F.col("markdown").alias("text"), F.lit(1.0).alias("mtime"), F.lit(1).alias("size")))
    k = Knowledge(index, out["facts"], search.build_postings(index), search.page_lengths(index))
    reply = ask(k, "What is the arr-usd for globex?")
    assert "512000" in reply["answer"] and reply["verdict"] == "verified" and not reply["refused"]
    assert ask(k, "What is the arr-usd for zenith?")["refused"]
    many = spark.createDataFrame([(1, "What is the arr-usd for globex in 2026-01?"), (2, "board minutes"), (3, "xyzzy"), (4, "arr-usd")],
                                 "question_id int, question string")
    answers = {r["question_id"]: r for r in answer_questions(many, k).collect()}
    assert "480000" in answers[1]["answer"] and answers[1]["confidence"] == "high" and answers[2]["confidence"] == "medium"
    assert answers[3]["refused"] and "xyzzy" in answers[3]["reason"] and "512000" in answers[4]["answer"]
    scoped = Knowledge(index, out["facts"], k.postings, k.lengths, audiences={"all"})
    assert scoped.page(state["n"]["path"]) is None and k.page(state["n"]["path"]) is not None


def test_marks_go_when_a_version_is_rewritten(spark, tmp_path):
    """Three passes: linked, the newer text rewritten to something else, and back again."""
    cfg = Settings(str(tmp_path / "t"), "2026-04-01T00:00:00")
    body = NOTE + " It has a list of orders, of people and of places."
    other = "Minutes of a board that met in spring and spoke of the garden, the roof and the old stairs of the house."

    def state(second):
        docs = [doc("x", "plan v1.md", "Clients/1. Globex", body), doc("y", "plan v2.md", "Clients/1. Globex", second),
                doc("z", "note.md", "Clients/2. Acme", "A short note of Acme.")]
        out = run_pass(spark, spark.createDataFrame(docs, DOCS), None, cfg)
        pages = {r["file_id"]: r["markdown"] for r in out["pages"].collect()}
        return {r["file_id"]: (r["superseded_by"], r["supersedes"]) for r in out["state"].collect()}, pages

    marks, pages = state(body + " Signed.")
    assert marks == {"x": ("y", None), "y": (None, "x"), "z": (None, None)} and 'superseded_by: "y"' in pages["x"]
    marks, pages = state(other)
    assert marks == {"x": (None, None), "y": (None, None), "z": (None, None)} and "superseded_by" not in pages["x"]
    marks, pages = state(body + " Signed again.")
    assert marks["x"] == ("y", None) and 'superseded_by: "y"' in pages["x"]


def test_graph_build_and_registry_merge(spark):
    mentions = spark.createDataFrame([("p1", 1, "Globex, Inc.", "company"), ("p1", 2, "GLOBEX", None), ("p2", 1, "Globex", "company"), ("p2", 2, "Zed", "x")],
                                     "page string, pos int, name string, type string")
    pages = spark.createDataFrame([("p1", "one "), ("p2", "two")], "page string, text string")
    out = build_graph(pages, mentions, previous=spark.createDataFrame([("p1",), ("old.md",)], "path string"))
    node = out["nodes"].first()
    assert node["path"] == "entities/company/globex.md" and "# Globex\n" in node["text"]
    text = {r["page"]: r["text"] for r in out["pages"].collect()}
    assert text["p1"] == "one\n\n## Related entities\n\n- [[entities/company/globex|Globex, Inc.]]\n"
    assert [r["path"] for r in out["stale"].collect()] == ["old.md"]
    registry = spark.createDataFrame([("globex", "Globex", "company", []), ("gx", "GX Industries", "company", ["GXI"]), ("acme", "Acme", "company", ["GX Industries", "AC"])],
                                     "entity_id string, name string, type string, aliases array<string>")
    merged = {r["entity_id"]: sorted(r["aliases"]) for r in apply_merge(registry, "globex", "Globex", "company", ["GX Industries"]).collect()}
    assert merged == {"globex": ["GX Industries", "GXI", "gx"], "acme": ["AC"]}


def test_chat_thread_order(spark):
    rows = [("c", "2026-01", "30.0", "U1", None, "late", None, False), ("c", "2026-01", "10.0", "U1", None, "hi <@U2>", None, False),
            ("c", "2026-01", "20.0", "U2", None, "reply", "10.0", False), ("c", "2026-01", "25.0", "", "bot", "orphan", "5.0", False),
            ("c", "2026-01", "26.0", "U1", None, "", None, False)]
    messages = spark.createDataFrame(rows, "channel string, month string, ts string, user string, username string, text string, thread_ts string, has_files boolean")
    users = spark.createDataFrame([("U1", "Ana"), ("U2", "Bo")], "id string, display string")
    lines = chat.conversation_lines(messages, users).orderBy("block_ts", "block_kind", "is_reply", "ts").collect()
    assert [ln["line"][:2] + "|" + ln["line"].split(": ", 1)[1] for ln in lines] == ["19|hi @Bo", "  |reply", "↳ |orphan", "19|late"]
    assert "bot" in lines[2]["line"]


def test_folder_paths_survive_missing_and_cyclic_parents(spark):
    rows = [("f", "F", "root", None), ("g", "G", "f", None), ("x", "X", "nowhere", None), ("e", "E", "f", "/Set/E"), ("c1", "C1", "c2", None), ("c2", "C2", "c1", None), ("h", "H", "g", None)]
    df = spark.createDataFrame(rows, "file_id string, name string, parent_id string, explicit_path string")
    got = {r["file_id"]: r["path"] for r in changes.child_paths(df, "root", "Drive").collect()}
    assert got == {"f": "/Drive/F", "g": "/Drive/F/G", "h": "/Drive/F/G/H", "x": "/Drive/X", "e": "/Set/E", "c1": "/Drive/C1", "c2": "/Drive/C2"}


def test_mass_deletion_brake(spark):
    manifest = spark.createDataFrame([("d1", "fp"), ("slack-1", "fp")], "file_id string, fingerprint string")
    with pytest.raises(changes.MassDeletion):
        changes.guard_mass_deletion(manifest.limit(0), manifest)
    changes.guard_mass_deletion(manifest.limit(0), manifest.filter("file_id = 'slack-1'"))


def test_provenance_freshness():
    side = json.dumps(provenance({"a": "1"}, "stage@1", 3, "now"))
    assert is_fresh(side, {"a": "1"}) and not is_fresh(side, {"a": "2"}) and not is_fresh(None, {}) and not is_fresh("{", {})
