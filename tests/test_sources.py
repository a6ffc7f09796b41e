import hashlib
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from sourceloom.sinks.tables import write_markdown
from sourceloom.sources import connectors, files
from sourceloom.streaming.polling import run_continuously, watch_documents


def test_files_sheets_and_documents(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "A").mkdir(parents=True)
    (root / "A" / "_hidden.csv").write_text("month,arr_usd\n\n2026-01,10\n2026-02,20\n")
    (root / "A" / "note.md").write_text("hello")
    with zipfile.ZipFile(root / "A" / "d.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>'
                   "<w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    scanned = files.scan_files(spark, str(root))
    assert {r["path"]: r["size"] for r in scanned.collect()}["./A/note.md"] == 5 and scanned.count() == 3
    rows = [(n, n, str(root / "A" / n)) for n in ("_hidden.csv", "note.md", "d.docx")]
    df = spark.createDataFrame(rows, "file_id string, name string, full_path string")
    grid = files.read_grids(df.filter("name LIKE '%csv'"))
    assert [(r["row"], r["values"]) for r in grid.orderBy("row").collect()] == [
        (1, ["month", "arr_usd"]), (2, ["2026-01", "10"]), (3, ["2026-02", "20"])]
    assert files.sheet_profiles(grid, sample=1).first()["text"] == (
        "### Sheet1 (3 rows, 2 cols)\n\n| month | arr_usd |\n| --- | --- |\n| 2026-01 | 10 |\n\n_(+1 more rows in the original file)_")
    texts = {r["name"]: r["text"] for r in files.read_texts(df).collect()}
    assert texts == {"note.md": "hello", "d.docx": "## Title\n\nText\n\n| a | b |"}


def test_large_tree_is_listed_by_tasks(spark, tmp_path, monkeypatch):
    """20,000 files in folders of several levels; no list of names is made on the driver."""
    root, want = tmp_path / "tree", set()
    for i in range(100):
        folder = root / f"a{i % 10}" / f"_b{i}" / ".c"
        folder.mkdir(parents=True)
        for k in range(200):
            (folder / f"f {k}.txt").touch()
            want.add(f"a{i % 10}/_b{i}/.c/f {k}.txt")
    os.symlink(root / "a1", root / "link")
    os.mkfifo(root / "pipe")
    (root / "top.md").write_text("x")
    os.makedirs(root / "empty")
    monkeypatch.setattr(os, "walk", None)
    listed = files.list_tree(spark, str(root))
    assert listed.filter("size = 0").count() == 20_000 and listed.count() == 20_001
    assert {r["rel"] for r in listed.filter("rel like 'a3/%' or rel = 'top.md'").collect()} == {w for w in want if w.startswith("a3/")} | {"top.md"}


def test_unreadable_paths_are_all_named(spark, tmp_path):
    with pytest.raises(files.UnreadablePaths) as failed:
        files.scan_files(spark, str(tmp_path / "missing"))
    assert "1 unreadable" in str(failed.value) and spark.read.parquet(failed.value.table).count() == 1
    (tmp_path / "one.txt").write_text("a")
    rows = {r["path"]: (r["size"], r["hash"]) for r in files.scan_files(spark, f"file://{tmp_path}").collect()}
    assert rows == {"./one.txt": (1, hashlib.md5(b"a").hexdigest())}
    (tmp_path / "empty").mkdir()
    assert files.scan_files(spark, str(tmp_path / "empty")).count() == 0


def test_markdown_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("x/a.md", "---\ntitle: A\n---\nb\n")], "path string, markdown string")
    write_markdown(pages, str(tmp_path))
    back = files.read_pages(spark, str(tmp_path)).collect()
    assert [(r["path"], r["text"]) for r in back] == [("x/a.md", "---\ntitle: A\n---\nb\n")]


def test_connectors(spark, tmp_path):
    (tmp_path / "chan").mkdir()
    (tmp_path / "users.json").write_text(json.dumps([{"id": "U1", "name": "ana", "profile": {"display_name": "", "real_name": "Ana P"}}]))
    (tmp_path / "chan" / "2026-01-02.json").write_text(json.dumps([{"ts": "1.5", "user": "U1", "text": "hi"}]))
    (tmp_path / "chan" / "2026-01-03.json").write_text("{broken")
    messages, users = connectors.chat_export(spark, str(tmp_path))
    assert [(m["channel"], m["month"], m["text"], m["has_files"]) for m in messages.collect()] == [("chan", "2026-01", "hi", False)]
    assert users.collect()[0].asDict() == {"id": "U1", "display": "Ana P"}
    for i, payload in enumerate([{"files": [{"id": "a", "title": "A", "parents": ["r"]}, {"name": "no id"}]}, [{"fileId": "b", "name": "B", "parents": [{"id": "a"}]}],
                                 {"id": "c", "name": "C", "parentId": "a"}]):
        (tmp_path / f"listing{i}.json").write_text(json.dumps(payload))
    got = {r["file_id"]: (r["name"], r["parent_id"]) for r in connectors.drive_listing(spark, str(tmp_path / "listing*.json")).collect()}
    assert got == {"a": ("A", "r"), "b": ("B", "a"), "c": ("C", "a")}
    (tmp_path / "_state.json").write_text(json.dumps({"files": {"f": {"name": "n", "fingerprint": "x"}}}))
    assert connectors.load_inventory(spark, str(tmp_path / "_state.json")).count() == 1
    assert connectors.load_inventory(spark, str(tmp_path / "missing.json")) is None


def test_streaming_hands_over_every_snapshot(spark, tmp_path):
    schema = "file_id string, raw_hash string, name string, path string, unit string, source_uri string, method string, text string"
    spark.createDataFrame([("f", "h", "n", "p", "u", "s", "text", "t")], schema).write.parquet(str(tmp_path / "in"))
    seen = []
    query = run_continuously(watch_documents(spark, str(tmp_path / "in")), lambda df, n: seen.append(df.select(F.max("file_id")).first()[0]),
                             str(tmp_path / "cp"), interval=None)
    query.awaitTermination(60)
    assert seen == ["f"]
