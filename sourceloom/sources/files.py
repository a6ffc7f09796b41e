"""Scans of file trees and the conversion of files to text and grids.

Folders are listed and contents read by tasks, because file readers ignore names starting with "_" or "." and absence
means deletion downstream.
"""
from __future__ import annotations

import hashlib
import io
import os
import subprocess
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.functions import paths
from sourceloom.session import cut_lineage, shared_folder
from sourceloom.sources.delimited import delimited_rows

SHEET_SAMPLE_ROWS = 25      # fixed value: rows shown in a sheet profile
GRID_SCHEMA = "file_id string, sheet string, row int, values array<string>"


class UnreadablePaths(RuntimeError):
    """Some paths could not be read; reporting them as absent would delete their documents.

    ``table`` names the stored table of all of them (rel, error); the message shows how many there are and some.
    """

    def __init__(self, message: str, table: str):
        super().__init__(message)
        self.table = table


_LISTED = "rel string, folder boolean, size long, mtime double, error string"
_SCANNED = "path string, size long, mtime double, hash string, sha256 string, error string"
_ROWS = 5_000


def _open(root: str):
    """File system and path of a folder; anything but a local path is opened by its URI."""
    from pyarrow.fs import FileSystem
    return FileSystem.from_uri(root) if "://" in root else (None, root)


def _entries(system, folder: str) -> Iterator[tuple[str, bool, int | None, float | None]]:
    """name, is a folder, size, time of what a folder holds; links and special files are left out."""
    if system is None:
        with os.scandir(folder) as found:
            for e in found:
                try:
                    e.name.encode("utf-8")
                except UnicodeEncodeError:
                    continue
                if e.is_dir(follow_symlinks=False):
                    yield e.name, True, None, None
                elif e.is_file(follow_symlinks=False):
                    info = e.stat(follow_symlinks=False)
                    yield e.name, False, info.st_size, info.st_mtime
        return
    from pyarrow.fs import FileSelector, FileType
    for e in system.get_file_info(FileSelector(folder)):
        if e.type in (FileType.File, FileType.Directory):
            yield e.base_name, e.type == FileType.Directory, e.size, e.mtime_ns / 1e9 if e.mtime_ns else 0.0


def _gone(system, base: str, rel: str, err: OSError) -> bool:
    """The entry itself has vanished while its folder is still there: its absence is the truth."""
    above = os.path.dirname(f"{base}/{rel}")
    return bool(rel) and isinstance(err, FileNotFoundError) and (system is not None or os.path.isdir(above))


def _list_folders(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _open(root)
        rows: list[tuple] = []

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["rel", "folder", "size", "mtime", "error"]).astype({"size": "Int64"})
            rows.clear()
            return out

        for batch in batches:
            for rel in batch["rel"]:
                try:
                    for name, folder, size, mtime in _entries(system, f"{base}/{rel}" if rel else base):
                        rows.append((f"{rel}/{name}" if rel else name, folder, size, mtime, None))
                        if len(rows) >= _ROWS:
                            yield flush()
                except OSError as err:
                    if not _gone(system, base, rel, err):
                        rows.append((rel, True, None, None, str(err)))
        yield flush()
    return run


def _refuse_errors(rows: DataFrame, name: str) -> None:
    """Fails with all unreadable paths, which stay in a stored table; only a few of them go into the message."""
    problems = rows.filter("error is not null").select(F.col(name).alias("rel"), "error")
    some = problems.limit(20).collect()
    if some:
        table = shared_folder(rows.sparkSession, "unreadable")
        problems.write.parquet(table)
        count = rows.sparkSession.read.parquet(table).count()
        raise UnreadablePaths("\n".join([f"{count} unreadable paths, all in {table}", *(f"{r['rel']}: {r['error']}" for r in some)]), table)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """rel, size, mtime of every regular file below ``root``.

    Folders are listed by tasks, level by level; a level is stored before the next one begins, and the driver sees
    numbers only.  A folder that cannot be read fails the listing after all others have been tried.
    """
    frontier, levels, spread = spark.createDataFrame([("",)], "rel string"), [], spark.sparkContext.defaultParallelism * 4
    count = 1
    while count:
        found = cut_lineage(frontier.repartition(min(count, max(spread, count // 256))).mapInPandas(_list_folders(root), _LISTED))
        levels.append(found)
        frontier = found.filter("folder and error is null").select("rel")
        count = frontier.count()
    everything = levels[0]
    for level in levels[1:]:
        everything = everything.unionByName(level)
    _refuse_errors(everything, "rel")
    return everything.filter("not folder").select("rel", "size", "mtime")


def _hash_files(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _open(root)
        for batch in batches:
            rows = []
            for rel in batch["rel"]:
                full = f"{base}/{rel}"
                try:
                    md5, sha = hashlib.md5(), hashlib.sha256()
                    with open(full, "rb") if system is None else system.open_input_stream(full) as handle:
                        while chunk := handle.read(1 << 20):
                            md5.update(chunk)
                            sha.update(chunk)
                    info = os.stat(full) if system is None else None
                    far = system.get_file_info(full) if system is not None else None
                    size, mtime = (info.st_size, info.st_mtime) if info else (far.size, (far.mtime_ns or 0) / 1e9)
                except OSError as err:
                    if not _gone(system, base, rel, err):
                        rows.append(("./" + rel, None, None, None, None, str(err)))
                    continue
                rows.append(("./" + rel, size, mtime, md5.hexdigest(), sha.hexdigest(), None))
            yield pd.DataFrame(rows, columns=["path", "size", "mtime", "hash", "sha256", "error"]).astype({"size": "Int64"})
    return run


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """path ('./' prefix), size, mtime, md5, sha256 of every regular file below ``root``; stored.

    ``root`` is a folder every executor can reach: a path of a shared file system or a URI.
    """
    listing = cut_lineage(list_tree(spark, root))
    parts = max(1, min(listing.count() // 64 + 1, 10_000))
    hashed = cut_lineage(listing.select("rel").repartition(parts).mapInPandas(_hash_files(root), _SCANNED))
    _refuse_errors(hashed, "path")
    return hashed.drop("error")


# --- converters: small helpers over the bytes of one file ---------------------------------------------
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PKG = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _column_number(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n


def _xlsx_grid(data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(_MAIN + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(_PKG + "Relationship")}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(_MAIN + "sheet"):
            target = targets[sheet.get(_REL + "id")].lstrip("/")
            tree = ET.fromstring(z.read(target if target.startswith("xl/") else "xl/" + target))
            rows = []
            for row in tree.iter(_MAIN + "row"):
                cells: list[str] = []
                for c in row.iter(_MAIN + "c"):
                    at = _column_number(c.get("r") or "") or len(cells) + 1
                    cells += [""] * (at - 1 - len(cells))
                    v, kind = c.find(_MAIN + "v"), c.get("t")
                    text = "".join(t.text or "" for t in c.iter(_MAIN + "t")) if kind == "inlineStr" else (v.text or "" if v is not None else "")
                    cells.append(shared[int(text)] if kind == "s" and text else text)
                rows.append(cells)
            yield sheet.get("name"), rows


def _grid_of(name: str, data: bytes):
    ext = os.path.splitext(name)[1].lower()
    if ext == ".xls":
        try:
            import xlrd
        except ImportError as err:
            raise RuntimeError("reading .xls needs the optional xlrd package") from err
        book = xlrd.open_workbook(file_contents=data)
        return ((s.name, ([str(int(v)) if isinstance(v, float) and v.is_integer() else str(v) for v in s.row_values(i)]
                          for i in range(s.nrows))) for s in book.sheets())
    return _xlsx_grid(data)


def read_grids(files: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Grid rows of spreadsheets (columns file_id, name, full_path); blank rows are dropped.

    Delimited files are read in ranges by many tasks, workbooks by one task each.
    """
    def convert(batches):
        for batch in batches:
            for rec in batch.itertuples():
                with open(rec.full_path, "rb") as handle:
                    data = handle.read()
                for sheet, rows in _grid_of(rec.name, data):
                    kept, n = [], 0
                    for cells in rows:
                        if not any(c.strip() for c in cells):
                            continue
                        n += 1
                        if max_rows and n > max_rows:
                            break
                        kept.append((rec.file_id, sheet, n, list(cells)))
                        if len(kept) == 10_000:       # hand over long sheets in pieces
                            yield pd.DataFrame(kept, columns=["file_id", "sheet", "row", "values"])
                            kept = []
                    yield pd.DataFrame(kept, columns=["file_id", "sheet", "row", "values"])

    delimiter = F.when(paths.extension(F.col("name")) == ".csv", ",").when(paths.extension(F.col("name")) == ".tsv", "\t")
    named = files.select("file_id", "name", "full_path", delimiter.alias("delimiter"))
    plain = delimited_rows(named.filter("delimiter is not null")).select("file_id", F.lit("Sheet1").alias("sheet"), F.col("row").cast("int"), "values")
    plain = plain if max_rows is None else plain.filter(F.col("row") <= max_rows)
    books = named.filter("delimiter is null").select("file_id", "name", "full_path").mapInPandas(convert, GRID_SCHEMA)
    return plain.unionByName(books)


def _docx_text(data: bytes) -> str:
    parts = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(_WORD + "body")
    for p in body.findall(_WORD + "p"):
        text = "".join(t.text or "" for t in p.iter(_WORD + "t")).strip()
        style = p.find(f"{_WORD}pPr/{_WORD}pStyle")
        if text:
            heading = style is not None and "heading" in (style.get(_WORD + "val") or "").lower()
            parts.append(f"## {text}" if heading else text)
    for row in body.iter(_WORD + "tr"):
        cells = [" ".join("".join(t.text or "" for t in p.iter(_WORD + "t")) for p in c.findall(_WORD + "p")).strip()
                 for c in row.findall(_WORD + "tc")]
        parts.append("| " + " | ".join(cells) + " |")
    return "\n\n".join(parts)


def _text_of(method: str, path: str) -> str:
    if method == "pdf":
        run = subprocess.run(["pdftotext", "-layout", path, "-"], capture_output=True, text=True)
        if run.returncode:
            raise RuntimeError(f"pdftotext failed: {run.stderr[:500]}")
        return run.stdout
    if method == "office":
        raise RuntimeError("office files need a conversion service; supply a converter")
    with open(path, "rb") as handle:
        data = handle.read()
    return _docx_text(data) if method == "docx" else data.decode("utf-8", "replace")


def read_texts(files: DataFrame, converters: dict | None = None) -> DataFrame:
    """Adds ``method``, ``text`` and ``error`` to files with file_id, name, full_path (no sheets)."""
    routed = files.withColumn("method", paths.extraction_method(paths.extension(F.col("name"))))
    schema = "file_id string, name string, full_path string, method string, text string, error string"
    custom = dict(converters or {})

    def convert(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                text, error = None, None
                try:
                    text = custom[r.method](r.full_path) if r.method in custom else _text_of(r.method, r.full_path)
                except Exception as err:  # noqa: BLE001 - one unreadable file must not stop the others
                    error = str(err)[:500]
                out.append((r.file_id, r.name, r.full_path, r.method, text, error))
            yield pd.DataFrame(out, columns=["file_id", "name", "full_path", "method", "text", "error"])

    return routed.filter(F.col("method") != "sheet").select(
        "file_id", "name", "full_path", "method").mapInPandas(convert, schema)


def sheet_profiles(grid: DataFrame, sample: int = SHEET_SAMPLE_ROWS) -> DataFrame:
    """Compact text of a workbook: dimensions, the first rows as a table, how many rows are left."""
    from sourceloom.functions.render import table
    shape = grid.groupBy("file_id", "sheet").agg(F.count(F.lit(1)).alias("n"))
    head = (grid.filter(F.col("row") <= sample + 1).groupBy("file_id", "sheet")
            .agg(F.array_sort(F.collect_list(F.struct("row", "values"))).alias("r"))
            .select("file_id", "sheet", F.transform("r", lambda x: x["values"]).alias("rows")))
    part = F.concat(F.lit("### "), "sheet", F.lit(" ("), F.col("n").cast("string"), F.lit(" rows, "),
                    F.size(F.get("rows", F.lit(0))).cast("string"), F.lit(" cols)\n\n"), table(F.col("rows")),
                    F.when(F.col("n") > F.size("rows"), F.concat(
                        F.lit("\n\n_(+"), (F.col("n") - F.size("rows")).cast("string"),
                        F.lit(" more rows in the original file)_"))).otherwise(""))
    return (head.join(shape, ["file_id", "sheet"]).select("file_id", F.struct("sheet", part.alias("text")).alias("p"))
            .groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "\n\n").alias("text")))


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """Markdown pages below ``root`` (version-control folders left out): path, text, mtime, size."""
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root))
    base = "file:" + os.path.abspath(root) if "://" not in root else root
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "file:/"), "^" + base.replace(".", r"\.") + "/?", "")
    return (raw.filter(~F.col("path").contains("/.git/"))
            .select(rel.alias("path"), F.decode("content", "UTF-8").alias("text"),
                    F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size")))
