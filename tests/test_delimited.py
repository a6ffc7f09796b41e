"""Delimited files read in ranges against a sequential reader."""
import csv
import io
import random

import pytest

from sourceloom.sources import delimited


def sequential(data, delimiter):
    rows = csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline=""), delimiter=delimiter)
    return [r for r in rows if any(c.strip() for c in r)]


def noise(r, n, delimiter):
    parts = [delimiter, delimiter, '"', '""', '"', "\n", "\r\n", "\r", "a", "bc", "é", " ", "日", "1,5", "\t"]
    return "".join(r.choice(parts) for _ in range(n)).encode() + (b"\xff" if r.random() < 0.2 else b"")


def written(r, n):
    out = io.StringIO()
    csv.writer(out, lineterminator=r.choice(["\n", "\r\n"])).writerows(
        [["".join(r.choice('ab", \n\ré') for _ in range(r.randint(0, 8))) for _ in range(r.randint(1, 4))] for _ in range(n)])
    return out.getvalue().encode()


def in_ranges(path, size, delimiter):
    """What the tasks do, one range after the other."""
    total, state, rows = delimited.size_of(path), delimited.ROW, []
    for begin in range(0, total, size):
        end = min(begin + size, total)
        ends, firsts = delimited.transitions(delimited._blocks(path, begin, end), delimiter)
        if firsts[state] >= 0:
            rows += [c for c in delimited.rows_from(path, begin + firsts[state], end, delimiter) if any(x.strip() for x in c)]
        state = ends[state]
    return rows


@pytest.mark.parametrize("delimiter", [",", "\t"])
def test_any_cut_gives_the_same_rows(tmp_path, delimiter, monkeypatch):
    r = random.Random(5)
    path = str(tmp_path / "f")
    for i in range(250):
        data = noise(r, r.randint(0, 60), delimiter) if i % 2 else written(r, r.randint(0, 12))
        with open(path, "wb") as handle:
            handle.write(data)
        want = sequential(data, delimiter)
        monkeypatch.setattr(delimited, "_BLOCK", r.choice([1, 3, 1 << 20]))
        for size in (1, 2, 5, 17, 1000):
            assert in_ranges(path, size, delimiter) == want, (data, size)


def test_large_file_by_many_tasks(spark, tmp_path):
    r = random.Random(6)
    files, want = [], {}
    for name, n in (("big.csv", 3_000), ("small.csv", 3), ("empty.csv", 0)):
        data = written(r, n)
        (tmp_path / name).write_bytes(data)
        files.append((name, str(tmp_path / name) if n != 3 else f"file://{tmp_path / name}", ","))
        want.update({(name, i): row for i, row in enumerate(sequential(data, ","), 1)})
    df = spark.createDataFrame(files, "file_id string, full_path string, delimiter string")
    got = {(x["file_id"], x["row"]): x["values"] for x in delimited.delimited_rows(df, size=700).collect()}
    assert got == want and len(want) > 1_500
