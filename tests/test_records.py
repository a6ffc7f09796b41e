"""JSON payloads read record by record: equal to a reader that holds them whole, with bounded memory."""
import io
import json
import tracemalloc
import zipfile
from contextlib import nullcontext

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sourceloom.sources import connectors
from sourceloom.sources.records import read_records, records_of, walk

ENVELOPES = ["files", "items"]
values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8),
                      lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=12)
payloads = st.lists(values, max_size=6) | st.dictionaries(st.sampled_from(["files", "items", "id", "é\"", ""]), values, max_size=4)


def plain(payload):
    if isinstance(payload, list):
        return payload
    for e in ENVELOPES:
        if isinstance(payload.get(e), list):
            return payload[e]
    return [payload] if payload else []


def read(data: bytes, block: int):
    return [json.loads(text) for _, _, text in records_of(lambda: nullcontext(io.BytesIO(data)), ENVELOPES, block)]


@settings(max_examples=300, deadline=None)
@given(payloads, st.integers(1, 40), st.booleans(), st.booleans())
def test_equal_to_a_whole_reader(payload, block, ascii_only, spaced):
    data = json.dumps(payload, ensure_ascii=ascii_only, indent=1 if spaced else None).encode("utf-8", "surrogatepass")
    assert read(data, block) == plain(payload)


@settings(max_examples=200, deadline=None)
@given(payloads, st.integers(0, 60), st.sampled_from([b"", b",", b"}", b"]", b"x", b"\xff"]), st.integers(1, 9))
def test_malformed_payloads_have_no_records(payload, cut, extra, block):
    data = json.dumps(payload).encode()
    data = data[:cut] + extra + data[cut + len(extra):] if cut < len(data) else data + extra
    try:
        whole = json.loads(data.decode("utf-8"))
    except ValueError:
        with pytest.raises(ValueError):
            next(records_of(lambda: nullcontext(io.BytesIO(data)), ENVELOPES, block))
            raise ValueError
        with pytest.raises(ValueError):
            list(walk(io.BytesIO(data), block))
    else:
        if isinstance(whole, (list, dict)):
            assert read(data, block) == plain(whole)


class Endless(io.RawIOBase):
    """A listing of many records that exists nowhere as a whole."""

    def __init__(self, count):
        self.count, self.sent, self.rest = count, 0, b'{"kind": "list", "files": ['

    def read(self, size=-1):
        while len(self.rest) < size and self.sent <= self.count:
            self.rest += (b"]}" if self.sent == self.count else
                          b'%s{"id": "%d", "name": "%s"}' % (b"," if self.sent else b"", self.sent, b"n" * 900))
            self.sent += 1
        out, self.rest = self.rest[:size], self.rest[size:]
        return out


def test_memory_is_a_block_and_a_record():
    count = 60_000                      # 55 MB
    tracemalloc.start()
    seen = sum(1 for _ in records_of(lambda: nullcontext(Endless(count)), ENVELOPES, 1 << 16))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == count and peak < 2 << 20


def test_listings_and_archives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.json").write_text(json.dumps({"items": [{"id": "later"}], "files": [{"id": str(i), "size": i} for i in range(500)]}))
    (tmp_path / "in" / "cut.json").write_text(json.dumps([{"id": "x"}] * 50)[:-1])
    (tmp_path / "in" / "empty.json").write_text("")
    (tmp_path / "in" / "none.json").write_text('{"files": []}')
    rows = read_records(spark, str(tmp_path / "in"), ENVELOPES, block=64, batch=1000).collect()
    assert sorted((r["place"], json.loads(r["record"])["id"]) for r in rows) == [(i, str(i)) for i in range(500)]
    assert {(r["field"], r["listed"]) for r in rows} == {("files", True)}
    with pytest.raises(Exception, match="cut.json"):
        read_records(spark, str(tmp_path / "in"), ENVELOPES, strict=True).count()
    listed = connectors.drive_listing(spark, str(tmp_path / "in")).select("file_id", "size").collect()
    assert {(r["file_id"], r["size"]) for r in listed} == {(str(i), str(i)) for i in range(500)}
    with zipfile.ZipFile(tmp_path / "export.zip", "w") as z:
        z.writestr("users.json", json.dumps([{"id": "U1", "name": "ana", "profile": None}, {"id": "U2", "profile": {"display_name": "Bo"}}]))
        z.writestr("chan/2026-01-02.json", json.dumps([{"ts": "1.5", "user": "U1", "text": "hi"}, "no message", {"ts": "2", "files": [{"id": "f"}]}]))
        z.writestr("chan/2026-01-03.json", "[{]")
        z.writestr("chan/2026-02-03.json", json.dumps({"ts": "9", "text": "one object"}))
        z.writestr("deep/er/2026-01-02.json", json.dumps([{"ts": "3", "text": "elsewhere"}]))
    messages, users = connectors.chat_export(spark, str(tmp_path / "export.zip"))
    assert sorted((m["channel"], m["month"], m["ts"], m["text"], m["has_files"]) for m in messages.collect()) == [
        ("chan", "2026-01", "1.5", "hi", False), ("chan", "2026-01", "2", "", True)]
    assert sorted((u["id"], u["display"]) for u in users.collect()) == [("U1", "ana"), ("U2", "Bo")]
