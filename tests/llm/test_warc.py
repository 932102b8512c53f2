"""Archives, index and revisits."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyarrow import fs as pafs

from cladeloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, payload int, refers_to string, archive string"
LONG = "<p>" + "x" * 5000 + "</p>"
ROWS = [
    (1, "http://www.a.example/x?b=2&a=1", LONG), (2, "https://b.example:8080/é y", LONG), (3, None, LONG), (4, "http://a.example/", ""),
    (5, "http://a.example/", None), (6, "not a url [", "short"), (7, "http://c.example", "short"), (8, "http://c.example/\r\nX: y", "WARC/1.1\r\n\r\n" * 20),
    (9, "http://c.example/z", LONG), (9, "http://c.example/z", LONG), (None, "http://d.example", LONG), (10, "http://e.example", "ü" * 60), (11, "http://e.example", "ü" * 60),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "d", 1, "r", "a") for r in ROWS], SCHEMA).repartition(3)


def brute():
    first = {}
    for i, _, h in ROWS:
        raw = (h or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(i, first.get(raw, i))
    out = []
    for i, _, h in ROWS:
        raw = (h or "").encode()
        to = first.get(raw)
        to = None if to is None or i == to else to
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def test_read_back(pages):
    _, files = warc.archive(pages)
    rows = warc.find(files, warc.url_keys(pages)).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, warc.read_captures(warc.directory(files)).collect()), key=repr)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=repr)
    assert got == brute()
    assert all(r["intact"] == (None if r["record_type"] == "revisit" else True) for r in rows)


def test_lookup_and_blocks(pages, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300)
    scratch = warc.Scratch(pages.sparkSession, "t")
    manifest = scratch.table(warc.write_archives(pages, scratch, f"{scratch.path}/a"), "m")
    files = scratch.table(warc.build_index(manifest, f"{scratch.path}/i", block_lines=2), "d")
    assert warc.directory(files).count() >= len(ROWS) // 2
    some = pages.sparkSession.createDataFrame([("example,a)/",), ("nowhere",), ("example,c)/z",)], "url_key string")
    assert sorted(r["page_id"] for r in warc.find(files, some).collect()) == [4, 5, 9, 9]
    assert sorted(r["page_id"] for r in warc.lookup(files, "http://a.example/")) == [4, 5]
    (one,) = warc.lookup(files, "http://www.a.example/x?a=1&b=2")
    assert one["page_id"] == 1 and one["payload"] == LONG.encode() and one["url"] == ROWS[0][1]
    assert warc.lookup(files, "http://nowhere.example/") == []
    # archives stand without their index
    total = 0
    for (uri,) in manifest.select("archive").distinct().collect():
        store, at = pafs.FileSystem.from_uri(uri)
        with store.open_input_stream(at, compression=None) as f:
            for offset, length, raw in warc.members(f.read()):
                warc.parse(raw)
                total += 1
    assert total == len(ROWS)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    _, files = warc.archive(none)
    assert warc.find(files, warc.url_keys(none)).count() == 0 and warc.read_captures(warc.directory(files)).count() == 0


def test_one_url_over_many_blocks_and_a_very_long_page(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(i, "http://hot.example/", f"<p>{i % 3}</p>" * 20, "d", 1, "r", "a") for i in range(200)] + [(500, "http://long.example", "y" * 3_000_000, "d", 1, "r", "a")]
    pages = spark.createDataFrame(rows, SCHEMA)
    scratch = warc.Scratch(spark, "t")
    manifest = scratch.table(warc.write_archives(pages, scratch, f"{scratch.path}/a"), "m")
    files = scratch.table(warc.build_index(manifest, f"{scratch.path}/i", block_lines=7), "d")
    got = {r["page_id"]: r for r in warc.find(files, warc.url_keys(pages)).collect()}
    assert len(got) == 201 and got[500]["payload_bytes"] == 3_000_000
    assert all(got[i]["refers_to"] == (None if i < 3 else i % 3) for i in range(200))
    assert len(warc.lookup(files, "http://hot.example/")) == 200


def test_keys_and_search():
    assert warc.url_key("https://www2.B.a.Example:443/p?y=2&x=1") == "example,a,b)/p?x=1&y=2"
    assert warc.url_key("http://a.b:81") == "b,a:81)/" and warc.url_key(None) == "-"
    lines = [f"{k}\t1" for k in ("a", "b", "b", "c")]
    assert warc.search(lines, "b") == ["b\t1", "b\t1"] and warc.search(lines, "bb") == []


def test_damage_is_noticed():
    raw = warc.record(1, "http://a", b"hello", "d", None, "2025-01-01T00:00:00Z")
    assert warc.parse(raw)["payload"] == b"hello"
    for bad in (raw[:-1], raw.replace(b"hello", b"hell"), b"x" + raw):
        with pytest.raises(ValueError):
            warc.parse(bad)
    assert list(warc.members(warc._gzip(b"a") + warc._gzip(b"b")))[1][2] == b"b" and zlib.crc32(b"") == 0


def test_bytes_that_differ_from_their_header_are_told(tmp_path):
    raw = warc._gzip(warc.record(1, "http://a", b"hello", hashlib.sha256(b"jello").hexdigest(), None, "2025-01-01T00:00:00Z"))
    (tmp_path / "a.warc.gz").write_bytes(raw)
    (row,) = warc._captures([f"a)/\t-\t-\tfile://{tmp_path}/a.warc.gz\t0\t{len(raw)}"])
    assert row[2:5] == (5, hashlib.sha256(b"hello").hexdigest(), "response") and row[6] is False


def test_a_damaged_archive_fails_the_check(spark):
    good = [(1, "u", 5, "d", "response", None, True), (2, "u", 5, "d", "revisit", 1, None), (None, "u", 5, "d", "response", None, True)]
    for bad in ([], [(3, "u", 5, "e", "response", None, False)], [(4, "u", 6, "d", "revisit", 1, None)], [(4, "u", 5, "d", "revisit", 9, None)]):
        scratch = warc.Scratch(spark, "t")
        captures = spark.createDataFrame(good + bad, warc.CAPTURE)
        if bad:
            with pytest.raises(ValueError, match="damaged"):
                warc.checked(captures, scratch)
        else:
            assert warc.checked(captures, scratch).count() == 3
