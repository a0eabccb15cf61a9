from __future__ import annotations

import glob
import gzip
import hashlib

import pytest

from galley.llm import warc

SCHEMA = "page_id bigint, url string, html string, digest string, original int"
BIG = "é<p>\r\n\r\nWARC/1.1\r\n</p>" * 80


def table(spark):
    rows = [
        (1, "http://a/", BIG), (5, None, BIG), (3, "http://c/\r\nX: y", BIG), (7, "http://d/", "x" * 999),
        (8, "http://e/", "x" * 999), (9, "", None), (10, "http://f/", ""), (11, "u", "y" * 1000), (None, "n", BIG),
        (12, "long", "z\n" * 400_000), (12, "long", "z\n" * 400_000), (None, "m", "only nulls " * 100), (None, None, "only nulls " * 100),
    ]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA), rows


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "out")
    pages, rows = table(spark)
    warc.deduplicated_archives(pages.repartition(3), path)
    return path, rows


def expected(rows):
    groups = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        groups.setdefault(data, []).append(page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        best = max((i for i in groups[data] if i is not None), default=None)
        revisit = len(data) >= 1000 and len(groups[data]) > 1 and best is not None and page_id != best
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


def test_round_trip_and_types(spark, written):
    path, rows = written
    got = warc.read_archives(spark, path)
    seen = [(r.record, r.bytes, r.digest, r.record_type, r.refers_to) for r in got.collect()]
    assert sorted(seen, key=str) == expected(rows)
    full = {r.record: bytes(r.payload) for r in warc.restore_payloads(got).collect() if r.record is not None}
    assert full == {i: (h or "").encode() for i, _, h in rows if i is not None}


def test_payload_is_stored_once(written):
    path, _ = written
    raw = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/part-*"))
    assert raw.count(BIG.encode()) == 1
    assert b"%0D%0AX: y" in raw and b"\r\nX: y" not in raw


def test_wrong_digest_is_noticed():
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx"
    head = {"warc-type": "response", "warc-record-id": "<urn:x-page:1>", "warc-payload-digest": "sha1:00"}
    with pytest.raises(ValueError):
        warc._read_record(head, block, False)


def test_empty_table(spark, tmp_path):
    pages, _ = table(spark)
    warc.deduplicated_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0
