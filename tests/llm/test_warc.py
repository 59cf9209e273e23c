import base64
import glob
import gzip
import hashlib

import pytest

from pairwell.llm.warc import archive_records, assemble, page_ids, read_records, write_captures
from pairwell.session import shared_dir

PAGES = [
    (1, "http://a/x y", "<p>A\r\n\r\nWARC/1.1\r\n"),
    (3, "u", "<p>A\r\n\r\nWARC/1.1\r\n"),
    (3, "u", "<p>A\r\n\r\nWARC/1.1\r\n"),
    (1, "http://a/x y", "<p>A\r\n\r\nWARC/1.1\r\n"),
    (2, None, None),
    (0, "z", ""),
    (None, "n", ""),
    (5, "é\r\nWARC-Type: x", "é" * 5000),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def folder(spark):
    path = shared_dir(spark, "warc-test")
    write_captures(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    return path


def test_round_trip(spark, folder):
    rows = page_ids(assemble(read_records(spark, folder))).collect()
    assert len(rows) == len(PAGES)
    found = sorted((r.page_id is None, r.page_id or 0, r.response.record_type) for r in rows)
    kinds = {0: "response", 1: "response", 2: "revisit", 3: "revisit", 5: "response"}
    assert found == sorted((i is None, i or 0, kinds.get(i, "response")) for i, _, _ in PAGES)
    html = {i: h or "" for i, _, h in PAGES}
    for r in rows:
        assert r.request.record_type == "request" and r.metadata.record_type == "metadata"
        if r.response.record_type == "response":
            assert bytes(r.response.payload).decode() == html[r.page_id] and r.original is None
            assert r.response.payload_digest == digest(html[r.page_id])
        else:
            assert r.original.payload_digest == digest(html[r.page_id]) and bytes(r.response.payload) == b""
        assert r.response.stated_digest == "sha1:" + digest(html[r.page_id])


def test_small_payloads_are_responses(spark):
    path = shared_dir(spark, "warc-test")
    write_captures(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path, least_bytes=10)
    kinds = [r.record_type for r in read_records(spark, path, payload=False).collect()]
    assert kinds.count("revisit") == 2 and kinds.count("response") == 6


def test_bad_archives_give_errors(spark, folder):
    data = b"".join(gzip.open(f).read() for f in glob.glob(folder + "/*.gz"))
    whole = list(archive_records(data))
    assert [e for _, _, e in whole] == [None] * 24
    assert [e is None for _, _, e in archive_records(gzip.compress(data[:-9]))] == [True] * 23 + [False]
    assert [e for _, _, e in archive_records(b"nothing")][0]
    assert list(archive_records(b"")) == []
    # One gzip member per record reads the same.
    members = b"".join(gzip.compress(part + b"\r\n\r\n") for part in [b"WARC/1.0\r\nContent-Length: 2\r\n\r\nab"] * 3)
    assert [block for _, block, _ in archive_records(members)] == [b"ab"] * 3


def test_empty_table(spark):
    path = shared_dir(spark, "warc-test")
    write_captures(spark.createDataFrame([], "page_id long, url string, html string, w_digest string"), path)
    assert assemble(read_records(spark, path)).count() == 0
