"""Archives: exact round trips, a plain reader, foreign archives, transactions in any order."""

import gzip
import hashlib
import random

import pytest

from plumbline.llm.common import Scratch
from plumbline.llm.warc import archived_pages, assemble, read_warc, write_warc

PAGES = "page_id long, url string, html string, key string, digest string, first long, n long, copy long"
LONG = "<p>" + "wörter und zeilen\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 40000


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "d", 1, 2, 3) for r in rows], PAGES).repartition(3)


@pytest.fixture(scope="module")
def rows():
    big = "x" * 100
    out = [(5, "http://a.example/x?y=1#z", "<html>é</html>"), (6, "https://b.example", None), (7, None, ""), (8, "http://c.example/a b\r\nInjected: 1", "WARC/1.0\r\n\r\n")]
    out += [(k, f"http://d.example/{k}", big) for k in (40, 12, 31)] + [(12, "http://d.example/12", big)] * 3 + [(11, None, big[:99])] * 2 + [(None, "http://e.example/", big), (None, None, None), (None, None, None)]
    out += [(50, "http://f.example/", LONG), (51, "http://f.example/", LONG), (52, "http://g.example/", "é" * 50), (52, "http://h.example/", "é" * 50)]
    random.Random(2).shuffle(out)
    return out


def plain(rows, least=100):
    """First of each payload by id, in one list."""
    out, seen = [], {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        digest = hashlib.sha256(payload).hexdigest()
        if len(payload) >= least and digest in seen:
            out.append((i, len(payload), digest, "revisit", seen[digest]))
        else:
            seen.setdefault(digest, i)
            out.append((i, len(payload), digest, "response", None))
    return sorted(out, key=repr)


def test_round_trip_against_plain_lists(spark, rows, distributed):
    for case in (rows, [], rows[:1], [(9, "u", "z" * 500)] * 50):
        found = archived_pages(frame(spark, case))
        assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(case)


def test_small_sides_are_broadcast_to_the_same_result(spark, rows):
    assert sorted((tuple(r) for r in archived_pages(frame(spark, rows)).collect()), key=repr) == plain(rows)


def independent(data):
    """A second reader, by index of lengths."""
    at, out = 0, []
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode().split("\r\n")
        headers = [tuple(x.split(": ", 1)) for x in lines[1:]]
        start = head_end + 4
        stop = start + int(dict(headers)["Content-Length"])
        assert lines[0] == "WARC/1.1" and data[stop : stop + 4] == b"\r\n\r\n"
        out.append((headers, data[start:stop]))
        at = stop + 4
    return out


def test_the_bytes_written(spark, rows, tmp_path):
    write_warc(frame(spark, rows), str(tmp_path / "a"))
    records = [r for f in sorted((tmp_path / "a").glob("part*.gz")) for r in independent(gzip.decompress(f.read_bytes()))]
    assert len(records) == 3 * len(rows) and len({dict(h)["WARC-Record-ID"] for h, _ in records}) == len(records)
    kinds = [dict(h)["WARC-Type"] for h, _ in records]
    assert {k: kinds.count(k) for k in set(kinds)} == {"request": len(rows), "metadata": len(rows), "response": len(rows) - 8, "revisit": 8}
    payloads = [b.split(b"\r\n\r\n", 1)[1] for h, b in records if dict(h)["WARC-Type"] == "response"]
    assert set(payloads) == {(r[2] or "").encode() for r in rows}
    assert all("Injected" not in n for h, _ in records for n, _ in h)
    assert any(dict(h).get("WARC-Target-URI") == "http://c.example/a%20b%0D%0AInjected:%201" for h, _ in records)
    for h, block in records:
        if dict(h)["WARC-Type"] == "response":
            assert dict(h)["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(block.split(b"\r\n\r\n", 1)[1]).hexdigest()
    requests = {b for h, b in records if dict(h)["WARC-Type"] == "request"}
    assert b"GET /x?y=1 HTTP/1.1\r\nHost: a.example\r\n\r\n" in requests and b"GET / HTTP/1.1\r\nHost: b.example\r\n\r\n" in requests
    read = read_warc(spark, str(tmp_path / "a")).collect()
    want = sorted((dict(h)["WARC-Record-ID"], dict(h)["WARC-Type"], b) for h, b in records)
    assert sorted((r["record_id"], r["record_type"], ((r["http_head"] or "").encode() + bytes(r["payload"]))) for r in read) == want


def record(kind, name, block=b"", *more):
    lines = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + name + b">", *more, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Ties of either side, in any order, over files, one compressed member per record, folded headers, orphans, other types."""
    tie = b"WARC-Concurrent-To: <%s>"
    one = [
        record(b"warcinfo", b"i", b"software: x\r\n", b"Content-Type: application/warc-fields"),
        record(b"metadata", b"m2", b"a: 1\r\nb: 2\r\na: 3\r\n", b"Content-Type: application/warc-fields", tie % b"q1"),  # of the request
        record(b"request", b"q1", b"GET / HTTP/1.1\r\n\r\n", b"Content-Type: application/http; msgtype=request"),
        record(b"metadata", b"m1", b"", tie % b"r1"),
    ]
    two = [
        record(b"response", b"r1", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n\xff\x00binary", b"Content-Type: application/http; msgtype=response", tie % b"q1", b"X-Folded: one", b"  two"),
        record(b"resource", b"s1", b"plain", b"Content-Type: text/plain"),
        record(b"request", b"q9", b"", tie % b"nowhere"),
        record(b"metadata", b"m3", b"", tie % b"r1", tie % b"s1"),
    ]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in one))
    (tmp_path / "two.warc").write_bytes(b"".join(two))
    records = read_warc(spark, str(tmp_path))
    by_id = {r["record_id"]: r for r in records.collect()}
    assert bytes(by_id["<r1>"]["payload"]) == b"\xff\x00binary" and by_id["<r1>"]["http_head"] == "HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    assert ("x-folded", "one two") in [tuple(h) for h in by_id["<r1>"]["headers"]]
    assert by_id["<m2>"]["fields"] == {"a": "1", "b": "2"} and by_id["<m1>"]["fields"] is None
    with Scratch(spark) as scratch:
        found = {r["capture_id"]: r for r in assemble(records, scratch).collect()}
    assert set(found) == {"<r1>", "<s1>", "<q9>"}
    assert found["<r1>"]["request"]["record_id"] == "<q1>" and [m["record_id"] for m in found["<r1>"]["metadata"]] == ["<m1>", "<m2>", "<m3>"]
    assert bytes(found["<r1>"]["response"]["payload"]) == b"\xff\x00binary"
    assert found["<s1>"]["request"] is None and [m["record_id"] for m in found["<s1>"]["metadata"]] == ["<m3>"]
    assert found["<q9>"]["response"] is None and found["<q9>"]["request"]["record_id"] == "<q9>" and found["<q9>"]["metadata"] == []


def test_damaged_archives_are_refused(spark, tmp_path):
    whole = record(b"response", b"r1", b"0123456789")
    for k, data in enumerate((whole[:-8], whole[:30], b"nonsense\r\n" + whole)):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "x.warc").write_bytes(data)
        with pytest.raises(Exception, match="ends within|should begin"):
            read_warc(spark, str(tmp_path / str(k))).collect()
