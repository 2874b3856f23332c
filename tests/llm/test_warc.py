import gzip
import hashlib

import pytest

from gritsieve.llm.warc import captures, pages_through_warc, read_records, write_warc

LONG = "é<p>\r\n\r\nWARC/1.1\r\n" * 100


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def expected(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "")]
        last = max((p for p in same if p is not None), default=None)
        again = len(data) >= 1000 and page != last
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(i, f"http://a/{i}", LONG if i % 3 else f"{LONG}{i}") for i in range(20)]
    rows += [(30, None, None), (31, "http://x", ""), (32, "u", "short"), (33, "u", "short"), (34, "a\r\nWARC-Type: x", "b\r\n\r\n"),
             (None, "n", LONG), (40, "u", "x" * 999), (41, "u", "x" * 999), (42, "u", "y" * 1000), (43, "u", "y" * 1000),
             (50, "v", "z" * 5_000_000), (44, "t", "same"), (44, "t", "same")]
    got = pages_through_warc(pages(spark, rows).selectExpr("*", "'q' as digest", "1 as target"))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_records_are_a_warc(spark, tmp_path):
    rows = [(1, "http://a", LONG), (2, "http://b", LONG), (3, None, None)]
    for compression in ("gzip", "none"):
        path = str(tmp_path / compression)
        write_warc(pages(spark, rows), path, compression=compression)
        found = read_records(spark, path).collect()
        assert sorted(r.record_type for r in found) == ["metadata"] * 3 + ["request"] * 3 + ["response"] * 2 + ["revisit"]
        assert {r.payload.decode() for r in found if r.record_type == "response"} == {LONG, ""}
        nested = captures(read_records(spark, path)).collect()
        assert len(nested) == 3 and all(r.request and r.response and r.metadata for r in nested)
        by_page = {r.metadata.fields["page"]: r for r in nested}
        assert by_page["1"].response.refers_to == by_page["2"].response.record_id
        assert by_page["1"].response.uri == "http://a" and by_page["3"].response.uri is None


def test_foreign_archive_in_members_and_truncation(spark, tmp_path):
    def record(kind, name, block, more=""):
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nwarc-record-id: <{name}>\r\n{more}Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    parts = [record("warcinfo", "i", b"x: y"), record("response", "r", b"HTTP/1.1 200 OK\r\n\r\nhi", "Content-Type: application/http\r\n"),
             record("request", "q", b"GET", "WARC-Concurrent-To: <r>\r\n"), record("metadata", "m", b"k: v", "WARC-Concurrent-To: <gone>\r\n")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    got = {r.capture_id: r for r in captures(read_records(spark, str(tmp_path))).collect()}
    assert set(got) == {"<r>", "<gone>"} and got["<r>"].response.payload == b"hi" and got["<r>"].metadata is None
    assert got["<gone>"].response is None
    (tmp_path / "b.warc").write_bytes(parts[1][:-6])
    with pytest.raises(Exception, match="ends early"):
        read_records(spark, str(tmp_path)).collect()


def test_empty(spark):
    assert pages_through_warc(pages(spark, [])).collect() == []
