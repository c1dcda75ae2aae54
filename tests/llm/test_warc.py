"""WARC source: round trips, pushdown, foreign archives."""

import gzip
import hashlib
import os

import pytest
from answerbank.llm import warc

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, payload string, record_type int, kept int, n int"


def expected(rows, least=1000):
    """(page_id, payload_bytes, digest, type, refers_to) by brute force."""
    out, bodies = [], [(r[0], (r[2] or "").encode()) for r in rows]
    for key, body in bodies:
        ids = [k for k, other in bodies if other == body and k is not None]
        kept = max(ids, default=None)
        revisit = len(body) >= least and kept is not None and kept != key
        out.append((key, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", kept if revisit else None))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_pages_come_back(spark, tmp_path):
    same, other = "é<p>same</p>" * 200, "x" * 999
    rows = [(k, f"http://h/{k}", same) for k in range(40)] + [(50 + k, "u", other) for k in range(3)] + [(60, "a\r\nb: c", "y" * 1000), (61, None, "y" * 1000)]
    rows += [(None, "", same), (70, "é", None), (71, "", ""), (72, "u", "WARC/1.1\r\n\r\n" * 300), (73, "u", "\x1f\x8b\r\n\r\n\0" * 9), (74, "u", "z" * 3_000_000)]
    rows += [(80, "u", "twice" * 400), (80, "v", "twice" * 400), (None, "u", "nobody" * 400), (None, "u", "nobody" * 400)]
    pages = spark.createDataFrame([(*r, "p", 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert ordered(warc.archived_pages(spark, str(tmp_path)).select(*columns).collect()) == ordered(expected(rows))
    warc.archived(pages.limit(0), f"{tmp_path}/none")
    assert warc.read_pages(spark, f"{tmp_path}/none").count() == 0
    warc.archived(pages, f"file:{tmp_path}/urls")
    back = {(r["page_id"], r["url"]) for r in warc.read_pages(spark, f"file:{tmp_path}/urls").collect()}
    assert back == {(r[0], r[1] if r[0] != 60 else "a%0D%0Ab: c") for r in rows}


def test_query_on_the_small_table(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    got = warc.archived_pages(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert ordered(got.collect()) == ordered(expected(rows))


def test_unwanted_payloads_are_not_decoded(spark, tmp_path):
    """The response's payload is spoilt: reading it fails, reading what does not need it works."""
    warc.register(spark)
    record = {"record_type": "response", "record_id": "urn:a", "target_uri": "http://a/x", "payload": bytes(range(256)) * 4000}
    spoilt = bytearray(warc.member(warc.record_bytes(record), 6))
    spoilt[-2000:-8] = b"\xff" * 1992
    good = warc.member(warc.record_bytes({"record_type": "metadata", "record_id": "urn:b", "target_uri": "http://b/", "payload": b"fine"}), 6)
    (tmp_path / "a.warc.gz").write_bytes(bytes(spoilt) + good)
    for wanted in ("record_type = 'metadata'", "record_type in ('metadata', 'x')", "target_uri like 'http://b%'", "record_type <> 'response'", "record_id = 'urn:b'"):
        assert [bytes(r["payload"]) for r in warc.load_records(spark, str(tmp_path), wanted).collect()] == [b"fine"], wanted
    light = spark.read.format("warc").schema("record_id string, record_type string").load(str(tmp_path))
    assert {r["record_id"] for r in light.collect()} == {"urn:a", "urn:b"}
    with pytest.raises(Exception, match="broken record at offset 0"):
        spark.read.format("warc").load(str(tmp_path)).collect()


def test_a_relation_serves_several_queries(spark, tmp_path):
    path = f"{tmp_path}/set"
    warc.register(spark)
    rows = [(f"urn:{k}", kind, b"x") for k, kind in enumerate(("resource", "metadata", "metadata"))]
    spark.createDataFrame(rows, "record_id string, record_type string, payload binary").write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").load(path)
    some = warc.load_records(spark, path, "record_type = 'metadata'")
    assert [read.filter("record_type = 'resource'").count(), read.count()] == [1, 3]
    assert [some.filter("record_id = 'urn:1'").count(), some.count(), warc.load_records(spark, path).count()] == [1, 2, 3]


def test_foreign_archives(spark, tmp_path):
    """Plain files, members without lengths, folded headers, chunked and coded bodies, other record types."""
    warc.register(spark)

    def raw(kind, block, content="application/http; msgtype=response", more=""):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{kind}>\r\n{more}Content-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    body = b"<p>hello</p>" * 50
    chunks = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n"
    packed = gzip.compress(body)
    chunks += b"%x\r\n" % 10 + packed[:10] + b"\r\n" + b"%x;a=b\r\n" % len(packed[10:]) + packed[10:] + b"\r\n0\r\n\r\n"
    parts = [raw("warcinfo", b"software: x\r\n\r\n", "application/warc-fields"), raw("response", chunks, more="WARC-Target-URI:\r\n http://folded/\r\n")]
    parts.append(raw("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "application/http; msgtype=request"))
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "notes.txt").write_bytes(b"not an archive")
    rows = spark.read.format("warc").option("partition_bytes", "1").load(str(tmp_path)).collect()
    for name in ("a.warc", "b.warc.gz"):
        found = {r["record_type"]: r for r in rows if os.path.basename(r["path"]) == name}
        assert set(found) == {"warcinfo", "response", "request"}
        assert bytes(found["response"]["payload"]) == body and found["response"]["target_uri"] == "http://folded/"
        assert bytes(found["warcinfo"]["payload"]) == b"software: x\r\n\r\n" and bytes(found["request"]["payload"]) == b""
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(parts[0])[:-20])
    with pytest.raises(Exception, match="c.warc.gz: broken record at offset 0"):
        spark.read.format("warc").load(str(tmp_path)).collect()


def test_only_committed_files_count(spark, tmp_path):
    warc.register(spark)
    rows = spark.createDataFrame([("urn:1", "resource", b"one")], "record_id string, record_type string, payload binary")
    path = f"{tmp_path}/set"
    rows.write.format("warc").mode("append").save(path)
    rows.write.format("warc").mode("append").option("roll_bytes", "1").save(path)
    load = lambda: spark.read.format("warc").load(path)
    assert load().count() == 2
    with open(f"{path}/part-lost.warc.gz", "wb") as left_behind:
        left_behind.write(b"half a mem")
    assert load().count() == 2
    rows.write.format("warc").mode("overwrite").save(path)
    assert [bytes(r["payload"]) for r in load().collect()] == [b"one"]
    with pytest.raises(Exception, match="no such column"):
        spark.read.format("warc").schema("wrong string").load(path).collect()
