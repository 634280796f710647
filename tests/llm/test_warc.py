"""WARC derivatives: links between records, digests, text, and a round trip through files."""

import base64
import gzip
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from transvoc.llm import queries, warc

SF = "/root/testdata/sf0.001"


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def response(head, body, **more):
    return {"record_id": "<urn:uuid:1>", "target_uri": "http://e.org/a/", "date": "2024-05-05T00:00:00Z",
            "headers": "WARC-Type: response\r\nWARC-Block-Digest: sha1:X\r\nWARC-IP-Address: 1.2.3.4",
            "block": b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body} | more


def fields(record):
    return dict(warc.named_fields(record["block"]))


def test_pair_of_records():
    page = "<title>T &amp; t</title><nav><a href='b?x=1&amp;y'>menu</a></nav><p>one<br>two</p><script>no</script>"
    meta, text = warc.derivatives(response(b"Content-Type: text/html; charset=utf-8", page.encode()))
    assert (meta["warc_type"], text["warc_type"]) == ("metadata", "conversion")
    assert text["block"] == "menu\none\ntwo" and text["content_type"].startswith("text/plain")
    for r in (meta, text):
        head = dict(warc.named_fields(r["header"].partition("\r\n")[2]))
        data = r["block"].encode()
        assert head["WARC-Refers-To"] == "<urn:uuid:1>" and head["WARC-Refers-To-Date"] == "2024-05-05T00:00:00Z"
        assert head["WARC-Refers-To-Target-URI"] == "http://e.org/a/" and head["Content-Length"] == str(len(data))
        assert head["WARC-Block-Digest"] == r["block_digest"] == sha1(data)
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", head["WARC-Record-ID"])
    f = fields(meta)
    assert f["conversion"] == text["record_id"] and f["title"] == "T & t"
    assert f["source-warc-block-digest"] == "sha1:X" and f["source-warc-ip-address"] == "1.2.3.4"
    assert f["outlink"] == "http://e.org/a/b?x=1&y a/@href" and f["http-status"] == "HTTP/1.1 200 OK"
    assert f["source-payload-digest-computed"] == sha1(page.encode())


@pytest.mark.parametrize("head,body,want", [
    (b"Content-Type: text/html\r\nContent-Encoding: gzip", gzip.compress(b"<p>zipped"), "zipped"),
    (b"Content-Type: text/html\r\nContent-Encoding: deflate", zlib.compress(b"<p>zipped"), "zipped"),
    (b"Content-Type: text/html\r\nTransfer-Encoding: chunked", b"5\r\n<p>ab\r\n3;x\r\ncde\r\n0\r\n\r\n", "abcde"),
    (b"Content-Type: text/html; charset=latin-1", "<p>é".encode("latin-1"), "é"),
    (b"Content-Type: text/html; charset=nope", "<p>é".encode(), "é"),
    (b"Content-Type: text/plain", b"a <b>\n c", "a <b>\n c"),
    (b"X: y", b"<p>untyped", "untyped"), (b"Content-Type: text/html", b"", "")])
def test_payloads(head, body, want):
    meta, text = warc.derivatives(response(head, body))
    assert text["block"] == want


@pytest.mark.parametrize("head,body", [
    (b"Content-Type: image/png", b"\x89PNG"), (b"Content-Encoding: br", b"x"),
    (b"Content-Encoding: gzip", b"not gzip"), (b"Transfer-Encoding: chunked", b"zz\r\n")])
def test_no_conversion(head, body):
    (meta,) = warc.derivatives(response(head, body))
    assert fields(meta)["conversion"].startswith("none")


def test_query_and_files(spark, tmp_dir):
    got = queries.op6_warc_derivatives(spark, SF)
    rows = got.collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == 2 * len(pages)
    sources = {r["page_id"]: r for r in warc.as_responses(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in rows:
        s = sources[r["page_id"]]
        assert r["refers_to"] == s["record_id"] and r["target_uri"] == pages[r["page_id"]]["url"]
        assert r["block_digest"] == sha1(r["block"].encode())
        if r["warc_type"] == "metadata":
            assert hashlib.sha256(bytes(s["block"])).hexdigest() in r["block"] and sha1(bytes(s["block"])) in r["block"]
    path = f"{tmp_dir}/warc"
    warc.write_warc(got, path)
    back = warc.read_warc(spark, f"{path}/part-*").collect()
    assert sorted((r["record_id"], bytes(r["block"]).decode()) for r in back) == \
        sorted((r["record_id"], r["block"]) for r in rows)


def test_derive_from_files(spark, tmp_dir):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hello"
    record = (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:7>\r\nContent-Length: {len(block)}"
              "\r\n\r\n").encode() + block + b"\r\n\r\n"
    import os
    os.makedirs(f"{tmp_dir}/in")
    for name, data in (("a.warc", record * 2), ("b.warc.gz", gzip.compress(record))):
        with open(f"{tmp_dir}/in/{name}", "wb") as f:
            f.write(data)
    rows = warc.derive(warc.read_warc(spark, f"{tmp_dir}/in/*")).collect()
    assert sorted(r["warc_type"] for r in rows) == ["conversion"] * 3 + ["metadata"] * 3
    assert {r["refers_to"] for r in rows} == {"<urn:uuid:7>"}


def test_edges(spark):
    schema = "page_id long, url string, html string, block string, header string"
    pages = spark.createDataFrame([(1, None, None, "b", "h"), (1, None, None, "b", "h"), (None, "http://x/", "", "", ""),
                                   (2, "http://[bad", "<a href='q'>t</a>" * 5000, None, None)], schema)
    rows = warc.derive(warc.as_responses(pages), keep=("page_id",)).collect()
    assert len(rows) == 8 and {r["block"] for r in rows if r["warc_type"] == "conversion"} == {"", "t" * 5000}
    assert "WARC-Target-URI" not in next(r["header"] for r in rows if r["page_id"] == 1)
    assert warc.derive(warc.as_responses(pages.limit(0))).collect() == []
    others = warc.as_responses(pages).withColumn("warc_type", warc.F.lit("request"))
    assert warc.derive(others).collect() == []


def test_ids_follow_the_content(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>one</p>"), (1, "http://a/", "<p>two</p>"), (None, None, "<p>three</p>"),
                                   (None, None, "<p>four</p>")], "page_id long, url string, html string")
    responses = warc.as_responses(pages)
    assert responses.select("record_id").distinct().count() == 4
    ids = [r.record_id for r in warc.derive(responses).collect()]
    assert len(ids) == len(set(ids)) == 8
    bare = warc.derive(responses.withColumn("record_id", F.lit(None).cast("string"))).collect()
    assert len({r.record_id for r in bare}) == 8 and all(r.refers_to is None for r in bare)


@pytest.mark.parametrize("meta", ['<meta charset="windows-1252">', "<META http-equiv=Content-Type content='text/html; charset=ISO-8859-1'>"])
def test_the_page_names_its_character_set(meta):
    body = f"<html><head>{meta}<title>x</title></head><p>Größe é".encode("latin-1")
    assert "Größe é" in warc.payload_text("text/html", body)
    assert "Größe" not in warc.payload_text("text/html; charset=utf-8", body)   # the header comes first
    assert "Größe" not in warc.payload_text("text/html", b" " * 2000 + body)


def test_files_are_read_in_batches(spark, tmp_dir, monkeypatch):
    import gzip
    records = [f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:{i}>\r\nContent-Length: {n}\r\n\r\n".encode()
               + b"x" * n + b"\r\n\r\n" for i, n in enumerate((0, 5, 70, 3, 90))]
    with open(f"{tmp_dir}/a.warc.gz", "wb") as f:
        f.write(b"".join(map(gzip.compress, records)))
    with open(f"{tmp_dir}/b.warc", "wb") as f:
        f.write(b"".join(records))
    monkeypatch.setattr(warc, "READ_BYTES", 50)
    got = sorted((r.record_id, len(r.block)) for r in warc.read_warc(spark, f"{tmp_dir}/*").collect())
    assert got == sorted([(f"<urn:x:{i}>", n) for i, n in enumerate((0, 5, 70, 3, 90))] * 2)
