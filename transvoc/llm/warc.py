"""WARC derivatives: metadata and plain-text conversion records from responses.

For every ``response`` record two records are made that refer to it: a
``metadata`` record with what its HTTP headers, digests and links tell, and, where
the payload is text, a ``conversion`` record with the plain text.  Both name the
source in ``WARC-Refers-To`` (and its URI and date), carry digests of their own,
and the metadata names the conversion and every header and digest of the source,
so each step can be traced and checked.  Record ids are UUIDs of version 5 of the
source's id (without one: its URI, date and digest) and the record type: a second run
makes the same records.

A record is one row, and derivatives are made where the row is read: no shuffle,
and memory of one record.  :func:`write_warc` writes rows as WARC files with
Spark's text writer (a record ends with two line ends, which is the line
separator given to it); :func:`read_warc` reads such files record by record, one file a task.

Defined results: a null or empty payload gives an empty conversion; null headers
are left out.  A payload that is compressed or chunked by its HTTP headers is
undone first; one that cannot be undone, or is not text, gives only metadata,
which says so.  The character set is that of the HTTP header, else of the page's
``<meta>``; unknown ones are read as UTF-8 with replacement.  Very long payloads are
converted whole.  Records of other types make nothing.  Repeated rows make repeated records; rows of
equal id and URL with other content have records of their own.  An empty table makes no records.
Extra columns are ignored but for those named in ``keep``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transvoc.llm.html_text import lines_of

VERSION = "WARC/1.1"
#: Bytes of records that a reading task hands over at a time.
READ_BYTES = 32_000_000
END = "\r\n"
RECORD = ("record_id string, warc_type string, refers_to string, target_uri string, date string, "
          "content_type string, block_digest string, payload_digest string, header string, block string")
#: The element attributes that hold links.
LINK = re.compile(r"""<(a|area|img|link|script|iframe)\b[^>]*?\s(href|src)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)


def digest(data: bytes) -> str:
    """SHA-1 in base 32, with its label, as WARC files have it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{kind}')}>"


def named_fields(block: str) -> list[tuple[str, str]]:
    """``Name: value`` lines; a line that starts with white space continues the one before."""
    fields: list[tuple[str, str]] = []
    for line in re.split(r"\r?\n", block):
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            fields.append((name.strip(), value.strip()))
    return fields


def header_text(fields: list[tuple[str, str | None]]) -> str:
    return END.join([VERSION, *(f"{n}: {v}" for n, v in fields if v is not None)])


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response (no status: all is body)."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    m = re.search(rb"\r?\n\r?\n", block)
    head, body = (block[:m.start()], block[m.end():]) if m else (block, b"")
    status, _, rest = head.decode("latin-1").partition("\n")
    return status.strip(), named_fields(rest), body


def decoded_body(headers: dict[str, str], body: bytes) -> bytes | None:
    """The payload without transfer and content encodings; None where they can't be undone."""
    try:
        if "chunked" in headers.get("transfer-encoding", "").lower():
            out, at = [], 0
            while at < len(body):
                line_end = body.index(b"\r\n", at)
                size = int(body[at:line_end].split(b";")[0], 16)
                if not size:
                    break
                out.append(body[line_end + 2:line_end + 2 + size])
                at = line_end + 4 + size
            body = b"".join(out)
        for coding in reversed([c.strip() for c in headers.get("content-encoding", "").lower().split(",")]):
            if coding in ("gzip", "x-gzip"):
                body = gzip.decompress(body)
            elif coding == "deflate":
                body = zlib.decompress(body)
            elif coding not in ("", "identity"):
                return None
    except (ValueError, OSError, EOFError, zlib.error):
        return None
    return body


#: Where a page names its character set itself, and in how many bytes.
META_CHARSET = re.compile(rb"""<meta\b[^>]*?\bcharset\s*=\s*["']?\s*([\w.:-]+)""", re.I)
META_BYTES = 1024


def payload_text(content_type: str, body: bytes) -> str | None:
    """The payload as a string, or None if its type isn't text."""
    kind = content_type.split(";")[0].strip().lower()
    if kind and not kind.startswith("text/") and kind not in ("application/xhtml+xml", "application/xml", "application/json"):
        return None
    found = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type, re.I)
    named = found[1] if found else "utf-8"
    if not found and ("html" in kind or not kind) and (meta := META_CHARSET.search(body[:META_BYTES])):
        named = meta[1].decode("ascii", "replace")
    try:
        return body.decode(named, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def plain_text(content_type: str, text: str) -> str:
    """All text of a page, one line a block; other text as it is."""
    if "html" not in content_type.lower() and content_type:
        return text
    body = re.sub(r"(?i)</?(?:nav|header|footer|aside|form|menu|dialog|button|select|textarea)\b[^>]*>",
                  "<div>", _without_names(text))
    return "\n".join(x.text for x in lines_of(body) if x.text)


def _without_names(page: str) -> str:
    """Attributes gone, so that nothing is stripped for its class or role."""
    bare = lambda m: "" if m[1].lower() == "svg" and m[0].endswith("/>") else f"<{m[1]}>"
    return re.sub(r"<([a-zA-Z][^\s/>]*)(?:\"[^\"]*\"|'[^']*'|[^'\">])*>", bare, page)


def links(uri: str | None, page: str) -> list[str]:
    """Absolute link targets in page order, each with the element it came from."""
    out = []
    for tag, attribute, value in LINK.findall(page):
        target = html.unescape(value.strip("\"'")).strip()
        try:
            out.append(f"{urljoin(uri or '', target)} {tag.lower()}/@{attribute.lower()}")
        except ValueError:
            out.append(f"{target} {tag.lower()}/@{attribute.lower()}")
    return [" ".join(x.split()) for x in out]


def derivatives(record: dict) -> list[dict]:
    """The metadata and, for text, the conversion record of one response."""
    source, uri, date = record["record_id"], record["target_uri"], record["date"]
    block = record["block"] or b""
    status, headers, raw = split_http(block)
    by_name = {n.lower(): v for n, v in headers}
    content_type = by_name.get("content-type", "")
    body = decoded_body(by_name, raw)
    text = None if body is None else payload_text(content_type, body)
    base = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date),
            ("WARC-Target-URI", uri), ("WARC-Date", date)]

    def make(kind: str, content: str, mime: str) -> dict:
        data = content.encode("utf-8", "replace")
        own, summed = derived_id(source or f"{uri} {date} {digest(block)}", kind), digest(data)
        fields = [("WARC-Type", kind), ("WARC-Record-ID", own), *base, ("WARC-Block-Digest", summed),
                  ("WARC-Payload-Digest", summed), ("Content-Type", mime), ("Content-Length", str(len(data)))]
        return {"record_id": own, "warc_type": kind, "refers_to": source, "target_uri": uri, "date": date,
                "content_type": mime, "block_digest": summed, "payload_digest": summed,
                "header": header_text(fields), "block": content}

    given = record.get("headers") or ""
    facts: list[tuple[str, str]] = [("source-" + n.lower(), v) for n, v in named_fields(given)]
    facts += [("source-block-digest-computed", digest(block)), ("source-payload-digest-computed", digest(raw))]
    if status:
        facts.append(("http-status", status))
    facts += [("http-" + n.lower(), v) for n, v in headers]
    made = []
    if text is None:
        facts.append(("conversion", "none: " + ("encoding" if body is None else "not text")))
    else:
        made.append(make("conversion", plain_text(content_type, text), "text/plain; charset=utf-8"))
        facts.append(("conversion", made[0]["record_id"]))
        if "html" in content_type.lower() or not content_type:
            title = TITLE.search(text)
            if title:
                facts.append(("title", " ".join(html.unescape(title[1]).split())))
            facts += [("outlink", x) for x in links(uri, text)]
    lines = END.join(f"{n}: {' '.join(v.split())}" for n, v in facts)
    return [make("metadata", lines, "application/warc-fields"), *made]


def derive(records: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Derivative records (:data:`RECORD`) of all ``response`` rows of ``records``:
    ``record_id, warc_type, target_uri, date, headers, block`` (``headers`` are the
    WARC header lines, ``block`` the bytes of the HTTP response)."""
    frame = records.where("warc_type = 'response'").select(
        *keep, "record_id", "target_uri", "date", "headers", F.col("block").cast("binary").alias("block"))
    schema = frame.select(*keep).schema
    names = [p.split()[0] for p in RECORD.split(", ")]
    for n in names:
        schema = schema.add(n, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names[len(keep):], batch.columns[len(keep):], strict=True))
            taken, made = [], []
            for i in range(batch.num_rows):
                for row in derivatives({n: c[i].as_py() for n, c in columns.items()}):
                    taken.append(i)
                    made.append(row)
            at = pa.array(taken, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(at) for c in batch.columns[:len(keep)]),
                 *(pa.array([r[n] for r in made], pa.string()) for n in names)], names=[*keep, *names])

    return frame.mapInArrow(run, schema)


def as_responses(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", content: str = "html",
                 date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages that came without WARC headers: ``page_id``
    and the columns that :func:`derive` takes."""
    body = F.encode(F.coalesce(content, F.lit("")), "utf-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(F.encode(head, "utf-8"), body)
    h = F.md5(F.concat_ws("|", F.col(page_id).cast("string"), F.col(url), F.sha2(block, 256)))
    record_id = F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"),
                         F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"),
                         F.substring(h, 21, 12), F.lit(">"))
    headers = F.concat_ws(END, F.lit("WARC-Type: response"), F.concat(F.lit("WARC-Record-ID: "), record_id),
                          F.concat(F.lit("WARC-Target-URI: "), F.col(url)), F.lit(f"WARC-Date: {date}"),
                          F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2(block, 256)))
    return pages.select(F.col(page_id).alias("page_id"), record_id.alias("record_id"),
                        F.lit("response").alias("warc_type"), F.col(url).alias("target_uri"),
                        F.lit(date).alias("date"), headers.alias("headers"), block.alias("block"))


def write_warc(records: DataFrame, path: str) -> None:
    """Records (``header``, ``block``) as WARC files below ``path``, one a partition."""
    (records.select(F.concat("header", F.lit(END + END), "block").alias("value"))
     .write.option("lineSep", END + END).text(path))


def parse_records(stream: BinaryIO) -> Iterator[dict]:
    """The records of one uncompressed WARC file, one at a time."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line)
        fields = named_fields(b"".join(head).decode("utf-8", "replace"))
        by_name = {n.lower(): v for n, v in fields}
        yield {"record_id": by_name.get("warc-record-id"), "warc_type": by_name.get("warc-type"),
               "target_uri": by_name.get("warc-target-uri"), "date": by_name.get("warc-date"),
               "headers": END.join(f"{n}: {v}" for n, v in fields),
               "block": stream.read(int(by_name.get("content-length", "0")))}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files (plain or gzip, of any number of members) that match ``path``.

    A task holds a file as it is stored and ``READ_BYTES`` of its records."""
    names = ["record_id", "warc_type", "target_uri", "date", "headers"]

    def packed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*(pa.array([r[n] for r in rows], pa.string()) for n in names),
             pa.array([r["block"] for r in rows], pa.binary())], names=[*names, "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                stored = io.BytesIO(content.as_buffer())
                zipped = stored.getbuffer()[:2] == b"\x1f\x8b"
                rows, held = [], 0
                for record in parse_records(io.BufferedReader(gzip.GzipFile(fileobj=stored)) if zipped else stored):
                    rows.append(record)
                    held += len(record["block"])
                    if held >= READ_BYTES:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    return (spark.read.format("binaryFile").load(path).select("content")
            .mapInArrow(run, ", ".join(f"{n} string" for n in names) + ", block binary"))
