"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged archives.

The writer rolls archives at ``ROLL`` bytes and returns their paths as a table. Archives have names of their own for
each attempt of a task, and only those in the table of finished attempts are read, so a lost executor leaves no
record twice. The reader checks every member or record (gzip checksum, version line, lengths, payload digest). After
a failed check it searches for the next valid gzip member or version line and goes on there; the bytes between are
logged as a gap. So it does within the bytes of a member, and within those that a damaged member still gives.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfield.llm.skew import joined
from starfield.plans.materialize import shared_folder, written

ROLL = 1 << 25
LEAST = 100
_TORN_BYTES = 30
_GZIP = b"\x1f\x8b\x08"
_MAGIC = b"WARC/1."
_FEED = 1 << 16
_HEADERS_END = re.compile(rb"\r\n(?:\r\n|WARC/1\.)")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Before each so many records of an archive the query leaves a torn member, as a writer that was killed does.
TORN = 25
MANIFEST = "path string, records long, gaps long, bytes long"
RECORDS = "kind string, path string, begin long, end long, record_type string, record_id string, refers_to string, uri string, payload_bytes long, payload_digest string, reason string"
_SCHEMA = pa.schema([("kind", pa.string()), ("path", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("reason", pa.string()), ("payload", pa.binary())])


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, kind: str) -> bytes:
    """One WARC record. Control characters and blanks in the URL are percent-encoded."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    block = _HTTP % len(payload) + (payload if kind == "response" else b"")
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{'' if page is None else page}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n"
    head += f"WARC-Target-URI: {uri}\r\nWARC-Payload-Digest: sha256:{digest}\r\nX-Payload-Length: {len(payload)}\r\n"
    if kind == "revisit":
        head += f"WARC-Refers-To: <urn:page:{refers_to}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
    head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, wbits=31)
    return z.compress(data) + z.flush()


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages with payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads of ``least`` bytes or more, the one with the smallest page_id is the response and the others
    revisit it. Where several rows have that page_id, all of them are responses. A null page_id is the smallest
    only where all are null. A null html is an empty payload.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(F.encode(html, "UTF-8"), 256).alias("payload_digest"))
    key = pages.select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).alias("_n"), F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256).alias("payload_digest"))
    first = key.filter(F.col("_n") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_copies")).filter("_copies > 1")
    both = joined(own, written(first, "first-payloads"), "payload_digest", "_copies", ["page_id", "url"])
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return both.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str | None = None, roll: int = ROLL, torn: int = 0) -> DataFrame:
    """Writes a record for every row of ``with_revisits`` and returns the finished archives: path, records, gaps, bytes.

    With ``torn``, the begin of a member stands before every so many records of an archive, as after a crash."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out = None
        finished = lambda: pa.RecordBatch.from_pydict({"path": [path], "records": [records], "gaps": [gaps], "bytes": [size]})
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "payload_digest", "refers_to", "record_type")]
            for row in zip(*columns, strict=True):
                page, url, html, digest, refers_to, kind = (x.as_py() for x in row)
                if out is None:
                    store.create_dir(root, recursive=True)
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, records, gaps, size = store.open_output_stream(path, compression=None), 0, 0, 0
                data = member(record(page, url, html.encode(), digest, refers_to, kind))
                if torn and records % torn == torn // 2:
                    out.write(data[:_TORN_BYTES])
                    gaps, size = gaps + 1, size + _TORN_BYTES
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= roll:
                    out.close()
                    out = None
                    yield finished()
        if out is not None:
            out.close()
            yield finished()

    manifest = written(pages.mapInArrow(write, MANIFEST), "warc-manifest")
    scheme = folder[: folder.index("://") + 3] if "://" in folder else ""
    return manifest.withColumn("path", F.concat(F.lit(scheme), "path"))


def _checked(data: bytes | memoryview, start: int) -> tuple[dict, bytes, int] | str:
    """The record at ``start`` of plain bytes: headers, payload and its end; or what is wrong."""
    if bytes(data[start : start + 7]) != _MAGIC:
        return "no version line"
    # Headers may be of any length (a long URL), but do not go beyond another version line.
    if not (last := _HEADERS_END.search(data, start)) or last[0] != b"\r\n\r\n":
        return "headers without an end"
    cut = last.start() - start
    fields = {}
    for line in bytes(data[start : start + cut]).decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return "broken header"
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        return "no length"
    begin, end = start + cut + 4, start + cut + 4 + int(fields["content-length"])
    if bytes(data[end : end + 4]) != b"\r\n\r\n":
        return "wrong length"
    block = bytes(data[begin:end])
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        payload = block[block.find(b"\r\n\r\n") + 4 :]
    named, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if fields.get("warc-type") != "revisit" and named == "sha256" and hashlib.sha256(payload).hexdigest() != digest:
        return "wrong payload digest"
    return fields, payload, end + 4


def _member(data: memoryview, start: int) -> tuple[bytes, int, str]:
    """What the gzip member at ``start`` gives, the place up to which it was read, and what is wrong with it if anything."""
    z, out, at = zlib.decompressobj(31), [], start
    try:
        while not z.eof and at < len(data):
            out.append(z.decompress(data[at : at + _FEED]))
            at += min(_FEED, len(data) - at)
    except zlib.error as e:
        error = f"gzip: {e}"[:80]
    else:
        return b"".join(out), at - len(z.unused_data), "" if z.eof else "gzip: cut off"
    # The call that failed gave nothing: up to its place again, and from there byte by byte.
    z = zlib.decompressobj(31)
    out = [z.decompress(data[start:at])]
    try:
        while at < len(data):
            out.append(z.decompress(data[at : at + 1]))
            at += 1
    except zlib.error:
        pass
    return b"".join(out), at, error


def _within(plain: bytes) -> Iterator[tuple]:
    """All valid records of the bytes of a member: ("record", end, headers, payload); and ("gap", reason)."""
    at = 0
    while 0 <= at < len(plain):
        if isinstance(one := _checked(plain, at), str):
            yield "gap", one
            while (at := plain.find(_MAGIC, at + 1)) >= 0 and isinstance(one := _checked(plain, at), str):
                pass
            if at < 0:
                return
        yield "record", one[2], *one[:2]
        at = one[2]


def salvaged(data: bytes) -> Iterator[tuple]:
    """All valid records of an archive: ("record", begin, end, headers, payload); and ("gap", begin, end, reason).

    Records of a member have its place, gaps within it begin there.
    """
    view, at, bad, why = memoryview(data), 0, None, ""
    while at < len(data):
        if data[at : at + 3] == _GZIP:
            plain, end, error = _member(view, at)
            found = _within(plain)
        else:
            plain, end, error = b"", at, ""
            one = _checked(view, at)
            if isinstance(one, str):
                found, error = iter(()), one
            else:
                end = one[2]
                found = iter([("record", end, *one[:2])])
        sure = 0  # bytes of the member up to the end of its last valid record
        for kind, *rest in found:
            if kind == "gap":
                if bad is None:
                    bad, why = at, error or rest[0]
                continue
            if bad is not None:
                yield "gap", bad, at if bad < at else end, why
                bad = None
            sure, *record = rest
            yield "record", at, end, *record
        if not error:
            at = end
            continue
        if bad is None:
            bad, why = at, error
        # A member without a valid end is searched for others, but not where its own records are.
        past = at + 1
        if plain and sure:
            z = zlib.decompressobj(31)
            z.decompress(view[at:end], sure)
            past = max(past, end - len(z.unconsumed_tail))
        ahead = [x for x in (data.find(_GZIP, past), data.find(_MAGIC, past)) if x > 0]
        at = min(ahead, default=len(data))
    if bad is not None:
        yield "gap", bad, len(data), why


def _rows(path: str, data: bytes, payloads: bool, records: int | None = None, gaps: int | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each record and gap; an error at the end if there are not as many ``records`` and ``gaps``."""
    rows, held = [], 0
    schema = _SCHEMA if payloads else _SCHEMA.remove(len(_SCHEMA) - 1)
    found = {"record": 0, "gap": 0}
    for kind, begin, end, *rest in salvaged(data):
        found[kind] += 1
        row = dict.fromkeys(schema.names) | {"kind": kind, "path": path, "begin": begin, "end": end}
        if kind == "gap":
            row["reason"] = rest[0]
        else:
            h, payload = rest
            name = h.get("warc-type")
            whole = h.get("x-payload-length", "") if name == "revisit" else ""
            digest = h.get("warc-payload-digest", "").rpartition(":")[2] if name == "revisit" else hashlib.sha256(payload).hexdigest()
            row |= {"record_type": name, "record_id": h.get("warc-record-id"), "refers_to": h.get("warc-refers-to"), "uri": h.get("warc-target-uri"), "payload_bytes": int(whole) if whole.isdigit() else len(payload), "payload_digest": digest}
            if payloads:
                row["payload"] = payload
                held += len(payload)
        rows.append(row)
        if len(rows) == 2000 or held > 1 << 23:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)
    if records is not None and (found["record"], found["gap"]) != (records, gaps):
        raise ValueError(f"{path}: {found['record']} records read of {records} written, {found['gap']} gaps of {gaps}")


def read_archives(manifest: DataFrame, payloads: bool = False, whole: bool = False) -> DataFrame:
    """Reads the archives of a table of paths: a row for each record, and one for each gap (kind ``gap``).

    A task holds one archive at a time, so archives must fit into its memory; headers and payloads may have any length
    within. With ``whole``, an archive without the numbers of ``records`` and ``gaps`` that the table tells is an error.
    """

    columns = ["path", "records", "gaps"] if whole else ["path"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, *numbers in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as f:
                    data = f.read()
                yield from _rows(path, data, payloads, *numbers)

    # A given number of partitions is not merged again, however few bytes the paths are.
    return manifest.select(*columns).repartition(max(1, manifest.count())).mapInArrow(read, RECORDS + ", payload binary" * payloads)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Reads the archives under any path that Spark reads, as ``read_archives`` does. Spark's reader of whole files
    refuses archives of 2 GB and more."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _rows(batch.column("path")[k].as_py(), batch.column("content")[k].as_py() or b"", payloads)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, RECORDS + ", payload binary" * payloads)


def round_trip(pages: DataFrame, torn: int = TORN) -> DataFrame:
    """Writes all pages, with torn members among them, and salvages the archives: page_id, payload_bytes, payload_digest,
    record_type, refers_to.

    Null and repeated pages as in ``with_revisits``; very long URLs and payloads are written whole; other columns of
    ``pages`` are ignored; no pages, no rows. A record that was written and cannot be read, or a gap too many or too
    few, is an error.
    """
    read = read_archives(write_warc(with_revisits(pages), torn=torn), whole=True).filter("kind = 'record'")
    number = lambda c: F.try_to_number(F.nullif(F.regexp_extract(c, r"<urn:page:(-?\d*)>", 1), F.lit("")), F.lit("S9999999999999999999")).cast("long")
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
