"""WARC archives: writing pages as transactions, reading records back, assembling one nested row per capture.

A capture is three records: the request, the response (or a revisit of an earlier response with the same payload) and a metadata
record, tied together by ``WARC-Concurrent-To``. Archives are written by Spark's text writer, whose line separator is the two line
breaks that end a record, so they go to any file system Spark can write. Readers take plain and compressed archives (one member or
one per record) and cut records by their declared lengths alone. Payloads are never collected or grouped: equal ones are found by
digest, and in the assembly only small records meet in a group.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, columns, small_side

# Fixed values of the format
VERSION = "WARC/1.1"
END = "\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PRIMARY = ("response", "revisit", "resource", "conversion")
FIELDS = "application/warc-fields"
HTTP = "application/http"

FLUSH_BYTES = 8 << 20  # of records in one batch of the reader

RECORD = {
    "archive": pa.string(), "record_id": pa.string(), "record_type": pa.string(), "target_uri": pa.string(), "date": pa.string(),
    "concurrent_to": pa.list_(pa.string()), "refers_to": pa.string(), "declared_digest": pa.string(), "content_type": pa.string(),
    "headers": pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), "http_head": pa.string(), "payload": pa.binary(),
    "payload_bytes": pa.int64(), "payload_digest": pa.string(), "fields": pa.map_(pa.string(), pa.string()),
}
TYPES = {
    "concurrent_to": "array<string>", "headers": "array<struct<name:string,value:string>>", "payload": "binary", "payload_bytes": "long", "fields": "map<string,string>",
}


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_revisit: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write every row of ``pages`` as a request, a response or revisit, and a metadata record with its ``page_id``.

    The payload is ``html`` in UTF-8, empty if null. Of the rows with equal payloads of at least ``least_revisit`` bytes the first by
    (page id, url), nulls last, is the response and the others revisit it; of rows equal in all three columns one counts as first.
    Characters that a header cannot hold are percent-encoded in the url; a null url leaves its header out, a null page id its field.
    Very long payloads go whole into one record. An empty table gives an archive without records. Other columns are ignored.
    """
    with Scratch(pages.sparkSession) as scratch:
        given = columns(pages, page_id=page_id, url=url, html=html)
        given = given.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
        given = given.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
        given = given.withColumn("key", F.md5(F.concat(F.to_json(F.struct("page_id", "url")), F.col("digest")).cast("binary")))
        known = scratch.keep(given.groupBy("key", "digest", "bytes", "page_id", "url").agg(F.count("*").alias("n")))
        order = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("b"), F.col("url").isNull().alias("c"), F.col("url").alias("d"), F.col("key"))
        equal = known.where(F.col("bytes") >= least_revisit).groupBy("digest").agg(F.min(order).alias("first"), F.sum("n").alias("n"))
        firsts = scratch.keep(equal.where("n > 1").select("digest", F.col("first.key").alias("first")))
        twins = scratch.keep(known.where("n > 1").select("key", "n"))
        repeated = twins.count()
        rows = given.withColumn("copy", F.lit(0).cast("long"))
        if repeated:
            # equal rows travel once, whatever their number
            side = small_side(twins, repeated, 48)
            once = given.join(side, "key").dropDuplicates(["key"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
            rows = rows.join(side.select("key"), "key", "left_anti").select(*rows.columns).unionByName(once.select(*rows.columns))
        rows = rows.join(small_side(firsts, firsts.count(), 120), "digest", "left")
        revisit = F.col("first").isNotNull() & ~((F.col("first") == F.col("key")) & (F.col("copy") == 0))
        rows.select(F.explode(F.array(*_records(revisit, date))).alias("value")).write.option("lineSep", END * 2).option("compression", "gzip").text(path)


def _records(revisit: Column, date: str) -> list[Column]:
    """The three records of a row, without the line breaks that end them."""
    uri = F.when(F.regexp_like("url", F.lit(r"[\x00-\x20\x7F]")), F.array_join(F.transform(F.split("url", ""), _encoded), "")).otherwise(F.col("url"))
    host, target = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    target = F.when(F.coalesce(target, F.lit("")) == "", F.lit("/")).otherwise(F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(F.lit("/"), target)))
    main = _record_id("main", F.col("key"), F.col("copy"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END * 2))
    refers = F.when(revisit, _record_id("main", F.col("first"), F.lit(0)))
    response = _record(
        [
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", main), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri),
            ("WARC-Profile", F.when(revisit, F.lit(SAME_PAYLOAD))), ("WARC-Refers-To", refers), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("Content-Type", F.lit(f"{HTTP};msgtype=response")),
        ],
        F.when(revisit, head).otherwise(F.concat(head, F.col("html"))),
    )
    request = _record(
        [
            ("WARC-Type", F.lit("request")), ("WARC-Record-ID", _record_id("request", F.col("key"), F.col("copy"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri),
            ("WARC-Concurrent-To", main), ("Content-Type", F.lit(f"{HTTP};msgtype=request")),
        ],
        F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{END}Host: "), F.coalesce(host, F.lit("")), F.lit(END * 2)),
    )
    metadata = _record(
        [
            ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _record_id("metadata", F.col("key"), F.col("copy"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri),
            ("WARC-Concurrent-To", main), ("Content-Type", F.lit(FIELDS)),
        ],
        F.coalesce(F.concat(F.lit("page_id: "), F.url_encode(F.col("page_id").cast("string")), F.lit(END)), F.lit("")),
    )
    return [request, response, metadata]


def _encoded(c: Column) -> Column:
    return F.when((F.ascii(c) <= 32) | (F.ascii(c) == 127), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)


def _record_id(kind: str, key: Column, copy: Column) -> Column:
    digits = F.md5(F.concat(F.lit(kind + ":"), key, F.lit(":"), copy.cast("string")).cast("binary"))
    parts = [F.substring(digits, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit("")) for name, value in headers]
    return F.concat(F.lit(VERSION + END), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END * 2), block)


def read_warc(spark: SparkSession, path: str, only: Sequence[str] | None = None) -> DataFrame:
    """One row per record of the archives under ``path``, with the columns of ``RECORD`` or those in ``only``.

    For HTTP records ``http_head`` is the block up to the first empty line and ``payload`` the rest; for others the payload is the
    whole block. ``payload_bytes`` and ``payload_digest`` (SHA-256, lower-case hex) are taken from the bytes read. ``fields`` holds
    the named fields of a metadata or warcinfo record, the first value of each name. An archive that ends within a record, or holds
    anything else between records, raises an error. A file is read whole by one task, records go on in bounded batches.
    """
    names = list(only or RECORD)
    schema = ", ".join(f"{n} {TYPES.get(n, 'string')}" for n in names)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    return files.select("path", "content").mapInArrow(_reader(names), schema)


def records_of(content: io.BufferedIOBase, archive: str) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """``(headers, block)`` of every record."""
    while True:
        line = content.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{archive}: a record should begin at {line[:40]!r}")
        headers: list[tuple[str, str]] = []
        while (line := content.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError(f"{archive} ends within a record")
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and headers:  # a header may go on in the next line
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {text.strip()}")
            else:
                name, _, value = text.partition(":")
                headers.append((name.strip().lower(), value.strip()))
        length = int(next(v for n, v in headers if n == "content-length"))
        block = content.read(length)
        if len(block) < length:
            raise ValueError(f"{archive} ends within a record")
        yield headers, block


def _reader(names: list[str]):
    def values(archive: str, headers: list[tuple[str, str]], block: bytes) -> dict:
        first = dict(reversed(headers))
        content_type = first.get("content-type", "")
        head, payload = None, block
        if content_type.startswith(HTTP):
            head, gap, payload = block.partition(b"\r\n\r\n")
            head = (head + gap).decode("utf-8", "replace")
        fields = None
        if content_type.startswith(FIELDS):
            lines = [x.partition(":") for x in block.decode("utf-8", "replace").split("\n") if ":" in x]
            fields = dict(reversed([(n.strip(), v.strip()) for n, _, v in lines]))
        return {
            "archive": archive, "record_id": first.get("warc-record-id"), "record_type": first.get("warc-type"), "target_uri": first.get("warc-target-uri"), "date": first.get("warc-date"),
            "concurrent_to": [v for n, v in headers if n == "warc-concurrent-to"], "refers_to": first.get("warc-refers-to"), "declared_digest": first.get("warc-payload-digest"),
            "content_type": content_type, "headers": [{"name": n, "value": v} for n, v in headers] if "headers" in names else None, "http_head": head, "payload": payload,
            "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest() if "payload_digest" in names else None, "fields": list(fields.items()) if fields is not None else None,
        }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {n: [] for n in names}
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            out = pa.RecordBatch.from_arrays([pa.array(held[n], RECORD[n]) for n in names], names=names)
            held, size = {n: [] for n in names}, 0
            return out

        for batch in batches:
            for k in range(batch.num_rows):
                archive = batch.column(0)[k].as_py()
                raw = pa.BufferReader(batch.column(1)[k].as_buffer())
                packed = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                for headers, block in records_of(gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw), archive):
                    row = values(archive, headers, block)
                    for n in names:
                        held[n].append(row[n])
                    size += 1000 + (len(block) if "payload" in held else 0)
                    if size > FLUSH_BYTES:
                        yield flush()
        if size:
            yield flush()

    return read


def assemble(records: DataFrame, scratch: Scratch) -> DataFrame:
    """``(capture_id, response, request, metadata)``: one nested row per capture, of all columns of ``records``.

    ``records`` needs ``record_id``, ``record_type`` and ``concurrent_to``; it is read twice. A capture is a response, revisit, resource
    or conversion with the requests and metadata tied to it by a concurrent-to header of either side, directly or through one
    other record (metadata of a request). ``request`` is the one of smallest id if there are several, ``metadata`` is in order of ids.
    A record tied to several captures is part of each; one tied to none makes a row without a response, under its own id. Records of
    other types, such as warcinfo, are no part of a capture. A record stored twice appears twice, and so does its capture if it is
    the response. Null concurrent-to lists tie nothing. Records without an id are captures of their own or left without one.
    """
    small = scratch.keep(records.select("record_id", F.col("record_type").isin(*PRIMARY).alias("main"), "concurrent_to").where(F.col("record_type").isin(*PRIMARY, "request", "metadata")))
    known = small.groupBy("record_id").agg(F.max("main").alias("main")).where("record_id is not null")
    ties = small.select("record_id", F.explode("concurrent_to").alias("other"))
    ties = ties.select(F.inline(F.array(F.struct("record_id", "other"), F.struct(F.col("other").alias("record_id"), F.col("record_id").alias("other"))))).distinct()
    ties = ties.join(known, "record_id").where("not main").select("record_id", "other")
    ties = scratch.keep(ties.join(known.withColumnRenamed("record_id", "other"), "other").select("record_id", "other", "main"))
    direct = ties.where("main").select("record_id", F.col("other").alias("capture_id"))
    further = ties.where("not main").join(direct.select("record_id"), "record_id", "left_anti")
    further = further.join(direct.withColumnRenamed("record_id", "other"), "other").select("record_id", "capture_id").distinct()
    part_of = scratch.keep(direct.unionByName(further))
    whole = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    others = records.where(F.col("record_type").isin("request", "metadata")).withColumn("_part", whole).select("record_id", "record_type", "_part")
    others = others.join(part_of, "record_id", "left").withColumn("capture_id", F.coalesce("capture_id", "record_id"))
    asked = F.col("record_type") == "request"
    # maps cannot be compared, so the order is that of the ids
    grouped = others.groupBy("capture_id").agg(
        F.min_by(F.when(asked, F.col("_part")), F.when(asked, F.col("record_id"))).alias("request"),
        F.collect_list(F.when(~asked, F.struct("record_id", "_part"))).alias("metadata"),
    )
    in_order = F.array_sort("metadata", lambda x, y: F.when(x["record_id"] < y["record_id"], -1).when(x["record_id"] > y["record_id"], 1).otherwise(0))
    grouped = grouped.select("capture_id", "request", F.transform(in_order, lambda x: x["_part"]).alias("metadata"))
    mains = records.where(F.col("record_type").isin(*PRIMARY)).select(F.col("record_id").alias("_id"), whole.alias("response"))
    joined = mains.join(grouped, F.col("_id") == F.col("capture_id"), "full_outer")
    return joined.select(F.coalesce("_id", "capture_id").alias("capture_id"), "response", "request", F.coalesce("metadata", F.array().cast(grouped.schema["metadata"].dataType)).alias("metadata"))


def archived_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_revisit: int = 100) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)``: the pages written as archives, read back and assembled.

    Bytes and digest of a revisit are those of the response it refers to, whose payload it repeats; ``refers_to`` is that response's
    page id. Cases are those of :func:`write_warc`.
    """
    spark = pages.sparkSession
    kind = dict(columns(pages, page_id=page_id).dtypes)["page_id"]
    with Scratch(spark) as scratch:
        archives = scratch.room()
        write_warc(pages, archives, page_id, url, html, least_revisit)
        needed = ("record_id", "record_type", "concurrent_to", "refers_to", "declared_digest", "payload_bytes", "payload_digest", "fields")
        records = scratch.keep(read_warc(spark, archives, needed))
        captures = assemble(records, scratch)
        own = F.url_decode(F.col("metadata")[0]["fields"]["page_id"]).cast(kind)
        flat = captures.where("response is not null").select(own.alias("page_id"), "capture_id", *[F.col("response")[c].alias(c) for c in ("record_type", "refers_to", "declared_digest", "payload_bytes", "payload_digest")])
        flat = scratch.keep(flat)
        asked = flat.where("record_type = 'revisit'").select(F.col("refers_to").alias("capture_id")).distinct()
        origins = flat.join(asked, "capture_id", "left_semi").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("origin"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest"))
        origins = scratch.keep(origins)
        joined = flat.join(small_side(origins, origins.count(), 160), "refers_to", "left")
        digest = F.when(F.col("record_type") == "revisit", F.col("full_digest")).otherwise(F.col("payload_digest"))
        true = F.col("declared_digest") == F.concat(F.lit("sha256:"), digest)
        checked = F.when(F.coalesce(true, F.lit(False)), digest).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("capture_id"))))
        size = F.when(F.col("record_type") == "revisit", F.col("full_bytes")).otherwise(F.col("payload_bytes"))
        found = joined.select("page_id", size.alias("payload_bytes"), checked.alias("payload_digest"), "record_type", F.col("origin").alias("refers_to"))
        return scratch.keep(found, release=True)
