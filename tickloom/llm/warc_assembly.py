"""WARC writing, reading and transaction assembly.

Each page becomes three records: a request and a metadata record that name, in WARC-Concurrent-To, the response or
revisit record of the same capture. The archives are written by Spark's text writer (a record is headers, an empty line,
the block, and the two line ends that the writer puts between rows), as gzip files of about FILE_BYTES of payloads that begin with a
warcinfo record, and read back as binary files by a parser that inflates as it goes and follows Content-Length. Assembly joins the three kinds by identifier, then revisits to the
response that they refer to, and emits one nested row per capture.

Defined results: a null html is an empty payload; a null page_id is kept as null and is never the largest unless all are;
rows that repeat a page_id, url and payload are captures of their own, the first of them first; an empty table gives no
capture. Archives whose records lack a request or metadata record give null in those fields. Other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, stored

MIN_PAYLOAD = 0
#: Pages are dealt to files by hash, so that a file holds about so many bytes of payloads; and no more than so many records.
FILE_BYTES = 32 << 20
RECORDS_PER_FILE = 30_000
INFLATE = 1 << 20
DATE = "2024-01-01T00:00:00Z"
END = "\r\n"

RECORD_SCHEMA = "type string, record_id string, concurrent_to string, refers_to string, target_uri string, header_digest string, fields map<string,string>, payload_bytes long, payload_digest string, payload binary"


def base32(sha1: Column) -> Column:
    """Upper-case base32 of a binary SHA-1: five hex digits are four base-32 digits."""
    digits = [F.lpad(F.conv(F.substring(F.hex(sha1), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(key: Column, n: Column, kind: str) -> Column:
    h = F.md5(F.concat_ws("|", F.hex(key), n.cast("string"), F.lit(kind)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: Column, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]  # null values leave their line out
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, F.lit("WARC/1.0"), *lines), F.lit(END + END), block)


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD) -> None:
    """Writes the archives of pages(page_id, url, html). Among equal payloads of at least min_payload bytes, that of the
    largest page_id is written in full; the others are revisits of it."""
    html = F.coalesce(F.col("html"), F.lit(""))
    key = F.unhex(F.md5(F.concat_ws("\x01", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce(F.col("url"), F.lit("\x02")), F.sha1(html))))
    rows = pages.select("page_id", "url", html.alias("html"), key.alias("key"))
    sizes = rows.groupBy("key").agg(F.first("page_id").alias("page_id"), F.first(F.octet_length("html")).alias("bytes"), F.first(F.unhex(F.sha1("html"))).alias("digest"), F.count(F.lit(1)).alias("times"))
    meta = stored(sizes, "captures")
    # Of equal payloads one struct is the largest. Equal rows have one key; the first of them stands for the others.
    first = meta.where(F.col("bytes") >= min_payload).groupBy("digest").agg(F.max(F.struct("page_id", "key")).alias("top")).select(F.col("digest").alias("of"), F.col("top.key").alias("top_key"))
    roles = meta.join(first, meta["digest"] == first["of"], "left").select(F.col("key").alias("role_key"), "bytes", "digest", "top_key")
    total = meta.agg(F.coalesce(F.sum(F.col("bytes") * F.col("times")), F.lit(0))).first()[0]
    n_files = max(-(-total // FILE_BYTES), pages.sparkSession.sparkContext.defaultParallelism)

    placed = rows.repartition(n_files, "key").withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    full = placed.join(roles, placed["key"] == roles["role_key"])
    is_response = F.col("top_key").isNull() | ((F.col("top_key") == F.col("key")) & (F.col("nth") == 1))
    full = full.withColumn("full", is_response).withColumn("original", F.when(~F.col("full"), _record_id(F.col("top_key"), F.lit(1), "response")))
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("about:blank")), "[\\x00-\\x20\\x7F]", "%20")
    host = F.coalesce(F.regexp_extract(uri, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    target = F.concat(F.lit("/"), F.regexp_extract(uri, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^#]*)", 1))
    main, to = _record_id(F.col("key"), F.col("nth"), "response"), ("WARC-Target-URI", uri)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest"))))
    revisit = ("WARC-Profile", F.when(~F.col("full"), F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")))
    heads_file = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # the first row of its task
    about = F.concat_ws(END, F.lit("software: tickloom"), F.lit("format: WARC File Format 1.0"), F.lit(""))
    info = _record(F.lit("warcinfo"), _record_id(F.col("key"), F.col("nth"), "warcinfo"), [("Content-Type", F.lit("application/warc-fields"))], about)
    records = F.array(
        _record(F.lit("request"), _record_id(F.col("key"), F.col("nth"), "request"), [("WARC-Concurrent-To", main), to, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END + END))),
        _record(F.when(F.col("full"), F.lit("response")).otherwise(F.lit("revisit")), main, [to, ("Content-Type", F.lit("application/http; msgtype=response")), digest, revisit, ("WARC-Refers-To", F.col("original"))], F.concat(http, F.when(F.col("full"), F.col("html")).otherwise(F.lit("")))),
        _record(F.lit("metadata"), _record_id(F.col("key"), F.col("nth"), "metadata"), [("WARC-Concurrent-To", main), to, ("Content-Type", F.lit("application/warc-fields"))], F.concat_ws(END, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string")), F.lit(""))),
    )
    records = F.when(heads_file, F.concat(F.array(info), records)).otherwise(records)
    full.select(F.explode(records).alias("value")).write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    """The content of an archive, compressed or not, in parts."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + INFLATE] for i in range(0, len(data), INFLATE))
        return
    member = zlib.decompressobj(31)
    for at in range(0, len(data), INFLATE):
        rest = data[at : at + INFLATE]
        while rest:
            if member.eof:  # one member after the other
                member = zlib.decompressobj(31)
            if part := member.decompress(rest, INFLATE):
                yield part
            rest = member.unused_data if member.eof else member.unconsumed_tail


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of one archive; no more than a record is held inflated. A
    record that the archive does not hold to its end is left out."""
    parts, held = _inflated(data), bytearray()

    def more() -> bool:
        part = next(parts, b"")
        held.extend(part)
        return bool(part)

    while True:
        while (start := held.find(b"WARC/")) < 0:
            del held[: max(len(held) - 4, 0)]
            if not more():
                return
        del held[:start]
        seen = 0
        while (head := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(len(held) - 3, 0)
            if not more():
                return
        headers = {}
        for line in held[:head].decode("utf-8", "replace").split(END)[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        end = head + 4 + int(headers.get("content-length", 0))
        while len(held) < end:
            if not more():
                return
        yield headers, bytes(held[head + 4 : end])
        del held[:end]


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives below path; see RECORD_SCHEMA. Without payload, that column is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["type", "record_id", "concurrent_to", "refers_to", "target_uri", "header_digest", "fields", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.string()] * 6 + [pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                out: list[tuple] = []
                held = 0
                for h, block in parse_records(content.as_py()):
                    kind, body, fields = h.get("warc-type"), block, None
                    if h.get("content-type", "").startswith("application/http"):
                        body = body.partition(b"\r\n\r\n")[2]
                    elif h.get("content-type") == "application/warc-fields":
                        pairs = (line.partition(":") for line in body.decode("utf-8", "replace").split(END) if line)
                        fields = [(k.strip(), v.strip()) for k, _, v in pairs]
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if kind in ("response", "revisit") else None
                    out.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"), fields, len(body), digest, body if payload else None))
                    held += len(body)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture id, target_uri, type, request, response, metadata, refers_to."""
    main = records.where(F.col("type").isin("response", "revisit"))
    side = lambda kind: records.where(F.col("type") == kind).where("concurrent_to IS NOT NULL").select(F.col("concurrent_to").alias(f"{kind}_of"), F.struct("record_id", "fields", "payload_bytes").alias(kind))
    request, metadata = side("request"), side("metadata")
    joined = main.join(request, main["record_id"] == request["request_of"], "left").join(metadata, main["record_id"] == metadata["metadata_of"], "left")
    captures = stored(joined.select("record_id", "target_uri", "type", "request", "metadata", "refers_to", F.struct("header_digest", "payload_bytes", "payload_digest", "payload").alias("response")), "captures")
    own = captures.where("type = 'response'").withColumn("original", F.lit(None).cast("struct<record_id:string,page_id:string,payload_bytes:bigint,payload_digest:string>"))
    target = captures.where("type = 'response'").select(F.col("record_id").alias("_to"), F.struct("record_id", F.col("metadata.fields")["page-id"].alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest")).alias("original"))
    revisits = captures.where("type = 'revisit'")
    return own.unionByName(revisits.join(target, revisits["refers_to"] == target["_to"], "left").drop("_to"))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives, reads them back and assembles their captures; payloads stay in the archives."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(pages, path)
    return assemble(stored(read_records(spark, path, payload=False), "records"))


def digest_rows(captures: DataFrame) -> DataFrame:
    pick = lambda name: F.coalesce(F.col(f"original.{name}"), F.col(f"response.{name}")).alias(name)
    return captures.select(F.col("metadata.fields")["page-id"].cast("long").alias("page_id"), pick("payload_bytes"), pick("payload_digest"), F.col("type").alias("record_type"), F.col("original.page_id").cast("long").alias("refers_to"))
