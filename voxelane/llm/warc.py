"""WARC archives: writing captures as request, response or revisit and metadata records, reading them, assembling transactions."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .workspace import small_enough

# Names that the format prescribes.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"

RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(data: Column) -> Column:
    """The bare upper-case base32 SHA-1 of binary or string data: five hex digits hold four characters."""
    digits = F.sha1(data)
    groups = [F.conv(F.substring(digits, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    char = lambda v, shift: F.substring(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.concat(*[char(v, shift) for v in groups for shift in (15, 10, 5, 0)])


def _record(block: Column, **headers: Column | str | None) -> Column:
    lines = [F.lit(VERSION + CRLF)]
    for name, value in headers.items():
        if value is not None:
            value = value if isinstance(value, Column) else F.lit(value)
            lines.append(F.coalesce(F.concat(F.lit(name.replace("_", "-") + ": "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def write_captures(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0, date: str = "2020-01-01T00:00:00Z", file_bytes: int = 256 << 20) -> None:
    """Write three records a row: request, response or revisit, and metadata, the others concurrent to the second.

    Among payloads of at least min_revisit_bytes bytes that are equal, the row of the largest key is a response and the
    others are revisits of it, without a payload; a row that repeats key and payload counts as a revisit too. A null key
    is the smallest. A null payload is empty. Record ids hold the key and, where any key repeats, the number among rows of
    equal key and payload and the payload's digest, so that every row keeps records of its own. Control characters and spaces of
    a URL are written as %20; a null URL as urn:x-none. A file is one gzip member of whole records, of payloads of file_bytes
    in all at most (or one larger payload); rows go to files by tiers of their payload's size. The writer's commit makes each
    file appear once. Only groups of equal payloads are joined back, by broadcast if their bytes allow. An empty table gives
    no records; other columns are not read.
    """
    rows = pages.select(F.col(key).cast("long").alias("id"), F.coalesce(F.regexp_replace(F.col(url).cast("string"), r"[\x00-\x20\x7f]", "%20"), F.lit("urn:x-none")).alias("uri"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("digest", base32_sha1(F.col("body")))
    groups = rows.where(F.octet_length("body") >= min_revisit_bytes).groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("rows")).where("rows > 1")
    repeated = rows.groupBy("id").count().where("count > 1").limit(1).count() > 0
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("id", "digest").orderBy("uri")) if repeated else F.lit(1))
    keepers = groups.select("digest", "keeper", F.lit(True).alias("shared"))
    rows = rows.join(F.broadcast(keepers) if small_enough(keepers) else keepers, "digest", "left")
    name = lambda i, copy, kind: F.concat(F.lit("<urn:x-capture:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(":"), copy.cast("string"), F.concat(F.lit(":"), F.col("digest")) if repeated else F.lit(""), F.lit(f":{kind}>"))
    revisit = F.col("shared").isNotNull() & ~(F.col("id").eqNullSafe(F.col("keeper")) & (F.col("copy") == 1))
    own, http = name(F.col("id"), F.col("copy"), "response"), F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("body").cast("string"), F.lit(CRLF + CRLF))
    common = {"WARC_Date": date, "WARC_Target_URI": F.col("uri")}
    request = _record(F.concat(F.lit("GET "), F.col("uri"), F.lit(f" HTTP/1.1{CRLF}{CRLF}")), WARC_Type="request", WARC_Record_ID=name(F.col("id"), F.col("copy"), "request"), WARC_Concurrent_To=own, **common, Content_Type="application/http;msgtype=request")
    main = _record(
        F.when(revisit, http).otherwise(F.concat(http, F.col("body"))),
        WARC_Type=F.when(revisit, "revisit").otherwise("response"),
        WARC_Record_ID=own,
        **common,
        WARC_Payload_Digest=F.concat(F.lit("sha1:"), F.col("digest")),
        WARC_Profile=F.when(revisit, REVISIT_PROFILE),
        WARC_Refers_To=F.when(revisit, name(F.col("keeper"), F.lit(1), "response")),
        Content_Type="application/http;msgtype=response",
    )
    metadata = _record(F.concat(F.lit(f"fetchTimeMs: 0{CRLF}payloadBytes: "), F.octet_length("body").cast("string"), F.lit(CRLF)), WARC_Type="metadata", WARC_Record_ID=name(F.col("id"), F.col("copy"), "metadata"), WARC_Concurrent_To=own, **common, Content_Type="application/warc-fields")
    size = F.octet_length(F.coalesce(F.col(payload).cast("string"), F.lit("")))
    largest, least = pages.agg(F.max(size)).first()[0] or 0, -1
    for tier, most in enumerate((1 << 16, 1 << 22, 1 << 31)):
        if least < largest or not tier:
            some = rows if largest <= 1 << 16 else rows.where((F.octet_length("body") > least) & (F.octet_length("body") <= most))
            records = some.select(F.explode(F.array(request, main, metadata)).alias("value"))
            records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", 3 * max(1, file_bytes // most)).text(f"{path}/{tier}")
        least = most


class _Stream:
    """Bytes of one archive, plain or of gzip members, inflated as far as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.buffer, self.zip = memoryview(data), 0, bytearray(), None
        if data[:2] == b"\x1f\x8b":
            self.zip = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        chunk = self.data[self.at : self.at + (1 << 18)]
        self.at += len(chunk)
        if self.zip is None:
            self.buffer += chunk
            return True
        self.buffer += self.zip.decompress(chunk)
        while self.zip.eof and self.zip.unused_data:
            rest, self.zip = self.zip.unused_data, zlib.decompressobj(31)
            self.buffer += self.zip.decompress(rest)
        if self.zip.eof:
            self.zip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (end := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def parse(data: bytes) -> Iterator[dict]:
    """The records of one archive file. HTTP blocks give a payload; lengths come from headers, never from a separator."""
    stream = _Stream(data)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        while lines and not lines[0].startswith("WARC/"):
            lines.pop(0)
        if not lines:
            continue
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = stream.take(int(fields.get("content-length", 0)))
        kind, payload, size, digest = fields.get("warc-type"), block, len(block), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if fields.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            size = len(payload)
            if kind == "revisit":
                size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), size)
        if kind == "response":
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        yield {"record_id": fields.get("warc-record-id"), "record_type": kind, "concurrent_to": fields.get("warc-concurrent-to"), "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "payload_digest": digest, "payload_bytes": size, "payload": payload}


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives (plain or gzip) under a path that Spark reads. A response's digest and length
    are computed from its bytes; a revisit's come from its headers. payloads=False leaves the payload column null."""
    ship(spark)
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.strip().split() for x in RECORD.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                rows, size = [], 0
                for r in parse(file.as_py()):
                    if not payloads:
                        r["payload"] = None
                    rows.append(r)
                    size += 500 + len(r["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture (id of its main record), main, request and metadata.

    main is the response, revisit or resource record; request the concurrent request of least id; metadata all concurrent
    metadata records by id. A metadata record may name the request in place of the main record. Records of other types
    and those that name no other record are left out; a capture whose main record is missing has a null main.
    """
    body = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    main = records.where(F.col("record_type").isin("response", "revisit", "resource")).select(F.col("record_id").alias("capture"), body.alias("main"))
    request = records.where("record_type = 'request' AND concurrent_to IS NOT NULL").select(F.col("concurrent_to").alias("capture"), body.alias("request"))
    named = records.where("record_type = 'metadata' AND concurrent_to IS NOT NULL").select(F.col("concurrent_to").alias("via"), body.alias("one"))
    via = request.select(F.col("request.record_id").alias("via"), F.col("capture").alias("behind")).dropDuplicates(["via"])
    metadata = named.join(via, "via", "left").select(F.coalesce("behind", "via").alias("capture"), "one")
    least = lambda x: F.min_by(x, f"{x}.record_id")
    main, request = main.groupBy("capture").agg(least("main").alias("main")), request.groupBy("capture").agg(least("request").alias("request"))
    metadata = metadata.groupBy("capture").agg(F.array_sort(F.collect_list("one")).alias("metadata"))
    return main.join(request, "capture", "full").join(metadata, "capture", "full")
