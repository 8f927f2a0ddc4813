"""WARC archives: segmented records written and reassembled.

The writer stores an HTTP response per page, its body in chunked transfer framing. Of pages with
equal payloads of at least ``least`` bytes the one with the largest id is stored, the others become revisit
records that name it. A block longer than ``segment`` bytes is split: the first record has segment
number 1, the rest are continuation records with the first one's identifier as their
origin, the last one with the total length. Archives are gzip members of one record each.

The reader parses the archives' records, groups continuations by origin identifier, orders
them by segment number, verifies the total length, takes off HTTP headers and chunked framing, and checks the payload's
digest.

Defined results: a null html is an empty payload; equal empty payloads count as equal if ``least`` is 0; rows
with the largest id that are repeated are all responses; null ids are responses unless another page with the
payload has an id; every row of the input gives one record, repeated rows too; other columns
are ignored; empty tables give no archives. A record whose segments lack a part or whose digest differs raises.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.arrow import slices
from quern.plans.shared import filesystem, new_path, prepare

#: Bytes of a record's block, of a transfer chunk and, about, of an archive file.
SEGMENT, CHUNK, FILE = 32 << 10, 8 << 10, 256 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def framed(data: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for x in (data[i : i + size] for i in range(0, len(data), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unframed(data: bytes) -> bytes:
    """The body of chunked framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].partition(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        if len(out[-1]) != size or data[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a transfer chunk is cut short")
        at = end + 4 + size


def body_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unframed(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(kind: str, own: str, block: bytes, more: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", "2024-01-01T00:00:00Z"), *more, ("Content-Length", str(len(block)))]
    clean = lambda x: x.replace("\r", "%0D").replace("\n", "%0A")
    text = "WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in head) + "\r\n"
    return text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def segmented(kind: str, block: bytes, more: list[tuple[str, str]], segment: int) -> Iterator[bytes]:
    """The record of a block, or its first segment and the continuation records."""
    new = lambda: f"<urn:uuid:{uuid.uuid4()}>"
    own = new()
    if len(block) <= segment:
        yield record(kind, own, block, more)
        return
    yield record(kind, own, block[:segment], [*more, ("WARC-Segment-Number", "1")])
    starts = range(segment, len(block), segment)
    for n, at in enumerate(starts, 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] * (at == starts[-1])
        yield record("continuation", new(), block[at : at + segment], [("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n)), *last])


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of uncompressed data."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield head, block
        at = end + 8 + size


def members(stream) -> Iterator[bytes]:
    """What each gzip member of a file holds."""
    rest = b""
    while True:
        unzip, out = zlib.decompressobj(31), []
        while not unzip.eof:
            rest = rest or stream.read(1 << 20)
            if not rest:
                if out:
                    raise ValueError("an archive is cut short")
                return
            out.append(unzip.decompress(rest))
            rest = unzip.unused_data
        yield b"".join(out)


def originals(pages: DataFrame, least: int, id_col: str, html_col: str, url_col: str) -> DataFrame:
    """``page_id, url, payload, origin``: origin is the id of the page that a revisit refers to, else null."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    own = own.withColumns({"sha": F.unhex(F.sha1("payload")), "size": F.length("payload")})
    largest = own.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max("page_id").alias("largest"))
    joined = own.join(largest, ["sha", "size"], "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("largest").eqNullSafe(F.col("page_id")), F.col("largest")).alias("origin"))


def write(pages: DataFrame, path: str | None = None, least: int = 0, segment: int = SEGMENT, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> tuple[str, list[str]]:
    """Write an archive record per page; returns the folder and its files' names (a bounded list: one for each task and 256 MB)."""
    spark = pages.sparkSession
    prepare(spark)
    path = path or new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = filesystem(path)
        system.create_dir(folder, recursive=True)
        task, out, names, size = TaskContext.get(), None, [], 0
        for batch in slices(batches, "payload"):
            for page, url, payload, origin in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or size > FILE:
                    if out is not None:
                        out.close()
                    names.append(f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(names):04d}.warc.gz")
                    out, size = system.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                more = [("WARC-Target-URI", url or "urn:none"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload)))]
                more += [("X-Page-ID", str(page))] * (page is not None)
                if origin is None:
                    kind, block = "response", HTTP + framed(payload)
                else:
                    more += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(origin))]
                    kind, block = "revisit", b""
                for data in segmented(kind, block, more, segment):
                    zipped = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = zipped.compress(data) + zipped.flush()
                    out.write(data)
                    size += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    done = originals(pages, least, id_col, html_col, url_col).mapInArrow(run, "name string")
    return path, sorted(r.name for r in done.collect())


SEGMENT_SCHEMA = "origin string, number int, total long, kind string, page_id long, refers_to long, digest string, length long, block binary"


def read_segments(spark: SparkSession, path: str, names: list[str], split: bool | None = None) -> DataFrame:
    """A row for each record of the archives, or only for those that are (not) segments: ``origin`` is the identifier that segments share."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = filesystem(path)
        schema = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("length", pa.int64()), ("block", pa.binary())])
        for batch in batches:
            for at in batch.column(0).to_pylist():
                with system.open_input_stream(f"{folder}/{names[at]}", compression=None) as stream:
                    rows, size = [], 0
                    for data in members(stream):
                        for head, block in records(data):
                            if split is not None and split != ("warc-segment-number" in head):
                                continue
                            number = lambda key: int(head[key]) if key in head else None  # noqa: B023, E731
                            rows.append((head.get("warc-segment-origin-id", head["warc-record-id"]), number("warc-segment-number"), number("warc-segment-total-length"), head["warc-type"], number("x-page-id"), number("x-refers-to-page-id"), head.get("warc-payload-digest", "").removeprefix("sha1:"), number("x-payload-length"), block))
                            size += len(block)
                        if size > 4 << 20 or len(rows) > 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spark.range(0, len(names), 1, max(1, len(names))).mapInArrow(run, SEGMENT_SCHEMA)


def reassembled(segments: DataFrame) -> DataFrame:
    """``kind, page_id, refers_to, digest, length, block`` of whole records; a missing or doubled segment raises."""
    grouped = segments.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("number", F.lit(1)).alias("number"), "kind", "page_id", "refers_to", "digest", "length", "total", "block"))).alias("parts"))
    first = F.col("parts")[0]
    in_order = F.transform("parts", lambda p: p.number) == F.sequence(F.lit(1), F.size("parts"))
    block = F.when(F.size("parts") == 1, first.block).otherwise(F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p.block)), "")))
    out = grouped.withColumn("total", F.array_max(F.transform("parts", lambda p: p.total))).select(first.kind.alias("kind"), first.page_id.alias("page_id"), first.refers_to.alias("refers_to"), first.digest.alias("digest"), first.length.alias("length"), "total", in_order.alias("in_order"), F.size("parts").alias("n"), block.alias("block"))
    whole = F.col("in_order") & ((F.col("n") == 1) | F.col("total").eqNullSafe(F.length("block").cast("long")))
    return out.select("kind", "page_id", "refers_to", "digest", "length", F.when(whole, F.col("block")).otherwise(F.raise_error(F.lit("segments do not make a whole record"))).alias("block"))


def payloads(whole: DataFrame) -> DataFrame:
    """``page_id, record_type, refers_to, payload_digest, payload_bytes, payload``; a revisit's payload is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "block"):
            out = []
            for kind, want, block in zip(*(batch.column(i).to_pylist() for i in (0, 3, 5))):
                out.append(body_of(block) if kind == "response" else None)
                if out[-1] is not None and digest(out[-1]) != want:
                    raise ValueError("a payload differs from its digest")
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(out, pa.binary())], names=["record_type", "page_id", "refers_to", "payload_digest", "payload_bytes", "payload"])

    return whole.mapInArrow(run, "record_type string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary")


def read(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The archives' pages, reassembled and decoded. Only segments are shuffled: the archives are read once more for whole records."""
    whole = read_segments(spark, path, names, split=False).select("kind", "page_id", "refers_to", "digest", "length", "block")
    return payloads(whole.unionByName(reassembled(read_segments(spark, path, names, split=True))))
