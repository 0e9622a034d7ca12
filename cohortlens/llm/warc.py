"""WARC archives: write pages as segmented records, read them back, reassemble.

Records are plain WARC 1.1 text, one gzip stream per file. A response whose block is
longer than ``SEGMENT`` bytes is split into a first segment and continuation records.
Its HTTP body is sent in chunks, so a segment may end inside a chunk: segments are
joined first and chunks decoded afterwards. All cuts fall between characters, because
Spark's text writer, which commits files safely when executors are lost, takes text.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import written

#: Payloads from this size on are stored once; the others are always stored.
REVISIT_FROM = 1000
SEGMENT, CHUNK = 8192, 4096
RECORDS_PER_FILE = 8000
END = "\r\n\r\n"
# Fixed value: the profile of revisits to an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about ``size`` bytes that end between characters."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def chunked(payload: bytes) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in _cuts(payload, CHUNK)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Payload of a chunked body; raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def _id(page_id, digest: str) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{digest}>"


def _record(kind: str, record_id: str, block: bytes, **fields) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"{name.replace('_', '-')}: {value}" for name, value in fields.items() if value is not None]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines) + END + block.decode("utf-8")


def records_of(page_id, url, html: str, digest: str, refers_to) -> Iterator[str]:
    """The records of one page, without the blank lines that end each."""
    payload = html.encode("utf-8")
    target = None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    known = {"WARC_Target_URI": target, "WARC_Payload_Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()}
    own = _id(page_id, digest)
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        block = status + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield _record("revisit", own, block, WARC_Profile=PROFILE, WARC_Refers_To=_id(refers_to, digest), **known)
        return
    block = status + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = list(_cuts(block, SEGMENT))
    if len(parts) == 1:
        yield _record("response", own, block, **known)
        return
    yield _record("response", own, parts[0], WARC_Segment_Number=1, **known)
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        yield _record(
            "continuation", f"{own[:-1]}:{n}>", part,
            WARC_Segment_Origin_ID=own, WARC_Segment_Number=n, WARC_Segment_Total_Length=total,
        )


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, size = [], 0
        for row in zip(*(batch.column(i) for i in range(5))):
            for record in records_of(*(v.as_py() for v in row)):
                out.append(record)
                size += len(record)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write the pages as WARC files below ``path``.

    Of equal payloads of ``REVISIT_FROM`` bytes or more the largest page id is stored
    and the others revisit it; rows that repeat that id are stored again, and so is a
    row without an id. A null text is an empty payload, a null address no header.
    """
    text = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), text.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= REVISIT_FROM
    kept = rows.where(large & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("keeper"))
    # a small page gets a key of its own, so that no key gathers them
    rows = rows.withColumn("key", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "digest"))))
    rows = rows.join(kept.withColumnRenamed("digest", "key"), "key", "left")
    refers = F.when(F.col("keeper") != F.col("page_id"), F.col("keeper"))
    rows = rows.select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    records = rows.mapInArrow(_write, "value string")
    options = {"lineSep": END, "compression": "gzip", "maxRecordsPerFile": RECORDS_PER_FILE}
    records.write.options(**options).text(path)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of one uncompressed stream."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            fields[name] = value.strip()
        size = int(fields["Content-Length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("record is cut off")
        yield fields, block


def _page_of(record_id: str | None) -> int | None:
    found = re.match(r"<urn:x-page:(-?\d+):", record_id or "")
    return int(found[1]) if found else None


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


PARTS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "stored_digest string, payload binary, valid boolean, origin string, segment int, total long, block binary"
)
KINDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("stored_digest", pa.string()),
    ("payload", pa.binary()), ("valid", pa.bool_()), ("origin", pa.string()), ("segment", pa.int32()),
    ("total", pa.int64()), ("block", pa.binary()),
])


def _payload(block: bytes) -> bytes | None:
    head, _, body = block.partition(b"\r\n\r\n")
    try:
        return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError:
        return None


def _complete(row: dict, block: bytes, keep: bool) -> dict:
    payload = _payload(block)
    if payload is None:
        return row | {"valid": False}
    digest = hashlib.sha1(payload).hexdigest()
    same = digest == row["stored_digest"]
    return row | {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload if keep else None, "valid": same}


def _row(fields: dict[str, str], block: bytes, keep: bool) -> dict:
    row = dict.fromkeys(KINDS.names)
    segment, origin = fields.get("WARC-Segment-Number"), fields.get("WARC-Segment-Origin-ID")
    stored = fields.get("WARC-Payload-Digest")
    row |= {"record_type": fields["WARC-Type"], "url": fields.get("WARC-Target-URI"), "stored_digest": stored and _hex(stored)}
    row["page_id"] = _page_of(fields["WARC-Record-ID"])
    if fields["WARC-Type"] == "revisit":
        size = re.search(rb"\r\nContent-Length: (\d+)", block)
        sizes = {"payload_bytes": size and int(size[1]), "payload_digest": row["stored_digest"]}
        return row | sizes | {"refers_to": _page_of(fields.get("WARC-Refers-To")), "valid": bool(size)}
    if segment is None:
        return _complete(row, block, keep)
    total = fields.get("WARC-Segment-Total-Length")
    return row | {"origin": origin or fields["WARC-Record-ID"], "segment": int(segment), "total": total and int(total), "block": block}


def _read(keep: bool):
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                with gzip.open(io.BytesIO(content.as_buffer())) as stream:
                    for fields, block in parse(stream):
                        rows.append(_row(fields, block, keep))
                        size += len(block)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, schema=KINDS)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=KINDS)

    return run


def _join_segments(keep: bool):
    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                rows = []
                for group in batch.slice(low, 64).to_pylist():
                    parts = group["parts"]
                    block = b"".join(p["block"] for p in parts)
                    row = dict.fromkeys(KINDS.names) | {k: parts[0][k] for k in ("page_id", "url", "stored_digest")}
                    row["record_type"] = "response"
                    whole = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(block)
                    rows += [_complete(row, block, keep) if whole else row | {"valid": False}] * group["copies"]
                yield pa.RecordBatch.from_pylist(rows, schema=KINDS)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, valid``.

    Segments are grouped by the record that they continue, put in order and checked
    against the total length; then chunks are decoded and the digest is compared with
    the stored one. ``valid`` is false where any of that fails, with null in place of
    what is not known. Size and digest of a revisit are those of the full payload, as
    its headers have them; its ``payload`` is null. Records that were written several
    times come out as often. Without ``payloads`` that column is null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    parts = written(files.mapInArrow(_read(payloads), PARTS), "records")
    part = F.struct("segment", "block", "total", "page_id", "url", "stored_digest")
    groups = (
        parts.where("origin is not null")
        .groupBy("origin")
        .agg(F.array_sort(F.collect_set(part)).alias("parts"), F.sum(F.when(F.col("segment") == 1, 1).otherwise(0)).alias("copies"))
        .withColumn("copies", F.greatest("copies", F.lit(1)))
        .select("parts", "copies")
    )
    joined = groups.mapInArrow(_join_segments(payloads), PARTS)
    out = parts.where("origin is null").unionByName(joined)
    return out.select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "valid")
