"""WARC archives: a writer with one gzip member per record, and a salvage reader.

Spark's text sink writes the members, so an archive can lie in any store Spark
writes to and a lost task's file is replaced as a whole. The sink puts one byte
after each row; it is made the zero byte that ends a member anyway (the highest
byte of a length below 16 MB), or padding, which gzip readers skip, after a
larger record.

The reader checks every record. Where a check fails it looks for the next gzip
member or version line that passes, goes on from there, and reports the bytes
between as a quarantined gap. A member that fails is unpacked as far as it goes:
its records up to there are kept if it was only cut short, and if it is damaged
those whose own digest holds (which says nothing of their other headers).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Payloads below this size are never recorded as revisits.
REVISIT_BYTES = 100
#: Fixed values of the format.
GZIP_START, VERSION, BREAK = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed moment written as the capture time of converted pages.
DATE = "2024-01-01T00:00:00Z"
_LEVEL, _CHUNK = 4, 1 << 16
#: Members are looked for within members this deep, so a member that holds itself has an end.
_DEPTH = 3
#: Headers every record has.
MANDATORY = {"warc-type", "warc-record-id", "warc-date", "content-length"}
#: Headers a record has at most once; a second one means that two records ran into each other.
SINGLE = ("warc-type", "warc-record-id", "warc-date", "content-length", "content-type", "warc-payload-digest")


def revisits(pages: DataFrame, key: str = "page_id", least: int = REVISIT_BYTES) -> DataFrame:
    """(key, digest, first) of pages whose payload a page with a smaller key has too.

    Needs columns key, digest and n_bytes. Only these narrow rows are shuffled;
    payload groups of any size are reduced to their least key map-side first.
    """
    narrow = pages.where(F.col("n_bytes") >= least).select(key, "digest")
    firsts = narrow.groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = F.col("first").isNotNull() & ~F.col(key).eqNullSafe(F.col("first"))
    return narrow.join(firsts.drop("n"), "digest").where(later).select(key, "digest", "first").distinct()


def build_record(page_id, url: str | None, payload: bytes, digest: str, first) -> bytes:
    """One record, not compressed; with ``first`` a revisit of that page, without a block."""
    name = "null" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    block = b""
    if first is None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
        block = head.encode() + payload
        lines.append("Content-Type: application/http; msgtype=response")
    else:
        lines += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}", f"X-Payload-Length: {len(payload)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + BREAK + block + BREAK


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES
) -> None:
    """Write a record per row into gzip archives below ``folder``.

    A null html is an empty payload, a null url leaves its header out. Of rows
    with equal payloads of at least ``least`` bytes those with the least key are
    responses (repeated rows of that page included), others revisit it; a null
    key revisits any that is not null. No rows make an empty folder.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), payload.alias("payload"))
    marked = rows.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload")})
    again = revisits(marked, "key", least).withColumnsRenamed({"key": "_key", "digest": "_digest"})
    joined = marked.join(again, F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest")), "left")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = []
            for page_id, target, body, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(build_record(page_id, target, body, digest, first)) + packer.flush()
                members.append(member[:-1] if member[-1] == 0 else member)
            yield pa.RecordBatch.from_arrays([pa.array(members, type=pa.binary())], names=["member"])

    members = joined.select("key", "url", "payload", "digest", "first").mapInArrow(compress, "member binary")
    members.select(F.col("member").cast("string")).write.option("lineSep", "\0").text(folder)


@dataclass
class Found:
    """A record, or with ``reason`` a gap: bytes [start, end) of the archive."""

    start: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    reason: str = ""
    checked: bool = False  # its digest was compared


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """Content and end of the gzip member that starts at ``at``, and what is wrong with it: "", "cut" or "damaged".

    Of a member that is not whole the content is what can be unpacked.
    """
    unpacker, parts, start = zlib.decompressobj(31), [], at
    while not unpacker.eof and start < len(data):
        before, chunk = unpacker.copy(), data[start : start + _CHUNK]
        try:
            parts.append(unpacker.decompress(chunk))
        except zlib.error:
            try:
                for i in range(len(chunk)):
                    parts.append(before.decompress(chunk[i : i + 1]))
            except zlib.error:
                pass
            return b"".join(parts), start, "damaged"
        start += _CHUNK
    return b"".join(parts), min(start, len(data)) - len(unpacker.unused_data), "" if unpacker.eof else "cut"


def _reach(data: bytes, at: int, size: int) -> int:
    """Where the first ``size`` bytes of the content of the member at ``at`` have been read."""
    unpacker, n = zlib.decompressobj(31), 0
    while True:
        before = unpacker.copy()
        try:
            got = len(unpacker.decompress(data[at : at + _CHUNK]))
        except zlib.error:
            got = size
        if n + got >= size:
            break
        n, at = n + got, at + _CHUNK
    while n < size:
        n, at = n + len(before.decompress(data[at : at + 1])), at + 1
    return at


def _record(data: bytes, at: int) -> tuple[Found | None, str]:
    """The record whose version line starts at ``at``; else None and what is wrong with it."""
    stop = data.find(BREAK, at)
    if stop < 0:
        return None, "header"
    version, *lines = data[at:stop].split(b"\r\n")
    if not version[len(VERSION) :].isdigit():
        return None, "version"
    headers: dict[str, str] = {}
    for line in lines:
        raw, colon, value = line.partition(b":")
        name = raw.strip().lower().decode("latin-1")
        if not colon or (name in headers and name in SINGLE):
            return None, "header"
        headers[name] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        return None, "length"
    start = stop + len(BREAK)
    end = start + int(headers["content-length"])
    if data[end : end + len(BREAK)] != BREAK:
        return None, "length"
    block = data[start:end]
    payload = block.partition(BREAK)[2] if "msgtype=response" in headers.get("content-type", "") else block
    digest = headers.get("warc-payload-digest", "")
    checked = headers.get("warc-type") == "response" and digest.startswith("sha256:")
    if checked:
        if hashlib.sha256(payload).hexdigest() != digest[7:]:
            return None, "digest"
    return Found(at, end + len(BREAK), headers, payload, checked=checked), ""


def _whole(data: bytes, at: int, depth: int) -> tuple[list[Found], int, str]:
    """Records that start at ``at``, where they end, and a reason if a check fails.

    With a reason the records are those a broken member could still give, often none.
    """
    if data.startswith(GZIP_START, at):
        if depth == _DEPTH:
            return [], at, "member"
        inner, end, wrong = _member(data, at)
        found = list(salvage(inner, depth + 1))
        if wrong == "damaged":
            kept = [f.reason or (f.checked and f.headers.keys() >= MANDATORY) for f in found]
            found = [f if k else Found(f.start, f.end, reason="member") for f, k in zip(found, kept)]
        if all(f.reason for f in found):
            return [], at, "member" if wrong else found[0].reason if found else "version"
        if wrong:
            while found[-1].reason:
                found.pop()
            end = _reach(data, at, found[-1].end)
        found = [Found(at, end, f.headers, f.payload, f.reason, f.checked) for f in found]
        return found, end, "member" if wrong else ""
    if data.startswith(VERSION, at):
        record, why = _record(data, at)
        return ([record], record.end, "") if record else ([], at, why)
    return [], at, "version"


def salvage(data: bytes, depth: int = 0) -> Iterator[Found]:
    """All sound records of an archive in order, and the gaps between them.

    An empty archive has neither. Zero bytes between members are padding. All
    records and gaps within a member have its bytes as theirs; of a broken one
    those up to the last record it gave, and a gap of its own follows.
    """
    at, size = 0, len(data)
    while at < size:
        if data[at] == 0:
            at += 1
            continue
        found, end, why = _whole(data, at, depth)
        yield from found
        if not why:
            at = end
            continue
        start, at = end, max(end, at + 1)
        while at < size:
            places = [p for p in (data.find(GZIP_START, at), data.find(VERSION, at)) if p >= 0]
            at = min(places, default=size)
            if at < size:
                if _whole(data, at, depth)[0]:
                    break
                at += 1
        yield Found(start, at, reason=why)


_OUT = (
    "archive string, start long, end long, reason string, record_type string, record_id string, refers_to string, "
    "url string, payload_bytes long, payload_digest string, payload binary"
)


def _urn(value: str | None) -> str | None:
    return value[10:-1] if value and value.startswith("<urn:page:") else value


def read_archives(spark: SparkSession, folder: str, contents: bool = True) -> DataFrame:
    """A row per record and, with a reason, per quarantined gap of the archives below ``folder``.

    payload_bytes and payload_digest are those of the full payload: measured for
    a response, taken from the headers for a revisit. An archive is read by one
    task, so archives must stay below the 2 GB Spark reads as one value; those
    written here hold a shuffle partition each.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _rows(path, data.as_py(), contents)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(rows, _OUT)


def _rows(path: str, data: bytes, contents: bool, batch: int = 2_000) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in _OUT.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[p.split()[1]] for p in _OUT.split(", ")]
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, type=k) for c, k in zip(zip(*held), kinds)]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=names)

    for f in salvage(data):
        if f.reason:
            held.append((path, f.start, f.end, f.reason, *[None] * 7))
        else:
            h, full = f.headers, f.headers.get("warc-type") != "revisit"
            stated = h.get("x-payload-length", "")
            size = len(f.payload) if full else int(stated) if stated.isdigit() else None
            digest = hashlib.sha256(f.payload).hexdigest() if full else h.get("warc-payload-digest", "")[7:] or None
            held.append((
                path, f.start, f.end, None, h.get("warc-type"), _urn(h.get("warc-record-id")),
                _urn(h.get("warc-refers-to")), h.get("warc-target-uri"), size, digest, f.payload if contents else None,
            ))
        if len(held) >= batch:
            yield flush()
    if held:
        yield flush()


def sound(records: DataFrame) -> Column:
    """Condition for rows that are records, not gaps."""
    return records["reason"].isNull()
