"""WARC archives: written as whole-file gzip streams, normalised to one gzip member per record with a sidecar index, and read back through it.

Records are of type response, or revisit where an earlier response has the same
payload. A null payload is an empty one. A record without an id has no
WARC-Record-ID; a page without a URL has no WARC-Target-URI. White space and
control characters in a URL are percent-encoded in its header.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomaudit.llm.common import hinted, small_enough, written
from loomaudit.llm.files import new_file, new_folder, place

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
ROWS = 500
#: Shared digests that may be broadcast, so that no payload is shuffled; beyond, each is joined in SALTS parts.
BROADCAST_DIGESTS, SALTS = 200_000, 16
FILES = "path string, records bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest_of(payload: bytes) -> str:
    """The bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit if refers_to is given."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(head: bytes) -> dict[str, str]:
    """The named fields of a record's head, names in lower case."""
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not the start of a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or more members."""
    gunzip = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            if piece := gunzip.decompress(data, CHUNK):
                yield piece
            data = gunzip.unconsumed_tail
            if gunzip.eof:
                data, gunzip = gunzip.unused_data, zlib.decompressobj(31)
    if rest := gunzip.flush():
        yield rest


def records_in(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) one after another; holds one record and one piece."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while (end := held.find(b"\r\n\r\n")) >= 0:
            headers = headers_of(bytes(held[:end]))
            stop = end + 4 + int(headers["content-length"]) + 4
            if len(held) < stop:
                break
            yield headers, bytes(held[:stop])
            del held[:stop]
    if held:
        raise ValueError("the archive ends within a record")


def _page(urn: str | None) -> int | None:
    return int(urn.strip("<>").rpartition(":")[2]) if urn else None


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): of pages with equal payloads of at least least_bytes, all refer to the smallest page_id but that itself. Rows that share it are all responses."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    groups = keyed.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    small = small_enough(groups, BROADCAST_DIGESTS)
    if not small:
        # One payload may be a third of all pages: its rows go to several tasks.
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return keyed.join(hinted(groups, small), ["digest"] if small else ["digest", "salt"], "left").select("page_id", "url", "payload", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame) -> DataFrame:
    """Writes pages (page_id, url, payload, refers_to), a gzip stream for each partition; returns FILES."""
    folder = new_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, records = new_file(folder, ".warc.gz"), 0
        files, name = place(file)
        gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
        with files.open_output_stream(name, compression=None) as out:
            for batch in batches:
                for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    out.write(gzip.compress(record_of(*(x.as_py() for x in row))))
                    records += 1
            out.write(gzip.flush())
        yield pa.RecordBatch.from_pydict({"path": [file], "records": pa.array([records], pa.int64())})

    return written(pages.mapInArrow(run, FILES).where("records > 0"), "warc-files")


def _each(files: DataFrame) -> DataFrame:
    """One file to a task, dealt in turn."""
    return files.repartition(max(1, files.count()))


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrites each archive (path), inflated once, with a gzip member for each record and a sidecar index, path + .idx, of a JSON line for each record; returns FILES."""
    folder = new_folder(archives.sparkSession, "warc-normalised")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                source, name = place(path)
                file = new_file(folder, ".warc.gz")
                files, target = place(file)
                offset = records = 0
                with source.open_input_stream(name, compression=None) as stream, files.open_output_stream(target, compression=None) as out, files.open_output_stream(target + ".idx") as index:
                    for headers, record in records_in(inflated(stream)):
                        gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = gzip.compress(record) + gzip.flush()
                        out.write(member)
                        index.write(json.dumps({"id": headers.get("warc-record-id"), "type": headers["warc-type"], "uri": headers.get("warc-target-uri"), "offset": offset, "length": len(member)}).encode() + b"\n")
                        offset += len(member)
                        records += 1
                yield pa.RecordBatch.from_pydict({"path": [file], "records": pa.array([records], pa.int64())})

    return written(_each(archives).mapInArrow(run, FILES), "warc-normalised-files")


def read_member(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of the record in one member; a revisit has no payload of its own."""
    file.seek(offset)
    record = zlib.decompress(file.read(length), 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = headers_of(head)
    return headers, rest[: int(headers["content-length"])].partition(b"\r\n\r\n")[2]


def read_archives(files: DataFrame) -> DataFrame:
    """RECORDS, each record read through the index of its file. The payload's length and digest are taken from the payload itself; of a revisit, which has none, from its head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                source, name = place(path)
                with source.open_input_stream(name + ".idx") as stream:
                    index = stream.read().splitlines()
                with source.open_input_file(name) as file:
                    for at in range(0, len(index), ROWS):
                        yield _rows([read_member(file, e["offset"], e["length"]) for e in map(json.loads, index[at : at + ROWS])])

    return _each(files).mapInArrow(run, RECORDS)


def _rows(members: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
    out = []
    for h, payload in members:
        revisit = h["warc-type"] == "revisit"
        size, digest = (int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:")) if revisit else (len(payload), digest_of(payload))
        out.append((_page(h.get("warc-record-id")), h.get("warc-target-uri"), size, digest, h["warc-type"], _page(h.get("warc-refers-to"))))
    columns = list(zip(*out, strict=True))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
