"""WARC archives: write pages, normalise monolithic gzip files, read records back.

1. `write_archives` finds, per payload digest, the page with the largest id.  It is
   written as a response, pages with an equal payload as revisits that refer to it.
   Every task streams its records into files of one gzip member each, the form in which
   a record can only be reached by inflating all before it.
2. `normalise` inflates each such file once, as a stream, and writes every record as a
   gzip member of its own, with a sidecar index of offsets beside the file.
3. `read_archives` seeks the records of the index and inflates them one by one.

Files lie in the folder that all executors share and are opened through its file system.
A file's name is new in every attempt of a task and only files named in the written
manifest are read, so a lost executor or a repeated task leaves no half-read file behind.
Memory is bounded by one record's payload on writing and reading and by a block while
normalising.

NULL html has an empty payload.  NULL page ids and urls are written as empty; of equal
payloads of which no page has an id, all are responses.  Rows that share an id and a
payload are all responses if that id is the largest, else all revisits.  Only the three
named columns are read, so others cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqstates.llm.common import materialize, shared_folder

MIN_BYTES = 0
MAX_FILE_BYTES = 256 << 20  # of payload in one archive
BLOCK = 1 << 20
LEVEL = 4
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str | None) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or with `refers_to` a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_header(url)}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + body + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs if name}


class Inflated:
    """Bytes of a gzip stream of one or more members, read forward only."""

    def __init__(self, source):
        self.source, self.inflate, self.held, self.ended = source, zlib.decompressobj(31), bytearray(), False

    def _more(self) -> bool:
        if self.ended:
            return False
        rest = self.inflate.unconsumed_tail or self.inflate.unused_data
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        data = rest or self.source.read(BLOCK)
        self.ended = not data
        if data:
            self.held += self.inflate.decompress(data, BLOCK)
        return bool(data)

    def until(self, mark: bytes) -> bytes:
        """Up to and with the mark; empty at the end."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record")
                return b""
        return self._take(at + len(mark))

    def parts(self, size: int) -> Iterator[bytes]:
        """The next `size` bytes, in blocks."""
        while size:
            if not self.held and not self._more():
                raise ValueError("the archive ends inside a record")
            part = self._take(min(size, len(self.held)))
            size -= len(part)
            yield part

    def _take(self, size: int) -> bytes:
        part = bytes(self.held[:size])
        del self.held[:size]
        return part


def split_members(source, sink) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Rewrite each record as a member of its own; yields (offset, length, record headers)."""
    stream, offset = Inflated(source), 0
    while block := stream.until(b"\r\n\r\n"):
        fields = headers(block)
        member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        size = sink.write(member.compress(block))
        for part in stream.parts(int(fields["content-length"]) + 4):  # and the blank lines after it
            size += sink.write(member.compress(part))
        size += sink.write(member.flush())
        yield offset, size, fields
        offset += size


def _open_folder(uri: str):
    """File system and path; runs in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with its file system, as executors can open it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", uri)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write all pages; returns the manifest (file, records) of monolithic archives."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    digests = rows.select("page_id", F.octet_length("payload").alias("size"), F.unhex(F.sha1("payload")).alias("sha")).distinct()
    digests = materialize(digests, "digests")
    latest = materialize(digests.groupBy("sha").agg(F.max("page_id").alias("last")), "latest")
    plan = digests.where(F.col("size") >= min_bytes).join(latest, "sha").where("NOT (page_id <=> last)")
    plan = materialize(plan.select(F.col("page_id").alias("id"), "sha", "last"), "revisits")
    same = F.col("page_id").eqNullSafe(F.col("id")) & (F.unhex(F.sha1("payload")) == F.col("sha"))
    rows = rows.join(plan, same, "left").select("page_id", "url", "payload", "last")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open_folder(folder)
        system.create_dir(path, recursive=True)
        sink = None
        name, written, records = "", 0, 0

        def close() -> pa.RecordBatch:
            sink.write(member.flush())
            sink.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": [records]})

        for batch in batches:
            for i in range(batch.num_rows):
                if sink is None:
                    name, written, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = system.open_output_stream(f"{path}/{name}", compression=None)
                    member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                page_id, url, payload, last = (batch.column(c)[i].as_py() for c in range(4))
                sink.write(member.compress(record(page_id, url, payload, last)))
                written += len(payload)
                records += 1
                if written >= MAX_FILE_BYTES:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    return materialize(rows.mapInArrow(archive, "file string, records long"), "archives")


def _spread(table: DataFrame, key: str) -> DataFrame:
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """One member per record and a sidecar index; returns the index (file, offset, size)."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fresh = f"{uuid.uuid4().hex}.members.warc.gz"
                with (
                    system.open_input_stream(f"{path}/{name}", compression=None) as source,
                    system.open_output_stream(f"{path}/{fresh}", compression=None) as sink,
                    system.open_output_stream(f"{path}/{fresh}.idx", compression=None) as sidecar,
                ):
                    offsets, sizes = [], []
                    for offset, size, fields in split_members(source, sink):
                        entry = {"offset": offset, "length": size, "type": fields["warc-type"], "uri": fields["warc-target-uri"]}
                        sidecar.write((json.dumps(entry) + "\n").encode())
                        offsets.append(offset)
                        sizes.append(size)
                yield pa.RecordBatch.from_pydict({"file": [fresh] * len(offsets), "offset": pa.array(offsets, pa.int64()), "size": pa.array(sizes, pa.int64())})

    rows = _spread(manifest.select("file"), "file").mapInArrow(rewrite, "file string, offset long, size long")
    return materialize(rows, "index")


def _number(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def parse_member(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of one record."""
    whole = zlib.decompress(data, 31)
    at = whole.index(b"\r\n\r\n") + 4
    fields = headers(whole[: at - 4])
    body = whole[at : at + int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size, digest = int(headers(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    page_id, kind = _number(fields["warc-record-id"]), fields["warc-type"]
    if kind == "revisit":
        return page_id, size, digest, kind, _number(fields["warc-refers-to"])
    if len(payload) != size or payload_digest(payload) != digest:
        raise ValueError(f"record of page {page_id} is damaged")
    return page_id, size, digest, kind, None


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every indexed record."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open_folder(folder)
        name, source = None, None
        for batch in batches:
            out = []
            for file, offset, size in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    name, source = file, system.open_input_file(f"{path}/{file}")
                out.append(parse_member(source.read_at(size, offset)))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rows = _spread(index, "file").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back all pages, in a new folder among the intermediate tables."""
    spark = pages.sparkSession
    folder = qualified(spark, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    return read_archives(normalise(write_archives(pages, folder), folder), folder)
