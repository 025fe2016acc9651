"""Web archives in ZIP packages: written by tasks, read back by byte ranges.

A package is a ZIP file whose members are stored, not deflated:

    archive/data.warc.gz   WARC records, each a gzip member of its own
    indexes/index.cdxj     a line for each record: page, time and a JSON object
                           with the record's offset and length in the archive

Reading never extracts a member.  The end of central directory record is looked
for in the file's last bytes, and the ZIP64 locator and record where its fields
are full; the central directory names the members, whose sizes and offsets may
be in ZIP64 extra fields; a member's data starts behind its local header.  The
index member gives the records' ranges, which are dealt to tasks in runs of
about ``RUN_BYTES``; a task reads its run in one range and unpacks the records.

Of pages with equal payloads (the html in UTF-8; null counts as empty) of
``least`` bytes and more, that with the largest page_id is written as a
response, and the others as revisits that name it and hold HTTP headers only.
The smaller ones are all responses.  Of equal page_ids one row is the response;
null ids are the smallest, and a revisit of one refers to null.  Every row is
written, also repeated ones; an empty table gives no package and no rows.  A
page of any length is one record.

Files are written through ``pyarrow.fs`` (local or mounted folders, hdfs, s3,
gs) below the shared folder, under names with the task attempt in them, and
only files that a finished task reported are read, so a task that runs again
leaves no trace in the result.  A record of a file that Spark reads differs
from its digest: the run fails.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import BROADCAST_GROUPS, checkpoint_root, join_groups, keyed, materialize, texts
from .text import give_back, pieces

# Signatures, sizes and marks of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_SIZE, CENTRAL_SIZE, END_SIZE, END64_SIZE, LOCATOR_SIZE = 30, 46, 22, 56, 20
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
ZIP64_EXTRA = 1
# WARC fields.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 32 << 20
RUN_BYTES = 4 << 20
READ_AHEAD = 1 << 20
DATE = "1970-01-01T00:00:00Z"
LEAST_BYTES = 0


# ---------------------------------------------------------------- ZIP files

def _dos_entry(name: bytes, crc: int, size: int, offset: int, zip64: bool) -> tuple[bytes, bytes]:
    """(local header, central directory entry) of a stored member."""
    big = zip64 or size >= FULL32 or offset >= FULL32
    version, date = (45, 33) if big else (20, 33)
    shown = FULL32 if big else size
    extra = struct.pack("<HHQQ", ZIP64_EXTRA, 16, size, size) if big else b""
    local = LOCAL + struct.pack("<HHHHHIIIHH", version, 0x800, 0, 0, date, crc, shown, shown, len(name), len(extra)) + name + extra
    extra = struct.pack("<HHQQQ", ZIP64_EXTRA, 24, size, size, offset) if big else b""
    central = CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", version, version, 0x800, 0, 0, date, crc, shown, shown, len(name),
                                    len(extra), 0, 0, 0, 0, FULL32 if big else offset) + name + extra
    return local, central


def write_zip(out, members: list[tuple[str, bytes]], zip64: bool = False, comment: bytes = b"") -> int:
    """Writes stored members to a binary file; returns its size.  ZIP64
    records are written where they are needed or asked for."""
    at, directory = 0, []
    for name, data in members:
        local, central = _dos_entry(name.encode(), zlib.crc32(data), len(data), at, zip64)
        out.write(local)
        out.write(data)
        directory.append(central)
        at += len(local) + len(data)
    start, size, n = at, sum(map(len, directory)), len(directory)
    end = b"".join(directory)
    if zip64 or n >= FULL16 or start >= FULL32 or size >= FULL32:
        end += END64 + struct.pack("<QHHIIQQQQ", END64_SIZE - 12, 45, 45, 0, 0, n, n, size, start)
        end += LOCATOR64 + struct.pack("<IQI", 0, start + size, 1)
        n, size, start = FULL16, FULL32, FULL32
    end += END + struct.pack("<HHHHIIH", 0, 0, n, n, size, start, len(comment)) + comment
    out.write(end)
    return at + len(end)


class ZipPackage:
    """The members of a ZIP file that can be read by ranges: ``read_at(at,
    size)`` gives bytes of a file of ``size`` bytes."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        self.members: dict[str, tuple[int, int, int]] = {}  # name: (method, size, local header's offset)
        n, length, start, base = self._directory(size)
        raw = read_at(base + start, length)
        at = 0
        for _ in range(n):
            if raw[at:at + 4] != CENTRAL:
                raise ValueError("central directory entry expected")
            flags, method, packed, plain, k_name, k_extra, k_note = struct.unpack_from("<4xHH8xIIHHH", raw, at + 4)
            offset, = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + CENTRAL_SIZE:at + CENTRAL_SIZE + k_name]
            extra = raw[at + CENTRAL_SIZE + k_name:at + CENTRAL_SIZE + k_name + k_extra]
            plain, packed, offset = self._full(extra, plain, packed, offset)
            if flags & 1:
                raise ValueError("encrypted member")
            self.members[name.decode("utf-8" if flags & 0x800 else "cp437")] = method, packed, base + offset
            at += CENTRAL_SIZE + k_name + k_extra + k_note

    def _directory(self, size: int) -> tuple[int, int, int, int]:
        """(entries, bytes, offset of the central directory, bytes before the
        archive's start)."""
        tail_at = max(0, size - END_SIZE - FULL16)
        tail = self.read_at(tail_at, size - tail_at)
        at = tail.rfind(END)
        while at >= 0:
            if at + END_SIZE <= len(tail) and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        end = tail_at + at
        if FULL16 == n or FULL32 in (length, start):
            where = self.read_at(end - LOCATOR_SIZE, LOCATOR_SIZE) if end >= LOCATOR_SIZE else b""
            if where[:4] == LOCATOR64:
                at64, = struct.unpack_from("<Q", where, 8)
                first = self.read_at(at64, END64_SIZE)
                if first[:4] != END64:  # bytes stand before the archive: the record is right before its locator
                    at64 = end - LOCATOR_SIZE - END64_SIZE
                    first = self.read_at(at64, END64_SIZE)
                if first[:4] != END64:
                    raise ValueError("no ZIP64 end of central directory")
                n, length, start = struct.unpack_from("<QQQ", first, 32)
                return n, length, start, at64 - length - start
        return n, length, start, end - length - start

    @staticmethod
    def _full(extra: bytes, plain: int, packed: int, offset: int) -> tuple[int, int, int]:
        """Sizes and offset, from the ZIP64 extra field where they are full."""
        values, at = [plain, packed, offset], 0
        while at + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, at)
            if kind == ZIP64_EXTRA:
                k = at + 4
                for i, v in enumerate(values):
                    if v == FULL32:
                        values[i], = struct.unpack_from("<Q", extra, k)
                        k += 8
            at += 4 + length
        return values[0], values[1], values[2]

    def place(self, name: str) -> tuple[int, int]:
        """(offset in the file, size) of a stored member's data."""
        method, size, at = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is not stored")
        head = self.read_at(at, LOCAL_SIZE)
        if head[:4] != LOCAL:
            raise ValueError("local header expected")
        k_name, k_extra = struct.unpack_from("<HH", head, 26)
        return at + LOCAL_SIZE + k_name + k_extra, size


# ---------------------------------------------------------------- records

def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def _line(value: str) -> str:
    """A header value: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def warc_record(page_id, url: str | None, payload: bytes, revisit: bool, refers_to, date: str = DATE) -> tuple[bytes, str]:
    """(one gzip member with the record, the payload's digest)."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _line(url)))
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    fields.append(("WARC-Payload-Digest", "sha1:" + digest))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to))]
        if refers_to is not None:
            fields.append(("X-Refers-To-Page-ID", refers_to))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush(), digest


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def parse_record(packed: bytes) -> dict:
    """A record's fields and block from its gzip member."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    fields = _headers(head)
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and payload_digest(payload) != digest:
        raise ValueError(f"record {fields['warc-record-id']}: wrong digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
            "refers_to": number("x-refers-to-page-id"), "payload_digest": digest, "payload": None if revisit else payload,
            "payload_bytes": int(_headers(http)["content-length"]) if revisit else len(payload)}


# ---------------------------------------------------------------- writing

def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a URI or local path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


class _Package:
    """One package under way."""

    def __init__(self):
        self.archive, self.index = io.BytesIO(), []

    def add(self, page_id, url, payload: bytes, revisit: bool, refers_to) -> None:
        record, digest = warc_record(page_id, url, payload, revisit, refers_to)
        note = {"url": url, "digest": "sha1:" + digest, "mime": "warc/revisit" if revisit else "text/html",
                "offset": self.archive.tell(), "length": len(record)}
        self.index.append(f"{'-' if page_id is None else page_id} {DATE} {json.dumps(note)}\n")
        self.archive.write(record)

    def write(self, folder: str, name: str) -> int:
        system, base = _place(folder)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{name}") as out:
            return write_zip(out, [(ARCHIVE, self.archive.getvalue()), (INDEX, "".join(self.index).encode())])


def _write_packages(folder: str, package_bytes: int):
    def run(batches):
        task = TaskContext.get()
        package, made = _Package(), 0

        def flush():
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{made:05d}.wacz"
            size = package.write(folder, name)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(package.index)], pa.int64()),
                                               pa.array([size], pa.int64())], names=["file", "n_records", "bytes"])

        for b in pieces(batches, 2, 1 << 20):
            for page_id, url, html, revisit, refers_to in zip(*(b.column(i).to_pylist() for i in range(5))):
                package.add(page_id, url, (html or "").encode(), revisit, refers_to)
                if package.archive.tell() >= package_bytes:
                    yield flush()
                    package, made = _Package(), made + 1
        if package.index:
            yield flush()
    return run


def page_fates(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(row, refers_to) of the rows (row, page_id, html) that revisit another
    one."""
    payload = F.coalesce("html", F.lit(""))
    size = F.octet_length(payload)
    p = pages.select("row", "page_id", F.sha2(payload, 256).alias("sha"), size.alias("size")).where(F.col("size") >= least)
    p = materialize(p.drop("size"), "payloads")
    # of equal page_ids the largest row is the response; null ids come first
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "row")).alias("best")
    groups = p.groupBy("sha").agg(best, F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups.select("sha", F.col("best.page_id").alias("refers_to"), F.col("best.row").alias("first"), "n"), "payload-groups")
    return join_groups(p, groups, "sha", "n").where("row <> first").select("row", "refers_to")


def write_packages(pages: DataFrame, folder: str, least: int = LEAST_BYTES, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes all pages (page_id, url, html) as packages into a shared folder;
    returns (file, n_records, bytes) of the packages that were finished."""
    p = pages.select(F.col("page_id").alias("doc_id"), "url", "html")
    p, _ = keyed(p.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("url").cast("string").alias("url"),
                          F.col("html").cast("string").alias("html")))
    p = p.withColumnRenamed("doc_id", "page_id")
    fates = materialize(page_fates(p.select("row", "page_id", "html"), least).withColumn("revisit", F.lit(True)), "revisits")
    if fates.count() <= BROADCAST_GROUPS:
        fates = F.broadcast(fates)
    rows = p.join(fates, "row", "left").select("page_id", "url", "html", F.coalesce("revisit", F.lit(False)).alias("revisit"), "refers_to")
    return materialize(rows.mapInArrow(_write_packages(folder, package_bytes), "file string, n_records long, bytes long"), "packages")


# ---------------------------------------------------------------- reading

def index_lines(raw: bytes) -> Iterator[tuple[int, int]]:
    """(offset, length) of each record named by an index member."""
    for line in raw.decode().splitlines():
        if "{" in line:
            note = json.loads(line[line.index("{"):])
            yield int(note["offset"]), int(note["length"])


def _runs_of_records(run_bytes: int):
    """From packages: (file, offset, lengths) of runs of records."""
    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                system, inner = _place(path)
                with system.open_input_file(inner) as f:
                    def read_at(at, n):
                        f.seek(at)
                        return f.read(n)

                    package = ZipPackage(read_at, f.size())
                    base, _ = package.place(ARCHIVE)
                    at, size = package.place(INDEX)
                    found = sorted(index_lines(read_at(at, size)))
                out, first, lengths = [], 0, []
                for offset, length in found:
                    if lengths and (offset != first + sum(lengths) or sum(lengths) >= run_bytes):
                        out.append((path, base + first, lengths))
                        lengths = []
                    if not lengths:
                        first = offset
                    lengths.append(length)
                if lengths:
                    out.append((path, base + first, lengths))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()),
                     pa.array([x[2] for x in out], pa.list_(pa.int64()))], names=["file", "offset", "lengths"])
    return run


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.large_binary())])


def _read_records(with_payload: bool):
    def run(batches):
        for b in batches:
            for path, offset, lengths in zip(*(b.column(i).to_pylist() for i in range(3))):
                system, inner = _place(path)
                rows, kept = [], 0
                with system.open_input_file(inner) as f:
                    f.seek(offset)
                    for length in lengths:  # a run is read on, record by record
                        r = parse_record(f.read(length))
                        kept += len(r["payload"] or b"") if with_payload else 0
                        rows.append(r if with_payload else r | {"payload": None})
                        if kept >= READ_AHEAD:
                            yield _batch(rows)
                            rows, kept = [], 0
                if rows:
                    yield _batch(rows)
        give_back()
    return run


def _batch(rows: list[dict]) -> pa.RecordBatch:
    b = pa.RecordBatch.from_pylist(rows, schema=_RECORD)
    return b.set_column(6, "payload", b.column(6).cast(pa.binary()))


def read_packages(spark: SparkSession, files: DataFrame, with_payload: bool = False, run_bytes: int = RUN_BYTES) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and,
    if asked for, payload of the records of the packages (column ``file``).
    A package is opened by one task; its runs are dealt to all."""
    runs = materialize(files.select("file").mapInArrow(_runs_of_records(run_bytes), "file string, offset long, lengths array<long>"), "record-runs")
    deal = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
    out = runs.repartition(deal, "file", "offset").mapInArrow(_read_records(with_payload), RECORD)
    return out if with_payload else out.drop("payload")


def op13(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all pages."""
    folder = f"{checkpoint_root(spark)}/packages-{uuid.uuid4().hex}"
    files = write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    out = read_packages(spark, files)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
