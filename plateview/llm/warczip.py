"""WARC archives in ZIP packages: written by tasks, read by ranges.

A package holds stored members: ``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.cdxj``, a line per record with its offset and length. The reader parses the end record,
its ZIP64 locator and the central directory, finds the index, and reads each record by its byte range;
nothing is extracted. Files are reached through ``pyarrow.fs``, so any store that it knows will do.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from plateview.sources.scratch import shared_folder, stored

MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 256 << 20    # payload after which a task starts another package
RANGE_RECORDS = 2_000        # records that one read task fetches from a package
REVISIT_FROM = 1_000         # smaller payloads are always stored whole
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- the package format ------------------------------------------------------------------

def open_file(path: str):
    """A random-access input for a path or URI; on object stores every read is a range request."""
    store, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return store.open_input_file(inner)


def read_range(source, offset: int, length: int) -> bytes:
    source.seek(offset)
    data = source.read(length)
    if len(data) != length:
        raise ValueError(f"the package ends inside a range: {offset}+{length}")
    return data


def directory(source) -> dict[str, tuple[int, int]]:
    """``{name: (offset of the data, size)}`` of the stored members, from the central directory.

    Counts, sizes and offsets of all ones are taken from the ZIP64 records. A compressed member
    raises, for its records have no byte ranges.
    """
    source.seek(0, 2)
    total = source.tell()
    tail_size = min(total, 22 + 0xFFFF)
    tail = read_range(source, total - tail_size, tail_size)
    at = tail.rfind(b"PK\x05\x06")
    # The mark may also stand in the comment; at the real one the comment ends with the file.
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    entries, size, start = struct.unpack_from("<HII", tail, at + 10)
    if entries == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = total - tail_size + at - 20
        mark, _, where, _ = struct.unpack("<4sIQI", read_range(source, locator, 20))
        if mark != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        mark, entries, size, start = struct.unpack("<4s28xQQQ", read_range(source, where, 56))
        if mark != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
    listing, found, p = read_range(source, start, size), {}, 0
    for _ in range(entries):
        if listing[p: p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method, packed, plain, name_size, extra_size, note_size, local = struct.unpack_from("<8xHH8xIIHHH8xI", listing, p)
        name = listing[p + 46: p + 46 + name_size].decode("utf-8" if flags & 0x800 else "cp437")
        extra = listing[p + 46 + name_size: p + 46 + name_size + extra_size]
        q = 0
        while q + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, q)
            if kind == 1:   # 64-bit values, present only for the fields that are all ones, in this order
                wide = list(struct.unpack_from(f"<{length // 8}Q", extra, q + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            q += 4 + length
        p += 46 + name_size + extra_size + note_size
        if name.endswith("/"):
            continue
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        head = read_range(source, local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        found[name] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
    return found


def index_entries(source) -> list[tuple[int, int]]:
    """Absolute (offset, length) of every record that the package's index lists."""
    members = directory(source)
    base, _ = members[MEMBER]
    entries = (json.loads(line.split(b" ", 2)[2]) for line in read_range(source, *members[INDEX]).splitlines() if line)
    return [(base + int(e["offset"]), int(e["length"])) for e in entries]


# --- the record format -------------------------------------------------------------------

def record_bytes(record_id: str, uri: str, kind: str, payload: bytes, headers: dict) -> bytes:
    """One WARC record as a gzip member; a revisit has no payload of its own."""
    block = b"" if kind == "revisit" else payload
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{record_id}>", "WARC-Target-URI": uri, **headers,
             "Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(packed: bytes) -> tuple[dict, bytes]:
    data = zlib.decompress(packed, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return headers, rest[:size]


class PackageWriter:
    """Collects records into one package on a store; the index becomes the last member."""

    def __init__(self, path: str):
        store, inner = pafs.FileSystem.from_uri(path)
        self.path, self.lines, self.payload, self.offset = path, [], 0, 0
        self.sink = store.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(MEMBER, "w", force_zip64=True)

    def add(self, uri: str, digest: str, record: bytes, payload_size: int) -> None:
        place = json.dumps({"url": uri, "digest": digest, "offset": self.offset, "length": len(record)})
        self.lines.append(f"{json.dumps(uri).replace(' ', '%20')} - {place}\n")
        self.member.write(record)
        self.offset += len(record)
        self.payload += payload_size

    def close(self) -> tuple[str, int]:
        self.member.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as index:
            index.write("".join(self.lines).encode())
        self.zip.close()
        self.sink.close()
        return self.path, len(self.lines)


# --- jobs --------------------------------------------------------------------------------

def with_revisits(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """``(page_id, url, html, digest, size, refers_to)``: the later page that holds an equal payload, if any.

    Of equal payloads of at least ``least`` bytes the one with the largest page_id is stored; rows that repeat that id and
    payload are all stored. Only digests and ids are grouped; the html moves once, by page_id.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary"))
    keyed = pages.select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    large = keyed.filter(F.col("size") >= least)
    last = large.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    again = (large.join(last.drop("_n"), ["digest", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
             .select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to").distinct())
    whole = pages.select("page_id", "url", "html", F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    return whole.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select(
        *whole.columns, "refers_to")


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write ``with_revisits`` rows; ``(path, records)`` of the packages of the attempts that succeeded.

    Every attempt writes under names of its own, and only names that a finished task returned are ever read,
    so lost and repeated tasks leave no double records.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for page_id, url, html, digest, size, refers_to in zip(*(column.to_pylist() for column in batch.columns)):
                if writer is None:
                    writer = PackageWriter(f"{folder}/{uuid.uuid4().hex}.wacz")
                kind = "response" if refers_to is None else "revisit"
                name = "" if page_id is None else str(page_id)
                headers = {"WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(size)}
                if refers_to is not None:
                    headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
                uri = "".join(c for c in (url or "") if c >= " ")
                writer.add(uri, digest, record_bytes(name, uri, kind, (html or "").encode(), headers), size)
                if writer.payload >= package_bytes:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    table = pages.select("page_id", "url", "html", "digest", "size", "refers_to")
    return stored(table.mapInArrow(run, "path string, records long"), "packages")


def read_packages(paths: DataFrame, range_records: int = RANGE_RECORDS) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload)`` of all records in packages of ``paths(path)``.

    Directories and indexes are read first; ranges of ``range_records`` records are then spread over the tasks, so
    one large package is read by many. A response whose payload does not match its digest raises.
    ``payload`` is NULL for revisits: it is that of the record they refer to.
    """
    def list_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_file(path) as source:
                    entries = index_entries(source)
                for i in range(0, len(entries), range_records):
                    part = entries[i: i + range_records]
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([[a for a, _ in part]], pa.list_(pa.int64())),
                                                      pa.array([[b for _, b in part]], pa.list_(pa.int64()))], names=["path", "offsets", "lengths"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                with open_file(path) as source:
                    rows, held = [], 0
                    for offset, length in zip(offsets, lengths):
                        rows.append(_row(*parse_record(read_range(source, offset, length))))
                        held += len(rows[-1][-1] or b"")
                        if held >= 8 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    ranges = stored(paths.select("path").mapInArrow(list_ranges, "path string, offsets array<long>, lengths array<long>"), "ranges")
    # An explicit number, so that the few rows that stand for much reading are not put into one task.
    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(tasks, F.col("path"), F.col("offsets")[0]).mapInArrow(
        fetch, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _number(value: str) -> int | None:
    digits = value.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _row(headers: dict, payload: bytes) -> tuple:
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"{headers['WARC-Record-ID']}: the payload does not match its digest")
    size = int(headers["X-Payload-Length"]) if revisit else len(payload)
    return (_number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size, digest, headers["WARC-Type"],
            _number(headers["WARC-Refers-To"]) if revisit else None, None if revisit else payload)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def package_folder(spark: SparkSession) -> str:
    """A new folder for packages in the shared folder, as a URI."""
    base = shared_folder(spark)
    folder = f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/packages-{uuid.uuid4().hex}"
    store, inner = pafs.FileSystem.from_uri(folder)
    store.create_dir(inner, recursive=True)
    return folder


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages (``page_id, url, html``; other columns are left out) and read the records back.

    A NULL html is an empty payload, a NULL url an empty one, a NULL page_id stays NULL. Repeated rows are records
    of their own. Control characters are taken out of urls, which stand in header lines. No pages give no rows.
    """
    folder = package_folder(pages.sparkSession)
    return read_packages(write_packages(with_revisits(pages), folder))
