import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from plateview.llm import warczip


def _package(monkeypatch=None, count=3, note=b""):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as z:
        z.comment = note
        for i in range(count):
            z.writestr(f"m/{i}.bin", bytes([i]) * (i + 1))
        with z.open("wide.bin", "w", force_zip64=True) as m:
            m.write(b"wide")
        z.writestr("folder/", b"")
    return sink.getvalue()


def _members(data):
    source = pa.BufferReader(data)
    return {name: warczip.read_range(source, at, size) for name, (at, size) in warczip.directory(source).items()}


def test_directory_finds_stored_members():
    want = {**{f"m/{i}.bin": bytes([i]) * (i + 1) for i in range(3)}, "wide.bin": b"wide"}
    assert _members(_package()) == want
    assert _members(_package(note=b"a comment with PK\x05\x06 inside")) == want


def test_zip64_records(monkeypatch):
    """With the limits lowered, the writer puts counts, sizes and offsets into ZIP64 records."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    data = _package(count=40)
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    # The writer keeps the small values in the plain fields, too; all ones force the reader to the wide ones.
    end = data.rfind(b"PK\x05\x06")
    data = data[:end + 8] + b"\xff" * 12 + data[end + 20:]
    assert len(_members(data)) == 41 and _members(data)["m/39.bin"] == bytes([39]) * 40


def test_compressed_members_and_other_files_raise():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"a" * 100)
    with pytest.raises(ValueError, match="stored"):
        _members(sink.getvalue())
    with pytest.raises(ValueError, match="not a ZIP"):
        _members(b"nothing of the kind")
    with pytest.raises(ValueError):
        _members(_package()[:-30])


def test_records_are_read_by_range(tmp_path):
    path = f"file://{tmp_path}/one.wacz"
    writer = warczip.PackageWriter(path)
    bodies = [b"", b"<p>\r\n\r\n</p>", "é".encode() * 900]
    for i, body in enumerate(bodies):
        digest = hashlib.sha1(body).hexdigest()
        writer.add(f"http://x/{i} y", digest, warczip.record_bytes(str(i), "http://x/", "response", body,
                   {"WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(len(body))}), len(body))
    assert writer.close() == (path, 3)
    with warczip.open_file(path) as source:
        entries = warczip.index_entries(source)
        parsed = [warczip.parse_record(warczip.read_range(source, *e)) for e in reversed(entries)]
    assert [p for _, p in parsed] == bodies[::-1]


def _pages():
    long = "<p>" + "x" * 1200 + "é</p>"
    return [(1, "http://a/", long), (2, "http://b/", long), (7, "http://c/", long), (3, "http://d/", "short"), (4, "u\nv", "short"),
            (5, None, None), (None, "http://e/", long), (8, "http://f/", ""), (7, "http://c/", long), (9, "http://g/", "y" * 1000), (10, "h", "y" * 1000)]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warczip, "RANGE_RECORDS", 2)
    table = spark.createDataFrame([(*p, "x") for p in _pages()], "page_id long, url string, html string, digest string")
    found = sorted((tuple(r) for r in warczip.round_trip(table).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()), key=str)
    want = []
    for i, _, t in _pages():
        body = (t or "").encode()
        last = {1204: 7, 1205: 7, 1000: 10}.get(len(body)) if len(body) >= 1000 else None
        last = max(j for j, _, u in _pages() if j is not None and u == t) if len(body) >= 1000 else None
        again = last is not None and last != i
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last if again else None, None if again else body))
    assert [(*r[:5], bytes(r[5]) if r[5] is not None else None) for r in found] == sorted(want, key=str)
    assert warczip.round_trip(table.limit(0)).collect() == []


def test_many_packages(spark, monkeypatch):
    table = spark.createDataFrame(_pages(), "page_id long, url string, html string")
    folder = warczip.package_folder(spark)
    packages = warczip.write_packages(warczip.with_revisits(table), folder, package_bytes=1)
    assert packages.count() > 4 and packages.groupBy().sum("records").first()[0] == len(_pages())
    assert warczip.read_packages(packages).count() == len(_pages())
