"""WARC records in ZIP archives: a writer, and a reader that parses the ZIP directories and reads ranges.

An archive holds stored (uncompressed) members: archive/data.warc.gz, one gzip member a record, and indexes/index.cdxj,
a CDXJ line a record (key, time, and a JSON object with file name, offset and length).  The reader finds the
end-of-central-directory record (or its ZIP64 form), walks the central directory (ZIP64 extra fields included), locates
each stored member behind its local header, reads the indexes (gzipped ones too), and then only the ranges of the
records; nothing is extracted.  Archives are rows of a table that holds them as blocks of bytes, or files: of those
the directories and indexes give a row for each record, and tasks read the records of one archive side by side, each
by its range of the file.

Edge cases: null html is an empty payload; payloads under min_bytes never revisit; of equal payloads the record of the
largest page_id is the response, so rows that repeat that page_id are all responses; a null page_id never is a
target and never revisits; a very long page has an archive of its own; a broken archive raises ValueError; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, need, scratch, table, tidy

RECORDS_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payload bytes in one archive; a larger record has an archive of its own.
ARCHIVE_BYTES = 8 << 20
_END, _END64, _LOCATOR64, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_MAX32 = 0xFFFFFFFF

# --------------------------------------------------------------------------- ZIP


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; zip64 forces the 64-bit forms that large archives need."""
    out, central, at = [], [], 0
    for name, data in members:
        raw, crc, wide = name.encode(), zlib.crc32(data), zip64 or len(data) >= _MAX32 or at >= _MAX32
        size = _MAX32 if wide else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        out += [struct.pack("<4sHHHHHIIIHH", _LOCAL, 45 if wide else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)), raw, extra, data]
        more = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        central += [struct.pack("<4sHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(more), 0, 0, 0, 0, _MAX32 if wide else at), raw, more]
        at += 30 + len(raw) + len(extra) + len(data)
    size, n = sum(map(len, central)), len(members)
    tail = b""
    if zip64 or at >= _MAX32 or n >= 0xFFFF:
        tail = struct.pack("<4sQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, at) + struct.pack("<4sIQI", _LOCATOR64, 0, at + size, 1)
        tail += struct.pack("<4sHHHHIIH", _END, 0, 0, 0xFFFF, 0xFFFF, _MAX32, _MAX32, 0)
    else:
        tail = struct.pack("<4sHHHHIIH", _END, 0, 0, n, n, size, at, 0)
    return b"".join([*out, *central, tail])


def zip_members(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int]]:
    """(offset, length) of the bytes of every stored member; read(offset, length) gives a range of the archive."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(_END, 0, max(0, len(tail) - 18))
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(_END, 0, end + 3)
    if end < 0:
        raise ValueError("no end of a central directory")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    if (n == 0xFFFF or _MAX32 in (length, start)) and tail_at + end >= 20:
        mark, _, where, _ = struct.unpack("<4sIQI", read(tail_at + end - 20, 20))
        if mark == _LOCATOR64:
            head = read(where, 56)
            if head[:4] != _END64:
                raise ValueError("no ZIP64 directory where its locator says")
            n, length, start = struct.unpack_from("<QQQ", head, 32)
    directory, found, at = read(start, length), {}, 0
    for _ in range(n):
        if directory[at : at + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        method, stored, whole, names, extras, comment, local = *struct.unpack_from("<H", directory, at + 10), *struct.unpack_from("<IIHHH", directory, at + 20), *struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + names].decode()
        extra, i = directory[at + 46 + names : at + 46 + names + extras], 0
        while i + 4 <= len(extra):
            kind, room = struct.unpack_from("<HH", extra, i)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{room // 8}Q", extra, i + 4))
                whole = wide.pop(0) if whole == _MAX32 else whole
                stored = wide.pop(0) if stored == _MAX32 else stored
                local = wide.pop(0) if local == _MAX32 else local
            i += 4 + room
        at += 46 + names + extras + comment
        if method == 0:
            head = read(local, 30)
            if head[:4] != _LOCAL:
                raise ValueError("broken local header")
            found[name] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), stored)
    return found


# --------------------------------------------------------------------------- WARC


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with the payload, or a revisit record without."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def archive(records: list[bytes], zip64: bool = False) -> bytes:
    """One ZIP of compressed records and their index."""
    packed = [_gzip(r) for r in records]
    index, at = [], 0
    for i, p in enumerate(packed):
        index.append(f"{i:012} 20240101000000 " + json.dumps({"filename": RECORDS_MEMBER.split("/")[1], "offset": str(at), "length": str(len(p))}) + "\n")
        at += len(p)
    return zip_stored([(RECORDS_MEMBER, b"".join(packed)), (INDEX_MEMBER, "".join(index).encode())], zip64)


def record_ranges(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) in the archive of every record that its indexes name."""
    members = zip_members(read, size)
    data = {name.removeprefix("archive/"): place for name, place in members.items() if name.startswith("archive/")}
    found = [name for name in members if re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", name)]
    if not data or not found:
        raise ValueError("no stored records or no index in the archive")
    for name in sorted(found):
        raw = read(*members[name])
        for line in (zlib.decompress(raw, 31) if name.endswith(".gz") else raw).decode().splitlines():
            if "{" not in line:
                continue  # a header line
            entry = json.loads(line[line.index("{") :])
            if entry["filename"] not in data:
                raise ValueError(f"the archive lacks {entry['filename']}")
            begin, room = data[entry["filename"]]
            at, length = int(entry["offset"]), int(entry["length"])
            if at + length > room:
                raise ValueError("the index points beyond the records")
            yield begin + at, length


def read_record(read: Callable[[int, int], bytes], at: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of the record in a range."""
    raw = read(at, length)
    return parse_record(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)


# --------------------------------------------------------------------------- operators


def write_archives(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """archive (binary): ZIP files with a record for every page; payloads seen before are revisits."""
    rows = need(pages, page_id="long", url="string", html="string").withColumn("payload", F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))).drop("html")
    rows = rows.withColumn("digest", F.sha1("payload"))
    targets = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1 and target is not null")
    targets = cut(targets.select(F.col("digest").alias("same"), "target"))
    marked = rows.join(targets, rows["digest"] == targets["same"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            ids, urls, digests, targets_ = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for page_id, url, payload, digest, target in zip(ids, urls, batch.column(2), digests, targets_):
                data = payload.as_py()
                held.append(record(page_id, url, data, digest, target if page_id is not None and target != page_id else None))
                size += len(data)
                if size > ARCHIVE_BYTES:
                    yield table("archive binary", archive=[archive(held)])
                    held, size = [], 0
            if held:
                yield table("archive binary", archive=[archive(held)])

    return marked.select("page_id", "url", "payload", "digest", "target").mapInArrow(run, "archive binary")


_RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _id(uri: str | None) -> int | None:
    """The page of a record's name; null for others' names."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def _rows(found: Iterator[tuple[dict[str, str], bytes]], at_once: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of records, of about so many bytes; payloads are held against their digests."""
    out: dict[str, list] = {k.split()[0]: [] for k in _RECORDS.split(", ")}
    size = 0
    for fields, payload in found:
        if fields["WARC-Type"] not in ("response", "revisit"):
            continue  # information about the archive, requests
        revisit = fields["WARC-Type"] == "revisit"
        digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
        if not revisit and "X-Payload-Length" in fields and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"])):
            raise ValueError("a payload differs from its digest")
        out["page_id"].append(_id(fields.get("WARC-Record-ID")))
        out["url"].append(fields.get("WARC-Target-URI"))
        out["record_type"].append(fields["WARC-Type"])
        out["refers_to"].append(_id(fields.get("WARC-Refers-To")) if revisit else None)
        out["payload_bytes"].append(int(fields.get("X-Payload-Length", len(payload))))
        out["payload_digest"].append(digest or hashlib.sha1(payload).hexdigest())
        out["payload"].append(None if revisit else payload)
        size += len(payload)
        if size >= at_once:
            yield table(_RECORDS.replace(", ", ","), **out)
            out, size = {k: [] for k in out}, 0
    yield table(_RECORDS.replace(", ", ","), **out)


def read_archives(archives: DataFrame, column: str = "archive") -> DataFrame:
    """A row a record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for a revisit).

    archives: a table with the bytes of archives in column, such as write_archives() returns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                if blob.is_valid:
                    data = memoryview(blob.as_buffer())

                    def read(at: int, n: int, data=data) -> bytes:
                        return bytes(data[at : at + n])

                    yield from _rows(read_record(read, *place) for place in record_ranges(read, len(data)))

    return archives.select(F.col(f"`{column}`").alias("archive")).mapInArrow(run, _RECORDS)


def _opened(path: str) -> pa.NativeFile:
    """A stored file for reads at any place: local, or of a store that pyarrow knows by its URI."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return system.open_input_file(at)


def read_files(spark: SparkSession, paths: str | list[str], parts: int | None = None) -> DataFrame:
    """The rows of read_archives() for archives that are files, of any size: paths as Spark's readers take them.

    Spark lists the files without reading them.  A task reads a file's directory and indexes; then the records' ranges
    are dealt over parts tasks (the session's shuffle partitions), in order of file and place, so a large archive is
    read by many.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns)):
                with _opened(path) as f:
                    found = list(record_ranges(lambda at, n, f=f: f.read_at(n, at), size))
                for b in range(0, len(found), 100_000):
                    own = found[b : b + 100_000]
                    yield table("path string,at long,length long", path=[path] * len(own), at=[a for a, _ in own], length=[n for _, n in own])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[dict[str, str], bytes]]:
            last, f = None, None
            for batch in batches:
                for path, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                    if path != last:
                        if f is not None:
                            f.close()
                        last, f = path, _opened(path)
                    yield read_record(lambda a, n, f=f: f.read_at(n, a), at, length)

        yield from _rows(each())

    found = files.repartition(parts, "path").mapInArrow(ranges, "path string, at long, length long")
    return found.repartitionByRange(parts, "path", "at").sortWithinPartitions("path", "at").mapInArrow(tidy(records), _RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Writes archives, stores them in the shared folder, and reads them back without the payloads."""
    with scratch(pages.sparkSession) as keep:
        archives = keep(cut(write_archives(pages, min_bytes)))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
