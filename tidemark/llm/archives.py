"""WARC records in ZIP archives: write them, parse directories and range-read records without extraction."""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import text_batches
from tidemark.session import cut, fresh_path

LEAST_REVISIT = 1000  # bytes of a payload that another record may refer to
ARCHIVE_BYTES = 32 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx.gz"
READ_BYTES = 4 << 20  # of stored records that one task reads
STORED, DEFLATED = 0, 8
DATE = "2024-01-01T00:00:00Z"

_LOCAL = struct.Struct("<4s5H3I2H")
_CENTRAL = struct.Struct("<4s6H3I5H2I")
_END64 = struct.Struct("<4sQ2H2I4Q")
_LOCATOR = struct.Struct("<4sIQI")
_END = struct.Struct("<4s4H2IH")
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


def store(write: Callable[[bytes], None], members: list[tuple[str, list[bytes]]]) -> None:
    """Write a ZIP of stored members, with ZIP64 sizes, offsets and end records throughout."""
    at, central = 0, []
    for name, chunks in members:
        size, crc, raw = sum(map(len, chunks)), 0, name.encode()
        for c in chunks:
            crc = zlib.crc32(c, crc)
        extra = struct.pack("<2H2Q", 1, 16, size, size)
        write(_LOCAL.pack(b"PK\3\4", 45, 0x800, STORED, 0, 0x21, crc, _FULL32, _FULL32, len(raw), len(extra)) + raw + extra)
        for c in chunks:
            write(c)
        more = struct.pack("<2H3Q", 1, 24, size, size, at)
        central.append(_CENTRAL.pack(b"PK\1\2", 45, 45, 0x800, STORED, 0, 0x21, crc, _FULL32, _FULL32, len(raw), len(more), 0, 0, 0, 0, _FULL32) + raw + more)
        at += _LOCAL.size + len(raw) + len(extra) + size
    directory = b"".join(central)
    write(directory)
    write(_END64.pack(b"PK\6\6", _END64.size - 12, 45, 45, 0, 0, len(central), len(central), len(directory), at))
    write(_LOCATOR.pack(b"PK\6\7", 0, at + len(directory), 1))
    write(_END.pack(b"PK\5\6", 0, 0, _FULL16, _FULL16, _FULL32, _FULL32, 0))


def members(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int, int]]:
    """Members of an archive: name -> (offset of the data, bytes, compression), from its central directory.

    `read(offset, length)` reads a range. The end record may be followed by a comment. Where it holds a
    full field, the ZIP64 end record is read instead; a member's full fields are in its ZIP64 extra field.
    """
    tail_at = max(0, size - _END.size - _FULL16)
    tail = read(tail_at, size - tail_at)
    end_at = len(tail)
    while True:
        end_at = tail.rfind(b"PK\5\6", 0, end_at)
        if end_at < 0:
            raise ValueError("no end of central directory: not a ZIP archive, or cut short")
        if len(tail) - end_at >= _END.size and end_at + _END.size + _END.unpack_from(tail, end_at)[7] == len(tail):
            break
    *_, count, length, start, _ = _END.unpack_from(tail, end_at)
    if count == _FULL16 or length == _FULL32 or start == _FULL32:
        place = tail_at + end_at - _LOCATOR.size
        mark, _, end64, _ = _LOCATOR.unpack(read(place, _LOCATOR.size)) if place >= 0 else (b"", 0, 0, 0)
        if mark == b"PK\6\7":
            record = _END64.unpack(read(end64, _END64.size))
            if record[0] != b"PK\6\6":
                raise ValueError("broken ZIP64 end record")
            count, length, start = record[7], record[8], record[9]
    directory, at, out = read(start, length), 0, {}
    for _ in range(count):
        f = _CENTRAL.unpack_from(directory, at)
        if f[0] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, packed, plain, n, e, c, local = f[4], f[8], f[9], f[10], f[11], f[12], f[16]
        name = directory[at + _CENTRAL.size : at + _CENTRAL.size + n].decode("utf-8")
        extra = directory[at + _CENTRAL.size + n : at + _CENTRAL.size + n + e]
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<2H", extra)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == _FULL32 else plain
                packed = wide.pop(0) if packed == _FULL32 else packed
                local = wide.pop(0) if local == _FULL32 else local
            extra = extra[4 + width :]
        head = _LOCAL.unpack(read(local, _LOCAL.size))
        out[name] = (local + _LOCAL.size + head[9] + head[10], packed, method)
        at += _CENTRAL.size + n + e + c
    return out


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, is_revisit: bool) -> bytes:
    """One gzip member with a WARC record. A revisit has no body; its headers tell the digest and size of the payload."""
    body = b"" if is_revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if is_revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"
    return gzip.compress(raw, compresslevel=1, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _number(urn: str) -> int | None:
    """The page of an id as the writer here makes it; ids of other writers are no numbers."""
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if re.fullmatch(r"-?[0-9]+", text) else None


def _writer(folder: str, limit: int):
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        data: list[bytes] = []
        index: list[str] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wacz"  # a repeated task writes other files; only names that come back count
            with where.open_output_stream(f"{base}/{name}") as out:
                store(out.write, [(DATA, data), (INDEX, [gzip.compress("".join(index).encode(), 1, mtime=0)])])
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64())], names=["archive", "records"])

        for batch in text_batches(batches):
            for r in batch.to_pylist():
                revisit = r["refers_to"] is not None
                payload = b"" if revisit else (r["html"] or "").encode("utf-8", "surrogatepass")
                made = record(r["page_id"], r["url"], payload, r["payload_digest"], r["payload_bytes"], r["refers_to"], revisit)
                index.append(f"{size} {len(made)}\n")
                data.append(made)
                size += len(made)
                if size >= limit:
                    yield close()
                    data, index, size = [], [], 0
        if data:
            yield close()

    return tasks


def roles(pages: DataFrame) -> DataFrame:
    """Adds payload_bytes, payload_digest and refers_to to (page_id, url, html).

    Of equal payloads of at least LEAST_REVISIT bytes the largest page_id is the response (every row that
    has it), the others refer to it; a group without any page_id has no revisits. Only digests are
    compared. The largest id is added up before the shuffle; the join has one row per repeated digest.
    """
    bytes_ = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    told = pages.select("page_id", "url", "html", F.octet_length(bytes_).cast("long").alias("payload_bytes"), F.sha1(bytes_).alias("payload_digest"))
    groups = told.filter(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    groups = groups.filter("n > 1 and top is not null").select(F.col("payload_digest").alias("d"), "top")
    joined = told.join(groups, F.col("payload_digest") == F.col("d"), "left")
    other = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(other, F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a WARC record per row of `pages` (page_id, url, html) into archives in `folder`; returns (archive, records).

    Each task writes archives of about `limit` bytes of records through the file system of the folder's
    scheme. The list is written too, so an archive that a failed task left behind is never read.
    """
    where, base = fs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    return cut(roles(pages).mapInArrow(_writer(folder, limit), "archive string, records long"))


def _index_lines(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """(file name, offset, length) of every record that an index tells of.

    A line is CDXJ (key, time and JSON with these three fields) or, as the writer here makes it, "offset length".
    """
    for line in raw.decode("utf-8").splitlines():
        start = line.find("{")
        if line.startswith("!"):  # a remark
            continue
        if start >= 0:
            told = json.loads(line[start:])
            yield str(told["filename"]), int(told["offset"]), int(told["length"])
        elif line.strip():
            offset, length = line.split()
            yield DATA, int(offset), int(length)


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column("archive").to_pylist():
            where, path = fs.FileSystem.from_uri(archive)
            with where.open_input_file(path) as source:
                def read(at: int, n: int, source=source) -> bytes:
                    return source.read_at(n, at)

                found = members(read, source.size())
                rows = []
                for index in sorted(x for x in found if re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", x)):
                    at, n, method = found[index]
                    raw = read(at, n)
                    raw = zlib.decompress(raw, -15) if method == DEFLATED else raw
                    rows += _index_lines(gzip.decompress(raw) if index.endswith(".gz") else raw)
                places = []
                for name, offset, length in rows:
                    start, size, method = found.get(name) or found.get(f"archive/{name}") or (0, -1, STORED)
                    if method != STORED:
                        raise ValueError(f"{archive}: {name} is not stored, so its records cannot be read by range")
                    if offset + length > size:
                        raise ValueError(f"{archive}: index points outside {name}")
                    places.append((start + offset, length))
            yield pa.RecordBatch.from_arrays(
                [pa.array([archive] * len(places), pa.string()), pa.array([x for x, _ in places], pa.int64()), pa.array([k for _, k in places], pa.int64())],
                names=["archive", "at", "length"],
            )


def locate(archives: DataFrame) -> DataFrame:
    """(archive, at, length) of every record of (archive): from the archives' directories and stored indexes alone."""
    return archives.select("archive").mapInArrow(_locate, "archive string, at long, length long")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, source = None, None
    try:
        for batch in text_batches(batches, 256):
            out = []
            for archive, at, length in zip(*[batch.column(c).to_pylist() for c in ("archive", "at", "length")], strict=True):
                if archive != name:
                    if source is not None:
                        source.close()
                    where, path = fs.FileSystem.from_uri(archive)
                    name, source = archive, where.open_input_file(path)
                headers, body = parse_record(source.read_at(length, at))
                kind = headers["WARC-Type"]
                whole = kind == "response"
                out.append((
                    _number(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind,
                    len(body) if whole else int(headers.get("X-Payload-Length", 0)),
                    hashlib.sha1(body).hexdigest() if whole else headers.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
                    None if whole else _number(headers.get("WARC-Refers-To", "")), body if whole else None,
                ))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"],
            )
    finally:
        if source is not None:
            source.close()


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_records(places: DataFrame) -> DataFrame:
    """Records at (archive, at, length), each by one range read; a revisit has no payload of its own.

    Places are spread by range, so that an archive's neighbours are read together and large archives by many tasks.
    There are as many tasks as the records' bytes ask for, since the places themselves are few bytes.
    """
    places = cut(places)
    size = places.agg(F.sum("length")).first()[0] or 0
    ordered = places.repartitionByRange(max(1, -(-size // READ_BYTES)), "archive", "at").sortWithinPartitions("archive", "at")
    return ordered.mapInArrow(_reader, RECORD)


def archive_table(pages: DataFrame) -> DataFrame:
    """Write all `pages` to archives in the shared folder, read them back; a row per record, as told by the archives.

    Null html is an empty payload, null page_ids and urls stay null, repeated rows are records of their own.
    Empty input writes no archive.
    """
    spark: SparkSession = pages.sparkSession
    folder = fresh_path(spark, "archives")
    folder = folder if "://" in folder else folder if folder.startswith("file:") else f"file://{folder}"
    written = write_archives(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), folder)
    return read_records(locate(written)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS top, count(*) AS n FROM p WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN g.n > 1 AND p.page_id IS DISTINCT FROM g.top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.n > 1 AND p.page_id IS DISTINCT FROM g.top THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND g.top IS NOT NULL
"""
