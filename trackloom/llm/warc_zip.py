"""WARC records in ZIP-packaged archives: a writer, and a reader that never extracts.

An archive is a ZIP file with stored members: archive/data.warc.gz holds one gzip member per record, and indexes/index.cdxj
one line per record with its offset and length there. The reader parses the end-of-central-directory record (or its ZIP64
form), walks the central directory, finds where the stored members' bytes begin, and reads records by byte range.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import lookup, materialize, new_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of records that one archive holds, and of neighbouring records that are read at once.
ARCHIVE_BYTES, READ_BYTES = 64 << 20, 4 << 20
#: Bytes of records that one task reads, about.
TASK_BYTES = 8 << 20
#: Payloads under this size are never revisits.
LEAST_REVISIT = 1_000
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


@dataclass
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Any store that pyarrow can open: a URI, or a local path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file with stored members; ZIP64 records where a value needs them, or always."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), len(out)
        big = zip64 or len(data) >= _MAX32 or at >= _MAX32
        size = _MAX32 if big else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        out += struct.pack("<4s5H3I2H", b"PK\3\4", 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        central += struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, _MAX32 if big else at) + raw + extra
    at, n = len(out), len(members)
    out += central
    if zip64 or at >= _MAX32 or n >= _MAX16:
        end = len(out)
        out += struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(central), at) + struct.pack("<4sIQI", b"PK\6\7", 0, end, 1)
        return bytes(out + struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, _MAX16, _MAX16, _MAX32, _MAX32, 0))
    return bytes(out + struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, n, n, len(central), at, 0))


def directory(file) -> list[Member]:
    """The central directory of an open file, by way of ZIP64 records where the end record says so."""
    file.seek(0, 2)
    size = file.tell()
    file.seek(max(0, size - 22 - _MAX16))
    tail = file.read()
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("not a ZIP file: no end-of-central-directory record")
    *_, count, length, start, _ = struct.unpack_from("<4s4H2IH", tail, at)
    if _MAX16 == count or _MAX32 in (length, start):
        mark, _, where, _ = struct.unpack_from("<4sIQI", tail, at - 20) if at >= 20 else (b"", 0, 0, 0)
        if mark == b"PK\6\7":
            file.seek(where)
            mark, *_, count, length, start = struct.unpack("<4sQ2H2I4Q", file.read(56))
            if mark != b"PK\6\6":
                raise ValueError("damaged ZIP64 end-of-central-directory record")
    file.seek(start)
    raw, at, members = file.read(length), 0, []
    for _ in range(count):
        head = struct.unpack_from("<4s6H3I5H2I", raw, at)
        if head[0] != b"PK\1\2":
            raise ValueError("damaged central directory")
        method, packed, full, n_name, n_extra, n_note, where = head[4], head[8], head[9], head[10], head[11], head[12], head[16]
        name, extra = raw[at + 46 : at + 46 + n_name], raw[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            wide = list(struct.unpack_from(f"<{min(n, 24) // 8}Q", extra, 4)) if kind == 1 else []
            if kind == 1:
                full = wide.pop(0) if full == _MAX32 and wide else full
                packed = wide.pop(0) if packed == _MAX32 and wide else packed
                where = wide.pop(0) if where == _MAX32 and wide else where
            extra = extra[4 + n :]
        members.append(Member(name.decode(), method, full, packed, where))
        at += 46 + n_name + n_extra + n_note
    return members


def begins(file, member: Member) -> int:
    """Where a stored member's bytes begin: its local header has name and extra lengths of its own."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    file.seek(member.header)
    mark, *_, n_name, n_extra = struct.unpack("<4s5H3I2H", file.read(30))
    if mark != b"PK\3\4":
        raise ValueError("damaged local header")
    return member.header + 30 + n_name + n_extra


def record_bytes(record: dict, payload: bytes) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the response's HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {record['size']}\r\n\r\n".encode()
    digest = base64.b32encode(bytes.fromhex(record["digest"])).decode()
    head = ["WARC/1.1", f"WARC-Type: {record['type']}", f"WARC-Record-ID: <urn:page:{record['id']}>", f"WARC-Target-URI: {record['url']}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if record["type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{record['refers']}>"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(raw: bytes) -> dict:
    """Headers, HTTP headers and payload of one gzip member."""
    raw = zlib.decompress(raw, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields | {"http": {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, "payload": payload}


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        task, nth = TaskContext.get(), 0
        data, index, n = bytearray(), [], 0

        def flush() -> pa.RecordBatch:
            nonlocal nth, n
            # a name of its own for each attempt: only the archives of attempts that end well are listed
            name = f"part-{task.partitionId():06d}-{nth:05d}-{uuid.uuid4().hex[:12]}.wacz"
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(zip_bytes([(DATA, bytes(data)), (INDEX, "".join(index).encode())]))
            row = pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([len(data)], pa.int64())})
            data.clear()
            index.clear()
            nth, n = nth + 1, 0
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    raw = record_bytes(row, row["payload"])
                    index.append(f"{row['url']} {json.dumps({'id': row['id'], 'offset': len(data), 'length': len(raw), 'type': row['type']})}\n")
                    data += raw
                    n += 1
                    if len(data) >= archive_bytes:
                        yield flush()
        if n:
            yield flush()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every row of pages as a record into ZIP-packaged archives under folder; returns (archive, n_records, n_bytes).

    The payload is the body in UTF-8; a null body or url is empty. Of equal payloads of LEAST_REVISIT bytes or more the largest
    id is the response and the others, rows without an id too, revisit it; smaller ones are responses, as are all rows that
    share the largest id and equal rows none of which has an id. Repeated ids are written each. No rows give no archives. Spaces and control characters in a url are percent-encoded in the archive.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    url = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), body.alias("payload"), F.octet_length(body).cast("long").alias("size"), F.sha1(body).alias("digest"))
    digests = materialize(rows.where(F.col("size") >= LEAST_REVISIT).select("id", "digest"), "digests")
    seen = materialize(digests.groupBy("digest").agg(F.max("id").alias("refers"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    revisits = lookup(digests, seen, "digest", "copies", "inner").where("refers is not null and not (id <=> refers)").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "refers").distinct()
    # a written table, whose size Spark knows: while it is small it is broadcast and payloads stay where they are
    revisits = materialize(revisits, "revisits")
    rows = rows.join(revisits, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.select("id", "url", "size", "digest", F.when(F.col("refers").isNull(), "response").otherwise("revisit").alias("type"), "refers", F.when(F.col("refers").isNull(), F.col("payload")).alias("payload"))
    rows = rows.withColumn("payload", F.coalesce("payload", F.lit("").cast("binary")))
    return materialize(rows.mapInArrow(_write(folder, archive_bytes), "archive string, n_records long, n_bytes long"), "archives")


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("archive").to_pylist():
            store, local = filesystem(path)
            with store.open_input_file(local) as f:
                members = {m.name: m for m in directory(f)}
                at, size = begins(f, members[INDEX]), members[INDEX].size
                first = begins(f, members[DATA])
                f.seek(at)
                # a url may hold braces; the entry behind it has one, which is the last of the line
                rows = [json.loads(x[x.rindex(b"{") :]) for x in f.read(size).splitlines()]
            yield pa.RecordBatch.from_pydict(
                {"archive": [path] * len(rows), "at": pa.array([first + r["offset"] for r in rows], pa.int64()), "length": pa.array([r["length"] for r in rows], pa.int64())}
            )


def locate_records(archives: DataFrame) -> DataFrame:
    """(archive, at, length) of every record, from the archives' directories and indexes alone."""
    return archives.select("archive").mapInArrow(_locate, "archive string, at long, length long")


RECORD = pa.schema([("id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())])


def _record(raw: bytes, with_payload: bool) -> tuple:
    r = parse_record(raw)
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:None>" else None
    digest = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(r["http"]["content-length"])
    if r["warc-type"] == "response" and (len(r["payload"]) != size or hashlib.sha1(r["payload"]).hexdigest() != digest):
        raise ValueError(f"record {r['warc-record-id']} does not match its digest")
    return number(r["warc-record-id"]), r.get("warc-target-uri", ""), r["warc-type"], number(r.get("warc-refers-to")), size, digest, r["payload"] if with_payload else None


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            rows, at, out = batch.to_pylist(), 0, []
            while at < len(rows):
                end, first = at + 1, rows[at]
                while end < len(rows) and rows[end]["archive"] == first["archive"] and rows[end]["at"] == rows[end - 1]["at"] + rows[end - 1]["length"] and rows[end]["at"] - first["at"] < READ_BYTES:
                    end += 1
                if first["archive"] != path:
                    path = first["archive"]
                    store, local = filesystem(path)
                    file = store.open_input_file(local)
                file.seek(first["at"])
                raw = file.read(rows[end - 1]["at"] + rows[end - 1]["length"] - first["at"])
                for r in rows[at:end]:
                    out.append(_record(raw[r["at"] - first["at"] : r["at"] - first["at"] + r["length"]], with_payload))
                at = end
                if len(out) >= 256 or at == len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), RECORD)], schema=RECORD)
                    out = []

    return run


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of ZIP-packaged archives: id, url, type, refers_to, payload_bytes, digest (hex SHA-1), payload.

    archives has a column archive with paths that executors can open; with n_bytes too, tasks are dealt TASK_BYTES each. Records are dealt over tasks by archive and place
    and read by range; responses are checked against their digests. A revisit has no payload of its own; its size and digest
    are those of the full payload. A damaged archive or record raises an error. No archives give no rows.
    """
    n = max(1, -(-(archives.agg(F.sum("n_bytes")).first()[0] or 0) // TASK_BYTES)) if "n_bytes" in archives.columns else None
    places = locate_records(archives)
    places = places.repartitionByRange(*([n] if n else []), "archive", "at").sortWithinPartitions("archive", "at")
    return places.mapInArrow(_read(with_payload), "id long, url string, type string, refers_to long, payload_bytes long, digest string, payload binary")


def round_trip(spark: SparkSession, pages: DataFrame, with_payload: bool = False, **columns: str) -> DataFrame:
    """Write pages as archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, new_path(spark, "wacz"), **columns), with_payload)
