"""WARC records in ZIP archives: written as stored members with an index, and range-read without extraction.

The reader parses the end-of-central-directory record, its ZIP64 form and the central directory, finds where each
stored member's bytes begin, parses the index member and then reads the ranges of records that it needs, in tasks
that are dealt by ranges and not by archives. Files are opened by ``pyarrow.fs``, so any store that it knows will do.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, new_folder, ship

# Fixed values of the ZIP format.
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF

_DATA, _INDEX = "archive/data.warc.gz", "indexes/data.warc.gz.tsv"
_URN = "urn:page:"


@dataclass(frozen=True)
class Member:
    """An entry of a central directory."""

    name: str
    method: int
    size: int
    stored_size: int
    header_at: int


def read_at(file: pa.NativeFile, at: int, length: int) -> bytes:
    file.seek(at)
    return file.read(length)


def directory(file: pa.NativeFile) -> list[Member]:
    """The members of an archive, from its central directory; ZIP64 records are followed where fields are full."""
    total = file.size()
    tail_at = max(0, total - 22 - _FULL16)
    tail = read_at(file, tail_at, total - tail_at)
    end = tail.rfind(_END, 0, max(0, len(tail) - 18))  # a whole record must fit behind it
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):  # a comment can hold the mark
        end = tail.rfind(_END, 0, end)
    if end < 0:
        raise ValueError("not a ZIP archive: it has no end record")
    count, size, at = struct.unpack_from("<HII", tail, end + 10)
    if (count == _FULL16 or size == _FULL32 or at == _FULL32) and end + tail_at >= 20:
        mark, _, end64_at, _ = struct.unpack("<4sIQI", read_at(file, tail_at + end - 20, 20))
        if mark == _LOCATOR64:
            end64 = read_at(file, end64_at, 56)
            if end64[:4] != _END64:
                raise ValueError("the ZIP64 locator points to no ZIP64 end record")
            count, size, at = struct.unpack_from("<QQQ", end64, 32)
    entries = read_at(file, at, size)
    members, k = [], 0
    for _ in range(count):
        if entries[k : k + 4] != _ENTRY:
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", entries, k + 8)
        stored, plain, name_len, extra_len, comment_len = struct.unpack_from("<IIHHH", entries, k + 20)
        header_at = struct.unpack_from("<I", entries, k + 42)[0]
        name = entries[k + 46 : k + 46 + name_len].decode("utf-8" if flags & 0x800 else "cp437")
        extra = entries[k + 46 + name_len : k + 46 + name_len + extra_len]
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<HH", extra)
            if kind == 1:  # 64-bit values, only of those fields that are full, in this order
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                plain = next(wide) if plain == _FULL32 else plain
                stored = next(wide) if stored == _FULL32 else stored
                header_at = next(wide) if header_at == _FULL32 else header_at
            extra = extra[4 + length :]
        members.append(Member(name, method, plain, stored, header_at))
        k += 46 + name_len + extra_len + comment_len
    return members


def data_at(file: pa.NativeFile, member: Member) -> int:
    """Where a stored member's bytes begin; only stored members can be read by ranges."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed by the archive and can't be read by ranges")
    header = read_at(file, member.header_at, 30)
    if header[:4] != _LOCAL:
        raise ValueError(f"{member.name} has no local header where the directory says")
    name_len, extra_len = struct.unpack_from("<HH", header, 26)
    return member.header_at + 30 + name_len + extra_len


def _opened(path: str) -> pa.NativeFile:
    system, inner = pafs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def record(fields: Iterable[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One WARC record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and block of a record's gzip member."""
    whole = zlib.decompress(raw, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def record_lengths(data: pa.NativeFile, at: int, size: int, step: int = 1 << 20) -> Iterator[int]:
    """Lengths of the gzip members in a range, for archives without an index."""
    left, buffer = size, b""
    while left or buffer:
        unpacker, length = zlib.decompressobj(31), 0
        while not unpacker.eof:
            if not buffer:
                buffer = read_at(data, at, min(step, left))
                at, left = at + len(buffer), left - len(buffer)
                if not buffer:
                    raise ValueError("the last record is cut off")
            unpacker.decompress(buffer)
            length += len(buffer) - len(unpacker.unused_data)
            buffer = unpacker.unused_data
        yield length


def base32(digest_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(digest_hex)).decode()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, level: int = 4, roll_bytes: int = 1 << 30, broadcast_rows: int = 50_000, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes one record per row of ``pages`` to archives in ``folder``; returns (path, records, bytes), computed.

    Of records whose payloads are equal and have at least ``min_bytes`` bytes, those with the smallest id are
    ``response``, the others ``revisit`` it and carry no payload. Digests are compared before anything is written:
    they are aggregated on the map side to one row per digest, and only digests that occur again are joined back, by
    broadcast if they are at most ``broadcast_rows`` and by a shuffle otherwise.

    Defined cases: a null payload is empty; a null url gives no target; rows with a null id revisit a record with an
    id if there is one and are responses otherwise; repeated rows are written as often as they come; an empty table
    gives no archive. A retried task writes files of new names, and only those of finished tasks are returned.
    """
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    big = rows.where(F.length("payload") >= min_bytes)
    again = cut(big.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", F.col("first").cast("string").alias("first")))
    small = again.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = rows.drop("key").join(F.broadcast(again) if small else again, "digest", "left")
    system, inner = pafs.FileSystem.from_uri(folder)
    system.create_dir(inner, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        made: list[tuple[str, int, int]] = []
        sink = None

        def close() -> None:
            nonlocal sink
            if sink is not None:
                data.close()
                archive.writestr(_INDEX, "".join(index))
                archive.close()
                sink.close()
                made.append((f"{folder}/{name}", len(index), at))
                sink = None

        for batch in batches:
            for digest, key, url, payload, first in zip(*(batch.column(k) for k in ("digest", "id", "url", "payload", "first")), strict=True):
                if sink is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made)}.wacz"
                    sink = target.open_output_stream(f"{base}/{name}")
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
                    data = archive.open(_DATA, "w", force_zip64=True)
                    index, at = [], 0
                key, first, whole = key.as_py(), first.as_py(), payload.as_py()
                kind = "revisit" if first is not None and first != key else "response"
                fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{_URN}{'' if key is None else key}>"), ("WARC-Date", date)]
                if url.as_py() is not None:
                    fields.append(("WARC-Target-URI", url.as_py().replace("\r", "%0D").replace("\n", "%0A")))
                fields += [("WARC-Payload-Digest", "sha1:" + base32(digest.as_py())), ("X-Payload-Length", str(len(whole)))]
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                if kind == "revisit":
                    fields += [("WARC-Refers-To", f"<{_URN}{first}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                else:
                    block += whole
                fields.append(("Content-Type", "application/http; msgtype=response"))
                raw = record(fields, block, level)
                data.write(raw)
                index.append(f"{at}\t{len(raw)}\n")
                at += len(raw)
                if at >= roll_bytes:
                    close()
        close()
        paths, records, sizes = zip(*made, strict=True) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    return cut(rows.mapInArrow(run, "path string, records bigint, bytes bigint"))


def read(archives: DataFrame, id_type: str = "bigint", chunk_bytes: int = 4 << 20, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives in column ``path``: page_id, payload_bytes, payload_digest, record_type,
    refers_to, target_uri and, if asked for, payload.

    Directories and indexes are read first and give ranges of about ``chunk_bytes``; these are dealt out evenly, so
    one archive of any size is read by many tasks. A response's payload must have the digest that its header says; a
    revisit's length and digest are those of the full payload, from its header. Archives without an index are walked
    once to find the records. No archive gives no rows.
    """
    spark = archives.sparkSession
    ship(spark)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple[int, list[int]]] = []
                size = 0  # of the last range
                with _opened(path) as file:
                    members = {m.name: m for m in directory(file)}
                    for name, member in members.items():
                        if not name.endswith(".warc.gz"):
                            continue
                        base = data_at(file, member)
                        listed = members.get(f"indexes/{name.rpartition('/')[2]}.tsv")
                        if listed:
                            lines = io.BytesIO(read_at(file, data_at(file, listed), listed.size))
                            places: Iterable[tuple[int, int]] = (tuple(map(int, line.split(b"\t"))) for line in lines)  # type: ignore[misc]
                        else:
                            places = _running(record_lengths(file, base, member.size))
                        for at, length in places:
                            if not rows or size >= chunk_bytes or rows[-1][0] + size != base + at:
                                rows.append((base + at, []))
                                size = 0
                            rows[-1][1].append(length)
                            size += length
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["path", "at", "lengths"])

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"] + ["payload"] * with_payload

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(path) as file:
                    raw = read_at(file, at, sum(lengths))
                rows, k = [], 0
                for length in lengths:
                    rows.append(_described(*parsed(raw[k : k + length]), with_payload))
                    k += length
                kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, *[pa.binary()] * with_payload]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    ranges = archives.select("path").mapInArrow(plan, "path string, at bigint, lengths array<bigint>")
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = ranges.mapInArrow(fetch, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, target_uri string" + ", payload binary" * with_payload)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def _running(lengths: Iterable[int]) -> Iterator[tuple[int, int]]:
    at = 0
    for length in lengths:
        yield at, length
        at += length


def _described(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    def page(value: str | None) -> str | None:
        return (value or "").strip("<>").removeprefix(_URN) or None

    kind = fields["warc-type"]
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size = len(payload)
    if kind == "revisit":
        size, payload = int(fields.get("x-payload-length", 0)), None
    else:
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest is not None and digest != own:
            raise ValueError(f"record {fields.get('warc-record-id')} has payload digest {own}; its header says {digest}")
        digest = own
    return (page(fields.get("warc-record-id")), size, digest, kind, page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), *[payload] * with_payload)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` to archives in a new shared folder and reads them back; one row per page."""
    spark = pages.sparkSession
    archives = write(pages, new_folder(spark, "warc"), **options)
    return read(archives, pages.schema[options.get("id_col", "page_id")].dataType.simpleString())
