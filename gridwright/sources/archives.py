"""Zip archives as rows (archive, member, content), or by their directories, for archives and members of any size."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import PART_BYTES
from .geotiff import opened
from .scratch import file_system, written

MEMBERS = "archive string, member string, size bigint, content binary, error string"


def _read(z: zipfile.ZipFile, member: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
    try:
        return z.read(member), None
    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError) as e:
        return None, str(e)


def _member(archive: str, member: str | None, size: int | None, content: bytes | None, error: str | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"archive": [archive], "member": pa.array([member], pa.string()), "size": pa.array([size], pa.int64()), "content": pa.array([content], pa.binary()), "error": pa.array([error], pa.string())})


def unzip(files: DataFrame) -> DataFrame:
    """MEMBERS of binaryFile rows, one member at a time; folders are left out. What can't be read has an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for m in z.infolist():
                            if not m.is_dir():
                                yield _member(path, m.filename, m.file_size, *_read(z, m))
                except (zipfile.BadZipFile, ValueError, OSError) as e:
                    yield _member(path, None, None, None, str(e))

    return files.select("path", "content").mapInArrow(run, MEMBERS)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Archives whose name ends in .zip, in lower case."""
    return unzip(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(folder))


DIRECTORY = "archive string, member string, size bigint, packed bigint, method int, crc bigint, at bigint, locked boolean, error string"
_DIRECTORY = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("packed", pa.int64()), ("method", pa.int32()), ("crc", pa.int64()), ("at", pa.int64()), ("locked", pa.bool_()), ("error", pa.string())])
#: Packed bytes that are read at a time, and that a task has about.
READ_BYTES, TASK_BYTES = 4 << 20, 128 << 20
MEMBER_PARTS = "archive string, member string, idx int, part binary, error string"


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of archives whose name ends in .zip, in lower case."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(folder).select("path", "length")


def directory(files: DataFrame) -> DataFrame:
    """DIRECTORY of archives (path): their members by the central directory, which alone is read. What can't be read has a row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows = []
                try:
                    system, name = file_system(path)
                    with system.open_input_file(name) as file, zipfile.ZipFile(file) as z:
                        for m in z.infolist():
                            if not m.is_dir():
                                rows.append({"archive": path, "member": m.filename, "size": m.file_size, "packed": m.compress_size, "method": m.compress_type, "crc": m.CRC, "at": m.header_offset, "locked": bool(m.flag_bits & 1)})
                            if len(rows) == 10_000:
                                yield pa.RecordBatch.from_pylist(rows, _DIRECTORY)
                                rows = []
                except (zipfile.BadZipFile, ValueError, OSError, struct.error) as e:
                    rows.append({"archive": path, "error": str(e)})
                yield pa.RecordBatch.from_pylist(rows, _DIRECTORY)

    return files.select("path").mapInArrow(run, DIRECTORY)


def _inflated(get, at: int, packed: int, method: int) -> Iterator[bytes]:
    """The bytes of a member whose local header is at a place, some at a time."""
    head = get(at, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError("no member begins here")
    start = at + 30 + sum(struct.unpack("<HH", head[26:30]))
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"compression {method} isn't supported")
    stream = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
    for k in range(0, packed, READ_BYTES):
        data = get(start + k, min(READ_BYTES, packed - k))
        if len(data) < min(READ_BYTES, packed - k):
            raise ValueError("the archive ends within the member")
        while data:
            yield stream.decompress(data, READ_BYTES) if stream else data
            data = stream.unconsumed_tail if stream else b""
    if stream and not stream.eof:
        yield stream.flush()


def member_parts(members: DataFrame, size: int = PART_BYTES) -> DataFrame:
    """MEMBER_PARTS of rows of DIRECTORY: each member in parts of ``size`` bytes, read by its place in the archive.

    Members, not archives, are dealt to tasks, by their packed bytes; nothing larger
    than a part is held. A member that can't be read, or whose checksum differs, ends
    with a row with an error, and its other parts count for nothing. An empty member
    has one empty part. Rows with an error are passed on.
    """
    members = written(members, "directory")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, get = None, None

        def row(m: dict, idx: int | None, part: bytes | None, error: str | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [m["archive"]], "member": pa.array([m["member"]], pa.string()), "idx": pa.array([idx], pa.int32()), "part": pa.array([part], pa.binary()), "error": pa.array([error], pa.string())})

        for batch in batches:
            for m in batch.to_pylist():
                if m["error"] is not None:
                    yield row(m, None, None, m["error"])
                    continue
                try:
                    if m["archive"] != path:
                        if get is not None:
                            get.close()
                        path, get = None, opened(m["archive"])
                        path = m["archive"]
                    if m["locked"]:
                        raise ValueError("the member is encrypted")
                    held, idx, crc, total = bytearray(), 0, 0, 0
                    for data in _inflated(get, m["at"], m["packed"], m["method"]):
                        crc, total = zlib.crc32(data, crc), total + len(data)
                        held += data
                        while len(held) >= size and total < m["size"]:
                            yield row(m, idx, bytes(held[:size]), None)
                            held, idx = held[size:], idx + 1
                    while len(held) > size:
                        yield row(m, idx, bytes(held[:size]), None)
                        held, idx = held[size:], idx + 1
                    if total != m["size"] or crc != m["crc"]:
                        raise ValueError("the checksum differs")
                    yield row(m, idx, bytes(held), None)
                except (ValueError, OSError, zlib.error, struct.error) as e:
                    yield row(m, None, None, str(e))
        if get is not None:
            get.close()

    tasks = max(members.sparkSession.sparkContext.defaultParallelism, (members.agg(F.sum("packed")).first()[0] or 0) // TASK_BYTES)
    return members.repartition(tasks, "archive", F.floor(F.col("at") / TASK_BYTES)).sortWithinPartitions("archive", "at").mapInArrow(run, MEMBER_PARTS)
