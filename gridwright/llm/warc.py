"""WARC archives in Zstandard with a dictionary in front.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; every record after it is a frame of its own, so a reader can stop and
start at any record. A record with the payload of an earlier one is written as a
revisit without it. Archives are rows (path, content), as Spark's binaryFile
source gives them: Spark's own writer stores them on any file system and commits
each task's archives once, and the reader takes either such rows or files.

Defined results: a null html is an empty payload, a null url an empty address;
records with equal payloads (empty ones too) are a response under the smallest id
and revisits of it otherwise, where a null id comes after all others; repeated
rows give one response and revisits of it; an empty table gives no archives and
an empty result. Other columns are ignored, whatever their names. A broken
archive gives rows with an error, one for each record that can't be read. Records
that other tools wrote (warcinfo, request, metadata and the like too) are read as
they are, without a page_id; digests are checked where headers state them.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = bytes.fromhex("28b52ffd")
ARCHIVE_BYTES = 4 << 20
DICTIONARY_BYTES = 16 << 10
SAMPLE_BYTES = 256 << 10
MIN_PAYLOAD = 0
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RECORDS = "path string, record_id string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, error string"
_ID = "urn:gridwright:page:"


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def encode_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC record; the block holds HTTP headers, and the payload unless it is a revisit."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    name = lambda i: f"<{_ID}{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {' '.join(url.split())}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{_b32(hashlib.sha1(payload).digest())}"]
    head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"] if revisit else []
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        key, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line without a colon")
        found[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return found


def _check_digest(stated: str | None, data: bytes, what: str) -> None:
    """Raises if a stated digest (algorithm:value, base 32 or hex) of a known algorithm is another than the data's."""
    name, _, value = (stated or "").partition(":")
    name = name.lower().replace("-", "")
    if name in ("md5", "sha1", "sha256", "sha512"):
        digest = hashlib.new(name, data).digest()
        if value.upper().rstrip("=") not in (_b32(digest).rstrip("="), digest.hex().upper()):
            raise ValueError(f"the {what} has another digest than its header says")


def _page(name: str | None) -> int | None:
    """The page of a record that this module has written; foreign records name none."""
    number = (name or "").strip("<>").removeprefix(_ID)
    return int(number) if number.isdecimal() and (name or "").strip("<>").startswith(_ID) else None


def decode_record(data: bytes) -> dict:
    """The fields of one record, after checks of its version, headers, lengths and digests.

    The payload of an HTTP message is its body and that of other records their block;
    a revisit has none. Its size and digest are stated by its headers, if they are.
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC record")
    h = _headers(lines[1:])
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - h.keys():
        raise ValueError(f"headers are missing: {', '.join(sorted(missing))}")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the block has another length than its header says")
    kind, payload, stated, size = h["warc-type"], rest[:n], h.get("warc-payload-digest"), None
    _check_digest(h.get("warc-block-digest"), payload, "block")
    if kind in ("response", "request", "revisit") and h.get("content-type", "application/http").startswith("application/http"):
        http, gap, payload = payload.partition(b"\r\n\r\n")
        if not gap and kind != "revisit":
            raise ValueError("no HTTP headers")
        fields = _headers(http.split(b"\r\n")[1:])
        size = int(fields["content-length"]) if fields.get("content-length", "").isdecimal() and "transfer-encoding" not in fields else None
    if kind == "revisit":
        payload = None
    else:
        if kind == "response" and size not in (None, len(payload)) and "warc-truncated" not in h:
            raise ValueError("the payload has another length than its header says")
        size = len(payload)
        if "warc-truncated" not in h:
            _check_digest(stated, payload, "payload")
        stated = "sha1:" + _b32(hashlib.sha1(payload).digest())
    return {"record_id": h["warc-record-id"].strip("<>"), "page_id": _page(h["warc-record-id"]), "url": h.get("warc-target-uri", ""), "record_type": kind, "refers_to": _page(h.get("warc-refers-to")), "payload_bytes": size, "payload_digest": stated and stated.rpartition(":")[2], "payload": payload}


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends: its header, then blocks that state their sizes."""
    import zstandard

    parameters = zstandard.get_frame_parameters(data[at : at + 18])
    at += zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        head = int.from_bytes(data[at : at + 3], "little")
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        last, kind = head & 1, head >> 1 & 3
        at += 3 + (1 if kind == 1 else head >> 3)  # a run-length block has one byte
    return at + 4 * parameters.has_checksum


class ArchiveWriter:
    """Records to one archive; the first records up to SAMPLE_BYTES train its dictionary."""

    def __init__(self) -> None:
        self.waiting: list[bytes] = []
        self.n_waiting, self.compressor, self.parts, self.size = 0, None, [], 0

    def add(self, record: bytes) -> None:
        if self.compressor:
            self._write(record)
            return
        self.waiting.append(record)
        self.n_waiting += len(record)
        if self.n_waiting >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        import zstandard

        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, self.waiting, k=200, d=8, level=3).as_bytes()
        except zstandard.ZstdError:  # too few or too small samples: raw content serves as the dictionary
            dictionary = b"".join(self.waiting)[:DICTIONARY_BYTES]
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        self.parts = [struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)), dictionary]
        self.size = 8 + len(dictionary)
        for record in self.waiting:
            self._write(record)
        self.waiting = []

    def _write(self, record: bytes) -> None:
        self.parts.append(self.compressor.compress(record))
        self.size += len(self.parts[-1])

    def close(self) -> bytes:
        if not self.compressor:
            self._start()
        return b"".join(self.parts)


def read_archive(content: bytes) -> Iterator[dict]:
    """A dict for each record; one that fails its checks has an error instead of fields."""
    import zstandard

    view = memoryview(content)
    try:
        magic, size = struct.unpack_from("<II", content)
        if magic != DICTIONARY_MAGIC or 8 + size > len(content):
            raise ValueError("no dictionary frame in front")
        dictionary = content[8 : 8 + size]
        if dictionary[:4] == ZSTD_MAGIC:  # the dictionary itself may be compressed
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    except (ValueError, struct.error, zstandard.ZstdError) as e:
        yield {"error": str(e)}
        return
    at = 8 + size
    while at < len(content):
        try:
            end = frame_end(view, at)
            if end > len(content):
                raise ValueError("a frame is cut off")
        except (ValueError, zstandard.ZstdError) as e:
            yield {"error": str(e)}
            return
        try:
            yield decode_record(plain.decompressobj().decompress(view[at:end]))
        except (ValueError, KeyError, zstandard.ZstdError) as e:
            yield {"error": str(e)}
        at = end


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, first_id, revisit: which rows repeat a payload of at least MIN_PAYLOAD bytes.

    Digests and ids alone are grouped; only payloads that occur twice meet the pages.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("html"), F.unhex(F.sha2(payload, 256)).alias("digest"))
    found = rows.groupBy("digest", F.octet_length("html").alias("size")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    again = materialize(found.where((F.col("n") > 1) & (F.col("size") >= MIN_PAYLOAD)).select("digest", "first_id"), "payloads")
    return rows.join(again, "digest", "left").withColumn("revisit", F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Archives (path, content) of about ``archive_bytes``, kept in the scratch folder; ``date`` is when the pages were fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k, writer = TaskContext.get().partitionId(), 0, None
        done = lambda: pa.RecordBatch.from_pydict({"path": [f"pages-{task:06d}-{k:06d}.warc.zst"], "content": pa.array([writer.close()], pa.binary())})
        for batch in batches:
            for page_id, url, html, first_id, revisit in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "first_id", "revisit"))):
                writer = writer or ArchiveWriter()
                writer.add(encode_record(page_id, url, html.encode(), first_id, revisit, date))
                if writer.size >= archive_bytes:
                    yield done()
                    writer, k = None, k + 1
        if writer:
            yield done()

    return materialize(_one_response(mark_revisits(pages)).select("page_id", "url", "html", "first_id", "revisit").mapInArrow(run, "path string, content binary"), "archives")


def _one_response(rows: DataFrame) -> DataFrame:
    """Of rows that repeat the winning id as well, all but one become revisits."""
    twice = rows.where("first_id is not null and not revisit")
    rank = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url"))
    return rows.where("first_id is null or revisit").unionByName(twice.withColumn("revisit", rank > 1))


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of (path, content) rows as RECORDS."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                rows, size = [], 0
                for record in read_archive(content.as_py() or b""):
                    rows.append({"path": path} | record)
                    size += len(record.get("payload") or b"")
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names=names)

    return archives.select("path", "content").mapInArrow(run, RECORDS)


__all__ = ["ArchiveWriter", "decode_record", "encode_record", "mark_revisits", "read_archive", "read_archives", "write_archives"]
