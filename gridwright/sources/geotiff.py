"""GeoTIFF as Spark tables: headers, windows and pixels.

Files are listed by Spark; tasks read the bytes of headers and of the blocks that a
window meets, through the file system of the path (or from a ``content`` column, as
binaryFile gives it, where there is one). So a file may be larger than a value can
be, and its windows are spread over tasks. Supported are TIFFs and BigTIFFs in
strips or tiles, uncompressed or packed by deflate, LZW or PackBits, of integer or
float samples, with either predictor, chunky or planar, and JPEG blocks if a decoder
is given; anything else gives a row with an error. So does a file without a usable
header: no file of the input goes without a row.
"""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import CHUNK_OVERLAP, CHUNK_SIZE, DEFAULT_CRS, UNKNOWN_CRS
from ..operators.raster import chunk_grid
from .scratch import file_system, written

HEADER = "path string, crs string, bounds struct<left:double,bottom:double,right:double,top:double>, width int, height int, bands int, dtype string, transform array<double>, error string"
#: Windows that a task reads, bytes that one read of a header fetches, and bytes of decoded blocks that a task keeps for the next windows.
WINDOWS_PER_TASK, HEADER_BYTES, BLOCK_BYTES = 16, 1 << 16, 128 << 20
#: How blocks of a compression that isn't known here are decoded: (bytes, tables or None) to an array (rows, columns, samples).
Decoders = dict[int, Callable[[bytes, bytes | None], np.ndarray]]
#: TIFF field types: code, struct format.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _STRIPS, _SAMPLES, _ROWS, _STRIP_SIZES, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
_TILE_W, _TILE_H, _TILES, _TILE_SIZES, _FORMAT, _JPEG_TABLES, _SCALE, _TIE, _MATRIX, _KEYS, _NODATA = 322, 323, 324, 325, 339, 347, 33550, 33922, 34264, 34735, 42113
FAILURES = (ValueError, KeyError, IndexError, struct.error, zlib.error, OSError)


class Bytes:
    """n bytes from a place: out of the content, or by a read of the file. Used in a with statement, or closed."""

    def __init__(self, path: str, content: bytes | None = None) -> None:
        self.content, self.file = content, None
        if content is None:
            system, name = file_system(path)
            self.file = system.open_input_file(name)

    def __call__(self, at: int, n: int) -> bytes:
        return self.content[at : at + n] if self.file is None else self.file.read_at(n, at)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()

    def __enter__(self) -> Bytes:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def opened(path: str, content: bytes | None = None) -> Bytes:
    """The bytes of a path, or of a content that is at hand."""
    return Bytes(path, content)


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the highest bit first; 256 clears the table and 257 ends."""
    out, table, bits, n, width, last = bytearray(), [], 0, 0, 9, b""
    for byte in data:
        bits, n = (bits << 8 | byte) & 0xFFFFFF, n + 8
        if n < width:
            continue
        n -= width
        code = bits >> n & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 + (len(table) > 510) + (len(table) > 1022) + (len(table) > 2046)
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    """PackBits: runs of literal bytes and of one repeated byte."""
    out, at = bytearray(), 0
    while at < len(data):
        k = data[at]
        if k < 128:
            out += data[at + 1 : at + 2 + k]
            at += 2 + k
        else:
            out += data[at + 1 : at + 2] * (257 - k if k > 128 else 0)
            at += 2 if k > 128 else 1
    return bytes(out)


_UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


class Tiff:
    """The first image of a TIFF file; ``get`` fetches bytes. Decoded blocks are kept, the last ones used, up to ``keep`` bytes."""

    def __init__(self, get: Callable[[int, int], bytes], decoders: Decoders | None = None, keep: int = BLOCK_BYTES) -> None:
        self.get, self.decoders, self.keep = get, decoders or {}, keep
        self.blocks: OrderedDict[int, np.ndarray] = OrderedDict()
        self.kept, self.decoded = 0, 0
        first = get(0, HEADER_BYTES)
        part = lambda at, n: first[at : at + n] if at + n <= len(first) else get(at, n)
        self.end = {b"II": "<", b"MM": ">"}.get(first[:2], "")
        version = struct.unpack(self.end + "H", first[2:4])[0] if self.end and len(first) >= 8 else 0
        if version not in (42, 43):
            raise ValueError("not a TIFF file")
        big = version == 43
        place, count, entry, inline = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
        at = struct.unpack(self.end + place, part(8 if big else 4, inline))[0]
        n_tags = struct.unpack(self.end + count, part(at, struct.calcsize("<" + count)))[0]
        at += struct.calcsize("<" + count)
        rows = part(at, entry * n_tags)
        self.tags = {}
        for k in range(n_tags):
            tag, kind, n = struct.unpack_from(self.end + "HH" + place, rows, entry * k)
            if kind in _TYPES:
                form = f"{self.end}{n}s" if kind == 2 else self.end + _TYPES[kind] * n
                size, here = struct.calcsize(form), entry * k + entry - inline
                self.tags[tag] = struct.unpack(form, rows[here : here + size] if size <= inline else part(struct.unpack_from(self.end + place, rows, here)[0], size))
        self.width, self.height, self.bands = self._one(_WIDTH), self._one(_HEIGHT), self._one(_SAMPLES, 1)
        bits, form = self._one(_BITS, 8), _KINDS.get(self._one(_FORMAT, 1))
        if form is None or bits % 8 or bits > 64:
            raise ValueError("samples of this kind aren't supported")
        self.dtype = np.dtype(f"{self.end}{form}{bits // 8}")

    def _one(self, tag: int, default: int | None = None) -> int:
        if tag not in self.tags and default is None:
            raise ValueError(f"tag {tag} is missing")
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def transform(self) -> list[float]:
        """a, b, c, d, e, f: x = a col + b row + c, y = d col + e row + f."""
        if _MATRIX in self.tags:
            m = self.tags[_MATRIX]
            return [m[0], m[1], m[3], m[4], m[5], m[7]]
        if _SCALE in self.tags and _TIE in self.tags:
            (sx, sy, *_), (i, j, _, x, y, *_) = self.tags[_SCALE], self.tags[_TIE]
            return [sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy]
        return [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]

    @property
    def crs(self) -> str | None:
        """From the projected or geographic code among the keys."""
        keys = self.tags.get(_KEYS, ())
        codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        code = codes.get(3072) or codes.get(2048)
        return f"EPSG:{code}" if code and code != 32767 else None

    @property
    def nodata(self) -> float | None:
        """The value of pixels without data, if the file names one."""
        try:
            return float(self.tags[_NODATA][0].split(b"\0")[0])
        except (KeyError, ValueError, AttributeError):
            return None

    def masked(self, bands: np.ndarray) -> np.ndarray:
        """Bands as float32, NaN where there is no data."""
        out = bands.astype(np.float32)
        if self.nodata is not None:
            out[bands == self.nodata] = np.nan
        return out

    @property
    def bounds(self) -> dict[str, float]:
        a, b, c, d, e, f = self.transform
        xs, ys = [c, c + a * self.width + b * self.height], [f, f + d * self.width + e * self.height]
        return {"left": xs[0], "bottom": ys[1], "right": xs[1], "top": ys[0]}

    def _unpacked(self, raw: bytes, rows: int, width: int, samples: int) -> np.ndarray:
        """(rows, width, samples) of a block's bytes."""
        compression, predictor = self._one(_COMPRESSION, 1), self._one(_PREDICTOR, 1)
        if compression in self.decoders:
            tables = self.tags.get(_JPEG_TABLES)
            found = np.asarray(self.decoders[compression](raw, bytes(tables) if tables else None))
            return found.reshape(found.shape[0], width, samples)[:rows].astype(self.dtype, copy=False)
        if compression not in _UNPACK or predictor not in (1, 2, 3) or predictor == 3 and self.dtype.kind != "f":
            raise ValueError(f"compression {compression} with predictor {predictor} isn't supported")
        raw = _UNPACK[compression](raw)
        if predictor == 3:  # the bytes of a row's samples in planes, the highest first, as differences
            size = self.dtype.itemsize
            planes = np.frombuffer(raw, np.uint8, count=rows * width * samples * size).reshape(rows, -1, samples).cumsum(axis=1, dtype=np.uint8)
            return np.ascontiguousarray(planes.reshape(rows, size, -1).transpose(0, 2, 1)).view(f">f{size}").reshape(rows, width, samples)
        block = np.frombuffer(raw, self.dtype, count=rows * width * samples).reshape(rows, width, samples)
        return np.cumsum(block, axis=1, dtype=self.dtype.newbyteorder("=")) if predictor == 2 else block

    def _block(self, k: int, place: int, size: int, rows: int, width: int, samples: int) -> np.ndarray:
        if k in self.blocks:
            self.blocks.move_to_end(k)
            return self.blocks[k]
        block = self._unpacked(self.get(place, size), rows, width, samples)
        self.decoded += 1
        self.blocks[k] = block
        self.kept += block.nbytes
        while self.kept > self.keep and len(self.blocks) > 1:
            self.kept -= self.blocks.popitem(last=False)[1].nbytes
        return block

    def read(self, row: int = 0, col: int = 0, height: int | None = None, width: int | None = None) -> np.ndarray:
        """(bands, height, width) of a window; only blocks that it meets are decoded."""
        height, width = self.height - row if height is None else height, self.width - col if width is None else width
        tiled = _TILES in self.tags
        bw, bh = (self._one(_TILE_W), self._one(_TILE_H)) if tiled else (self.width, min(self.height, self._one(_ROWS, self.height)))
        places, sizes = (self.tags[_TILES], self.tags[_TILE_SIZES]) if tiled else (self.tags[_STRIPS], self.tags[_STRIP_SIZES])
        across, down = -(-self.width // bw), -(-self.height // bh)
        planar = self._one(_PLANAR, 1) == 2 and self.bands > 1
        out = np.zeros((self.bands, height, width), self.dtype)
        for plane in range(self.bands if planar else 1):
            for by in range(row // bh, min(down, -(-(row + height) // bh))):
                for bx in range(col // bw, min(across, -(-(col + width) // bw))):
                    k = plane * across * down + by * across + bx
                    rows = bh if tiled else min(bh, self.height - by * bh)
                    block = self._block(k, places[k], sizes[k], rows, bw, 1 if planar else self.bands)
                    y0, y1 = max(row, by * bh), min(row + height, by * bh + rows)
                    x0, x1 = max(col, bx * bw), min(col + width, bx * bw + bw, self.width)
                    part = block[y0 - by * bh : y1 - by * bh, x0 - bx * bw : x1 - bx * bw].transpose(2, 0, 1)
                    out[plane if planar else slice(None), y0 - row : y1 - row, x0 - col : x1 - col] = part[0] if planar else part
        return out


def _fields(bands: int, height: int, width: int, dtype: np.dtype, rows: int, transform: tuple[float, ...] | None, epsg: int | None, deflate: bool, nodata: float | None) -> list[tuple[int, str, list]]:
    """Tags, types and values of an image in strips, but for the strips' places and sizes; ``transform`` as in Tiff.transform, written whole where the image is turned."""
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    fields = [(_WIDTH, "I", [width]), (_HEIGHT, "I", [height]), (_BITS, "H", [dtype.itemsize * 8] * bands), (_COMPRESSION, "H", [8 if deflate else 1]), (262, "H", [1]), (_SAMPLES, "H", [bands]), (_ROWS, "I", [rows]), (_PLANAR, "H", [1]), (_FORMAT, "H", [kind] * bands)]
    if transform:
        a, b, c, d, e, f = transform
        if b or d or a <= 0 or e >= 0:  # a scale says neither a turn nor an axis the other way
            fields.append((_MATRIX, "d", [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
        else:
            fields += [(_SCALE, "d", [a, -e, 0.0]), (_TIE, "d", [0.0, 0.0, 0.0, c, f, 0.0])]
    if epsg:
        fields.append((_KEYS, "H", [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg]))
    if nodata is not None:
        fields.append((_NODATA, "c", [bytes([x]) for x in f"{nodata:.17g}".encode() + b"\0"]))
    return fields


_CODES = {"c": 2, "H": 3, "I": 4, "d": 12, "Q": 16}


def encode(pixels: np.ndarray, transform: tuple[float, ...] | None = None, epsg: int | None = None, deflate: bool = False, rows: int | None = None, nodata: float | None = None) -> bytes:
    """A GeoTIFF of (bands, height, width) in strips of ``rows`` rows, or in one."""
    bands, height, width = pixels.shape
    rows = rows or max(height, 1)
    strips = [pack_strip(pixels[:, k : k + rows], deflate) for k in range(0, max(height, 1), rows)]
    sizes, body = [len(s) for s in strips], b"".join(strips)
    starts = (8 + np.cumsum([0, *sizes[:-1]])).tolist()
    fields = [*_fields(bands, height, width, pixels.dtype, rows, transform, epsg, deflate, nodata), (_STRIPS, "I", starts), (_STRIP_SIZES, "I", sizes)]
    at = 8 + len(body) + len(body) % 2
    out, tail, place = [struct.pack("<H", len(fields))], b"", at + 2 + 12 * len(fields) + 4
    for tag, form, values in sorted(fields):
        data = struct.pack(f"<{len(values)}{form}", *values)
        if len(data) > 4:
            data += b"\0" * (len(data) % 2)
            tail, data = tail + data, struct.pack("<I", place + len(tail))
        out.append(struct.pack("<HHI", tag, _CODES[form], len(values)) + data.ljust(4, b"\0"))
    return b"II*\0" + struct.pack("<I", at) + body + b"\0" * (len(body) % 2) + b"".join(out) + b"\0\0\0\0" + tail


def pack_strip(pixels: np.ndarray, deflate: bool = False) -> bytes:
    """The bytes of a strip (bands, rows, width)."""
    raw = np.ascontiguousarray(pixels.transpose(1, 2, 0)).astype(pixels.dtype.newbyteorder("<")).tobytes()
    return zlib.compress(raw) if deflate else raw


def leading_header(strips: int, big: bool, bands: int, height: int, width: int, dtype: np.dtype, rows: int, transform: tuple[float, ...] | None, epsg: int | None, deflate: bool, nodata: float | None) -> tuple[list[tuple[int, bytes]], int, int, int]:
    """What stands before the strips of a file that is written in parts: parts (offset, bytes), where the lists of the strips' places and of their sizes begin, and where the first strip does.

    The lists' numbers (of 8 bytes in a BigTIFF, else 4) are left to those who have the strips.
    """
    form, width_of, entry, inline = ("Q", 8, 20, 8) if big else ("I", 4, 12, 4)
    start = b"II+\0\x08\0\0\0" + struct.pack("<Q", 16) if big else b"II*\0" + struct.pack("<I", 8)
    fields = sorted([*_fields(bands, height, width, dtype, rows, transform, epsg, deflate, nodata), (_STRIPS, form, []), (_STRIP_SIZES, form, [])])
    count = struct.pack("<Q" if big else "<H", len(fields))
    place = len(start) + len(count) + entry * len(fields) + inline
    out, tail, lists = [start, count], b"", {}
    for tag, kind, values in fields:
        if tag not in (_STRIPS, _STRIP_SIZES):
            data = struct.pack(f"<{len(values)}{kind}", *values)
            if len(data) > inline:
                data += b"\0" * (-len(data) % 8)
                tail, data = tail + data, struct.pack("<" + form, place + len(tail))
            out.append(struct.pack("<HH" + form, tag, _CODES[kind], len(values)) + data.ljust(inline, b"\0"))
        else:
            lists[tag] = len(b"".join(out)) + entry - inline  # of one number its place, else where its list's place is written
            out.append(struct.pack("<HH" + form, tag, _CODES[kind], strips) + b"\0" * inline)
    head = bytearray(b"".join(out) + b"\0" * inline + tail)
    if strips * width_of <= inline:
        (first, second), parts, at = sorted(lists.values()), [], 0
        for x in (first, second):
            parts.append((at, bytes(head[at:x])))
            at = x + strips * width_of
        return [*parts, (at, bytes(head[at:]))], lists[_STRIPS], lists[_STRIP_SIZES], len(head)
    places, sizes = len(head), len(head) + strips * width_of
    struct.pack_into("<" + form, head, lists[_STRIPS], places)
    struct.pack_into("<" + form, head, lists[_STRIP_SIZES], sizes)
    return [(0, bytes(head))], places, sizes, sizes + strips * width_of


def read_files(spark: SparkSession, path: str, pattern: str = "*.[tT][iI][fF]*", content: bool = False) -> DataFrame:
    """(path, length) of the files below a folder; with ``content`` binaryFile's rows, for files up to 2 GB on systems that only Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files if content else files.select("path", "length")


def _content(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch["content"].to_pylist() if "content" in batch.schema.names else [None] * len(batch)


def headers(files: DataFrame) -> DataFrame:
    """HEADER of each file, with the chunk grid's size; a file that can't be read has an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"].to_pylist(), _content(batch)):
                try:
                    with opened(path, content) as get:
                        t = Tiff(get)
                    rows.append({"path": path, "crs": t.crs or UNKNOWN_CRS, "bounds": t.bounds, "width": t.width, "height": t.height, "bands": t.bands, "dtype": t.dtype.newbyteorder("=").name, "transform": t.transform, "error": None})
                except FAILURES as e:
                    rows.append({"path": path, "error": str(e)})
            kinds = pa.schema([("path", pa.string()), ("crs", pa.string()), ("bounds", pa.struct([(k, pa.float64()) for k in ("left", "bottom", "right", "top")])), ("width", pa.int32()), ("height", pa.int32()), ("bands", pa.int32()), ("dtype", pa.string()), ("transform", pa.list_(pa.float64())), ("error", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, kinds)

    found = files.select(*[c for c in ("path", "content") if c in files.columns]).mapInArrow(run, HEADER)
    count = lambda d: F.floor((F.col(d) + CHUNK_SIZE - 1) / CHUNK_SIZE).cast("int")
    return found.withColumns({"chunk_cols": count("width"), "chunk_rows": count("height"), "total_inference_chunks": count("width") * count("height")})


def ready_bands(bands: np.ndarray, want: int = 4, masked: bool = False) -> np.ndarray:
    """The first ``want`` bands, filled up with zeros, each scaled to 0..1; a constant band, or one with NaN, becomes zeros. With ``masked`` NaN stands for no data: it counts for nothing and stays."""
    out = np.zeros((want, *bands.shape[1:]), np.float32)
    for k, band in enumerate(bands[:want].astype(np.float32)):
        there = ~np.isnan(band) if masked else np.True_
        low, high = band.min(initial=np.inf, where=there), band.max(initial=-np.inf, where=there)
        if high > low:  # false with NaN as well
            out[k] = (band - low) / (high - low)
        if masked:
            out[k][~there] = np.nan
    return out


def _plan(files: DataFrame, windows: DataFrame, count: int) -> DataFrame:
    """Windows (path, r0, c0, ...), ``count`` of them, dealt to tasks by some WINDOWS_PER_TASK that lie side by side, with the content where files have one."""
    if "content" in files.columns:
        return windows.join(files.select("path", "content"), "path", "left")
    group = F.floor(F.col("r0") / (4 * CHUNK_SIZE)), F.floor(F.col("c0") / (4 * CHUNK_SIZE))
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-count // WINDOWS_PER_TASK))
    return windows.repartition(tasks, "path", *group).sortWithinPartitions("path", "r0", "c0")


class _Open:
    """The file that is being read; a task reads a file's windows one after the other."""

    def __init__(self, decoders: Decoders | None = None) -> None:
        self.path, self.tiff, self.decoders = None, None, decoders

    def __call__(self, path: str, content: bytes | None) -> Tiff:
        if path != self.path:
            self.close()
            get = opened(path, content)
            try:
                self.tiff = Tiff(get, self.decoders)
            except FAILURES:
                get.close()
                raise
            self.path = path
        return self.tiff

    def close(self) -> None:
        if self.path is not None:
            self.tiff.get.close()
        self.path, self.tiff = None, None


def _bands_array(bands: np.ndarray) -> pa.Array:
    flat = bands.reshape(len(bands), int(np.prod(bands.shape[1:])))
    inner = pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], pa.array(flat.ravel()))
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), inner)


def chunk_row(path: str, name: str, window: tuple[int, int, int, int], bands: np.ndarray, transform: list[float] | None, crs: str | None, total: int | None, error: str | None) -> list[pa.Array]:
    """A row of CHUNK; ``window`` is (r0, c0, h, w), ``transform`` that of the file."""
    r0, c0, h, w = window
    place, at = None, None
    if transform:
        a, b, c, d, e, f = transform
        place, at = [c + a * c0 + b * r0, a, b, f + d * c0 + e * r0, d, e], {"col_off": c0, "row_off": r0, "width": w, "height": h}
    pixels = pa.nulls(1, _CHUNK.field("pixels").type) if error is not None else _bands_array(bands)
    values = [[path], [name], [at], pixels, [place], [DEFAULT_CRS if crs == UNKNOWN_CRS else crs], [total], [error]]
    return [v if isinstance(v, pa.Array) else pa.array(v, field.type) for v, field in zip(values, _CHUNK)]


def chunks(files: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, ready: int = 0, decoders: Decoders | None = None) -> DataFrame:
    """A row per chunk: its window, its transform and its bands as arrays; a window that can't be read has an error and no bands, and so has a file, in a row without a chunk.

    Windows are the unit of work: a task reads one at a time, whatever file it is of.
    With ``ready`` the bands are adapted to this number and scaled to 0..1.
    """
    heads = written(headers(files), "headers")
    grid = chunk_grid(heads.where("error is null"), size, overlap).select("path", "cr", "cc", "r0", "c0", "h", "w", "crs", "total_chunks", F.col("transform").alias("t"))
    empty = heads.where("error is not null or height < 1 or width < 1").select("path", F.coalesce("error", F.lit("an image without pixels")).alias("error"))
    count = grid.groupBy().count().first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = _Open(decoders)
        for batch in batches:
            for row, content in zip(batch.drop_columns([c for c in ("content",) if c in batch.schema.names]).to_pylist(), _content(batch)):
                error, bands = None, np.zeros((0, 0), np.float32)
                try:
                    bands = file(row["path"], content).read(row["r0"], row["c0"], row["h"], row["w"]).astype(np.float32)
                    bands = ready_bands(bands, ready) if ready else bands
                except FAILURES as x:
                    error = str(x)
                window = row["r0"], row["c0"], row["h"], row["w"]
                yield pa.RecordBatch.from_arrays(chunk_row(row["path"], f"{row['cr']}_{row['cc']}", window, bands, row["t"], row["crs"], row["total_chunks"], error), schema=_CHUNK)
        file.close()

    unread = empty.select("path", *[(F.col("error") if f == "error" else F.lit(None)).alias(f) for f in _CHUNK.names[1:]])
    read = _plan(files, grid, count).mapInArrow(run, CHUNK)
    return read.unionByName(unread.select([F.col(f.name).cast(f.dataType) for f in read.schema.fields]))


def cut(files: DataFrame, windows: DataFrame, decoders: Decoders | None = None) -> DataFrame:
    """``windows`` (path, r0, c0, h, w, ...) with ``content``, a GeoTIFF of all bands of the window in its place, and ``error``, why it has none."""
    own = windows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = _Open(decoders)
        for batch in batches:
            content = _content(batch)
            for k, (path, r0, c0, h, w) in enumerate(zip(*(batch[n].to_pylist() for n in ("path", "r0", "c0", "h", "w")))):
                data, error = None, None
                try:
                    tiff = file(path, content[k])
                    a, b, c, d, e, f = tiff.transform
                    data = encode(tiff.read(r0, c0, h, w), (a, b, c + a * c0 + b * r0, d, e, f + d * c0 + e * r0), int(tiff.crs[5:]) if tiff.crs else None, deflate=True, nodata=tiff.nodata)
                except FAILURES as x:
                    error = str(x)
                yield pa.RecordBatch.from_arrays([*(batch[n].slice(k, 1) for n in own), pa.array([data], pa.binary()), pa.array([error], pa.string())], names=[*own, "content", "error"])
        file.close()

    return _plan(files, windows, windows.count()).mapInArrow(run, f"{schema}, content binary, error string")


def rgb(files: DataFrame) -> DataFrame:
    """(path, width, height, png, error): the first three bands of whole images as pictures; one band gives grey. For images that fit in a task."""
    from .images import encode_png

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), _content(batch)):
                out = {"path": path}
                try:
                    with opened(path, content) as get:
                        pixels = Tiff(get).read()[:3]
                    pixels = np.repeat(pixels[:1], 3, axis=0) if len(pixels) < 3 else pixels
                    out |= {"width": pixels.shape[2], "height": pixels.shape[1], "png": encode_png(np.clip(np.nan_to_num(pixels), 0, 255).astype(np.uint8).transpose(1, 2, 0))}
                except FAILURES as x:
                    out["error"] = str(x)
                yield pa.RecordBatch.from_pylist([out], pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("png", pa.binary()), ("error", pa.string())]))

    return files.select(*[c for c in ("path", "content") if c in files.columns]).mapInArrow(run, "path string, width int, height int, png binary, error string")


CHUNK = "path string, chunk_id string, window struct<col_off:int,row_off:int,width:int,height:int>, pixels array<array<float>>, geo_transform array<double>, crs string, total_chunks int, error string"
_CHUNK = pa.schema([("path", pa.string()), ("chunk_id", pa.string()), ("window", pa.struct([(k, pa.int32()) for k in ("col_off", "row_off", "width", "height")])), ("pixels", pa.list_(pa.list_(pa.float32()))), ("geo_transform", pa.list_(pa.float64())), ("crs", pa.string()), ("total_chunks", pa.int32()), ("error", pa.string())])
