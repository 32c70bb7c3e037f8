"""Polygon shapefiles as rows (path, geom_id, part, ring); the rings of a shape, holes too, share its geom_id."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.constants import DEFAULT_CRS
from ..operators.tiles import layer_files
from .geotiff import opened
from .scratch import written

POLYGONS = "path string, geom_id int, part int, ring array<array<double>>"
SHAPES = f"{POLYGONS}, error string"
_SHAPES = pa.schema([("path", pa.string()), ("geom_id", pa.int32()), ("part", pa.int32()), ("ring", pa.list_(pa.list_(pa.float64()))), ("error", pa.string())])
#: Records that a task reads in a row, and bytes of them that it reads at a time.
RECORDS, READ_BYTES = 5_000, 4 << 20


def rings_of(record: bytes) -> list[list[list[float]] | None]:
    """The rings of one record's contents; a null shape has one null ring."""
    kind = struct.unpack_from("<i", record)[0]
    if kind == 0:
        return [None]
    if kind not in (5, 15, 25):
        raise ValueError(f"shapes of type {kind} aren't supported")
    n_parts, n_points = struct.unpack_from("<ii", record, 36)
    if n_parts < 0 or n_points < 0 or len(record) < 44 + 4 * n_parts + 16 * n_points:
        raise ValueError("the record ends within its shape")
    starts = [*struct.unpack_from(f"<{n_parts}i", record, 44), n_points]
    points = np.frombuffer(record, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
    if any(not 0 <= a <= b for a, b in zip(starts, starts[1:])):
        raise ValueError("the parts of the shape are out of order")
    return [points[a:b].tolist() for a, b in zip(starts, starts[1:])]


def read_shapes(data: bytes) -> Iterator[tuple[int, int, list[list[float]] | None]]:
    """(record, part, ring) of a .shp file's polygons; a null shape has a null ring."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at + 8 <= len(data):
        number, words = struct.unpack_from(">ii", data, at)
        for part, ring in enumerate(rings_of(data[at + 8 : at + 8 + 2 * words])):
            yield number, part, ring
        at += 8 + 2 * words


def encode_index(shp: bytes) -> bytes:
    """The .shx file of a .shp file: where each record is and how long."""
    body, at = b"", 100
    while at + 8 <= len(shp):
        words = struct.unpack_from(">i", shp, at + 4)[0]
        body += struct.pack(">ii", at // 2, words)
        at += 8 + 2 * words
    return shp[:24] + struct.pack(">i", (100 + len(body)) // 2) + shp[28:100] + body


def encode_shapes(shapes: list[list[list[tuple[float, float]]] | None]) -> bytes:
    """A .shp file with a polygon of one or more rings for each entry; None is a null shape."""
    body = b""
    for number, rings in enumerate(shapes, 1):
        shape = struct.pack("<i", 0)
        if rings is not None:
            points = [p for ring in rings for p in ring]
            xs, ys = zip(*points)
            starts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
            shape = struct.pack(f"<i4dii{len(rings)}i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(points), *starts) + struct.pack(f"<{2 * len(points)}d", *(v for p in points for v in p))
        body += struct.pack(">ii", number, len(shape) // 2) + shape
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8) + body


def polygons(files: DataFrame) -> DataFrame:
    """POLYGONS of binaryFile rows."""
    kinds = pa.schema([("path", pa.string()), ("geom_id", pa.int32()), ("part", pa.int32()), ("ring", pa.list_(pa.list_(pa.float64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                rows = []
                for number, part, ring in read_shapes(content):
                    rows.append({"path": path, "geom_id": number, "part": part, "ring": ring})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return files.select("path", "content").mapInArrow(run, POLYGONS)


def _record_runs(path: str) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(number of the first record, places and lengths of up to RECORDS records) by the index beside a .shp file."""
    with opened(re.sub("(?i)p$", lambda m: "X" if m[0] == "P" else "x", path)) as get:
        head = get(0, 100)
        if len(head) < 100 or struct.unpack(">i", head[:4])[0] != 9994:
            raise ValueError("not an index of shapes")
        n = (2 * struct.unpack(">i", head[24:28])[0] - 100) // 8
        for first in range(0, n, RECORDS):
            some = get(100 + 8 * first, 8 * min(RECORDS, n - first))
            if len(some) < 8 * min(RECORDS, n - first):
                raise ValueError("the index ends early")
            yield first, [(2 * at, 2 * words) for at, words in struct.iter_unpack(">ii", some)]


def shapes(files: DataFrame) -> DataFrame:
    """SHAPES of .shp files (path) by their .shx indexes: runs of records are dealt to tasks and read by ranges.

    A record that can't be read has a row with an error, and so has a file without a
    usable index or with another format; other records and files aren't touched by it.
    """
    runs = "path string, first int, places array<struct<at:bigint,size:bigint>>, error string"
    kinds = pa.schema([("path", pa.string()), ("first", pa.int32()), ("places", pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64())]))), ("error", pa.string())])

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                try:
                    with opened(path) as get:
                        if struct.unpack(">i", get(0, 4))[0] != 9994:
                            raise ValueError("not a shapefile")
                    for first, places in _record_runs(path):
                        yield pa.RecordBatch.from_pylist([{"path": path, "first": first, "places": [{"at": a, "size": n} for a, n in places]}], kinds)
                except (ValueError, OSError, struct.error) as e:
                    yield pa.RecordBatch.from_pylist([{"path": path, "error": str(e)}], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["error"] is not None:
                    yield pa.RecordBatch.from_pylist([{"path": r["path"], "error": r["error"]}], _SHAPES)
                    continue
                rows, held = [], 0
                with opened(r["path"]) as get:
                    for number, place in enumerate(r["places"], r["first"] + 1):
                        try:
                            record = get(place["at"] + 8, place["size"])
                            rows += [{"path": r["path"], "geom_id": number, "part": part, "ring": ring} for part, ring in enumerate(rings_of(record))]
                        except (ValueError, OSError, struct.error) as e:
                            rows.append({"path": r["path"], "geom_id": number, "error": str(e)})
                        held += place["size"]
                        if held > READ_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, _SHAPES)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, _SHAPES)

    planned = written(files.select("path").mapInArrow(plan, runs), "records")
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, planned.count())
    return planned.repartition(tasks, "path", "first").mapInArrow(run, SHAPES)


def load_layers(spark: SparkSession, folder: str, region: str = "CG") -> DataFrame:
    """(region, layer_val, geom_id, part, ring, crs) of a region's four layers, numbered in their fixed order; null shapes are skipped.

    The system is that of the .prj file beside a layer, or WGS 84 where there is none.
    """
    names = layer_files(region)
    files = spark.read.format("binaryFile").load([f"{folder}/{n}" for n in names])
    value = lambda path: F.array_position(F.array(*map(F.lit, [n[:-4] for n in names])), F.regexp_replace(F.url_decode(F.element_at(F.split(path, "/"), -1)), r"\.\w+$", "")).cast("int")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.prj").load(folder)
    systems = found.select(value(F.col("path")).alias("layer_val"), geo.crs_of_wkt(F.col("content").cast("string")).alias("crs")).where("layer_val > 0")
    rings = polygons(files).where("ring is not null").select(F.lit(region).alias("region"), value(F.col("path")).alias("layer_val"), "geom_id", "part", "ring")
    return rings.join(F.broadcast(systems), "layer_val", "left").select("region", "layer_val", "geom_id", "part", "ring", F.coalesce("crs", F.lit(DEFAULT_CRS)).alias("crs"))  # a system for each of four layers
