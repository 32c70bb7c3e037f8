"""Rasters and files as Spark data sources: ``spark.read.format("gridwright_raster")`` and ``df.write.format("gridwright_files")``.

The reader deals every file to tasks in shares of about SHARE_BYTES. The driver only
lists files; each task reads the header and the blocks that its windows meet, so the
scan needs no shuffle. Filters on path leave out files before tasks are made, filters
on the place of a window leave out windows before their blocks are read.

The writer puts each row's content below a folder of its own first. When all tasks
have ended, the driver moves what they wrote to its place, whole folders at once
where it can, so it holds no list of files; where a task fails for good, all goes.
So a folder holds files of whole jobs only.
"""

from __future__ import annotations

import importlib
import math
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.constants import CHUNK_OVERLAP, CHUNK_SIZE, UNKNOWN_CRS
from . import geotiff
from .scratch import file_system, written

if TYPE_CHECKING:
    from pyarrow.fs import FileSystem

READER, WRITER, PARTS = "gridwright_raster", "gridwright_files", "gridwright_parts"
#: Bytes of files that a task of the reader has about, and small files that it has at most.
SHARE_BYTES, SHARE_FILES = 64 << 20, 256
#: How often the writer looks for files of a job that failed, at a fifth of a second.
ABORT_TRIES = 50
#: File systems that move a folder with all that is in it.
MOVES_FOLDERS = ("local", "hdfs")
#: Columns of a window's place, on which filters are pushed down.
PLACE = ("cr", "cc", "r0", "c0", "h", "w")
SCHEMA = f"{geotiff.CHUNK}, {', '.join(f'{c} int' for c in PLACE)}, blocks_read int"
_TESTS = {EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x}


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session and lets it push filters into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
    spark.dataSource.register(FileSink)
    spark.dataSource.register(PartSink)


def read_rasters(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Windows of all rasters below a folder: the columns of geotiff.chunks, the window's place and how many blocks were decoded for it."""
    register(spark)
    return spark.read.format(READER).options(**options).load(path)


def write_rows(rows: DataFrame, folder: str) -> None:
    """Writes the files (path, content) below ``folder``, all or none. Paths are relative; the rows may hold each path once."""
    register(rows.sparkSession)
    rows.select("path", "content").write.format(WRITER).mode("append").save(folder)


@dataclass
class Share(InputPartition):
    """Of each file (path) the windows whose number leaves ``part`` when divided by ``parts``; whole files have one part."""

    files: list[str]
    part: int = 0
    parts: int = 1


class RasterSource(DataSource):
    """Options: path, chunk and overlap in pixels, ready (bands to be made ready, 0 for raw ones), masked (true: pixels that the file says to be without data are NaN, and count for nothing when bands are made ready), suffix (any of, by commas), share in bytes, decoder ("module:function") for JPEG blocks."""

    @classmethod
    def name(cls) -> str:
        return READER

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RasterReader(dict(self.options))


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.size, self.overlap, self.ready = int(options.get("chunk", CHUNK_SIZE)), int(options.get("overlap", CHUNK_OVERLAP)), int(options.get("ready", 0))
        self.suffixes = tuple(options.get("suffix", ".tif,.tiff").lower().split(","))
        self.share, self.decoder = int(options.get("share", SHARE_BYTES)), options.get("decoder")
        self.masked = str(options.get("masked", "false")).lower() == "true"
        self.tests: list[tuple[str, type[Filter], object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of path and of a window's place; Spark applies the others."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _TESTS and name in ("path", *PLACE):
                self.tests.append((name, type(f), f.value))
            else:
                yield f

    def _passes(self, values: dict[str, object]) -> bool:
        """A null passes no test, as in SQL."""
        return all(values[name] is not None and _TESTS[kind](values[name], x) for name, kind, x in self.tests if name in values)

    def partitions(self) -> list[Share]:
        from pyarrow.fs import FileSelector, FileType

        system, base = file_system(self.path)
        files = system.get_file_info(FileSelector(base, recursive=True))
        prefix = self.path.rstrip("/")[: -len(base.rstrip("/"))]  # what stands before the name in the file system
        found = sorted((prefix + f.path, f.size or 0) for f in files if f.type == FileType.File and f.base_name.lower().endswith(self.suffixes) and not f.base_name.startswith((".", "_")))
        shares, group, held = [], [], 0
        for path, size in found:
            if not self._passes({"path": path}):
                continue
            if size > self.share:
                parts = math.ceil(size / self.share)
                shares += [Share([path], k, parts) for k in range(parts)]
                continue
            if group and (held + size > self.share or len(group) == SHARE_FILES):
                shares.append(Share(group))
                group, held = [], 0
            group, held = [*group, path], held + size
        return [*shares, Share(group)] if group or not shares else shares

    def _windows(self, tiff: geotiff.Tiff, part: int, parts: int) -> Iterator[dict[str, int]]:
        """The windows of a share: bands of rows of windows that lie together, so blocks are met by one task."""
        down, across = (-(-d // self.size) for d in (tiff.height, tiff.width))
        numbers = range(part * down * across // parts, (part + 1) * down * across // parts)
        for k in numbers:
            at = {"cr": k // across, "cc": k % across}
            for name, axis, dim, origin in (("h", "cr", tiff.height, "r0"), ("w", "cc", tiff.width, "c0")):
                at[origin] = max(0, at[axis] * self.size - self.overlap)
                at[name] = min(self.size + 2 * self.overlap, dim - at[origin])
            if self._passes(at):
                yield at

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        decoders = {}
        if self.decoder:
            module, _, function = self.decoder.partition(":")
            decoders = {7: getattr(importlib.import_module(module), function)}
        schema = pa.schema([*geotiff._CHUNK, *((c, pa.int32()) for c in (*PLACE, "blocks_read"))])

        def row(path: str, at: dict, bands: object, tiff: geotiff.Tiff | None, error: str | None, blocks: int) -> pa.RecordBatch:
            total = -(-tiff.width // self.size) * -(-tiff.height // self.size) if tiff else None
            name, window = (f"{at['cr']}_{at['cc']}", (at["r0"], at["c0"], at["h"], at["w"])) if at else (None, (0, 0, 0, 0))
            columns = geotiff.chunk_row(path, name, window, bands, tiff.transform if tiff else None, (tiff.crs or UNKNOWN_CRS) if tiff else None, total, error)
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([at.get(c)], pa.int32()) for c in PLACE), pa.array([blocks], pa.int32())], schema=schema)

        for path in partition.files:
            empty = geotiff.np.zeros((0, 0), geotiff.np.float32)
            try:
                with geotiff.opened(path) as get:
                    tiff = geotiff.Tiff(get, decoders)
                    for at in self._windows(tiff, partition.part, partition.parts):
                        before, error, bands = tiff.decoded, None, empty
                        try:
                            bands = tiff.read(at["r0"], at["c0"], at["h"], at["w"])
                            bands = tiff.masked(bands) if self.masked else bands.astype("float32")
                            bands = geotiff.ready_bands(bands, self.ready, self.masked) if self.ready else bands
                        except geotiff.FAILURES as x:
                            error = str(x)
                        yield row(path, at, bands, tiff, error, tiff.decoded - before)
            except geotiff.FAILURES as x:
                if partition.part == 0 and self._passes(dict.fromkeys(PLACE)):
                    yield row(path, {}, empty, None, str(x), 0)


#: Strips whose sizes are summed in one group of a window.
STRIPS_PER_RUN = 1024


def write_strips(strips: DataFrame, folder: str, path: str, count: int, **header: object) -> None:
    """Writes one GeoTIFF below ``folder`` from its strips (k, data), all ``count`` of them, as geotiff.pack_strip gives them; ``header`` as for geotiff.leading_header.

    No task holds the file: strips are written once, the sizes before each are summed in
    runs, and every strip goes to its place with its own entries of both lists. Beyond
    4 GB it is a BigTIFF.
    """
    spark = strips.sparkSession
    register(spark)
    kept = written(strips.select(F.col("k").cast("bigint").alias("k"), "data"), "strips")
    sized = kept.select("k", F.octet_length("data").cast("bigint").alias("n"), F.floor(F.col("k") / STRIPS_PER_RUN).alias("run"))
    runs = written(sized.groupBy("run").agg(F.sum("n").alias("n"), F.count("*").alias("strips")), "runs")
    total, there = runs.agg(F.sum("n"), F.sum("strips")).first()
    if there != count:
        raise ValueError(f"{there} strips of {count}")
    big = total + 16 * count > (1 << 32) - (1 << 16)
    parts, places, sizes, first = geotiff.leading_header(count, big, **header)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("run", before(Window.orderBy("run")).alias("start"))
    within = kept.withColumns({"n": F.octet_length("data").cast("bigint"), "run": F.floor(F.col("k") / STRIPS_PER_RUN)}).withColumn("before", before(Window.partitionBy("run").orderBy("k")))
    width = 8 if big else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, out = [], []
            for k, data, at in zip(*(batch[c].to_pylist() for c in ("k", "data", "at"))):
                offsets += [places + width * k, sizes + width * k, at]
                out += [at.to_bytes(width, "little"), len(data).to_bytes(width, "little"), data]
            yield pa.RecordBatch.from_pydict({"path": [path] * len(out), "offset": pa.array(offsets, pa.int64()), "part": pa.array(out, pa.binary())})

    placed = within.join(starts, "run").select("k", "data", (F.col("start") + F.col("before") + first).alias("at")).mapInArrow(run, "path string, offset bigint, part binary")
    rows = placed.unionByName(spark.createDataFrame([(path, at, part) for at, part in parts], "path string, offset bigint, part binary"))
    rows = rows if has_positions(folder) else rows.repartition("path").sortWithinPartitions("path", "offset")
    rows.write.format(PARTS).mode("append").save(folder)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return WRITER

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], overwrite)


@dataclass
class Placed(WriterCommitMessage):
    """Where the files of one task are, by the names that they get below the target. It doesn't grow with them, as all messages meet in the driver."""

    folder: str


def _entries(system: FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder) of what stands in a folder."""
    from pyarrow.fs import FileSelector, FileType

    if system.type_name == "local":  # one after the other, however many there are
        with os.scandir(folder) as found:
            for entry in found:
                yield entry.path, entry.is_dir(follow_symlinks=False)
    else:
        for f in system.get_file_info(FileSelector(folder)):
            yield f.path, f.type == FileType.Directory


def move_into(system: FileSystem, source: str, target: str) -> None:
    """Moves what stands in ``source`` to ``target``: a folder as a whole where the target has none of its name yet, else what is in it. Files of the same name are replaced."""
    from pyarrow.fs import FileType

    system.create_dir(target, recursive=True)
    again = True
    while again:  # a folder that is read while entries leave it may pass over some
        again = False
        for path, is_folder in _entries(system, source):
            to = f"{target}/{path.rpartition('/')[2]}"
            if is_folder and (system.type_name not in MOVES_FOLDERS or system.get_file_info(to).type == FileType.Directory):
                move_into(system, path, to)
            else:
                system.move(path, to)
                again = system.type_name == "local"


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        self.aside = f"{self.folder}/_aside-{uuid.uuid4().hex}"  # one for each job; the object travels to the tasks

    def write(self, rows: Iterator[Row]) -> Placed:
        system, base = file_system(self.aside)
        own = f"{base}/{uuid.uuid4().hex}"  # attempts of a task don't meet
        for row in rows:
            if row["content"] is None:
                raise ValueError(f"{row['path']} has no content")
            name = f"{own}/{row['path']}"
            system.create_dir(name.rpartition("/")[0], recursive=True)
            with system.open_output_stream(name) as out:
                out.write(bytes(row["content"]))
        return Placed(own)

    def commit(self, messages: list[Placed | None]) -> None:
        from pyarrow.fs import FileSelector, FileType

        system, base = file_system(self.folder)
        if self.overwrite:
            for old in system.get_file_info(FileSelector(base, allow_not_found=True)):
                if old.base_name != self.aside.rpartition("/")[2]:
                    (system.delete_dir if old.type == FileType.Directory else system.delete_file)(old.path)
        for folder in dict.fromkeys(m.folder for m in messages if m):
            if system.get_file_info(folder).type == FileType.Directory:  # a task without rows has none
                move_into(system, folder, base)
        self._clean()

    def abort(self, messages: list[Placed | None]) -> None:
        """Tasks that are still being ended may write for a moment, so the folder is looked at until it stays away."""
        gone = 0
        for _ in range(ABORT_TRIES):
            try:
                gone = 0 if self._clean() else gone + 1
            except OSError:
                gone = 0
            if gone == 3:
                return
            time.sleep(0.2)

    def _clean(self) -> bool:
        """Deletes what stands aside; was there any?"""
        from pyarrow.fs import FileType

        system, base = file_system(self.aside)
        there = system.get_file_info(base).type == FileType.Directory
        if there:
            system.delete_dir(base)
        return there


class PartSink(FileSink):
    """Files as parts (path, offset, part); a part that comes twice is written twice, to the same place."""

    @classmethod
    def name(cls) -> str:
        return PARTS

    def schema(self) -> str:
        return "path string, offset bigint, part binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PartWriter(self.options["path"], overwrite)


def has_positions(folder: str) -> bool:
    """Whether tasks can write at any place of a file there, as local and mounted file systems let them; a store takes a file from its start to its end."""
    return file_system(folder)[0].type_name == "local"


class PartWriter(FileWriter):
    """Tasks share the files of the job, and so do attempts, which write the same parts to the same places. Where there are no positions, a task must get all parts of a file in order."""

    def write(self, rows: Iterator[Row]) -> Placed:
        system, base = file_system(self.aside)
        path, out, at = None, None, 0
        try:
            for row in rows:
                if row["part"] is None or row["offset"] is None or row["path"] is None:
                    raise ValueError(f"a part of {row['path']} without content or position")
                if row["path"] != path:
                    if out is not None:
                        out.close()
                    path, at = row["path"], 0
                    name = f"{base}/{path}"
                    system.create_dir(name.rpartition("/")[0], recursive=True)
                    out = os.fdopen(os.open(name, os.O_CREAT | os.O_WRONLY), "wb") if system.type_name == "local" else system.open_output_stream(name)
                if system.type_name == "local":
                    out.seek(row["offset"])
                elif row["offset"] != at:
                    raise ValueError(f"{path} continues at {at}, not at {row['offset']}")
                out.write(bytes(row["part"]))
                at += len(row["part"])
        finally:
            if out is not None:
                out.close()
        return Placed(base)
