"""Uploads in parts: splitting, putting together, and the rules they must keep.

Defined results: a null content has no parts, an empty one has one empty part; a part
that is null is counted as received, adds nothing to a value, has no length in a
manifest, and is refused by ``place``; parts without a number are refused as well; of
copies of a part without an order between them any may win; rows without a key are
of one upload; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.constants import MAX_UPLOAD_BYTES, PART_BYTES
from ..sources.datasource import PARTS, has_positions, register
from ..sources.geotiff import opened
from ..sources.scratch import file_system

#: Parts of a file that a task writes in a row, and slices that a task reads.
PARTS_PER_TASK = 64
#: Files and bytes that a task has about to read whole, and bytes that one read fetches.
FILES_PER_TASK, BYTES_PER_TASK, READ_BYTES = 4096, 64 << 20, 1 << 20


def split_parts(files: DataFrame, key: str, content: str, size: int = PART_BYTES) -> DataFrame:
    """(key, idx, part): slices of ``size``; bytes of a binary, characters of a string. An empty file has one empty part."""
    if dict(files.dtypes)[content] == "string":  # one pass over the text, where substring would start anew for each part
        parts = F.regexp_extract_all(content, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
        return files.select(key, F.posexplode(F.when(F.col(content) == "", F.array(F.lit(""))).otherwise(parts)).alias("idx", "part"))
    count = F.greatest(F.lit(1), F.ceil(F.length(content) / F.lit(size)).cast("int"))
    rows = files.select(key, content, F.explode(F.sequence(F.lit(0), count - 1)).alias("idx"))
    return rows.select(key, "idx", F.substring(content, F.col("idx") * size + 1, F.lit(size)).alias("part"))


def _arrival(parts: DataFrame) -> Column:
    """What orders copies of a part."""
    return F.col("seq") if "seq" in parts.columns else F.lit(0)


def latest_parts(parts: DataFrame, key: str) -> DataFrame:
    """(key, idx, part, n): each part once, the later copy (by ``seq``, if there is one), and how often it arrived.

    This is the stored form of files that are larger than a value can be.
    """
    return parts.groupBy(key, "idx").agg(F.max_by("part", _arrival(parts)).alias("part"), F.count("*").alias("n"))


def reassemble(parts: DataFrame, key: str) -> DataFrame:
    """(key, content, received, distinct_parts, highest): parts in the order of their numbers.

    Writing a part again is harmless: the later copy wins, while ``received`` counts
    every arrival. A file is one value in the end, so its parts meet in one row.
    """
    joined = F.expr("listagg(part) within group (order by idx)")
    return latest_parts(parts, key).groupBy(key).agg(joined.alias("content"), F.sum("n").alias("received"), F.count("*").alias("distinct_parts"), F.max("idx").alias("highest"))


def slices(files: DataFrame, size: int = PART_BYTES) -> DataFrame:
    """(path, idx, part) of files (path, length) of any length: each task reads its slices by ranges. An empty file has one empty part."""
    count = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("length") / F.lit(size)))
    each = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("idx"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, get = None, None
            for name, idx, length in zip(*(batch[c].to_pylist() for c in ("path", "idx", "length"))):
                if name != path:
                    if get is not None:
                        get.close()
                    path, get = name, opened(name)
                part = get(idx * size, min(size, length - idx * size)) if length else b""
                yield pa.RecordBatch.from_pydict({"path": [name], "idx": pa.array([idx], pa.int32()), "part": pa.array([part], pa.binary())})
            if get is not None:
                get.close()

    # dealt by a written number of tasks, as these rows are small and what they stand for is not
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-(each.groupBy().count().first()[0]) // PARTS_PER_TASK))
    dealt = each.repartition(tasks, "path", F.floor(F.col("idx") / PARTS_PER_TASK)).sortWithinPartitions("path", "idx")
    return dealt.mapInArrow(run, "path string, idx int, part binary")


def manifest(parts: DataFrame, key: str, size: int = PART_BYTES) -> DataFrame:
    """(key, idx, offset, length, checksum, arrivals): the place of each part in its file; a part that came again is listed once, its later copy. Parts are measured where they are, so no bytes are shuffled."""
    bytes_of = F.col("part").cast("binary")
    measured = parts.select(key, "idx", _arrival(parts).alias("_seq"), F.octet_length(bytes_of).cast("bigint").alias("length"), F.md5(bytes_of).alias("checksum"))
    found = measured.groupBy(key, "idx").agg(F.max_by("length", "_seq").alias("length"), F.max_by("checksum", "_seq").alias("checksum"), F.count("*").alias("arrivals"))
    return found.select(key, "idx", (F.col("idx").cast("bigint") * size).alias("offset"), "length", "checksum", "arrivals")


def whole_files(listed: DataFrame, key: str, size: int = PART_BYTES) -> DataFrame:
    """(key, total_size, parts, whole) of a manifest: whole, if no part is missing and none but the last is short."""
    found = listed.groupBy(key).agg(F.sum("length").alias("total_size"), F.count("*").alias("parts"), F.max("idx").alias("_last"), F.count_if(F.col("length") != size).alias("_odd"), F.max_by("length", "idx").alias("_end"))
    tidy = (F.col("parts") == F.col("_last") + 1) & (F.col("_odd") - (F.col("_end") != size).cast("int") == 0) & (F.col("_end") <= size)
    return found.select(key, "total_size", "parts", tidy.alias("whole"))


def place(parts: DataFrame, key: str, folder: str, name: Column | None = None, size: int = PART_BYTES) -> None:
    """Writes each upload's parts to one file below ``folder``, named by ``name`` (the key), all files or none.

    Every part goes to the place that its number says, so parts may come in any order
    and again. No file is ever one value: many tasks write runs of a large file where
    files have positions, else a task streams a file's parts in their order. Check
    whole_files first, as a missing part leaves a hole.
    """
    register(parts.sparkSession)
    run = {"_run": F.floor(F.col("idx") / PARTS_PER_TASK)} if has_positions(folder) else {}
    named = parts.withColumns({"_path": F.col(key).cast("string") if name is None else name, **run})
    # copies of a part meet in the task that writes it, so bytes are shuffled once
    latest = named.repartition("_path", *run).groupBy("_path", *run, key, "idx").agg(F.max_by("part", _arrival(parts)).alias("part"))
    rows = latest.select(F.col("_path").alias("path"), (F.col("idx").cast("bigint") * size).alias("offset"), F.col("part").cast("binary").alias("part"))
    rows.sortWithinPartitions("path", "offset").write.format(PARTS).mode("append").save(folder)


def digests(files: DataFrame, folder: str) -> DataFrame:
    """Adds ``sha256`` to files (path below ``folder``, length, ...), each read by its name: no folder is listed, so empty files count and the driver holds no names.

    A task reads its files piece by piece. A null path has no digest, a file that isn't
    there is an error. The rows are counted first, so they should be a written table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)

        def digest(path: str) -> str:
            found = hashlib.sha256()
            with system.open_input_stream(f"{base}/{path}") as file:
                while piece := file.read(READ_BYTES):
                    found.update(piece)
            return found.hexdigest()

        for batch in batches:
            values = [None if path is None else digest(path) for path in batch["path"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string())], names=[*batch.schema.names, "sha256"])

    # dealt by a written number of tasks, as in slices
    count, length = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-count // FILES_PER_TASK), -(-length // BYTES_PER_TASK))
    return files.repartition(tasks, "path").mapInArrow(run, StructType([*files.schema, StructField("sha256", StringType())]))


def complete(found: DataFrame, total: str = "total_chunks") -> DataFrame:
    """Uploads of which no part is missing: a check of our own, on top of the counter."""
    return found.where((F.col("distinct_parts") == F.col(total)) & (F.col("highest") == F.col(total) - 1))


def is_raster_name(name: Column, any_case: bool = True) -> Column:
    return (F.lower(name) if any_case else name).rlike(r"\.tiff?$")


def validate(requests: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Adds the HTTP status of an upload request (filename, total_size): 413 too large, 400 wrong name, 200 accepted."""
    verdict = F.when(F.col("total_size") > max_bytes, 413).when(~is_raster_name(F.col("filename")), 400).otherwise(200)
    return requests.withColumn("http_status", verdict)


def chunk_status(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds the status of part uploads: 404 without a session, 400 if it is not uploading, else 200."""
    joined = requests.join(sessions.select("upload_id", F.col("status").alias("_status")), "upload_id", "left")
    return joined.withColumn("http_status", F.when(F.col("_status").isNull(), 404).when(F.col("_status") != "uploading", 400).otherwise(200)).drop("_status")
