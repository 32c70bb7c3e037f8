"""A log in numbered batches, its snapshot, and a stream that begins exactly behind it.

``append`` writes each batch of a stream to a folder of its own and then its number
to the list of batches; a batch that runs again replaces itself. A position in the
log is the number of batches that are there, so what a snapshot holds and what the
tail brings depends on when a message was written and never on its contents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.scratch import file_system

LOG = "gridwright_log"
_DONE = "_batches"


def _folder(log: str, number: int) -> str:
    return f"{log.rstrip('/')}/{number:012d}"


def position(log: str) -> int:
    """How many batches of the log are complete: the first number that isn't in its list."""
    from pyarrow.fs import FileSelector

    system, base = file_system(log)
    there = {int(f.base_name) for f in system.get_file_info(FileSelector(f"{base}/{_DONE}", allow_not_found=True)) if f.base_name.isdecimal()}
    n = 0
    while n in there:
        n += 1
    return n


def append(stream: DataFrame, log: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Appends a stream's batches to the log; one query writes a log. Ends when all is read, or runs by ``trigger``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_folder(log, number))
        system, base = file_system(log)
        system.create_dir(f"{base}/{_DONE}", recursive=True)
        with system.open_output_stream(f"{base}/{_DONE}/{number:012d}") as out:
            out.write(b"")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def snapshot(spark: SparkSession, log: str, schema: str, until: int) -> DataFrame:
    """All messages of the first ``until`` batches."""
    return spark.read.schema(schema).parquet(*[_folder(log, k) for k in range(until)]) if until else spark.createDataFrame([], schema)


def tail(spark: SparkSession, log: str, schema: str, after: int) -> DataFrame:
    """All messages of later batches, as a stream."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format(LOG).schema(schema).option("after", after).load(log)


def follow(spark: SparkSession, log: str, schema: str, job_id: int) -> tuple[DataFrame, DataFrame]:
    """A job's messages so far as a table in their order, and all later ones as a stream: each message is on one side, whatever its number."""
    at = position(log)
    mine = F.col("job_id") == job_id
    return snapshot(spark, log, schema, at).where(mine).orderBy("seq"), tail(spark, log, schema, at).where(mine)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return LOG

    def schema(self) -> str:
        raise ValueError("a log needs its schema")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LogReader(self.options["path"], int(self.options.get("after", 0)), schema)


class LogReader(DataSourceStreamReader):
    """Offsets are positions in the log; the files of a batch are dealt to tasks one by one."""

    def __init__(self, log: str, after: int, schema: StructType) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        self.log, self.after, self.kinds = log, after, to_arrow_schema(schema)

    def initialOffset(self) -> dict[str, int]:
        return {"batches": self.after}

    def latestOffset(self) -> dict[str, int]:
        return {"batches": max(self.after, position(self.log))}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[_File]:
        from pyarrow.fs import FileSelector

        system, _ = file_system(self.log)
        files = [f for k in range(start["batches"], end["batches"]) for f in system.get_file_info(FileSelector(file_system(_folder(self.log, k))[1]))]
        return [_File(f.path) for f in files if f.base_name.endswith(".parquet")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        system, _ = file_system(self.log)
        with parquet.ParquetFile(partition.path, filesystem=system) as file:
            for batch in file.iter_batches(columns=self.kinds.names):
                yield batch.select(self.kinds.names).cast(self.kinds)
