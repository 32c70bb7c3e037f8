"""Job messages as streams: parsing, the state of each job, counts and windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.constants import PING_SECONDS, TTL_SECONDS

#: A job's statuses in the order that it can take.
ORDER = {"queued": 0, "running": 1, "completed": 2, "failed": 2}
STATES = "job_id bigint, status string, chunks_done int, total_chunks int, detections_found int, progress double, error string"
STATE = "status string, chunks_done int, total_chunks int, detections_found int, error string"
NEW = ("queued", 0, 0, 0, None)


def parse(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """JSON frames; what can't be parsed or has no type is dropped."""
    parsed = lines.select(F.from_json(value, schema, {"mode": "PERMISSIVE"}).alias("m"))
    return parsed.where("m is not null and m.type is not null").select("m.*")


def advance(state: tuple, rows: pd.DataFrame) -> tuple:
    """The state (as in STATE) after more messages of a job, in the order of their seq; what follows the first end counts for nothing."""
    status, done, total, found, error = state
    if ORDER[status] == 2:
        return state
    rows = rows.sort_values("seq", kind="stable")
    kind = rows["type"].to_numpy(object)
    ends = np.flatnonzero((kind == "completed") | (kind == "error"))
    live = rows.iloc[: ends[0]] if len(ends) else rows
    chunk = (live["type"] == "chunk_done").to_numpy(bool)
    begun = chunk | (live["type"] == "started").to_numpy(bool)
    totals = live["total_chunks"][begun].dropna()
    total = int(totals.iloc[-1]) if len(totals) else total
    done, found = done + int(chunk.sum()), found + int(live["n_det"][chunk].dropna().sum())
    if len(ends):
        last = rows.iloc[ends[0]]
        failed = last["type"] == "error"
        return "failed" if failed else "completed", done, total, found, last["error"] if failed and isinstance(last["error"], str) else None
    return "running" if begun.any() else status, done, total, found, error


def state_row(job_id: int | None, state: tuple) -> tuple:
    """A row of STATES."""
    status, done, total, found, error = state
    share = 100.0 if status == "completed" else int(done / total * 10000 + 0.5) / 100 if total else 0.0
    return job_id, status, done, total, found, share, error


def job_states(messages: DataFrame, expire: bool = False, forget: bool = False) -> DataFrame:
    """The state of each job after each batch (STATES), from (job_id, seq, type, total_chunks, n_det, error).

    queued, running, then completed or failed. A job that has ended takes no
    further messages. Numbers that are null change nothing, and messages without a
    seq are left out. With ``expire`` the state of a job that was silent for a day
    is dropped; a query with such timers never runs out of batches, so it suits a
    stream that stays up, not one that ends when all is read. With ``forget`` a job's
    state is dropped as soon as it ends, for ids that no later message names.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if expire and state.hasTimedOut:
            state.remove()
            return
        new = advance(state.get if state.exists else NEW, pd.concat(list(batches)))
        if forget and ORDER[new[0]] == 2:
            if state.exists:
                state.remove()
        else:
            state.update(new)
            if expire:
                state.setTimeoutDuration(1000 * TTL_SECONDS)
        yield pd.DataFrame([state_row(key[0], new)], columns=[c.split()[0] for c in STATES.split(", ")])

    return messages.where("seq is not null").groupBy("job_id").applyInPandasWithState(fold, STATES, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def final_states(messages: DataFrame) -> DataFrame:
    """What job_states ends with, as one aggregation over a finished log."""
    messages = messages.where("seq is not null")
    known = messages.groupBy("job_id").agg(
        F.min_by("type", F.when(F.col("type").isin("completed", "error"), F.col("seq"))).alias("end"),
        F.min(F.when(F.col("type").isin("completed", "error"), F.col("seq"))).alias("end_seq"),
        F.min_by("error", F.when(F.col("type").isin("completed", "error"), F.col("seq"))).alias("end_error"),
    )
    live = messages.withColumnRenamed("job_id", "_job").join(known, F.col("_job").eqNullSafe(F.col("job_id"))).where(F.col("end_seq").isNull() | (F.col("seq") <= F.col("end_seq")))
    chunk = F.col("type") == "chunk_done"
    sums = live.groupBy("job_id").agg(F.count_if(chunk).cast("int").alias("chunks_done"), F.coalesce(F.max_by("total_chunks", F.when(F.col("type").isin("started", "chunk_done") & F.col("total_chunks").isNotNull(), F.col("seq"))), F.lit(0)).cast("int").alias("total_chunks"), F.coalesce(F.sum(F.when(chunk, F.col("n_det"))), F.lit(0)).cast("int").alias("detections_found"), F.count_if(F.col("type").isin("started", "chunk_done")).alias("begun"), F.first("end").alias("end"), F.first("end_error").alias("error"))
    status = F.when(F.col("end") == "completed", "completed").when(F.col("end") == "error", "failed").when(F.col("begun") > 0, "running").otherwise("queued")
    share = F.when(status == "completed", 100.0).when(F.col("total_chunks") > 0, F.floor(F.col("chunks_done") / F.col("total_chunks") * 10000 + 0.5) / 100).otherwise(0.0)
    return sums.select("job_id", status.alias("status"), "chunks_done", "total_chunks", "detections_found", share.alias("progress"), F.when(status == "failed", F.col("error")).alias("error"))


def counts(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("n"))


def windows(events: DataFrame, ts: Column, kind: str = "tumbling", length: str = "1 hour", slide: str = "30 minutes", gap: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts by tumbling, sliding or session windows of ``ts``; late data go by the stream's watermark."""
    w = {"tumbling": lambda: F.window(ts, length), "sliding": lambda: F.window(ts, length, slide), "session": lambda: F.session_window(ts, gap)}[kind]()
    found = events.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"))
    return found.select(*by, F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "n")


def forward(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = PING_SECONDS) -> StreamingQuery:
    """Hands each batch to ``send``, at least once; the batch number tells repeats apart."""
    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is there to Parquet files, exactly once, and ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def snapshot_and_tail(spark: SparkSession, log: str, schema: str, job_id: int, seen: int) -> tuple[DataFrame, DataFrame]:
    """A job's messages up to number ``seen`` as a table, and the later ones as a stream: none is lost between them if they are written in the order of their numbers; log.follow does without that."""
    return spark.read.schema(schema).parquet(log).where((F.col("job_id") == job_id) & (F.col("seq") <= seen)).orderBy("seq"), spark.readStream.schema(schema).parquet(log).where((F.col("job_id") == job_id) & (F.col("seq") > seen))


def run_once(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Drives a stream over all that is there, and gives what it says then.

    Every batch is written as Parquet below ``folder``, under its number, so a
    repeated batch replaces itself. In complete mode the last batch holds all.
    """
    written: dict[int, str] = {}

    def write(batch: DataFrame, number: int) -> None:
        written[number] = f"{folder}/batches/{number}"
        batch.write.mode("overwrite").parquet(written[number])

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    paths = [written[max(written)]] if mode == "complete" and written else list(written.values())
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)
