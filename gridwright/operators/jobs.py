"""Documents as logs of patches, job progress, and joins of jobs with uploads and detections.

Defined results: rows without a key are one document or one job; a patch without a
number sets nothing, and a key that has no other ones has null fields; a request
without an upload, or with a null one, starts nothing and is answered 404, also where
the upload's status is null; a null n_det counts nothing; equal numbers leave one of
their values; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import TTL_SECONDS
from ..functions.numbers import progress_percent


def fold_patches(events: DataFrame, key: str, seq: str, fields: list[str]) -> DataFrame:
    """Each key's document: of every field the last value that a patch set, by ``seq``.

    One hash aggregation; a patch that leaves a field null does not touch it.
    """
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in fields]
    return events.groupBy(key).agg(*last, F.max(seq).alias(seq))


def latest(events: DataFrame, key: str, seq: str) -> DataFrame:
    """Each key's last row as a whole, null fields too."""
    others = [c for c in events.columns if c != key]
    row = events.groupBy(key).agg(F.max_by(F.struct(*others), seq).alias("_row"))
    return row.select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def alive(documents: DataFrame, now: Column, written: str = "updated_at", ttl: int = TTL_SECONDS) -> DataFrame:
    """Documents whose time to live is not over."""
    return documents.where(now < F.col(written) + F.lit(ttl))


def start_jobs(requests: DataFrame, uploads: DataFrame) -> DataFrame:
    """Requests with their upload's path and metadata; only uploads that are ready start a job."""
    return requests.join(uploads.where("status = 'ready'"), "upload_id")


def refused_jobs(requests: DataFrame, uploads: DataFrame) -> DataFrame:
    """Requests whose upload does not exist."""
    return requests.join(uploads.select("upload_id"), "upload_id", "left_anti")


def start_status(requests: DataFrame, uploads: DataFrame) -> DataFrame:
    """Adds the status of requests to start a job: 404 without an upload, 400 if it is not ready, else 200."""
    joined = requests.join(uploads.select("upload_id", F.col("status").alias("_status")), "upload_id", "left")
    return joined.withColumn("http_status", F.when(F.col("_status").isNull(), 404).when(F.col("_status") != "ready", 400).otherwise(200)).drop("_status")


def stamped(documents: DataFrame, written: str = "updated_at") -> DataFrame:
    """Adds the time of writing, in seconds with a fraction, as alive() reads it."""
    return documents.withColumn(written, F.unix_micros(F.current_timestamp()) / F.lit(1e6))


def with_id(documents: DataFrame, name: str = "job_id") -> DataFrame:
    """Adds a random id; write the result before using it twice, as ids are drawn anew in each run."""
    return documents.withColumn(name, F.uuid())


def progress(messages: DataFrame) -> DataFrame:
    """Adds chunks_done, detections_found and progress to chunk messages (job_id, seq, total_chunks, n_det)."""
    order = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = messages.withColumns({"chunks_done": F.count("*").over(order), "detections_found": F.coalesce(F.sum("n_det").over(order), F.lit(0))})
    return counted.withColumn("progress", progress_percent(F.col("chunks_done"), F.col("total_chunks")))


def replay(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """For each finished or failed job one message with its status and number of detections; counts come before the join."""
    counts = found.groupBy("job_id").agg(F.count("*").alias("n"))
    ended = jobs.where(F.col("status").isin("completed", "failed"))
    return ended.join(counts, "job_id", "left").select("job_id", "status", F.lit("completed").alias("type"), F.coalesce("n", F.lit(0)).alias("total_detections"))
