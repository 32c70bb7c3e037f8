"""Requests to start jobs and the states of uploads as two streams that are joined in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import UPLOAD_TTL_SECONDS


def start_status(requests: DataFrame, states: DataFrame, ttl: int = UPLOAD_TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Each request (job_id, upload_id, asked_at) with the states (upload_id, status, said_at) of its upload that hold then: said before, and at most ``ttl`` seconds.

    http_status is 200 for a ready upload, 400 for another, and 404 without one, which
    is said as soon as the watermarks of both sides have passed the time in which a
    state could come. Rows later than ``late`` count for nothing. State is bounded by
    ``ttl`` and ``late`` on both sides. An upload with several states gives a row for
    each; ``decided`` picks the last. Requests without an
    upload_id or a time get no answer, and rows without an upload_id move no watermark.
    """
    asked = requests.where("asked_at is not null and upload_id is not null").withWatermark("asked_at", late)
    said = states.where("said_at is not null").select(F.col("upload_id").alias("_upload"), F.col("status").alias("_status"), "said_at").withWatermark("said_at", late)
    holds = (F.col("upload_id") == F.col("_upload")) & (F.col("said_at") <= F.col("asked_at")) & (F.col("said_at") >= F.col("asked_at") - F.make_dt_interval(secs=F.lit(ttl)))
    answer = F.when(F.col("_upload").isNull(), 404).when(F.coalesce(F.col("_status"), F.lit("")) == "ready", 200).otherwise(400)
    return asked.join(said, holds, "left").select("job_id", "upload_id", "asked_at", "said_at", answer.alias("http_status"))


def decided(answers: DataFrame) -> DataFrame:
    """(job_id, http_status): the answer by the upload's last state before each request, of the rows that start_status gave; ready wins a tie."""
    order = F.struct("said_at", F.col("http_status") == 200)
    return answers.groupBy("job_id").agg(F.max_by("http_status", order).alias("http_status"))
