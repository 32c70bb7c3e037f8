"""Jobs' lifecycle with timers, logs with positions, and requests joined with states of uploads in time."""

import random
import time
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridwright.streaming import lifecycle, log
from gridwright.streaming import messages as stream
from gridwright.streaming import requests as starts

SCHEMA = "job_id bigint, seq bigint, type string, total_chunks int, n_det int, error string"


def fold(rows):
    """The plain way, message by message."""
    status, done, total, found, error = stream.NEW
    for _, _, kind, chunks, n, why in sorted(rows, key=lambda r: r[1]):
        if status in ("completed", "failed"):
            break
        if kind in ("started", "chunk_done"):
            status, total = "running", total if chunks is None else chunks
            if kind == "chunk_done":
                done, found = done + 1, found + (n or 0)
        elif kind in ("completed", "error"):
            status, error = ("completed", None) if kind == "completed" else ("failed", why)
    return status, done, total, found, error


def random_log(rng, n):
    maybe = lambda x: None if rng.random() < 0.3 else x
    return [(rng.choice([1, 2, 3, 4, 5]), k, rng.choice(["started", "chunk_done", "chunk_done", "chunk_done", "ping", None, *(["completed", "error"] if k % 40 == 0 else [])]), maybe(rng.randint(0, 9)), maybe(rng.randint(0, 5)), maybe("boom")) for k in range(n)]


def test_advance_is_the_plain_fold():
    rng = random.Random(8)
    for _ in range(60):
        rows = [r for r in random_log(rng, rng.randrange(1, 120)) if r[0] == 1] or [(1, 0, "ping", None, None, None)]
        frame = lambda part: pd.DataFrame(part, columns=["job_id", "seq", "type", "total_chunks", "n_det", "error"])
        shuffled = rng.sample(rows, len(rows))
        assert stream.advance(stream.NEW, frame(shuffled)) == fold(rows)
        cut = rng.randrange(len(rows) + 1)
        state = stream.NEW
        for part in (rows[:cut], rows[cut:]):
            state = stream.advance(state, frame(part)) if part else state
        assert state == fold(rows)


def test_lifecycle_ends_with_the_states_of_the_log(spark, tmp_path):
    rng = random.Random(4)
    rows = [*random_log(rng, 300), (None, 1, "started", 3, None, None), (6, None, "started", 1, None, None)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/log")
    want = Counter(map(tuple, stream.final_states(spark.read.parquet(f"{tmp_path}/log")).collect()))
    for k, forget in enumerate((False, True)):
        with lifecycle.rocks(spark):
            found = stream.run_once(lifecycle.lifecycle(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/log"), timed=False, forget=forget), "update", f"{tmp_path}/c{k}")
        assert Counter(tuple(r)[:-1] for r in found.collect()) == want and len(want) == 6
        assert {r.kind for r in found.collect()} == {"state"}


def test_pings_and_times_to_live(spark, tmp_path):
    """A running job is pinged until its state is gone, a waiting one is forgotten sooner, an ended one is silent."""
    rows = [(1, 1, "started", 4, None, None), (2, 1, "ping", None, None, None), (3, 1, "completed", None, None, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/log")
    seen = []
    with lifecycle.rocks(spark):
        events = lifecycle.lifecycle(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/log"), ping=1, ttl=9, queued_ttl=3)
        query = events.writeStream.foreachBatch(lambda batch, n: seen.extend((n, r) for r in batch.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 90
        while time.time() < end and len([1 for _, r in seen if r.kind == "forgotten"]) < 2:
            time.sleep(0.5)
            assert query.exception() is None
    finally:
        query.stop()
    kinds = defaultdict(list)
    for n, r in seen:
        kinds[r.job_id].append((r.kind, r.status))
    assert kinds[3] == [("state", "completed")]
    assert kinds[1][0] == ("state", "running") and kinds[1][-1][0] == "forgotten" and ("ping", "running") in kinds[1]
    assert kinds[2][0] == ("state", "queued") and kinds[2][-1][0] == "forgotten"
    assert len(kinds[1]) > len(kinds[2])  # a day against an hour


def test_times_are_those_of_the_contract():
    own = lifecycle.Lifecycle(True, False, lifecycle.PING_SECONDS, lifecycle.TTL_SECONDS, lifecycle.UPLOAD_TTL_SECONDS)
    assert (own.ping, own.ttl, own.queued_ttl) == (15_000, 86_400_000, 3_600_000)


def test_old_numbers_after_the_snapshot_are_in_the_tail(spark, tmp_path):
    path, source = f"{tmp_path}/log", f"{tmp_path}/source"
    write = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    message = lambda job, seq: (job, seq, "chunk_done", 9, 1, None)
    write([message(1, 5), message(1, 7), message(2, 6)])
    run = lambda: log.append(spark.readStream.schema(SCHEMA).parquet(source), path, f"{tmp_path}/w").awaitTermination()
    assert log.position(path) == 0
    run()
    past, later = log.follow(spark, path, SCHEMA, 1)
    assert [r.seq for r in past.collect()] == [5, 7] and later.isStreaming
    write([message(1, 2), message(2, 3)])
    run()
    write([message(1, 6), message(1, 9)])
    run()
    assert log.position(path) == 3 and [r.seq for r in past.collect()] == [5, 7]
    assert sorted(r.seq for r in stream.run_once(later, "append", f"{tmp_path}/t").collect()) == [2, 6, 9]
    write([message(1, 1)])
    run()
    assert [r.seq for r in stream.run_once(later, "append", f"{tmp_path}/t").collect()] == [1]  # goes on from its own offset


def test_unfinished_batches_are_not_in_the_log(spark, tmp_path):
    path = f"{tmp_path}/log"
    spark.createDataFrame([(1, 1, "started", 1, None, None)], SCHEMA).write.parquet(f"{path}/{0:012d}")
    assert log.position(path) == 0 and log.snapshot(spark, path, SCHEMA, 0).count() == 0
    (tmp_path / "log" / "_batches").mkdir()
    (tmp_path / "log" / "_batches" / f"{1:012d}").write_bytes(b"")  # a number without the one before
    assert log.position(path) == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_requests_meet_states_as_by_brute_force(spark, tmp_path, seed):
    rng, base = random.Random(seed), 1_700_000_000
    asked = [(k, rng.choice(["a", "b", "c", "d", None]), base + rng.randrange(9000)) for k in range(60)]
    said = [(rng.choice("abc"), rng.choice(["ready", "uploading", None]), base + rng.randrange(9000)) for _ in range(12)]
    table = lambda rows, kind, name: spark.createDataFrame(rows, kind).withColumn(name, F.timestamp_seconds(name)).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    end = base + 10**6
    table([*asked, (None, "z", end)], "job_id bigint, upload_id string, asked_at bigint", "asked_at")
    table([*said, ("z", "ready", end)], "upload_id string, status string, said_at bigint", "said_at")
    read = lambda name: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{name}").schema).parquet(f"{tmp_path}/{name}")
    answers = stream.run_once(starts.start_status(read("asked_at"), read("said_at")), "append", f"{tmp_path}/c")
    got = {r.job_id: r.http_status for r in starts.decided(answers.where("job_id is not null")).collect()}
    want = {}
    for job, up, t in asked:
        if up is not None:
            held = [(at, status == "ready") for u, status, at in said if u == up and t - 3600 <= at <= t]
            want[job] = (200 if max(held)[1] else 400) if held else 404
    assert got == want and len(set(want.values())) == 3


def test_rows_at_the_end_meet_no_other_row(spark, monkeypatch):
    """As one upload's, they made a row for each pair of them."""
    from gridwright.plans import queries as plans

    sides = []
    monkeypatch.setattr(plans, "_stream", lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    monkeypatch.setattr(plans, "_ran", lambda df, mode: df)
    monkeypatch.setattr(plans.starts, "start_status", lambda asked, states: sides.extend([asked, states]) or asked)
    monkeypatch.setattr(plans.starts, "decided", lambda df: df.select("job_id", F.lit(0).alias("http_status")))
    plans.QUERIES["stream_start_status"](spark, "/root/testdata/sf0.001")
    asked, states = sides
    ends, last = asked.where("job_id is null"), states.where("status = 'none'")
    assert ends.count() > 1 and last.count() > 1
    assert ends.join(states, "upload_id").count() == 0 and last.join(asked, "upload_id").count() == 0
    assert ends.select("upload_id").distinct().count() == ends.count() and last.select("upload_id").distinct().count() == last.count()
