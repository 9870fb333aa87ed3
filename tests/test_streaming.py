"""Streams against their batch equivalents."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from veridoc.operators import jobs
from veridoc.streaming import jobs as streams

SCHEMA = "job_id long, event_id long, ts timestamp, status string, progress int"


def events(spark, first, n):
    start = datetime(2024, 1, 1)
    rows = [(k % 5, k, start + timedelta(minutes=k), ("QUEUED", "RUNNING", "COMPLETE")[k % 3], k % 100) for k in range(first, first + n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_states_over_restarts(spark, tmp_path):
    source, states, checkpoint = (str(tmp_path / x) for x in ("in", "states", "checkpoint"))
    for first in (0, 40):
        events(spark, first, 40).coalesce(1).write.mode("append").parquet(source)
        streams.run_states(streams.event_stream(spark, source, spark.read.parquet(source).schema), states, checkpoint).awaitTermination()
    got = sorted(tuple(r) for r in streams.current(spark, states, jobs.latest(spark.read.parquet(source)).schema).select("job_id", "status", "progress", "events").collect())
    want = sorted(tuple(r) for r in jobs.latest(spark.read.parquet(source)).select("job_id", "status", "progress", "events").collect())
    assert got == want and len(got) == 5


def test_windowed_counts_wait_for_the_watermark(spark, tmp_path):
    source = str(tmp_path / "in")
    events(spark, 0, 300).coalesce(1).write.parquet(source)
    stream = streams.event_stream(spark, source, spark.read.parquet(source).schema)
    query = streams.windowed_counts(stream, "1 hour", "10 minutes").writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    closed = spark.table("counts").agg(F.sum("events")).first()[0]
    assert closed == 240  # the fifth hour is open still


def test_state_query_reads_folders_and_empty_tables(spark, tmp_path):
    from veridoc.plans import job_queries as Q

    given = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    given.repartition(3).write.parquet(str(tmp_path / "a" / "events.parquet"))
    got, want = (sorted(map(tuple, q(spark, str(tmp_path / "a")).collect())) for q in (Q.job_state_stream, Q.job_latest_state))
    assert got == want and got
    given.where("false").write.parquet(str(tmp_path / "b" / "events.parquet"))
    assert Q.job_state_stream(spark, str(tmp_path / "b")).count() == 0


def test_intake_tries_again_and_keeps_all_states(spark, tmp_path):
    source, states, checkpoint = (str(tmp_path / x) for x in ("in", "states", "checkpoint"))
    names = ["refused", "queue_error", "file_error", "extract_error", "page_error", "check_error"]
    schema = "job_id int, " + ", ".join(f"{n} string" for n in names) + ", no_text boolean, n_paragraphs int"
    for first in (0, 10):
        rows = [(first + k, *[None] * 6, k == 3, k % 2) for k in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    failures = [ValueError("once"), ValueError("twice")]

    def run(batch):
        if failures:
            raise failures.pop()
        return jobs.run(batch)

    streams.intake(streams.event_stream(spark, source, spark.read.parquet(source).schema), run, states, checkpoint).awaitTermination()
    got = spark.read.parquet(states)
    last = {r.job_id: r.status for r in got.groupBy("job_id").agg(F.max_by("status", "seq").alias("status")).collect()}
    assert not failures and last == {first + k: "COMPLETE" if k % 2 and k != 3 else "FAILED" for first in (0, 10) for k in range(10)}


def test_poll_ends_with_a_terminal_state():
    answers = iter([None, {"status": "RUNNING"}, OSError("away"), {"status": "COMPLETE"}, {"status": "never read"}])

    def read():
        found = next(answers)
        if isinstance(found, Exception):
            raise found
        return found

    assert [s["status"] for s in streams.poll(read, every=0.0)] == ["RUNNING", "COMPLETE"]
    assert list(streams.poll(lambda: None, every=0.01, most=0.03)) == []
