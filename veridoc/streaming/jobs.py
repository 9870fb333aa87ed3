"""Job intake and state as streams.

State is keyed by job and kept by Structured Streaming; a batch's changed states go to a folder of its own, overwritten
if the batch is repeated, so a restart neither loses nor doubles any.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veridoc.operators import jobs

# How often a failed step is tried again, and the seconds between polls.
RETRIES, EVERY = 2, 1.5


def event_stream(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    """New Parquet files of a folder; or a table that is one file, then what it holds."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder, glob = path, "*.parquet"
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder, glob = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(folder)


def run_states(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest state of each job; all that has arrived is processed, then the query ends."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    states = jobs.latest(events)
    return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()


def intake(requests: DataFrame, run: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, retries: int = RETRIES) -> StreamingQuery:
    """Runs requests as they come: run() gives a batch's requests with job_id and states (see operators.jobs.run), and the
    batch's states, one row each, go to a folder of its own. A batch that fails is tried again, `retries` times; then the
    stream stops, and starts with that batch when it is started anew."""

    def work(batch: DataFrame, number: int) -> None:
        for left in reversed(range(retries + 1)):
            try:
                ran = run(batch).select("job_id", F.explode("states").alias("s")).select("job_id", "s.*")
                return ran.write.mode("overwrite").parquet(f"{folder}/batch={number}")
            except Exception:
                if not left:
                    raise

    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work).trigger(availableNow=True).start()


def poll(read: Callable[[], dict | None], every: float = EVERY, most: float | None = None) -> Iterator[dict]:
    """A job's state (read(): a row with status, or None) at once and then every so many seconds, until it is terminal; a
    read that fails is passed over. most: seconds after which polling ends anyway."""
    began = time.monotonic()
    while True:
        try:
            state = read()
        except Exception:  # the next one may succeed
            state = None
        if state is not None:
            yield state
            if state["status"] in jobs.TERMINAL:
                return
        if most is not None and time.monotonic() - began + every > most:
            return
        time.sleep(every)


def current(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The latest state of each job, over all batches; schema: that of jobs.latest(). No batch yet: no row."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", folder).parquet(folder)
    names = [f.name for f in schema if f.name != "job_id"]
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*names), F.col("batch").cast("long")).alias("s")).select("job_id", "s.*")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and status; windows close when the watermark passes them."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", size), "status").agg(F.count(F.lit(1)).alias("events"))
    return rows.select(F.col("window.start").alias("start"), "status", "events")
