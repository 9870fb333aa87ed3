"""Jobs as an event log: latest state, expiry, what a viewer shows, crop and page-range arithmetic, stable snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds that a finished job is kept; snapshots until a page counts as stable anyway; least crop in pixels.
KEEP_SECONDS, MOST_SNAPSHOTS, LEAST_CROP = 3600, 10, 50
TERMINAL = ("COMPLETE", "FAILED")
# The states of a job that runs to its end, with their progress and messages; what its result is kept for.
STATES = (
    ("QUEUED", 0, None), ("RUNNING", 0, None), ("RUNNING", 5, "Preflight passed"), ("RUNNING", 10, "Extracting PDF text..."), ("RUNNING", 15, "Measuring PDF structure..."),
    ("RUNNING", 20, "Extracting PDF text..."), ("RUNNING", 40, "Extracted paragraphs from PDF"), ("RUNNING", 45, "Scraping website..."), ("RUNNING", 70, "Scraped paragraphs from website"),
    ("RUNNING", 75, "Running QA checks..."), ("RUNNING", 90, "Found issues"), ("COMPLETE", 100, None),
)
#: How many of STATES a job has had when a step fails.
AT_QUEUE, AT_PREFLIGHT, AT_EXTRACTION, AT_SCRAPE, AT_CHECKS = 1, 2, 6, 8, 10


def run(requests: DataFrame) -> DataFrame:
    """requests with status, progress, error and states (array<struct<seq, status, progress, message, error>>).

    What went wrong is data: refused (why a request is no job), queue_error, file_error, no_text, extract_error,
    n_paragraphs, page_error, check_error; the first that holds ends the job, and no row fails another. A refused request
    has no states.
    """
    named = lambda prefix, c: F.concat(F.lit(prefix + ": "), c)
    steps = [
        (AT_QUEUE, F.col("queue_error").isNotNull(), named("QUEUE_ERROR", F.col("queue_error"))),
        (AT_PREFLIGHT, F.col("file_error").isNotNull(), F.col("file_error")),
        (AT_PREFLIGHT, F.col("no_text"), F.lit("NO_TEXT_LAYER")),
        (AT_EXTRACTION, F.col("extract_error").isNotNull(), named("EXTRACTION_ERROR", F.col("extract_error"))),
        (AT_EXTRACTION, F.col("n_paragraphs") == 0, F.lit("EMPTY_OUTPUT: extraction produced no text")),
        (AT_SCRAPE, F.col("page_error").isNotNull(), F.col("page_error")),
        (AT_CHECKS, F.col("check_error").isNotNull(), named("UNEXPECTED_ERROR", F.col("check_error"))),
    ]
    end = F.lit(None).cast("struct<at:int,error:string>")
    for at, test, error in reversed(steps):
        end = F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(at).alias("at"), error.alias("error"))).otherwise(end)
    state = lambda seq, status, progress, message, error: F.struct(seq.cast("int").alias("seq"), status.alias("status"), progress.cast("int").alias("progress"), message.cast("string").alias("message"), error.cast("string").alias("error"))
    whole = F.array(*[state(F.lit(k), F.lit(s), F.lit(p), F.lit(m), F.lit(None)) for k, (s, p, m) in enumerate(STATES)])
    rows = requests.withColumn("_end", end)
    failed = F.array(state(F.col("_end.at"), F.lit("FAILED"), F.lit(0), F.lit(None), F.col("_end.error")))
    states = F.when(F.col("refused").isNotNull(), F.slice(whole, 1, 0)).when(F.col("_end").isNotNull(), F.concat(F.slice(whole, F.lit(1), F.col("_end.at")), failed)).otherwise(whole)
    rows = rows.withColumn("states", states)
    last = F.try_element_at("states", F.lit(-1))
    return rows.withColumns({
        "status": F.when(F.col("refused").isNotNull(), "REFUSED").otherwise(last["status"]), "progress": F.coalesce(last["progress"], F.lit(0)), "error": F.coalesce("refused", last["error"]),
    }).drop("_end")


def run_counts(ran: DataFrame) -> DataFrame:
    """One row: how many jobs succeeded, failed and were refused."""
    n = lambda status: F.count_if(F.col("status") == status)
    return ran.agg(n("COMPLETE").alias("succeeded"), n("FAILED").alias("failed"), n("REFUSED").alias("refused"))


def latest(events: DataFrame) -> DataFrame:
    """job_id with its last event by (ts, event_id): ts, status, progress, and how many events it had."""
    last = F.max_by(F.struct("ts", "status", "progress"), F.struct("ts", "event_id"))
    return events.groupBy("job_id").agg(last.alias("s"), F.count(F.lit(1)).alias("events")).select("job_id", "s.*", "events")


def with_expiry(states: DataFrame, now: Column) -> DataFrame:
    """states with expires_at, of finished jobs only, and whether that is past."""
    at = F.when(F.col("status").isin(*TERMINAL), F.col("ts") + F.expr(f"INTERVAL {KEEP_SECONDS} SECONDS"))
    return states.withColumn("expires_at", at).withColumn("expired", F.coalesce(at <= now, F.lit(False)))


def view_state(status: Column, has_results: Column) -> Column:
    """What a viewer shows for a job."""
    return F.when(has_results & status.isin(*TERMINAL), "RESULTS").when(status.isin("QUEUED", "RUNNING"), "PROCESSING").otherwise("UPLOAD")


def pixel_to_fraction(pixel: Column, height: Column) -> Column:
    return F.when(height <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(pixel, height)) / height)


def fraction_to_pixel(fraction: Column, height: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(fraction, F.lit(1.0))) * height


def crop_edges(top: Column, bottom: Column, height: Column) -> tuple[Column, Column]:
    """The pixels of a crop's edges, kept LEAST_CROP apart within the page: the lower edge gives way, then the upper."""
    upper = F.greatest(F.lit(0.0), F.least(top, height - LEAST_CROP))
    return upper, F.least(height, F.greatest(bottom, upper + LEAST_CROP))


def clamp_range(first: Column, last: Column, pages: Column) -> tuple[Column, Column]:
    """A range of pages from 1, clamped to those that exist, as first (from 0) and last (exclusive)."""
    low = F.greatest(F.lit(1), F.least(first, pages))
    high = F.when(last < 0, pages).otherwise(F.greatest(low, F.least(last, pages)))
    return low - 1, high


def stable_snapshot(snapshots: DataFrame) -> DataFrame:
    """job_id, attempt, text, stable: the first snapshot (job_id, attempt, text) equal to the one before it, of the first
    ten; else the last of these."""
    order = Window.partitionBy("job_id").orderBy("attempt")
    rows = snapshots.withColumn("same", F.coalesce(F.col("text") == F.lag("text").over(order), F.lit(False))).where(F.col("attempt") <= MOST_SNAPSHOTS)
    first = F.min(F.when(F.col("same"), F.struct("attempt", "text")))
    found = rows.groupBy("job_id").agg(first.alias("s"), F.max(F.struct("attempt", "text")).alias("l"))
    return found.select("job_id", F.coalesce("s.attempt", "l.attempt").alias("attempt"), F.coalesce("s.text", "l.text").alias("text"), F.col("s").isNotNull().alias("stable"))
