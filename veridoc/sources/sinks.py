"""Sinks: text by document, reports and states as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.operators.jobs import KEEP_SECONDS


def write_texts(texts: DataFrame, key: str, text: str, folder: str) -> None:
    """One folder of text for each key."""
    texts.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(folder)


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """key, body: each row as a JSON document."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("body"))


def write_reports(reports: DataFrame, folder: str) -> None:
    reports.write.mode("overwrite").json(folder)


def final_bodies(reports: DataFrame, key: str, finished: Column) -> DataFrame:
    """key, body, expires_at: each report as the JSON of a finished job, and until when it is kept."""
    names = [c for c in reports.columns if c != key]
    body = F.to_json(F.struct(F.lit("COMPLETE").alias("status"), F.lit(100).alias("progress"), *names))
    return reports.select(key, body.alias("body"), (finished + F.expr(f"INTERVAL {KEEP_SECONDS} SECONDS")).alias("expires_at"))
