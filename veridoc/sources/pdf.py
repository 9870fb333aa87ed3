"""PDF sources: directory scan, upload guard, preflight, spans from a decoder's page trees.

A decoder (bytes -> page trees) is a plug-in: register_decoder(). The one named "plain" comes with the package.
A file that cannot be read becomes a row with an error; it never fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.functions.shipping import ship
from veridoc.functions.text import pytrim
from veridoc.sources import pdf_decoder

# The first bytes of a PDF, and the preflight's sample.
MAGIC = "255044462D"
SAMPLE_PAGES, SAMPLE_CHARS = 3, 10

_decoders: dict[str, Callable[[bytes], list[dict]]] = {"plain": pdf_decoder.decode}


def register_decoder(name: str, decode: Callable[[bytes], list[dict]]) -> None:
    """decode(content) returns pages: dicts of width, height, rotation, plain_text and blocks (type, lines, spans, chars)."""
    _decoders[name] = decode


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content of the PDF files of a folder, not of its subfolders."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files.select("path", "length", "content")


def guard(content: Column, url: Column, top: Column, bottom: Column, left: Column, right: Column, first: Column) -> Column:
    """Why a request is refused, or null."""
    share = lambda c: (c >= 0) & (c <= 1)
    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), "EMPTY_FILE")
        .when(F.hex(F.substring(content, 1, 5)) != MAGIC, "NOT_A_PDF")
        .when(~(share(top) & share(bottom) & share(left) & share(right)) | (first < 0), "OUT_OF_RANGE")
        .when((top >= bottom) | (left >= right), "INVALID_CROP")
        .when(~F.coalesce(url, F.lit("")).rlike("^https?://[^/]+"), "INVALID_URL")
    )


def accepted(name: Column, mime: Column) -> Column:
    """Whether a file may be offered at all: by its type, or by its name."""
    return F.coalesce(mime == "application/pdf", F.lit(False)) | F.coalesce(F.endswith(name, F.lit(".pdf")), F.lit(False))


def preflight(pages: DataFrame) -> DataFrame:
    """doc_id, has_text, page_count, error: whether one of the first three pages has more than ten characters."""
    text = F.when(F.col("page_no") <= SAMPLE_PAGES, F.length(pytrim(F.coalesce("plain_text", F.lit("")))) > SAMPLE_CHARS)
    rows = pages.groupBy("doc_id").agg(F.bool_or(text).alias("has_text"), F.count(F.lit(1)).alias("page_count"))
    return rows.withColumn("error", F.when(~F.col("has_text"), "NO_TEXT_LAYER"))


def decoded(files: DataFrame, decoder: str = "plain") -> DataFrame:
    """path, page_no, width, height, rotation, plain_text, blocks, error; a file that fails has one row with its error."""
    decode = _decoders[decoder]
    schema = "path string, page_no int, width double, height double, rotation int, plain_text string, blocks array<struct<type:int,lines:array<struct<spans:array<struct<text:string,chars:array<struct<c:string>>,x0:double,y0:double,x1:double,y1:double,size:double,font:string,flags:int,color:int>>>>>>, error string"
    names = [x.split()[0] for x in ("path", "page_no", "width", "height", "rotation", "plain_text", "blocks", "error")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b.path, b.content, strict=True):
                try:
                    pages = decode(bytes(content))
                    if not pages:
                        raise ValueError("the file has no pages")
                    rows = [{"path": path, "page_no": k, "error": None, **p} for k, p in enumerate(pages, 1)]
                except Exception as e:  # any decoder error is the file's, not the job's
                    rows = [{"path": path, "error": f"CORRUPTED_PDF: {e}"}]
                frame = pd.DataFrame(rows, columns=names).astype(object)
                yield frame.where(frame.notna(), None)

    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, schema)


def span_text(span: Column) -> Column:
    """A span's text, or else its characters, trimmed."""
    text = pytrim(F.coalesce(span["text"], F.lit("")))
    return F.when(text != "", text).otherwise(pytrim(F.array_join(F.transform(F.coalesce(span["chars"], F.expr("array()")), lambda c: c["c"]), "")))


def spans(pages: DataFrame, least_size: float = 0.0) -> DataFrame:
    """Spans of the text blocks of decoded pages, in order, without empty ones and those below a size."""
    rows = pages.select("path", "page_no", F.posexplode("blocks").alias("i", "b")).where("b.type = 0")
    rows = rows.select("path", "page_no", "i", F.posexplode("b.lines").alias("j", "l"))
    rows = rows.select("path", "page_no", "i", "j", F.posexplode("l.spans").alias("k", "s"))
    rows = rows.withColumn("text", span_text(F.col("s"))).where((F.col("text") != "") & (F.col("s.size") >= least_size))
    order = F.struct("i", "j", "k")
    return rows.select("path", "page_no", order.alias("seq"), "text", *[f"s.{c}" for c in ("x0", "y0", "x1", "y1", "size", "font", "flags", "color")])


def chars_only(pages: DataFrame) -> DataFrame:
    """path, chars_only: whether the first text span with anything to say spells it in characters."""
    rows = pages.select("path", "page_no", F.posexplode("blocks").alias("i", "b")).where("b.type = 0")
    rows = rows.select("path", "page_no", "i", F.posexplode("b.lines").alias("j", "l")).select("path", "page_no", "i", "j", F.posexplode("l.spans").alias("k", "s"))
    has_text, has_chars = F.coalesce(F.col("s.text"), F.lit("")) != "", F.coalesce(F.size("s.chars"), F.lit(0)) > 0
    first = rows.where(has_text | has_chars).groupBy("path").agg(F.min_by(has_chars & ~has_text, F.struct("page_no", "i", "j", "k")).alias("chars_only"))
    return pages.select("path").distinct().join(first, "path", "left").select("path", F.coalesce("chars_only", F.lit(False)).alias("chars_only"))


def layout_tables(pages: DataFrame, least_size: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Decoded pages as the tables that measurement and extraction take, with the path as doc_id; files with an error are
    left out, turned pages are set upright."""
    from veridoc.operators.layout import upright

    good = pages.where("error IS NULL")
    order = F.row_number().over(Window.partitionBy("path", "page_no").orderBy("seq"))
    found = spans(good, least_size).withColumn("seq", order).withColumnRenamed("path", "doc_id")
    return upright(good.select(F.col("path").alias("doc_id"), "page_no", "width", "height", "rotation", "plain_text"), found)
