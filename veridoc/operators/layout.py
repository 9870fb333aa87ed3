"""Layout measurement of documents from positioned text spans: one row for each document.

Inputs: pages (doc_id, page_no, width, height, rotation, plain_text) and spans (doc_id, page_no, seq, text, x0, y0, x1, y1,
size, font). All results hang on the documents of `pages`, so documents without spans keep their defaults. `seq` gives
spans their reading order; every list has an order of its own, whatever the shuffles do.

Two passes over the spans measure everything: facts() what repeats in the zones at the edges, sizes and halves; body(),
which needs the zones, what lies between them. A function that returns a part of it reads only that part's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions.text import pytrim

# Zones as shares of the page, buffers in points, and the column histogram's parameters.
TOP, BOTTOM, RIGHT = 0.12, 0.88, 0.85
BUFFER, OVERLAP = 5.0, 20.0
BAND, LEAST_SIZE, PEAK_SHARE, MOST_COLUMNS = 80, 8, 0.15, 6
SPREAD_SHARE, DIGITAL_CHARS, FREQUENT = 0.10, 50, 5


def documents(pages: DataFrame) -> DataFrame:
    """doc_id, page_count, page_width, page_height (of the first page), least: on how many pages a text must stand to repeat."""
    first = F.min_by(F.struct("width", "height"), "page_no")
    rows = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"), first.alias("f"))
    return rows.select("doc_id", "page_count", F.col("f.width").alias("page_width"), F.col("f.height").alias("page_height"), F.greatest(F.lit(2), F.floor(F.col("page_count") / 2)).alias("least"))


def digital_pages(pages: DataFrame) -> DataFrame:
    """pages with `digital`: whether their text layer has at least 50 characters."""
    return pages.withColumn("digital", F.length(pytrim(F.coalesce("plain_text", F.lit("")))) >= DIGITAL_CHARS)


def digital_spans(pages: DataFrame, spans: DataFrame) -> DataFrame:
    return spans.join(digital_pages(pages).where("digital").select("doc_id", "page_no"), ["doc_id", "page_no"], "left_semi")


def upright(pages: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages and spans as a reader sees them: boxes given on the unturned page are turned clockwise by the page's
    rotation (a multiple of 90), width and height change places where the page lies on its side."""
    r, w, h = F.pmod(F.coalesce("rotation", F.lit(0)), F.lit(360)), F.col("width"), F.col("height")
    lies = r.isin(90, 270)
    turned = spans.join(pages.select("doc_id", "page_no", r.alias("_r"), w.alias("_w"), h.alias("_h")), ["doc_id", "page_no"])
    by = lambda none, quarter, half, three: F.when(F.col("_r") == 90, F.expr(quarter)).when(F.col("_r") == 180, F.expr(half)).when(F.col("_r") == 270, F.expr(three)).otherwise(F.expr(none))
    boxes = {
        "x0": by("x0", "_h - y1", "_w - x1", "y0"), "y0": by("y0", "x0", "_h - y1", "_w - x1"), "x1": by("x1", "_h - y0", "_w - x0", "y1"), "y1": by("y1", "x1", "_h - y0", "_w - x0"),
    }
    upright_pages = pages.withColumns({"width": F.when(lies, h).otherwise(w), "height": F.when(lies, w).otherwise(h), "rotation": F.lit(0)})
    return upright_pages, turned.withColumns(boxes).drop("_r", "_w", "_h")


def rotated_pages(pages: DataFrame) -> DataFrame:
    """doc_id, rotated: the numbers of the pages that are turned."""
    return pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("rotation") != 0, F.col("page_no")))).alias("rotated"))


_NONE = "cast(array() as array<string>)"


def facts(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """documents() with the first pass's results: for the zones top, bottom and right `_v` (the lowest edge of the texts
    that repeat at the top, negative; the highest of those at the bottom; the leftmost at the right) and `_strings` (by
    falling count, then by first appearance; null: none); shares of sizes and halves.

    Every span gives a fact for its size and one for each zone it is in; facts are counted by page, then by text, then by
    document. Of a text that stands on a page more than once the first span counts.
    """
    docs, text = documents(pages), pytrim(F.col("text"))
    found = digital_spans(pages, spans).join(docs, "doc_id")
    fact = lambda kind, key, page, size, v: F.struct(F.lit(kind).alias("kind"), key.alias("key"), page.alias("page"), size.cast("double").alias("s"), v.cast("double").alias("v"))
    none = F.lit(None)
    at = lambda zone, test, v: F.when(test & (text != ""), fact(zone, text, F.col("page_no"), none, v))
    each = F.array(
        at("top", (F.col("y0") < F.col("page_height") * TOP) & (F.col("x0") < F.col("page_width") * RIGHT), -F.col("y1")),
        at("bottom", F.col("y1") > F.col("page_height") * BOTTOM, F.col("y0")), at("right", F.col("x0") > F.col("page_width") * RIGHT, F.col("x0")),
        fact("size", F.lit(""), F.lit(0), F.bround("size", 1), none),
    )
    left = ((F.col("x0") + F.col("x1")) / 2 < F.col("page_width") / 2).cast("int")
    rows = found.select("doc_id", "least", "page_no", "seq", left.alias("left"), F.explode(F.array_compact(each)).alias("f"))
    rows = rows.select("doc_id", "least", "page_no", "seq", "left", "f.*")
    by_page = rows.groupBy("doc_id", "least", "kind", "key", "page", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("left").alias("left"), F.min(F.struct("page_no", "seq", "v")).alias("f"))
    by_text = by_page.groupBy("doc_id", "least", "kind", "key", "s").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"), F.sum("left").alias("left"), F.min("f.v").alias("v"), F.min(F.struct("f.page_no", "f.seq")).alias("first")
    )
    size = F.col("kind") == "size"

    def zone(name: str) -> list:
        here = (F.col("kind") == name) & (F.col("pages") >= F.col("least"))
        listed = F.sort_array(F.collect_list(F.when(here, F.struct((-F.col("pages")).alias("n"), "first", "key"))))
        return [F.min(F.when(here, F.col("v"))).alias(f"{name}_v"), F.when(F.size(listed) > 0, F.transform(listed, lambda x: x["key"])).alias(f"{name}_strings")]

    whole = by_text.groupBy("doc_id").agg(
        *zone("top"), *zone("bottom"), *zone("right"),
        (F.sum(F.when(size, F.col("left"))) / F.sum(F.when(size, F.col("n")))).alias("left_share"), F.min("s").alias("lo"), F.max("s").alias("hi"),
        F.min(F.when(size & (F.col("n") >= FREQUENT), F.col("s"))).alias("real"), F.min(F.when(size, F.struct((-F.col("n")).alias("n"), "first", "s")))["s"].alias("body"),
    )
    return docs.join(whole, "doc_id", "left")


def with_header_footer(known: DataFrame) -> DataFrame:
    """facts() with header_y, footer_y, header_strings, footer_strings."""
    return known.withColumns({
        "header_y": F.greatest(F.coalesce(-F.col("top_v"), F.lit(0.0)), F.lit(0.0)) + BUFFER, "footer_y": F.least(F.coalesce("bottom_v", "page_height"), F.col("page_height")) - BUFFER,
        "header_strings": F.coalesce("top_strings", F.expr(_NONE)), "footer_strings": F.coalesce("bottom_strings", F.expr(_NONE)),
    })


def header_footer(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, header_y, footer_y, header_strings, footer_strings."""
    return with_header_footer(facts(pages, spans)).select("doc_id", "header_y", "footer_y", "header_strings", "footer_strings")


def with_body(known: DataFrame, pages: DataFrame, spans: DataFrame) -> DataFrame:
    """with_header_footer() with sidebar_x, sidebar_strings and column_count, by a second pass over the spans between
    header and footer: how far they reach, and a histogram of left edges, both for a page with its sidebar and without,
    as which it is follows from the reach. Of neighbouring peaks every second counts."""
    known = known.withColumn("_min_x", F.least("right_v", "page_width"))
    body = digital_spans(pages, spans).join(known.select("doc_id", "header_y", "footer_y", "page_width", "_min_x"), "doc_id").where("y0 >= header_y AND y1 <= footer_y")
    upto = lambda x: F.count_if((F.col("x0") <= x) & (F.col("size") >= LEAST_SIZE))
    bands = body.groupBy("doc_id", (F.col("x0") / BAND).cast("int").alias("b")).agg(F.max("x1").alias("x1"), upto(F.col("page_width")).alias("wide"), upto(F.col("_min_x") - BUFFER).alias("narrow"))
    whole = bands.groupBy("doc_id").agg(F.max("x1").alias("_reach"), F.sort_array(F.collect_list(F.struct("b", "wide", "narrow"))).alias("_bands"))
    rows = known.join(whole, "doc_id", "left")
    overlap = F.greatest(F.coalesce("_reach", F.lit(0.0)), F.lit(0.0)) > F.col("_min_x") - OVERLAP
    without = F.col("right_strings").isNull() | overlap
    rows = rows.withColumn("_bands", F.filter(F.transform("_bands", lambda x: F.struct(x["b"].alias("b"), F.when(without, x["wide"]).otherwise(x["narrow"]).alias("n"))), lambda x: x["n"] > 0))
    rows = rows.withColumn("_most", F.array_max(F.transform("_bands", lambda x: x["n"])))

    def peak(x: Column, i: Column) -> Column:
        near = lambda other, b: F.when(other["b"] == b, other["n"]).otherwise(0)
        above = (x["n"] >= near(F.get("_bands", i - 1), x["b"] - 1)) & (x["n"] >= near(F.get("_bands", i + 1), x["b"] + 1))
        return (x["n"] > F.col("_most") * PEAK_SHARE) & above & (x["b"] >= 0) & (x["b"] <= (F.col("page_width") / BAND).cast("int"))

    kept = F.aggregate(
        F.filter("_bands", peak), F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n")),
        lambda s, x: F.when(x["b"] - s["last"] <= 1, s).otherwise(F.struct(x["b"].alias("last"), (s["n"] + 1).alias("n"))),
    )["n"]
    return rows.withColumns({
        "sidebar_x": F.when(without, F.col("page_width")).otherwise(F.col("_min_x") - BUFFER), "sidebar_strings": F.coalesce("right_strings", F.expr(_NONE)),
        "column_count": F.greatest(F.lit(1), F.least(F.coalesce(kept, F.lit(1)), F.lit(MOST_COLUMNS))),
    }).drop("_min_x", "_reach", "_bands", "_most")


def zones(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, page_width, page_height and the edges and strings of header, footer and sidebar, and column_count."""
    found = with_body(with_header_footer(facts(pages, spans)), pages, spans)
    return found.select("doc_id", "page_width", "page_height", "header_y", "footer_y", "sidebar_x", "header_strings", "footer_strings", "sidebar_strings", "column_count")


def with_spread(known: DataFrame) -> DataFrame:
    """facts() with is_spread and mid_x: landscape documents with text on both halves."""
    both = F.coalesce((F.col("page_width") > F.col("page_height")) & (F.col("left_share") > SPREAD_SHARE) & (1 - F.col("left_share") > SPREAD_SHARE), F.lit(False))
    return known.withColumns({"is_spread": both, "mid_x": F.when(both, F.col("page_width") / 2)})


def spread(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, is_spread, mid_x."""
    return with_spread(facts(pages, spans)).select("doc_id", "is_spread", "mid_x")


def fonts(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, font, spans, sizes, samples (the first three texts, 40 characters each)."""
    found = digital_spans(pages, spans)
    sample = F.struct("page_no", "seq", F.substring("text", 1, 40).alias("t"))
    # the three smallest of a sorted list, found by a rank before anything is collected
    k = F.row_number().over(Window.partitionBy("doc_id", "font").orderBy("page_no", "seq"))
    firsts = found.withColumn("k", k).where("k <= 3").groupBy("doc_id", "font").agg(F.transform(F.sort_array(F.collect_list(sample)), lambda s: s["t"]).alias("samples"))
    sums = found.groupBy("doc_id", "font").agg(F.count(F.lit(1)).alias("spans"), F.sort_array(F.collect_set(F.bround("size", 1))).alias("sizes"))
    return sums.join(firsts, ["doc_id", "font"])


def with_font_sizes(known: DataFrame) -> DataFrame:
    """facts() with font_size_min, font_size_max, decorative_threshold."""
    threshold = F.greatest(F.coalesce(F.col("real") - 0.5, F.col("body") - 1.0, F.lit(8.0)), F.lit(0.0))
    return known.withColumns({"font_size_min": F.coalesce("lo", F.lit(0.0)), "font_size_max": F.coalesce("hi", F.lit(0.0)), "decorative_threshold": threshold})


def measure(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Everything that extraction needs, and what a report shows, in one row for each document."""
    known = with_font_sizes(with_spread(with_header_footer(facts(pages, spans))))
    found = with_body(known, pages, spans).select(
        "doc_id", "page_count", "page_width", "page_height", "header_y", "footer_y", "header_strings", "footer_strings", "sidebar_x", "sidebar_strings", "is_spread", "mid_x", "column_count",
        "font_size_min", "font_size_max", "decorative_threshold",
    )
    marks = digital_pages(pages).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("rotation") != 0, F.col("page_no")))).alias("rotated"),
        F.sort_array(F.collect_list(F.when(~F.col("digital"), F.col("page_no")))).alias("non_digital_pages"),
    )
    return found.join(marks, "doc_id")


def constants(measured: DataFrame) -> DataFrame:
    """The numbers of a measurement to one decimal, halves to even."""
    one = lambda c: F.bround(c, 1)
    return measured.select(
        "doc_id", one("header_y").alias("header_y"), one("footer_y").alias("footer_y"), one("sidebar_x").alias("sidebar_x"),
        F.when(F.col("mid_x") != 0, one("mid_x")).alias("mid_x"), F.lit(6).alias("line_bucket"), one("decorative_threshold").alias("min_font"), "column_count", "is_spread",
    )
