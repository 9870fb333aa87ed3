"""Queries over page layout. Orders stand for pages of their customers' documents, line items for text spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.functions.text import pytrim
from veridoc.operators import extract as E
from veridoc.operators import layout as L

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"WITH {LAYOUT} {sql}"
        return f

    return add


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey")
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("o_orderkey"))
    return orders.select(
        "doc_id", "o_orderkey", k.alias("page_no"), F.when(F.col("doc_id") % 10 == 0, 1224.0).otherwise(612.0).alias("width"), F.lit(792.0).alias("height"),
        F.when(F.col("o_orderkey") % 50 == 0, 90).otherwise(0).alias("rotation"), F.expr("repeat('page ', cast(o_orderkey % 23 as int))").alias("plain_text"),
    )


def span_rows(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    rows = lines.join(pages.select("doc_id", "page_no", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    shift = F.when((F.col("doc_id") % 10 == 0) & (F.col("l_suppkey") % 2 == 0), 612.0).otherwise(0.0)
    x0, y0 = 50.0 + 150 * (F.col("l_partkey") % 3) + shift, 60.0 + 7 * F.col("l_linenumber")
    body = rows.select("doc_id", "page_no", seq.alias("seq"), F.concat("l_linestatus", F.col("l_partkey").cast("string")).alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 60).alias("x1"), (y0 + 10).alias("y1"), (8.0 + F.col("l_suppkey") % 5).alias("size"), F.col("l_returnflag").alias("font"))
    frame = pages.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_mktsegment"), "doc_id")
    extra = lambda k, text, x0, y0: F.struct(F.lit(k).alias("seq"), text.alias("text"), F.lit(x0).alias("x0"), F.lit(y0).alias("y0"), F.lit(x0 + 40).alias("x1"), F.lit(y0 + 10).alias("y1"))
    marks = F.array(extra(1001, F.concat(F.lit("HEADER "), "c_mktsegment"), 50.0, 20.0), extra(1002, F.concat(F.lit("FOOTER "), "c_mktsegment"), 50.0, 760.0), extra(1003, F.lit("SIDE"), 560.0, 300.0))
    frame = frame.select("doc_id", "page_no", F.explode(marks).alias("m")).select("doc_id", "page_no", "m.*", F.lit(9.0).alias("size"), F.lit("M").alias("font"))
    return body.unionByName(frame)


LAYOUT = """
pg AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS page_no, CASE WHEN o_custkey % 10 = 0 THEN 1224.0 ELSE 612.0 END::DOUBLE AS width, 792.0::DOUBLE AS height,
  CASE WHEN o_orderkey % 50 = 0 THEN 90 ELSE 0 END AS rotation, repeat('page ', (o_orderkey % 23)::INT) AS plain_text FROM orders),
sp AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS seq, l_linestatus || l_partkey AS text,
    (50 + 150 * (l_partkey % 3) + CASE WHEN doc_id % 10 = 0 AND l_suppkey % 2 = 0 THEN 612 ELSE 0 END)::DOUBLE AS x0, (60 + 7 * l_linenumber)::DOUBLE AS y0,
    (110 + 150 * (l_partkey % 3) + CASE WHEN doc_id % 10 = 0 AND l_suppkey % 2 = 0 THEN 612 ELSE 0 END)::DOUBLE AS x1, (70 + 7 * l_linenumber)::DOUBLE AS y1, (8 + l_suppkey % 5)::DOUBLE AS size, l_returnflag AS font
  FROM lineitem JOIN pg ON l_orderkey = o_orderkey
  UNION ALL SELECT doc_id, page_no, seq, CASE WHEN seq = 1003 THEN 'SIDE' ELSE w || c_mktsegment END, x0, y0, x0 + 40, y0 + 10, 9.0, 'M' FROM pg JOIN customer ON c_custkey = doc_id, (VALUES (1001, 'HEADER ', 50.0::DOUBLE, 20.0::DOUBLE), (1002, 'FOOTER ', 50.0, 760.0), (1003, '', 560.0, 300.0)) AS m(seq, w, x0, y0)),
docs AS (SELECT doc_id, count(*) AS page_count, arg_min(width, page_no) AS page_width, arg_min(height, page_no) AS page_height, greatest(2, count(*) // 2) AS least FROM pg GROUP BY doc_id),
dg AS (SELECT *, length(trim(plain_text)) >= 50 AS digital FROM pg),
ds AS (SELECT sp.*, page_width, page_height, least FROM sp JOIN dg USING (doc_id, page_no) JOIN docs USING (doc_id) WHERE digital),
z AS (SELECT 't' AS zone, * FROM ds WHERE y0 < page_height * 0.12 AND x0 < page_width * 0.85 UNION ALL SELECT 'b', * FROM ds WHERE y1 > page_height * 0.88 UNION ALL SELECT 'r', * FROM ds WHERE x0 > page_width * 0.85),
zp AS (SELECT zone, doc_id, least, page_no, trim(text) AS text, min(seq) AS seq, arg_min(CASE zone WHEN 't' THEN y1 WHEN 'b' THEN y0 ELSE x0 END, seq) AS v FROM z WHERE trim(text) <> '' GROUP BY ALL),
zt AS (SELECT zone, doc_id, text, count(*) AS n, CASE zone WHEN 't' THEN max(v) ELSE min(v) END AS v, min((page_no, seq)) AS first FROM zp GROUP BY zone, doc_id, least, text HAVING count(*) >= least),
zd AS (SELECT zone, doc_id, CASE zone WHEN 't' THEN max(v) ELSE min(v) END AS v, list(text ORDER BY n DESC, first) AS strings FROM zt GROUP BY zone, doc_id),
hf AS (SELECT d.doc_id, greatest(coalesce(t.v, 0), 0) + 5 AS header_y, least(coalesce(b.v, page_height), page_height) - 5 AS footer_y, coalesce(t.strings, []) AS header_strings, coalesce(b.strings, []) AS footer_strings
  FROM docs d LEFT JOIN (FROM zd WHERE zone = 't') t USING (doc_id) LEFT JOIN (FROM zd WHERE zone = 'b') b USING (doc_id)),
bx AS (SELECT doc_id, max(x1) AS max_x1 FROM ds JOIN hf USING (doc_id) WHERE y0 >= header_y AND y1 <= footer_y GROUP BY doc_id),
sb AS (SELECT d.doc_id, CASE WHEN r.strings IS NULL OR coalesce(max_x1, 0) > r.v - 20 THEN page_width ELSE r.v - 5 END AS sidebar_x, coalesce(r.strings, []) AS sidebar_strings FROM docs d LEFT JOIN (FROM zd WHERE zone = 'r') r USING (doc_id) LEFT JOIN bx USING (doc_id)),
sh AS (SELECT doc_id, avg(CASE WHEN (x0 + x1) / 2 < page_width / 2 THEN 1.0 ELSE 0.0 END) AS l FROM ds GROUP BY doc_id),
sd AS (SELECT doc_id, coalesce(page_width > page_height AND l > 0.1 AND 1 - l > 0.1, false) AS is_spread, CASE WHEN coalesce(page_width > page_height AND l > 0.1 AND 1 - l > 0.1, false) THEN page_width / 2 END AS mid_x FROM docs LEFT JOIN sh USING (doc_id)),
hb AS (SELECT doc_id, page_width, trunc(x0 / 80)::INT AS b, count(*) AS n FROM ds JOIN hf USING (doc_id) JOIN sb USING (doc_id) WHERE y0 >= header_y AND y1 <= footer_y AND x0 <= sidebar_x AND size >= 8 GROUP BY ALL),
hw AS (SELECT *, max(n) OVER (PARTITION BY doc_id) AS most, coalesce((SELECT n FROM hb o WHERE o.doc_id = hb.doc_id AND o.b = hb.b - 1), 0) AS before, coalesce((SELECT n FROM hb o WHERE o.doc_id = hb.doc_id AND o.b = hb.b + 1), 0) AS after FROM hb),
pk AS (SELECT doc_id, b, row_number() OVER (PARTITION BY doc_id ORDER BY b) - b AS isle FROM hw WHERE n > most * 0.15 AND n >= before AND n >= after AND b <= trunc(page_width / 80)),
pc AS (SELECT doc_id, sum(c) AS n FROM (SELECT doc_id, isle, (count(*) + 1) // 2 AS c FROM pk GROUP BY doc_id, isle) GROUP BY doc_id),
cc AS (SELECT doc_id, greatest(1, least(coalesce(n, 1), 6))::INT AS column_count FROM docs LEFT JOIN pc USING (doc_id)),
fz AS (SELECT doc_id, round_even(size, 1) AS s, count(*) AS n, min((page_no, seq)) AS first FROM ds GROUP BY ALL),
fs AS (SELECT doc_id, coalesce(min(s), 0) AS font_size_min, coalesce(max(s), 0) AS font_size_max, greatest(coalesce(min(s) FILTER (n >= 5) - 0.5, arg_min(s, (-n, first)) - 1, 8.0), 0) AS decorative_threshold FROM docs LEFT JOIN fz USING (doc_id) GROUP BY doc_id),
nz AS (SELECT * FROM sp s WHERE NOT EXISTS (FROM hf WHERE hf.doc_id = s.doc_id AND (list_contains(header_strings, trim(s.text)) OR list_contains(footer_strings, trim(s.text)))) AND NOT EXISTS (FROM sb WHERE sb.doc_id = s.doc_id AND list_contains(sidebar_strings, trim(s.text)))),
sq AS (SELECT nz.doc_id, page_no, seq, text, y0, coalesce((x0 + x1) / 2 >= mid_x, false)::INT AS side, x0 - CASE WHEN coalesce((x0 + x1) / 2 >= mid_x, false) THEN mid_x ELSE 0 END AS x0 FROM nz LEFT JOIN sd USING (doc_id)),
ce AS (SELECT DISTINCT doc_id, page_no, side, round_even(x0, 0) AS x FROM sq),
cn AS (SELECT *, coalesce((x - lag(x) OVER (PARTITION BY doc_id, page_no, side ORDER BY x) > 60)::INT, 0) AS new FROM ce),
cg AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_no, side ORDER BY x)::INT AS col_id FROM cn),
cb AS (SELECT doc_id, page_no, side, col_id, min(x) AS x_start, max(x) AS x_end FROM cg GROUP BY ALL),
sc AS (SELECT sq.*, (SELECT arg_min(col_id, (abs(sq.x0 - x_start), col_id)) FROM cb WHERE cb.doc_id = sq.doc_id AND cb.page_no = sq.page_no AND cb.side = sq.side) AS col_id FROM sq),
li AS (SELECT doc_id, page_no, side, col_id, round_even(y0 / 6, 0) * 6 AS y_key, trim(string_agg(trim(text), ' ' ORDER BY x0, seq)) AS line FROM sc GROUP BY ALL),
lp AS (SELECT doc_id, page_no, side, list(line ORDER BY col_id, y_key) AS lines FROM li WHERE line <> '' GROUP BY ALL),
pa AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, side)::INT AS para_index, page_no AS page, 'FULL' AS "column", trim(array_to_string(lines, ' ')) AS text FROM lp)
"""


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = page_rows(spark, sf_dir)
    return pages, span_rows(spark, sf_dir, pages)


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, spans = _parts(spark, sf_dir)
    known = L.with_spread(L.with_header_footer(L.facts(pages, spans)))
    noise = L.with_body(known, pages, spans)
    return E.split_spread(E.without_noise(spans, noise), noise)


@query("SELECT doc_id, header_y, footer_y, header_strings, footer_strings FROM hf")
def header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.header_footer(*_parts(spark, sf_dir))


@query("SELECT doc_id, sidebar_x, sidebar_strings FROM sb")
def sidebar_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, spans = _parts(spark, sf_dir)
    return L.zones(pages, spans).select("doc_id", "sidebar_x", "sidebar_strings")


@query("SELECT doc_id, is_spread, mid_x FROM sd")
def spread_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.spread(*_parts(spark, sf_dir))


@query("SELECT doc_id, column_count FROM cc")
def column_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, spans = _parts(spark, sf_dir)
    return L.zones(pages, spans).select("doc_id", "column_count")


@query("""SELECT doc_id, font, count(*) AS spans, list_sort(list(DISTINCT round_even(size, 1))) AS sizes, list(text[1:40] ORDER BY page_no, seq)[1:3] AS samples FROM ds GROUP BY doc_id, font""")
def font_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fonts(*_parts(spark, sf_dir))


@query("""SELECT doc_id, round_even(header_y, 1) AS header_y, round_even(footer_y, 1) AS footer_y, round_even(sidebar_x, 1) AS sidebar_x, round_even(mid_x, 1) AS mid_x, 6 AS line_bucket,
  round_even(decorative_threshold, 1) AS min_font, column_count, is_spread FROM hf JOIN sb USING (doc_id) JOIN sd USING (doc_id) JOIN cc USING (doc_id) JOIN fs USING (doc_id)""")
def layout_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.constants(L.measure(*_parts(spark, sf_dir)))


@query("SELECT doc_id, page_no, digital FROM dg")
def digital_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.digital_pages(page_rows(spark, sf_dir)).select("doc_id", "page_no", "digital")


@query("SELECT doc_id, coalesce(list(page_no ORDER BY page_no) FILTER (rotation <> 0), []) AS rotated FROM pg GROUP BY doc_id")
def rotation_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rotated_pages(page_rows(spark, sf_dir))


@query("""SELECT doc_id, 0.05 * page_width AS x0, CASE WHEN 0.02 * page_height < header_y THEN header_y ELSE 0.02 * page_height END AS y0, least(0.97 * page_width, sidebar_x) AS x1, least(page_height, footer_y) AS y1
  FROM docs JOIN hf USING (doc_id) JOIN sb USING (doc_id)""")
def clip_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, spans = _parts(spark, sf_dir)
    rows = L.zones(pages, spans)
    clip = E.clip_rect(*(F.col(c) for c in ("page_width", "page_height", "header_y", "footer_y", "sidebar_x")), crop=(0.02, 1.0, 0.05, 0.97))
    return rows.select("doc_id", clip.alias("c")).select("doc_id", "c.*")


@query("SELECT doc_id, page_no FROM pg JOIN docs USING (doc_id) WHERE page_no - 1 >= greatest(0, least(2, page_count - 1)) AND page_no - 1 < least(6, page_count)")
def page_range_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.page_range(page_rows(spark, sf_dir), 2, 6).select("doc_id", "page_no")


@query("SELECT doc_id, page_no, seq, text FROM nz")
def noise_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, spans = _parts(spark, sf_dir)
    return E.without_noise(spans, L.zones(pages, spans)).select("doc_id", "page_no", "seq", "text")


@query("SELECT doc_id, page_no, seq, side, x0 FROM sq")
def spread_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir).select("doc_id", "page_no", "seq", "side", "x0")


@query("SELECT doc_id, page_no, side, col_id, x_start, x_end FROM cb")
def column_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.column_boundaries(_sides(spark, sf_dir))


@query("SELECT doc_id, page_no, side, seq, col_id FROM sc")
def span_column_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _sides(spark, sf_dir)
    return E.assign_columns(sides, E.column_boundaries(sides)).select(*E.SIDE, "seq", "col_id")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _sides(spark, sf_dir)
    return E.lines(E.assign_columns(sides, E.column_boundaries(sides)))


@query("SELECT * FROM li WHERE line <> ''")
def span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


@query("SELECT * FROM lp")
def logical_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.logical_pages(_lines(spark, sf_dir))


@query("SELECT *, len(regexp_extract_all(text, '[^\\s]+'))::INT AS n_words FROM pa WHERE text <> ''")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.paragraphs(E.logical_pages(_lines(spark, sf_dir)))


@query("SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY para_index) AS pdf_ready FROM pa WHERE text <> '' GROUP BY doc_id")
def pdf_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pdf_ready(E.paragraphs(E.logical_pages(_lines(spark, sf_dir))))


_CLIPPED = """cl AS (SELECT doc_id, 0.0 AS cx0, CASE WHEN header_y > 0 AND header_y < footer_y AND header_y < page_height THEN header_y ELSE 0 END AS cy0,
  CASE WHEN sidebar_x > 0 AND sidebar_x < page_width THEN sidebar_x ELSE page_width END AS cx1, CASE WHEN footer_y < page_height AND footer_y > header_y AND footer_y > 0 THEN footer_y ELSE page_height END AS cy1,
  round_even(decorative_threshold, 1) AS least_size FROM docs JOIN hf USING (doc_id) JOIN sb USING (doc_id) JOIN fs USING (doc_id)),
inside AS (SELECT sp.* FROM sp JOIN dg USING (doc_id, page_no) JOIN cl USING (doc_id) WHERE digital AND x1 > cx0 AND x0 < cx1 AND y1 > cy0 AND y0 < cy1 AND size >= least_size),
nz AS (SELECT * FROM inside s"""


def extract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement and all steps of extraction, clip and font size included."""
    pages, spans = _parts(spark, sf_dir)
    return E.pdf_ready(E.paragraphs(E.extract(pages, spans, L.measure(pages, spans))))


QUERIES["extract_documents"] = extract_documents
ORACLE["extract_documents"] = f"""WITH {LAYOUT.replace("nz AS (SELECT * FROM sp s", _CLIPPED)} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY para_index) AS pdf_ready FROM pa WHERE text <> '' GROUP BY doc_id"""


@query("""SELECT doc_id, page_no, seq, CASE turn WHEN 90 THEN h - y1 WHEN 180 THEN w - x1 WHEN 270 THEN y0 ELSE x0 END AS x0, CASE turn WHEN 90 THEN x0 WHEN 180 THEN h - y1 WHEN 270 THEN w - x1 ELSE y0 END AS y0,
  CASE turn WHEN 90 THEN h - y0 WHEN 180 THEN w - x0 WHEN 270 THEN y1 ELSE x1 END AS x1, CASE turn WHEN 90 THEN x1 WHEN 180 THEN h - y0 WHEN 270 THEN w - x0 ELSE y1 END AS y1
  FROM sp JOIN (SELECT doc_id, page_no, width AS w, height AS h, o_orderkey % 4 * 90 AS turn FROM pg) USING (doc_id, page_no)""")
def upright_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of pages that are turned by a quarter for each of their number's remainder by four."""
    pages, spans = _parts(spark, sf_dir)
    turned = pages.withColumn("rotation", (F.col("o_orderkey") % 4 * 90).cast("int"))
    return L.upright(turned, spans)[1].select("doc_id", "page_no", "seq", "x0", "y0", "x1", "y1")


@query("""SELECT doc_id, bool_or(length(trim(plain_text)) > 10) FILTER (page_no <= 3) AS has_text, count(*) AS page_count, CASE WHEN NOT bool_or(length(trim(plain_text)) > 10) FILTER (page_no <= 3) THEN 'NO_TEXT_LAYER' END AS error FROM pg GROUP BY doc_id""")
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.sources.pdf import preflight as check

    return check(page_rows(spark, sf_dir))


ORACLE["join_hyphen_lines"] = """WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE i % 4 WHEN 1 THEN x || '-' WHEN 2 THEN x || '­' ELSE x END) AS l FROM documents),
t AS (SELECT doc_id, list_transform(l, lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS l FROM l)
SELECT doc_id, CASE WHEN len(l) = 1 THEN l[1] ELSE list_reduce(l, lambda a, x: CASE WHEN x = '' THEN a WHEN regexp_replace(a, '­+$', '') LIKE '%-' THEN CASE WHEN regexp_matches(x, '^\\p{Ll}') THEN regexp_replace(a, '­+$', '') || x ELSE regexp_replace(a, '­+$', '') || ' ' || x END
  WHEN regexp_replace(a, '­+$', '') <> a THEN regexp_replace(a, '­+$', '') || x ELSE a || ' ' || x END) END AS paragraph FROM t"""


def join_hyphen_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.transform(F.split("text", "\n", -1), lambda x, i: F.when((i + 1) % 4 == 1, F.concat(x, F.lit("-"))).when((i + 1) % 4 == 2, F.concat(x, F.lit(E.SOFT))).otherwise(x))
    return table(spark, sf_dir, "documents").select("doc_id", marked.alias("l")).select("doc_id", E.join_lines(F.col("l")).alias("paragraph"))


QUERIES["join_hyphen_lines"] = join_hyphen_lines
