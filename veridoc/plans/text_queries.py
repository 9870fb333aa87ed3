"""Queries over texts, addresses and currency figures, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.functions import text as X
from veridoc.operators import checks as C
from veridoc.operators import unicode as U
from veridoc.operators import webtext as W

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Inputs, as expressions that Spark and DuckDB share.
WEB = "CASE doc_id % 3 WHEN 0 THEN replace(text, ' the ', '  the ') WHEN 1 THEN replace(text, '. ', '.   ') ELSE text END"
NOISY = """CASE doc_id % 4
  WHEN 0 THEN text || chr(10) || 'Read more at https://x.example.org/a?b=1 or call +91 98765 43210 now.' || chr(10) || '12' || chr(10) || 'mail a.b@c.example.org or @handle'
  WHEN 1 THEN text || chr(10) || '© 2024 Some Corp' || chr(10) || chr(10) || 'Copyright 2024 all' || chr(10) || 'All Rights Reserved' || chr(10) || '[image: x.png] the end'
  ELSE text END"""
CURLY = "CASE WHEN doc_id % 5 = 0 THEN replace(replace(text, ' of ', ' of’s '), ' and ', ' and ') ELSE replace(text, ' of ', ' of’s ') END"
STRAIGHT = "replace(text, ' of ', ' of''s ')"


def docs_as(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", "text")
    return found.select("doc_id", *[F.expr(e.replace("''", "\\'")).alias(c) for c, e in columns.items()])


# --- currency ---------------------------------------------------------------------------------------------------


def currency_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair for each order: the source writes H before every figure, the web Rs. on even lines."""
    n = (F.col("l_partkey") + 10).cast("string")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", n.alias("n"))
    whole = lines.groupBy(F.col("l_orderkey").alias("pair_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "n"))).alias("l"))
    joined = lambda f: F.array_join(F.transform("l", f), ". ")
    pdf = joined(lambda x: F.concat(F.lit("Revenue of H"), x["n"], F.lit(" Crores")))
    web = joined(lambda x: F.concat(F.lit("Revenue of "), F.when(x["l_linenumber"] % 2 == 0, "Rs.").otherwise("H"), x["n"], F.lit(" Crores")))
    return whole.select("pair_id", pdf.alias("pdf"), web.alias("web"))


PAIRS = r"""
pairs AS (SELECT l_orderkey AS pair_id,
    string_agg('Revenue of H' || (l_partkey + 10) || ' Crores', '. ' ORDER BY l_linenumber, l_partkey) AS pdf,
    string_agg('Revenue of ' || CASE WHEN l_linenumber % 2 = 0 THEN 'Rs.' ELSE 'H' END || (l_partkey + 10) || ' Crores', '. ' ORDER BY l_linenumber, l_partkey) AS web
  FROM lineitem GROUP BY l_orderkey),
sides AS (SELECT pair_id, 'pdf' AS side, pdf AS t FROM pairs UNION ALL SELECT pair_id, 'web', web FROM pairs),
raw AS (SELECT pair_id, side, unnest(regexp_extract_all(t, '(?:^|[^\p{L}])(\bRs\.?\s*|₹\s*|\bINR\s*|\bH)(\d[\d,]*(?:\.\d+)?)(\s*(?:Crores?|Lakhs?|cr\.?|L)?)', 1)) AS prefix,
    unnest(regexp_extract_all(t, '(?:^|[^\p{L}])(\bRs\.?\s*|₹\s*|\bINR\s*|\bH)(\d[\d,]*(?:\.\d+)?)(\s*(?:Crores?|Lakhs?|cr\.?|L)?)', 2)) AS num,
    unnest(regexp_extract_all(t, '(?:^|[^\p{L}])(\bRs\.?\s*|₹\s*|\bINR\s*|\bH)(\d[\d,]*(?:\.\d+)?)(\s*(?:Crores?|Lakhs?|cr\.?|L)?)', 3)) AS u, generate_subscripts(regexp_extract_all(t, '(?:^|[^\p{L}])(\bRs\.?\s*|₹\s*|\bINR\s*|\bH)(\d[\d,]*(?:\.\d+)?)(\s*(?:Crores?|Lakhs?|cr\.?|L)?)', 1), 1) AS k FROM sides),
ord AS (SELECT pair_id, side, trim(prefix) AS prefix, replace(num, ',', '') AS number, trim(u) AS unit, k FROM raw),
figs AS (SELECT pair_id, side, prefix, number, unit, row_number() OVER (PARTITION BY pair_id, side ORDER BY k) AS ord FROM ord WHERE length(string_split(number, '.')[1]) >= 2),
last AS (SELECT pair_id, number, arg_max(prefix, ord) AS prefix FROM figs WHERE side = 'web' GROUP BY ALL),
bad AS (SELECT f.pair_id, f.ord, f.number, f.prefix AS pdf_symbol, l.prefix AS web_symbol, f.unit FROM figs f JOIN last l USING (pair_id, number) WHERE f.side = 'pdf' AND f.prefix <> l.prefix)
"""


def currency_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = currency_pairs(spark, sf_dir).select("pair_id", C.figures(F.col("pdf")).alias("pdf"), C.figures(F.col("web")).alias("web"))
    rows = pairs.select("pair_id", F.posexplode(C.mismatches(F.col("pdf"), F.col("web"))).alias("ord", "m"))
    return rows.select("pair_id", "ord", F.lit("currency_mismatch").alias("type"), F.lit("must_fix").alias("severity"), "m.*")


@query(f"""WITH {PAIRS}
SELECT pair_id, count(number) AS must_fix, 0 AS minor, 0 AS extra_whitespace_count, count(number) AS currency_mismatch_count, 0 AS missing_word_count, 0 AS missing_paragraph_count,
  CASE WHEN count(number) > 0 THEN 'needs_fixing' ELSE 'all_clear' END AS overall FROM pairs LEFT JOIN bad USING (pair_id) GROUP BY pair_id""")
def currency_mismatch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.report(currency_pairs(spark, sf_dir), currency_issues(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT pair_id, side, ord, prefix, number, unit FROM figs")
def currency_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = currency_pairs(spark, sf_dir).select("pair_id", F.explode(F.create_map(F.lit("pdf"), "pdf", F.lit("web"), "web")).alias("side", "t"))
    rows = sides.select("pair_id", "side", F.posexplode(C.figures(F.col("t"))).alias("k", "f"))
    return rows.select("pair_id", "side", (F.col("k") + 1).alias("ord"), "f.prefix", "f.number", "f.unit")


@query(f"WITH {PAIRS} SELECT pair_id, number, prefix FROM last")
def currency_web_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = currency_pairs(spark, sf_dir).select("pair_id", F.posexplode(C.figures(F.col("web"))).alias("k", "f"))
    return rows.groupBy("pair_id", F.col("f.number").alias("number")).agg(F.max_by("f.prefix", "k").alias("prefix"))


@query(f"""WITH {PAIRS}
SELECT pair_id, format('issue_{{:03d}}', row_number() OVER (PARTITION BY pair_id ORDER BY ord)) AS id, number AS numeric_value, pdf_symbol, web_symbol, unit,
  printf('{C.MISMATCH_SAID}', pdf_symbol, web_symbol) AS explanation FROM bad""")
def issue_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.format_string(C.MISMATCH_SAID, "pdf_symbol", "web_symbol")
    rows = C.numbered(currency_issues(spark, sf_dir), "issue", ["ord"])
    return rows.select("pair_id", "id", F.col("number").alias("numeric_value"), "pdf_symbol", "web_symbol", "unit", said.alias("explanation"))


# --- white space, sections, sentences ----------------------------------------------------------------------------


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_as(spark, sf_dir, web=WEB)
    return rows.select("doc_id", F.posexplode(C.whitespace_runs(F.col("web"))).alias("ord", "r")).select("doc_id", "ord", "r.*")


def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where only the number of runs is asked for, no run is cut out."""
    return docs_as(spark, sf_dir, web=WEB).select(F.col("doc_id").alias("pair_id"), C.whitespace_count(F.col("web")).cast("long").alias("n"))


RUNS = f"""
w AS (SELECT doc_id, {WEB} AS web FROM documents),
m AS (SELECT doc_id, web, regexp_extract_all(web, '[ \\t]{{2,}}') AS m, string_split_regex(web, '[ \\t]{{2,}}') AS g FROM w),
i AS (SELECT *, unnest(range(len(m))) AS ord FROM m),
runs AS (SELECT doc_id, web, ord, (list_sum(list_transform(g[1:ord + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:ord], lambda x: length(x))), 0))::INT AS start_at, length(m[ord + 1]) AS space_count FROM i)
"""


@query(f"""WITH {RUNS}, c AS (SELECT *, substr(web, greatest(start_at - 40, 0) + 1, start_at + space_count + 40 - greatest(start_at - 40, 0)) AS web_snippet FROM runs)
SELECT doc_id, ord, start_at, space_count, web_snippet, regexp_replace(web_snippet, '[ \\t]{{2,}}', ' ', 'g') AS pdf_snippet FROM c""")
def extra_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("doc_id", "ord", F.col("at").alias("start_at"), "space_count", "web_snippet", "pdf_snippet")


@query(f"""WITH {RUNS},
s AS (SELECT *, list_transform(string_split(web, chr(10)), lambda x, k: {{'section': substr(x, 1, 80), 'text': substr(x, 1, 500), 'selector': 'p:nth-of-type(' || k || ')'}}) AS sections,
  lower(substr(trim(substr(web, greatest(start_at - 20, 0) + 1, start_at + 40 - greatest(start_at - 20, 0)), ' ' || chr(10) || chr(9)), 1, 60)) AS snippet FROM runs),
h AS (SELECT *, list_filter(sections, lambda x: contains(lower(x.text), snippet)) AS hit FROM s)
SELECT doc_id, ord, CASE WHEN len(hit) > 0 THEN hit[-1].section ELSE sections[1].section END AS section, CASE WHEN len(hit) > 0 THEN hit[-1].selector ELSE sections[1].selector END AS selector FROM h""")
def section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda x, k: F.struct(F.substring(x, 1, 80).alias("section"), F.lower(F.substring(x, 1, 500)).alias("text"), F.format_string("p:nth-of-type(%d)", k + 1).alias("selector"))
    docs = docs_as(spark, sf_dir, web=WEB)
    docs = docs.select("doc_id", "web", C.whitespace_runs(F.col("web")).alias("runs"), F.transform(F.split("web", "\n", -1), line).alias("sections"))
    found = docs.select("doc_id", F.posexplode(F.transform("runs", lambda r: W.find_section(r["at"], F.col("web"), F.col("sections")))).alias("ord", "s"))
    return found.select("doc_id", "ord", "s.section", "s.selector")


_SHORT = "|".join(X.ABBREVIATIONS)


@query(f"""WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1' || chr(1) || '\\2', 'g'), '\\b({_SHORT})\\.', '\\1' || chr(1), 'g') AS t FROM documents),
s AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?])[\\s\\p{{Z}}]+([A-Z])', '\\1' || chr(2) || '\\2', 'g'), chr(2)) AS l FROM p),
t AS (SELECT doc_id, list_transform(l, lambda x: regexp_replace(replace(x, chr(1), '.'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS l FROM s),
f AS (SELECT doc_id, list_filter(l, lambda x: len(regexp_extract_all(x, '[^\\s\\p{{Z}}]+')) >= 6) AS l FROM t)
SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) AS ord FROM f""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(C.sentences(F.col("text"))).alias("k", "sentence")).select("doc_id", "sentence", (F.col("k") + 1).alias("ord"))


# --- web text ----------------------------------------------------------------------------------------------------


def _cleaned(column: str) -> str:
    for pattern in W.REMOVED:
        column = f"regexp_replace({column}, '{pattern}', '', 'g')"
    trim = lambda c: f"regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
    return trim(f"array_to_string(list_filter(string_split({column}, chr(10)), lambda x: {trim('x')} <> ''), chr(10))")


@query(f"WITH n AS (SELECT doc_id, {NOISY} AS t FROM documents) SELECT doc_id, {_cleaned('t')} AS cleaned FROM n")
def clean_web_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_as(spark, sf_dir, t=NOISY).select("doc_id", W.clean_web_text(F.col("t")).alias("cleaned"))


@query("""WITH p AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS l FROM documents),
u AS (SELECT doc_id, generate_subscripts(l, 1) AS para_index, regexp_replace(unnest(l), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS text FROM p) SELECT * FROM u WHERE text <> ''""")
def web_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.web_paragraphs(docs_as(spark, sf_dir, t="replace(text, chr(10), chr(10) || chr(10))"), "doc_id", "t")


@query(r"""WITH p AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1), ':', '_', 'g') AS a,
  regexp_replace(regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '[^\p{L}\p{N}_\-]', '_', 'g') AS b FROM pages),
s AS (SELECT page_id, url, substr(regexp_replace(regexp_replace(a || '_' || b, '_+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 120) AS s FROM p)
SELECT page_id, url, CASE WHEN s = '' THEN 'crawl' ELSE s END AS slug FROM s""")
def url_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", W.url_slug(F.col("url")).alias("slug"))


@query(r"""WITH h AS (SELECT page_id, url, replace(replace(lower(regexp_extract(url, '^[^:/?#]+://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '.vercel.app', ''), '-', ' ') AS h FROM pages),
t AS (SELECT page_id, url, array_to_string(list_transform(regexp_extract_all(h, '(\p{L}+|[^\p{L}]+)'), lambda p: upper(p[1:1]) || p[2:]), '') AS b FROM h)
SELECT page_id, url, CASE WHEN b = '' THEN 'Unknown' ELSE b END AS brand FROM t""")
def brand_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", W.brand_name(F.col("url")).alias("brand"))


# --- Unicode -----------------------------------------------------------------------------------------------------

_FROM, _TO = (s.replace("'", "''") for s in X.typographic_map())


@query(f"WITH t AS (SELECT doc_id, {CURLY} AS t FROM documents) SELECT doc_id, translate(t, '{_FROM}', '{_TO}') AS plain, length(t) - length(replace(t, ' ', '')) AS wide FROM t")
def typographic_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return docs_as(spark, sf_dir, t=CURLY).select("doc_id", X.typographic(t).alias("plain"), X.wide_spaces(t).alias("wide"))


@query("SELECT doc_id, regexp_replace(nfc_normalize(replace(text, 'é', 'é')), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS prepared FROM documents")
def nfc_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_as(spark, sf_dir, t="replace(text, 'é', 'é')").select("doc_id", X.prepare(F.col("t")).alias("prepared"))


# What folding does to the characters that these texts hold: SQL has no compatibility form.
@query(f"""WITH t AS (SELECT doc_id, {CURLY} AS t FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(replace(replace(nfc_normalize(t), '’', ''''), chr(160), ' '), '([A-Za-z])-[\\s\\p{{Z}}]+([A-Za-z])', '\\1-\\2', 'g'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS prepared FROM t""")
def prepare_for_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_as(spark, sf_dir, t=CURLY).select("doc_id", X.prepare_for_comparison(F.col("t"), U.LOOKALIKES).alias("prepared"))


@query(f"""WITH t AS (SELECT doc_id, {CURLY} AS t FROM documents), m AS (FROM (VALUES (chr(8217), 'U+2019', 'RIGHT SINGLE QUOTATION MARK', '''', 'skeleton'), (chr(160), 'U+00A0', 'NO-BREAK SPACE', ' ', 'NFKC')) AS m(original, codepoint, name, result, changed_by)),
p AS (SELECT *, (strpos(t, original) - 1)::INT AS position FROM t JOIN m ON contains(t, original))
SELECT doc_id, original, codepoint, name, result, changed_by, position, substr(t, greatest(position - 30, 0) + 1, position + 30 - greatest(position - 30, 0)) AS sample_context FROM p""")
def unicode_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.audit(docs_as(spark, sf_dir, t=CURLY), "doc_id", "t", U.LOOKALIKES)


@query("""SELECT * FROM (VALUES (chr(8217), ''''), (chr(1040), 'A'), (chr(198), 'AE'), (chr(119808), 'A')) AS t(original, target)""")
def confusables_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ["# a comment", "2019 ; 0022 ; MA", "", "0410 ;\t0041 ;\tMA\t# look-alike", "00C6 ; 0041 0045 ; MA", "ZZZZ ; 0041 ; MA", "no separator", "2019 ; 0027 ; MA", "1D400 ; 0041 ; MA", "0411 ; 00G1 ; MA"]
    rows = spark.range(1).select(F.posexplode(F.array(*map(F.lit, lines))).alias("line_no", "line"))
    return U.parse_confusables(rows)


# --- pass two ----------------------------------------------------------------------------------------------------


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An issue for each document: its first eight words, three of them reported as missing."""
    rows = docs_as(spark, sf_dir, pdf=CURLY, web=STRAIGHT)
    w = F.filter(F.split("pdf", " ", -1), lambda x: x != "")
    find = C.find_text(F.lit("missing_word"), F.array_join(F.slice(w, 1, 5), " "), F.slice(w, 6, 3), F.lit(None))
    dropped, plain, delta = C.pass_two(F.col("find_text"), F.col("web"))
    return rows.withColumn("find_text", find).select("doc_id", "find_text", dropped.alias("dropped"), plain.alias("normalised"), delta.alias("char_delta"))


CANDIDATES = f"""
d AS (SELECT doc_id, {STRAIGHT} AS web, list_filter(string_split({CURLY}, ' '), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, web, regexp_replace(array_to_string(w[1:5], ' ') || ' ' || array_to_string(w[6:8], ' '), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS find_text FROM d),
g AS (SELECT doc_id, find_text, translate(find_text, '{_FROM}', '{_TO}') AS normalised, length(find_text) - length(replace(find_text, ' ', '')) AS char_delta, translate(web, '{_FROM}', '{_TO}') AS web FROM f),
c AS (SELECT doc_id, find_text, normalised, char_delta, find_text <> '' AND contains(web, normalised) AND char_delta <= 2 AS dropped FROM g)
"""


@query(f"WITH {CANDIDATES} SELECT doc_id, find_text FROM c WHERE NOT dropped")
def pass_two_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).where("NOT dropped").select("doc_id", "find_text")


@query(f"WITH {CANDIDATES} SELECT doc_id, find_text, normalised, char_delta, 'typographic variant found in web text' AS reason FROM c WHERE dropped")
def pass_two_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).where("dropped").select("doc_id", "find_text", "normalised", "char_delta", F.lit("typographic variant found in web text").alias("reason"))


# --- reports -----------------------------------------------------------------------------------------------------


def counted_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, type, severity, n: how many issues of a type a pair has."""
    space = run_counts(spark, sf_dir).where("n > 0").select("pair_id", F.lit("extra_whitespace").alias("type"), F.lit("minor").alias("severity"), "n")
    money = currency_issues(spark, sf_dir).select("pair_id", "type", "severity", F.lit(1).cast("long").alias("n"))
    return space.unionByName(money)


@query(f"""WITH {RUNS}, {PAIRS.strip()}, u AS (SELECT doc_id AS pair_id, 'extra_whitespace' AS type, 'minor' AS severity FROM runs UNION ALL SELECT pair_id, 'currency_mismatch', 'must_fix' FROM bad)
SELECT type, severity, count(*) AS issues, count(DISTINCT pair_id) AS pairs FROM u GROUP BY type, severity""")
def issues_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_pair = counted_issues(spark, sf_dir).groupBy("type", "severity", "pair_id").agg(F.sum("n").alias("n"))
    return by_pair.groupBy("type", "severity").agg(F.sum("n").alias("issues"), F.count(F.lit(1)).alias("pairs"))


@query(f"""WITH {RUNS} SELECT doc_id AS pair_id, 0 AS must_fix, count(start_at) AS minor, count(start_at) AS extra_whitespace_count, 0 AS currency_mismatch_count, 0 AS missing_word_count, 0 AS missing_paragraph_count,
  CASE WHEN count(start_at) > 0 THEN 'minor_issues' ELSE 'all_clear' END AS overall FROM w LEFT JOIN runs USING (doc_id) GROUP BY doc_id""")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"))
    issues = run_counts(spark, sf_dir).where("n > 0").select("pair_id", F.lit("extra_whitespace").alias("type"), F.lit("minor").alias("severity"), "n")
    return C.report(pairs, issues)


@query("""SELECT item_id, doc_id, coalesce(d.text <> '' AND (contains(d.text, b.text) OR contains(b.text, d.text)), false) AS present FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id WHERE length(trim(b.text)) >= 60""")
def missing_paragraph_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.operators.fuzzy import paragraph_pairs, present

    pairs = paragraph_pairs(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
    return pairs.select("item_id", "doc_id", present(F.col("paragraph"), F.col("web")).alias("present"))


@query()
def missing_paragraph_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.operators.fuzzy import missing_paragraphs, paragraph_pairs

    return missing_paragraphs(paragraph_pairs(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")))


def _thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source, and on the web without every seventh word."""
    w = X.split_words(F.col("text"))
    web = F.array_join(F.filter(w, lambda x, i: (i + 1) % 7 != 0), " ")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.col("text").alias("pdf"), web.alias("web"))


@query()
def best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.operators.fuzzy import best_windows

    return best_windows(_thinned(spark, sf_dir))


@query()
def missing_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.operators.fuzzy import missing_words

    return missing_words(_thinned(spark, sf_dir))
