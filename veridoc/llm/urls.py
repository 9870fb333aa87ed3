"""URL filters: a temporal join of captures with dated block lists (native).

A list is a log of dated entries, "add" or "remove", for a pattern: a domain (with its subdomains) or a host with a path
(with all that lies below the path). Each addition becomes a validity interval that ends where the same pattern's next
entry in the list begins. A capture is judged by the entries valid on its own fetch date: an equi-join on what could
match it, with the interval as the as-of test.

Patterns are normalised as captures are: scheme, user, port, query, fragment, a leading "*." and the dots and slashes at
the end go, the host is in lower case; paths keep their case and match whole segments. An address (IPv4, or IPv6 in
brackets) has no parent domains: it matches as a whole only.

Hosts are few beside captures, so domains are looked up once for each different host: its suffixes meet the entries, and
captures join what was found for their host. Paths are looked up only for captures of hosts that have path entries, one
key for each of the capture's path prefixes up to the longest path listed for the host. Captures that nothing matches
take no part in the counting; they come back by one join on the capture. Only page_id, url and date move. Where one host
has very many captures, adaptive execution splits the captures' side of these joins. Equal captures are counted before
and repeated after.

Defined cases: a null or host-less url matches nothing and passes; a null date matches nothing; two entries of a pattern
on one date: the removal comes first, so the addition holds; repeated entries, also by other spellings, count once; an
entry without a host matches nothing; an empty list passes every capture; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.llm.shared import table, written

#: Host (without user and port) and path of an address; a pattern may lack the scheme.
AFTER_SCHEME = r"(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#]*)[^/?#]*([^?#]*)"
URL = rf"(?i)^[a-z][a-z0-9+.\-]*://{AFTER_SCHEME}"
PATTERN = rf"(?i)^(?:[a-z][a-z0-9+.\-]*://)?(?:\*\.)?{AFTER_SCHEME}"
ADDRESS = r"^(?:\[.*\]|[0-9]+(?:\.[0-9]+)*)$"
FIRST_DAY, DAYS = "2024-01-01", 365
CAPTURE = ["page_id", "url", "fetched"]


def host_and_path(text: Column, form: str = URL) -> Column:
    """struct<host, path> of a URL or pattern: host in lower case without dots at the end, path without slashes there; host
    is empty if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(text, form, 1)), r"^\.+|\.+$", "")
    return F.struct(host.alias("host"), F.regexp_replace(F.regexp_extract(text, form, 2), "/+$", "").alias("path"))


def normalised(entries: DataFrame) -> DataFrame:
    """entries (list, pattern, day, action) as list, host, path, day, action."""
    rows = entries.select("list", host_and_path(F.col("pattern"), PATTERN).alias("p"), "day", "action")
    return rows.select("list", "p.host", "p.path", "day", "action").where("host <> '' AND day IS NOT NULL").distinct()


def intervals(entries: DataFrame) -> DataFrame:
    """list, host, path, valid_from, valid_to (exclusive; null: still valid) of normalised entries."""
    order = Window.partitionBy("list", "host", "path").orderBy("day", F.col("action") == "add")
    rows = entries.withColumn("valid_to", F.lead("day").over(order)).where("action = 'add'")
    return rows.where("valid_to IS NULL OR valid_to > day").select("list", "host", "path", F.col("day").alias("valid_from"), "valid_to")


def domains_of(host: Column) -> Column:
    """A host and its parent domains; an address alone."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host.rlike(ADDRESS), F.array(host)).otherwise(suffixes)


def prefixes_of(path: Column, most: Column) -> Column:
    """The prefixes of a path that end at a segment, of at most `most` segments: /a, /a/b and so on."""
    parts = F.split(path, "/", -1)
    ends = F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.least(F.size(parts), most + 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched) with blocked, n_active (entries valid then), lists and the longest pattern (the
    last in order of equally long ones)."""
    same = captures.groupBy(*CAPTURE).agg(F.count(F.lit(1)).cast("int").alias("copies"))
    known = same.where("url IS NOT NULL AND fetched IS NOT NULL").select(*CAPTURE, host_and_path(F.col("url")).alias("u")).select(*CAPTURE, "u.*").where("host <> ''")
    valid = written(intervals(normalised(entries)), "url-intervals")  # read three times
    as_of = "fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)"
    hosts = known.select(F.col("host").alias("of_host")).distinct().withColumn("host", F.explode(domains_of(F.col("of_host"))))
    by_domain = hosts.join(valid.where("path = ''"), "host").select(F.col("of_host").alias("host"), F.col("host").alias("pattern"), "list", "valid_from", "valid_to")
    hits = known.join(by_domain, "host").where(as_of).select(*CAPTURE, "list", "pattern")
    paths = valid.where("path <> ''")
    longest = paths.groupBy("host").agg(F.max(F.size(F.split("path", "/", -1)) - 1).alias("most"))
    below = known.where("path <> ''").join(longest, "host").withColumn("path", F.explode(prefixes_of(F.col("path"), F.col("most"))))
    by_path = below.join(paths, ["host", "path"]).where(as_of).select(*CAPTURE, "list", F.concat("host", "path").alias("pattern"))
    found = hits.unionByName(by_path).groupBy(*CAPTURE).agg(
        F.count(F.lit(1)).alias("n_active"), F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"), F.max(F.struct(F.length("pattern"), "pattern"))["pattern"].alias("longest")
    )
    found = found.select(*[F.col(c).alias(f"_{c}") for c in CAPTURE], "n_active", "lists", "longest")
    on = same["page_id"].eqNullSafe(found["_page_id"]) & (same["url"] == found["_url"]) & (same["fetched"] == found["_fetched"])
    rows = same.join(found, on, "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    n = F.coalesce("n_active", F.lit(0))
    return rows.select(*CAPTURE, (n > 0).alias("blocked"), n.cast("long").alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), "longest")


def _part(name: str, at: int) -> Column:
    """Three hexadecimal digits of a pattern's MD5, as a number."""
    return F.conv(F.substring(F.md5(F.col(name).cast("binary")), at, 3), 16, 10).cast("int")


def dated_lists(pages: DataFrame) -> DataFrame:
    """The query's lists: for about a third of the hosts, parent domains and host/segments seen, an addition, a
    removal some days later and, for half of them, a second addition; dates and list names follow from MD5 digits."""
    seen = pages.select(host_and_path(F.col("url")).alias("u")).select("u.*").where("host <> ''").distinct()
    named = F.concat(domains_of(F.col("host")), F.transform(prefixes_of(F.col("path"), F.lit(1)), lambda p: F.concat("host", p)))
    seen = seen.select(F.explode(named).alias("pattern")).where("pattern LIKE '%.%'").distinct()
    some = seen.where(_part("pattern", 1) % 3 == 0)
    start, gap = _part("pattern", 4) % DAYS, _part("pattern", 7) % 90 + 1
    steps = F.array(
        F.struct(start.alias("at"), F.lit("add").alias("action")), F.struct((start + gap).alias("at"), F.lit("remove").alias("action")),
        F.when(_part("pattern", 10) % 2 == 0, F.struct((start + 2 * gap).alias("at"), F.lit("add").alias("action"))),
    )
    rows = some.select("pattern", F.concat(F.lit("list"), (_part("pattern", 13) % 4).cast("string")).alias("list"), F.explode(F.array_compact(steps)).alias("s"))
    return rows.select("list", "pattern", F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("s.at")).alias("day"), F.col("s.action").alias("action"))


def op6_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture, fetched on a date that follows from its page_id, against the dated lists."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 37, F.lit(DAYS)).cast("int"))
    return judge(pages.withColumn("fetched", fetched), dated_lists(pages)).withColumn("fetched", F.col("fetched").cast("string"))


_HEX = lambda at: f"('0x' || substr(md5(pattern), {at}, 3))::INT"
SQL = rf"""
WITH raw AS (SELECT row_number() OVER () AS row_id, page_id, url, DATE '{FIRST_DAY}' + ((page_id * 37 % {DAYS} + {DAYS}) % {DAYS})::INT AS fetched, url LIKE '%://%' AS ok,
    string_split(string_split(string_split(substr(url, strpos(url, '://') + 3), '#')[1], '?')[1], '/') AS parts FROM pages),
  cap AS (SELECT row_id, page_id, url, fetched, CASE WHEN ok THEN rtrim(string_split(lower(string_split(parts[1], '@')[-1]), ':')[1], '.') ELSE '' END AS host, rtrim(array_to_string(parts[2:], '/'), '/') AS path FROM raw),
  lab AS (SELECT *, CASE WHEN regexp_full_match(host, '[0-9.]+') THEN [host] ELSE string_split(host, '.') END AS l, string_split(path, '/') AS seg FROM cap),
  keys AS (SELECT row_id, unnest(list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:], '.'))) AS pattern FROM lab WHERE host <> ''
    UNION ALL SELECT row_id, host || '/' || seg[1] FROM lab WHERE host <> '' AND path <> ''),
  picked AS (SELECT DISTINCT pattern FROM keys WHERE pattern LIKE '%.%' AND {_HEX(1)} % 3 = 0),
  num AS (SELECT pattern, 'list' || ({_HEX(13)} % 4) AS list, {_HEX(4)} % {DAYS} AS s, {_HEX(7)} % 90 + 1 AS gap, {_HEX(10)} % 2 AS twice FROM picked),
  iv AS (SELECT pattern, list, DATE '{FIRST_DAY}' + s AS a, DATE '{FIRST_DAY}' + (s + gap) AS b FROM num
    UNION ALL SELECT pattern, list, DATE '{FIRST_DAY}' + (s + 2 * gap), NULL FROM num WHERE twice = 0),
  hit AS (SELECT row_id, list, pattern FROM keys JOIN iv USING (pattern) JOIN cap USING (row_id) WHERE fetched >= a AND (b IS NULL OR fetched < b)),
  agg AS (SELECT row_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, max((length(pattern), pattern)) AS longest FROM hit GROUP BY row_id)
SELECT page_id, url, fetched::VARCHAR AS fetched, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_active, coalesce(lists, '') AS lists, longest[2] AS longest
FROM cap LEFT JOIN agg USING (row_id)
"""
