"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (native).

Every shard owns VNODES points of a ring; a row belongs to the first point at or after its own hash. Shards are full at
their capacity, and what a full shard cannot take continues clockwise, first come first served, so the loads are
guaranteed while few rows leave their home shard.

Only counts of rows on each arc matter to that walk, so it runs over one table of shards * VNODES arcs (a proven bound)
as a single SQL expression. First come first served means that the walk cuts the rows, numbered clockwise, into runs:
a row's shard and slot follow from its number. Numbers come from the arcs' counts and a running sum within each arc.

A row's place is the hash of its doc_id; where the table gives an id to more than one text (or to none: null), its rows
after the first text are placed by id and checksum together, so neither an id nor a group of equal texts, however large,
crowds an arc, and no task sees more than about one arc in shards * VNODES of the different rows. Rows that are
alike in all of id, checksum and size are one row with a count until their numbers are spelled out, in portions of
COPIES that other tasks take. Only ids and sizes are shuffled, never texts.

Law: `rows` - with capacities of the rounded mean, shard counts differ by at most one.

Defined cases: a null text has 0 bytes; a null doc_id is an id, that hashes as -1; repeated rows have slots of their own;
an empty table gives no rows; other columns are ignored. Hashes take 60 bits of MD5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.llm.shared import table, written

SHARDS = 40
VNODES = 128
OVERHEAD = 16
RING = 1 << 60
COPIES = 1_000_000  # equal rows that one task numbers


def place(key: Column) -> Column:
    """A point of the ring for a string."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")


def points(spark: SparkSession, shards: int, vnodes: int = VNODES) -> DataFrame:
    """arc (clockwise from 0), shard, low, high: low < a row's place <= high. The last arc of the ring is the first shard's again."""
    nodes = spark.range(shards * vnodes).select((F.col("id") / vnodes).cast("int").alias("shard"), place(F.concat(F.lit("node:"), F.col("id").cast("string"))).alias("at"))
    whole = nodes.agg(F.sort_array(F.collect_list(F.struct("at", "shard"))).alias("p"))
    end = F.struct(F.lit(RING).alias("at"), F.get("p", F.lit(0))["shard"].alias("shard"))
    arcs = whole.select(F.posexplode(F.concat("p", F.array(end))).alias("arc", "node"), "p")
    low = F.coalesce(F.get("p", F.col("arc") - 1)["at"], F.lit(-1))
    return arcs.select("arc", F.col("node.shard").alias("shard"), low.alias("low"), F.col("node.at").alias("high"))


def arc_of(at: Column, highs: Column) -> Column:
    """Position of the first element of the sorted array highs that is not below `at`: a binary search in one expression."""
    step = lambda r, _: F.when(r["a"] >= r["b"], r).otherwise(_half(r, at, highs))
    start = F.struct(F.lit(0).alias("a"), (F.size(highs) - 1).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, step)["a"]


def _half(r: Column, at: Column, highs: Column) -> Column:
    mid = F.shiftright(r["a"] + r["b"], 1)
    over = F.get(highs, mid) < at
    return F.struct(F.when(over, mid + 1).otherwise(r["a"]).alias("a"), F.when(over, r["b"]).otherwise(mid).alias("b"))


def walk(arcs: DataFrame, shards: int) -> DataFrame:
    """run_start, run_end, shard, slot_start: which row numbers go where.

    arcs: arc, shard, n (rows whose home it is), before (rows of all earlier arcs). The ring is walked twice: what the
    last arcs could not place continues on the first.
    """
    one = F.struct("arc", "shard", "n", "before")
    whole = arcs.agg(F.sort_array(F.collect_list(one)).alias("arcs"), F.sum("n").alias("total"))
    k = F.lit(shards)
    room = F.transform(F.sequence(F.lit(0), k - 1), lambda s: F.floor(F.col("total") / k) + F.when(s < F.col("total") % k, 1).otherwise(0))
    steps = F.concat(
        F.transform("arcs", lambda a: F.struct(a["shard"].alias("shard"), (a["before"] + a["n"]).alias("come"))),
        F.transform("arcs", lambda a: F.struct(a["shard"].alias("shard"), F.col("total").alias("come"))),
    )
    nothing = F.expr("cast(array() as array<struct<run_start:bigint,run_end:bigint,shard:int,slot_start:bigint>>)")
    start = F.struct(F.lit(0).cast("bigint").alias("done"), F.transform(F.sequence(F.lit(0), k - 1), lambda _: F.lit(0).cast("bigint")).alias("used"), nothing.alias("runs"))

    def step(state: Column, a: Column) -> Column:
        used = F.get(state["used"], a["shard"])
        take = F.least(a["come"] - state["done"], F.get("room", a["shard"]) - used)
        run = F.struct(state["done"].alias("run_start"), (state["done"] + take).alias("run_end"), a["shard"].alias("shard"), used.alias("slot_start"))
        grown = F.struct(
            (state["done"] + take).alias("done"), F.transform(state["used"], lambda u, s: F.when(s == a["shard"], u + take).otherwise(u)).alias("used"),
            F.concat(state["runs"], F.array(run)).alias("runs"),
        )
        return F.when(take > 0, grown).otherwise(state)

    found = whole.select("total", room.alias("room"), steps.alias("steps")).select(F.aggregate("steps", start, step)["runs"].alias("runs"))
    return found.select(F.inline("runs"))


def assign(rows: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """rows (doc_id, size, text_crc32) with shard and slot.

    One pass numbers rows within arcs and is written down (a few longs a row); the arcs' counts come from it.
    """
    spark = rows.sparkSession
    nodes = points(spark, shards, vnodes)
    ring = nodes.agg(F.sort_array(F.collect_list("high")).alias("_highs"))  # one row of shards * vnodes + 1 longs
    # equal rows become one with a count where they are read; the smallest checksum of an id has the id's own place
    alike = rows.groupBy("doc_id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("_n"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-1"))
    own = place(name)
    first = alike.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_texts"), F.min(F.struct("text_crc32", "size")).alias("_first")).where("_texts > 1").select("doc_id", "_first")
    first = first.withColumnRenamed("doc_id", "_id")
    known = alike.join(first, alike["doc_id"].eqNullSafe(first["_id"]), "left")
    later = F.col("_first").isNotNull() & (F.struct("text_crc32", "size") != F.col("_first"))
    at = F.when(later, place(F.concat_ws(":", name, F.col("text_crc32").cast("string"), F.col("size").cast("string")))).otherwise(own)
    placed = known.select("doc_id", "size", "text_crc32", "_n", at.alias("_at")).join(F.broadcast(ring))
    placed = placed.select("doc_id", "size", "text_crc32", "_n", "_at", arc_of(F.col("_at"), F.col("_highs")).alias("_arc"))
    within = Window.partitionBy("_arc").orderBy("_at", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = written(placed.withColumn("_k", F.sum("_n").over(within) - F.col("_n")).drop("_at"), "ring-rows")
    counted = numbered.groupBy("_arc").agg(F.sum("_n").alias("n"))
    arcs = nodes.join(F.broadcast(counted), F.col("arc") == F.col("_arc"), "left").select("arc", "shard", F.coalesce("n", F.lit(0)).alias("n"))
    arcs = arcs.agg(F.sort_array(F.collect_list(F.struct("arc", "shard", "n"))).alias("a")).select(
        F.explode(
            F.aggregate(
                "a", F.struct(F.lit(0).cast("bigint").alias("sum"), F.expr("cast(array() as array<struct<arc:int,shard:int,n:bigint,before:bigint>>)").alias("rows")),
                lambda s, x: F.struct((s["sum"] + x["n"]).alias("sum"), F.concat(s["rows"], F.array(F.struct(x["arc"], x["shard"], x["n"], s["sum"].alias("before")))).alias("rows")),
            )["rows"]
        ).alias("x")
    ).select("x.*")
    arcs = written(arcs, "ring-arcs")  # shards * vnodes + 1 rows
    runs = walk(arcs, shards).agg(F.sort_array(F.collect_list(F.struct("run_end", "run_start", "shard", "slot_start"))).alias("_runs"))
    runs = runs.withColumn("_ends", F.transform("_runs", lambda r: r["run_end"]))
    known = numbered.join(F.broadcast(arcs.select(F.col("arc").alias("_arc"), "before")), "_arc").join(F.broadcast(runs))
    found = spelled_out(known.withColumn("_number", F.col("before") + F.col("_k")))
    run = F.get("_runs", arc_of(F.col("_number") + 1, F.col("_ends")))
    found = found.select("doc_id", "size", "text_crc32", "_number", run.alias("_run"))
    return found.select("doc_id", "size", "text_crc32", F.col("_run.shard").alias("shard"), (F.col("_number") - F.col("_run.run_start") + F.col("_run.slot_start")).alias("slot"))


def spelled_out(rows: DataFrame) -> DataFrame:
    """Each row _n times, numbered from _number on; portions of COPIES are dealt out."""
    portions = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES)))
    few = rows.where(f"_n <= {COPIES}").withColumn("_portion", F.lit(0).cast("long"))
    many = rows.where(f"_n > {COPIES}").withColumn("_portion", portions).repartition("_number", "_portion")
    start = F.col("_portion") * COPIES
    copies = F.explode(F.sequence(start, F.least(start + COPIES, F.col("_n")) - 1))
    return few.unionByName(many).withColumn("_copy", copies).withColumn("_number", F.col("_number") + F.col("_copy"))


def op7_ring_bounded_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on shards 0 to 39."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length("text").cast("bigint")).alias("bytes"), F.crc32(text).alias("text_crc32"))
    rows = rows.select("doc_id", (F.coalesce("bytes", F.lit(0)) + OVERHEAD).cast("bigint").alias("size"), "text_crc32")
    found = assign(rows)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


_place = lambda name: f"('0x' || substr(md5({name}), 1, 15))::BIGINT"
#: The walk as a recursion over the arcs, twice around; CRC-32 over the texts' bytes.
SQL = f"""
WITH RECURSIVE bit AS (SELECT i, i::UINTEGER AS c, 0 AS k FROM range(256) AS t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS l FROM bit WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents),
r AS MATERIALIZED (SELECT doc_id, strlen(t) + {OVERHEAD} AS size, xor(list_reduce(list_transform(range(strlen(t)), lambda i: ('0x' || substr(x, 1 + 2 * i, 2))::UINTEGER), lambda a, b: xor(a >> 8, l[1 + (xor(a, b) & 255)]), 4294967295::UINTEGER), 4294967295::UINTEGER)::BIGINT AS crc FROM d, tab),
p AS (SELECT *, coalesce(doc_id::VARCHAR, '-1') AS name, (crc, size) <> min((crc, size)) OVER (PARTITION BY doc_id) AS later FROM r),
q AS (SELECT doc_id, size, crc, CASE WHEN later THEN {_place("name || ':' || crc || ':' || size")} ELSE {_place("name")} END AS pos FROM p),
node AS (SELECT (i // {VNODES})::INT AS shard, {_place("'node:' || i")} AS pos FROM range({SHARDS * VNODES}) AS t(i)),
arc AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pos, shard) AS arc, shard, pos FROM (FROM node UNION ALL SELECT arg_min(shard, pos), {RING} FROM node)),
n AS MATERIALIZED (SELECT q.*, arc, row_number() OVER (ORDER BY arc, q.pos, doc_id NULLS FIRST, crc, size) - 1 AS number FROM q ASOF JOIN arc ON q.pos <= arc.pos),
step AS MATERIALIZED (SELECT arc.arc + turn * {SHARDS * VNODES + 1} AS k, shard, CASE turn WHEN 0 THEN sum(coalesce(c, 0)) OVER (PARTITION BY turn ORDER BY arc.arc) ELSE (SELECT count(*) FROM n) END::BIGINT AS come
  FROM arc LEFT JOIN (SELECT arc, count(*) AS c FROM n GROUP BY arc) AS m USING (arc), range(2) AS t(turn)),
room AS (SELECT list(c // {SHARDS} + (s < c % {SHARDS})::INT ORDER BY s) AS room FROM range({SHARDS}) AS t(s), (SELECT count(*) AS c FROM n)),
walk AS (SELECT 0::BIGINT AS k, 0::BIGINT AS done, list_transform(range({SHARDS}), lambda s: 0::BIGINT) AS used, NULL::INT AS shard, 0::BIGINT AS run_start, 0::BIGINT AS slot_start
  UNION ALL SELECT w.k + 1, w.done + take, list_transform(w.used, lambda u, i: u + CASE WHEN i = s.shard + 1 THEN take ELSE 0 END), s.shard, w.done, w.used[s.shard + 1]
  FROM walk AS w JOIN step AS s ON s.k = w.k + 1, room, LATERAL (SELECT greatest(least(s.come - w.done, room[s.shard + 1] - w.used[s.shard + 1]), 0) AS take)),
run AS (SELECT shard, run_start, slot_start FROM (SELECT *, lead(run_start) OVER (ORDER BY k) AS run_end, done FROM walk WHERE shard IS NOT NULL) WHERE done > run_start)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, shard, (number - run_start + slot_start)::BIGINT AS slot, NULL::INT AS grown_shard FROM n ASOF JOIN run ON n.number >= run.run_start
"""
