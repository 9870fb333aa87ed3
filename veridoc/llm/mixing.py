"""Mixing sources to target weights by hierarchical budgeting.

The corpus is a tree: domain, then language, then source; weights are relative among siblings. A token budget runs down
the tree. A node can take at most MAX_EPOCHS times the tokens below it; what a node cannot take goes to its siblings in
proportion to their weights, and only what all of them together cannot take is left for the ancestors' other children.
As capacities are summed bottom-up first, one water-filling for each level, top-down, settles all of it exactly.

Each leaf then takes whole epochs and a token prefix of one more. An epoch is a seeded order of the leaf's documents
(60 bits of MD5 of seed, epoch and doc_id). The prefix is the shortest that reaches the budget. Its end is found in two
steps so that no task holds a leaf: tokens summed in 4,096 ranges of the order, then the one range that holds the end,
row by row. A document decides for itself against its leaf's end key. Leaf tables of up to BROADCAST_LEAVES rows are
broadcast, and then texts are not shuffled; with more leaves than that documents are joined with them by a shuffle.

Everything here is DataFrame functions. Numbers are whole at every level, so results do not depend on summation order.

Defined cases: null lang or source counts as the empty name; a null text has no tokens; a null doc_id orders as -1;
rows with equal doc_id in a leaf stand or fall together; leaves without tokens give no rows; weight 0, nothing; a
name without a weight has DEFAULT_WEIGHT; an empty table gives an empty result; other columns pass through mix(), whose own
columns start with "_mix_" (mixed() takes any names and adds none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.llm.shared import packed, table, words, written

#: Relative weights by name, for each level; production parameters of the query.
WEIGHTS = {
    "domain": {"domain0": 40, "domain1": 30, "domain2": 20, "domain3": 10},
    "lang": {"en": 50, "de": 20, "fr": 20, "es": 10},
    "source": {},
}
DEFAULT_WEIGHT = 5
SHARE = 0.6  # of the corpus's tokens
MAX_EPOCHS = 3
SEED = "mix-1"
RANGES = 4096
#: Leaf tables up to this many rows are broadcast; larger ones are joined with a shuffle that AQE may split.
BROADCAST_LEAVES = 10_000
LEAF = ["_mix_domain", "_mix_lang", "_mix_source"]


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo 4."""
    return F.concat(F.lit("domain"), F.coalesce((F.expr("try_cast(regexp_extract(_mix_source, '([0-9]{1,9})$', 1) AS int)") % 4).cast("string"), F.lit("?")))


def with_leaf(docs: DataFrame) -> DataFrame:
    named = docs.withColumns({"_mix_lang": F.coalesce("lang", F.lit("")), "_mix_source": F.coalesce("source", F.lit(""))})
    return named.withColumn("_mix_domain", domain_of(F.col("_mix_source")))


def key_of(epoch: Column, seed: str) -> Column:
    """A document's place in a leaf's seeded epoch: 0 to 2 ** 60 - 1."""
    name = F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-1")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("bigint")


def fill(nodes: DataFrame, parent: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """Water-filling among siblings: nodes(parent.., name, cap, budget of the parent) with `given`, at most cap each."""
    weight = F.lit(DEFAULT_WEIGHT)
    for k, v in weights.items():
        weight = F.when(F.col(name) == k, v).otherwise(weight)
    family = Window.partitionBy(*parent)
    order = family.orderBy(F.col("cap") / F.col("_w"), name)
    rows = nodes.withColumn("_w", weight).where("_w > 0")
    rows = rows.withColumns({
        "_k": F.row_number().over(order),
        "_below": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_rest": F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    open_ = F.col("cap") * F.col("_rest") > (F.col("budget") - F.col("_below")) * F.col("_w")
    rows = rows.withColumn("_first", F.min(F.when(open_, F.struct("_k", "_below", "_rest"))).over(family))
    f = F.col("_first")
    share = F.floor(F.col("_w") * (F.col("budget") - f["_below"]) / f["_rest"])
    given = F.when(f.isNull() | (F.col("_k") < f["_k"]), F.col("cap")).otherwise(F.least(F.col("cap"), share))
    return rows.withColumn("given", given.cast("bigint")).drop("_w", "_k", "_below", "_rest", "_first")


def budgets(leaves: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights: dict = WEIGHTS) -> DataFrame:
    """leaves (LEAF columns, tokens) with full (whole epochs) and rest (tokens of the next one)."""
    d, l, s = LEAF
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    all_tokens = leaves.agg(F.floor(F.sum("tokens") * F.lit(share)).cast("bigint").alias("budget"))
    domains = leaves.groupBy(d).agg(F.sum("cap").alias("cap")).join(F.broadcast(all_tokens))
    domains = fill(domains, [], d, weights["domain"]).select(d, F.col("given").alias("budget"))
    langs = leaves.groupBy(d, l).agg(F.sum("cap").alias("cap")).join(domains, d)
    langs = fill(langs, [d], l, weights["lang"]).select(d, l, F.col("given").alias("budget"))
    found = fill(leaves.join(langs, [d, l]), [d, l], s, weights["source"]).where("tokens > 0")
    full = F.floor(F.col("given") / F.col("tokens")).cast("int")
    return found.select(*LEAF, "tokens", "given", full.alias("full"), (F.col("given") - full * F.col("tokens")).alias("rest"))


def plan(slim: DataFrame, seed: str = SEED, **kw) -> DataFrame:
    """slim: LEAF columns, doc_id, _mix_tokens. One row for each leaf: full, end_key and end_doc of its prefix (null: none)."""
    leaves = written(slim.groupBy(*LEAF).agg(F.sum("_mix_tokens").alias("tokens")), "mix-leaves")
    budget = written(budgets(leaves, **kw), "mix-budgets")
    rows = on_leaf(slim, budget.where("rest > 0")).withColumn("_key", key_of(F.col("full"), seed))
    rows = rows.withColumn("_range", F.shiftright("_key", 48).cast("int"))
    ranges = rows.groupBy(*LEAF, "_range").agg(F.sum("_mix_tokens").alias("_t"))
    so_far = Window.partitionBy(*LEAF).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_t").over(so_far), F.lit(0)))
    last = on_leaf(ranges, budget.select(*LEAF, "rest")).where("_before < rest").groupBy(*LEAF).agg(F.max(F.struct("_range", "_before")).alias("_r"))
    last = written(last.select(*LEAF, F.col("_r._range").alias("_at"), F.col("_r._before").alias("_before")), "mix-ranges")
    edge = on_leaf(rows, last).where("_range = _at")
    one_by_one = Window.partitionBy(*LEAF, "_range").orderBy("_key", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = Window.partitionBy(*LEAF, "_range", "_key", "doc_id")
    edge = edge.withColumn("_upto", F.col("_before") + F.sum("_mix_tokens").over(one_by_one) - F.sum("_mix_tokens").over(peers))
    ends = edge.where("_upto < rest").groupBy(*LEAF).agg(F.max(F.struct("_key", "doc_id")).alias("_e"))
    ends = ends.select(*LEAF, F.col("_e._key").alias("end_key"), F.col("_e.doc_id").alias("end_doc"))
    return budget.join(ends, LEAF, "left").select(*LEAF, F.col("full").alias("_mix_full"), "end_key", "end_doc")


def on_leaf(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """An inner join on the leaf; the leaves' size is checked before they are broadcast."""
    small = leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return rows.join(F.broadcast(leaves) if small else leaves, LEAF)


def mix(docs: DataFrame, seed: str = SEED, **kw) -> DataFrame:
    """docs with all their columns plus LEAF columns, _mix_tokens and _mix_epoch; a row for each epoch a document is in."""
    named = with_leaf(docs)
    tokens = F.size(words(F.coalesce("text", F.lit("")))).cast("bigint")
    slim = written(named.select(*LEAF, "doc_id", tokens.alias("_mix_tokens")), "mix-docs")
    ends = written(plan(slim, seed, **kw), "mix-ends")
    return chosen(named.withColumn("_mix_tokens", tokens), ends, seed)


def mixed(docs: DataFrame, seed: str = SEED, **kw) -> DataFrame:
    """The mixture with the columns of docs, whatever their names."""
    return mix(packed(docs, doc_id="doc_id", text="text", lang="lang", source="source"), seed, **kw).select("_row.*")


def chosen(named: DataFrame, ends: DataFrame, seed: str) -> DataFrame:
    rows = on_leaf(named, ends)
    key = key_of(F.col("_mix_full"), seed)
    doc, end = F.col("doc_id"), F.col("end_doc")  # nulls come first
    inside = (key < F.col("end_key")) | ((key == F.col("end_key")) & (doc.isNull() | F.coalesce(doc <= end, F.lit(False))))
    copies = F.col("_mix_full") + F.coalesce(inside, F.lit(False)).cast("int")
    rows = rows.withColumn("_mix_copies", copies).where("_mix_copies > 0")
    return rows.withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0), F.col("_mix_copies") - 1))).drop("_mix_copies", "_mix_full", "end_key", "end_doc")


def op2_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: a row for each document and epoch it is taken in."""
    docs = with_leaf(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    slim = written(docs.select(*LEAF, "doc_id", F.size(words(F.coalesce("text", F.lit("")))).cast("bigint").alias("_mix_tokens")), "mix-docs")
    found = chosen(slim, written(plan(slim), "mix-ends"), SEED)
    return found.select("doc_id", F.col("_mix_domain").alias("domain"), F.col("_mix_lang").alias("lang"), F.col("_mix_source").alias("source"), F.col("_mix_tokens").alias("n_tokens"), F.col("_mix_epoch").alias("epoch"))


def _weights(name: str, level: str) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + f" ELSE {DEFAULT_WEIGHT} END" if WEIGHTS[level] else str(DEFAULT_WEIGHT)


def _level(out: str, source: str, parent: str, name: str, level: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""{out}_w AS (SELECT *, {_weights(name, level)} AS w FROM ({source})),
    {out}_k AS (SELECT *, row_number() OVER o AS k, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
      sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {out}_w WINDOW o AS ({by} ORDER BY cap / w, {name})),
    {out}_f AS (SELECT *, min(CASE WHEN cap * rest > (budget - below) * w THEN k END) OVER ({by}) AS fk FROM {out}_k),
    {out}_g AS (SELECT *, max(CASE WHEN k = fk THEN below END) OVER ({by}) AS fb, max(CASE WHEN k = fk THEN rest END) OVER ({by}) AS fr FROM {out}_f),
    {out} AS (SELECT * EXCLUDE (budget), CASE WHEN fk IS NULL OR k < fk THEN cap ELSE least(cap, floor(w * (budget - fb) / fr)) END::BIGINT AS budget FROM {out}_g)"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    'domain' || coalesce((TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT) % 4)::VARCHAR, '?') AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
  leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {MAX_EPOCHS} AS cap FROM d GROUP BY ALL),
  {_level("dom", f"SELECT domain, sum(cap)::BIGINT AS cap, (SELECT floor(sum(tokens)::BIGINT * {SHARE}::DOUBLE)::BIGINT FROM leaf) AS budget FROM leaf GROUP BY domain", "", "domain", "domain")},
  {_level("lng", "SELECT l.domain, l.lang, sum(l.cap)::BIGINT AS cap, any_value(dom.budget) AS budget FROM leaf l JOIN dom USING (domain) GROUP BY l.domain, l.lang", "domain", "lang", "lang")},
  {_level("src", "SELECT l.domain, l.lang, l.source, l.tokens, l.cap, lng.budget FROM leaf l JOIN lng USING (domain, lang)", "domain, lang", "source", "source")},
  b AS (SELECT domain, lang, source, budget // tokens AS full_, budget % tokens AS rest FROM src WHERE tokens > 0),
  r AS (SELECT d.*, full_, rest, ('0x' || substr(md5('{SEED}:' || full_ || ':' || coalesce(doc_id, -1)), 1, 15))::BIGINT AS key FROM d JOIN b USING (domain, lang, source)),
  c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id NULLS FIRST) - sum(tokens) OVER (PARTITION BY domain, lang, source, key, doc_id) AS before FROM r),
  n AS (SELECT *, full_ + (before < rest)::INT AS copies FROM c)
SELECT doc_id, domain, lang, source, tokens AS n_tokens, unnest(range(copies))::INT AS epoch FROM n
"""
