"""Quality rules by weak supervision (native).

Each rule votes good, bad or abstains on a document. A latent-class model gives every rule, for good and for bad
documents apart, its share of bad votes, so its accuracies; expectation-maximisation estimates them without labels, and
the posterior probability of "good" replaces all-must-pass filtering. An abstention says nothing.

Junk is of many kinds and a rule looks for one of them, so a frequent kind must not stand for all: documents that the
base rule rejects have no weight in the fit; bad documents that only other rules vote bad do not count as misses of a
rule; and a good vote never tells more than the prior belief about it. SQL, as given, has none of the three: it fits all
documents to one bad class. Both give the same rows unless a kind of junk is frequent.

The model sees documents only through their vote patterns. There are at most 3 ** len(RULES) of those whatever the
corpus, so one aggregation over all documents leaves a table with a proven bound; EM runs over it as one SQL expression.
Everything is DataFrame functions: no Python on the executors, no shuffle of texts.

score_rules() writes the documents with their counts once and joins the verdicts to what it has written, on the pattern's
code: counting, the costly part, is done once for each text.

Defined cases: a null text is an empty one; a document without words gets abstentions only (and fails the base rule);
repeated rows each get their verdict; an empty table gives an empty result; other columns pass through score_rules()
untouched, as all of its own columns live in one struct column, named `_rules` or with as many more underscores as no
column has.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm.shared import SPACE, let, packed, table, total, unused, words, written

GOOD, ABSTAIN, BAD = 2, 1, 0
#: name: (measure, bad if over, good if under); between the two, and where the measure is null, the rule abstains.
RULES = {
    "symbols": ("n_symbols / n_words", 0.3, 0.05),
    "repeats": ("n_repeat_words / n_words", 0.5, 0.05),
    "lines": ("n_dup_lines / n_lines", 0.6, 0.05),
    "capitals": ("n_upper / word_chars", 0.5, 0.2),
    "shouts": ("n_shouts / n_words", 0.3, 0.05),
    "variety": ("1 - n_distinct / n_words", 0.9, 0.75),
}
ROUNDS = 15
#: A document is as likely good as bad before its votes are seen. Prior belief in the share of bad among a rule's votes, on good and on bad documents: rules beat chance. It weighs as
#: much as PRIOR votes per document of the class, plus one, and pins the two classes to their names.
BAD_ON_GOOD, BAD_ON_BAD, PRIOR = 0.01, 0.5, 0.2
KEEP_AT = 0.5
#: Before the first round, a document with a bad vote is good with this probability, any other with one minus it.
START = 0.1


def repeat_words(w: Column) -> Column:
    """How many words lie in a three-word window found twice or more in the array w, the first one included.

    A 33-bit hash of each window is packed above its 31-bit position and the longs are sorted; windows whose hash has
    an equal neighbour are compared as strings, so the count is exact. n log n in the text, without any shuffle.
    """
    low = (1 << 31) - 1

    def pack(i: Column) -> Column:
        h = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return F.shiftleft(h, 31).bitwiseOR(i.cast("bigint"))

    def alike(values: Column, key) -> Column:
        same = lambda x, y: F.coalesce(key(x) == key(y), F.lit(False))
        return F.filter(values, lambda x, i: same(x, F.get(values, i - 1)) | same(x, F.get(values, i + 1)))

    def window(x: Column) -> Column:
        i = x.bitwiseAND(F.lit(low)).cast("int")
        return F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))

    def covered(at: Column) -> Column:
        return total(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))).cast("bigint")))

    packed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), pack))
    near = let(packed, lambda s: alike(s, lambda x: F.shiftrightunsigned(x, 31)))
    exact = let(F.sort_array(F.transform(near, window)), lambda s: F.transform(alike(s, lambda x: x["g"]), lambda x: x["i"]))
    return F.when(F.size(w) < 3, F.lit(0).cast("bigint")).otherwise(let(F.sort_array(exact), covered))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the struct `_rules` of a text's counts."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    long = lambda c: c.cast("bigint")
    found = docs.withColumn("_w", words(t)).withColumn("_l", lines)
    w, rows = F.col("_w"), F.col("_l")
    # through explode(), so that the optimizer does not write these expressions out again for every use of a count
    return found.withColumn(
        "_rules",
        F.explode(F.array(F.struct(
            long(F.size(w)).alias("n_words"), long(F.length(F.regexp_replace(t, SPACE, ""))).alias("word_chars"),
            long(without(r"[#*$%&|<>]")).alias("n_symbols"), long(F.size(rows) - F.size(F.array_distinct(rows))).alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"), long(F.size(rows)).alias("n_lines"), long(without(r"\p{Lu}")).alias("n_upper"),
            long(without("!")).alias("n_shouts"), long(F.size(F.array_distinct(w))).alias("n_distinct"),
        ))),
    ).drop("_w", "_l")


def votes(counted: DataFrame) -> DataFrame:
    """Adds to `_rules` the fields base_failed and code: the votes as digits of a number to the base 3, first rule first."""
    fields = [f.name for f in counted.schema["_rules"].dataType]
    code = F.lit(0)
    for measure, bad, good in RULES.values():
        measure = re.sub(r"[a-z]\w+", r"_rules.\g<0>", measure)
        top, _, bottom = measure.rpartition(" / ")
        x = F.expr(f"try_divide({top}, {bottom})" if not top.startswith("1 - ") else f"1 - try_divide({top[4:]}, {bottom})")
        code = code * 3 + F.when(x > bad, BAD).when(x <= good, GOOD).otherwise(ABSTAIN)
    r = F.col("_rules")
    failed = (r["n_words"] < 50) | (100 * r["n_repeat_words"] > 50 * r["n_words"])
    return counted.withColumn("_rules", F.struct(*[r[f].alias(f) for f in fields], failed.alias("base_failed"), code.alias("code")))


def label_model(voted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """code, posterior: the probability of "good" for each vote pattern that occurs. At most 3 ** len(RULES) rows."""
    n = len(RULES)
    weight = F.when(F.col("_rules.base_failed"), 0.0).otherwise(1.0)
    patterns = voted.groupBy(F.col("_rules.code").alias("code")).agg(F.sum(weight).alias("n"))
    digits = F.array(*[F.floor(F.col("code") / 3 ** (n - 1 - j)).cast("int") % 3 for j in range(n)])
    one = F.struct("code", "n", digits.alias("v"))
    whole = patterns.agg(F.sort_array(F.collect_list(one)).alias("p"))
    p = F.col("p")
    double = lambda x: F.lit(float(x))

    def posterior(q: Column) -> Column:
        """One round: from the documents' posteriors to outcome probabilities and back."""
        parts = F.transform(p, lambda x, i: F.struct((x["n"] * F.get(q, i)).alias("g"), (x["n"] * (1 - F.get(q, i))).alias("b"), x["v"].alias("v"), F.array_contains(x["v"], BAD).alias("junk")))

        def model(z: Column) -> Column:
            def cell(k: Column) -> Column:
                vote = lambda x: F.get(x["v"], F.floor(k / 3).cast("int"))
                own = lambda c, x: F.lit(True) if c == "g" else ~x["junk"] | (vote(x) == BAD)
                sum_of = lambda c, test: F.aggregate(z, double(0), lambda a, x: a + F.when(test(vote(x)) & own(c, x), x[c]).otherwise(0.0))
                n_of = lambda c: sum_of(c, lambda v: F.lit(True))
                believed = lambda bad: F.when(k % 3 == BAD, bad).otherwise(1 - bad)
                share = lambda c, n, bad: (sum_of(c, lambda v: v == k % 3) + (n * PRIOR + 1) * believed(bad)) / (sum_of(c, lambda v: v != ABSTAIN) + n * PRIOR + 1)
                odds = F.log(share("g", n_of("g"), BAD_ON_GOOD)) - F.log(share("b", n_of("b"), BAD_ON_BAD))
                most = math.log((1 - BAD_ON_GOOD) / (1 - BAD_ON_BAD))
                return F.when(k % 3 == ABSTAIN, 0.0).when(k % 3 == GOOD, F.least(odds, F.lit(most))).otherwise(odds)

            return F.transform(F.sequence(F.lit(0), F.lit(3 * n - 1)), cell)

        def score(m: Column) -> Column:
            def odds(x: Column) -> Column:
                return F.aggregate(F.transform(x["v"], lambda v, j: F.get(m, j * 3 + v)), double(0), lambda a, o: a + o)

            return F.transform(p, lambda x: 1.0 / (1.0 + F.exp(-odds(x))))

        return let(let(parts, model), score)

    start = F.transform(p, lambda x: F.when(F.exists(x["v"], lambda v: v == BAD), double(START)).otherwise(double(1 - START)))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda q, _: posterior(q))
    done = whole.select("p", last.alias("q"))
    return done.select(F.explode(F.arrays_zip("p", "q")).alias("r")).select(F.col("r.p.code").alias("code"), F.col("r.q").alias("posterior"))


def judged(voted: DataFrame, model: DataFrame) -> DataFrame:
    """Adds to `_rules` the fields posterior and kept. The model has at most 3 ** len(RULES) rows and is broadcast."""
    small = model.select(F.col("code").alias("_code"), F.col("posterior").alias("_posterior"))
    r = F.col("_rules")
    fields = [f.name for f in voted.schema["_rules"].dataType]
    kept = ~r["base_failed"] & (F.col("_posterior") >= KEEP_AT)
    found = voted.join(F.broadcast(small), r["code"] == F.col("_code"), "left")
    return found.withColumn("_rules", F.struct(*[r[f].alias(f) for f in fields], F.col("_posterior").alias("posterior"), kept.alias("kept"))).drop("_code", "_posterior")


def score_rules(docs: DataFrame, text: str = "text", into: str | None = None) -> DataFrame:
    """docs, with all their columns, and a struct column of counts, votes and verdict, named `into` or else `_rules` with as
    many more underscores as no column has. Written down once with the counts, so that texts are counted once."""
    voted = written(votes(counts(packed(docs, text=text))).drop("text"), "rule-votes", texts=True)
    return judged(voted, written(label_model(voted), "label-model")).select("_row.*", F.col("_rules").alias(into or unused(docs, "_rules")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    voted = written(votes(counts(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text"), "rule-votes")
    named = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged(voted, label_model(voted)).select("doc_id", *[F.col(f"_rules.{c}").alias(c) for c in named])


def _sql() -> str:
    """The plain model (all documents, one bad class) in DuckDB, with one pair of common table expressions for each round."""
    n, ws = len(RULES), r"\x20\x09-\x0D"
    cases = []
    for measure, bad, good in RULES.values():
        top, _, bottom = measure.rpartition(" / ")
        x = f"(1 - {top[4:]}::DOUBLE / nullif({bottom}, 0))" if top.startswith("1 - ") else f"({top}::DOUBLE / nullif({bottom}, 0))"
        cases.append(f"CASE WHEN {x} > {bad} THEN 0 WHEN {x} <= {good} THEN 2 ELSE 1 END")
    code = "0"
    for c in cases:
        code = f"({code}) * 3 + ({c})"
    digit = " UNION ALL ".join(f"SELECT code, n, {j} AS j, (code // {3 ** (n - 1 - j)}) % 3 AS v FROM pat" for j in range(n))
    any_bad = " OR ".join(f"(code // {3 ** (n - 1 - j)}) % 3 = 0" for j in range(n))
    ctes = [
        f"d AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{ws}]+') AS w FROM documents)",
        "tok AS (SELECT row_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d)",
        "tri AS (SELECT row_id, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM tok WINDOW o AS (PARTITION BY row_id ORDER BY i))",
        "twice AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS c FROM tri WHERE g IS NOT NULL) WHERE c > 1)",
        "rep AS (SELECT row_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY row_id)",
        f"ln AS (SELECT row_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{ws}]')) AS l FROM d)",
        f"""c AS MATERIALIZED (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[{ws}]+', '', 'g')) AS word_chars,
          length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
          coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS n_upper,
          length(t) - length(replace(t, '!', '')) AS n_shouts, len(list_distinct(w)) AS n_distinct
          FROM d JOIN ln USING (row_id) LEFT JOIN rep USING (row_id))""",
        f"v AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {code} AS code FROM c)",
        "pat AS MATERIALIZED (SELECT code, count(*)::DOUBLE AS n FROM v GROUP BY code)",
        f"dig AS MATERIALIZED ({digit})",
        "cell AS (SELECT j, v FROM range(" + str(n) + ") AS a(j), range(3) AS b(v))",
        f"q0 AS MATERIALIZED (SELECT code, CASE WHEN {any_bad} THEN {START} ELSE {1 - START} END AS q FROM pat)",
    ]
    for k in range(1, ROUNDS + 1):
        believed = lambda bad: f"CASE WHEN v = {BAD} THEN {bad} ELSE {1 - bad} END"
        ctes += [
            f"""m{k} AS MATERIALIZED (SELECT j, v, CASE WHEN v = {ABSTAIN} THEN 0 ELSE
                ln((coalesce(g, 0) + (tg * {PRIOR} + 1) * {believed(BAD_ON_GOOD)}) / (coalesce(sum(g) FILTER (v <> {ABSTAIN}) OVER (PARTITION BY j), 0) + tg * {PRIOR} + 1))
                - ln((coalesce(b, 0) + (tb * {PRIOR} + 1) * {believed(BAD_ON_BAD)}) / (coalesce(sum(b) FILTER (v <> {ABSTAIN}) OVER (PARTITION BY j), 0) + tb * {PRIOR} + 1)) END AS o
              FROM cell LEFT JOIN (SELECT j, v, sum(n * q) AS g, sum(n * (1 - q)) AS b FROM dig JOIN q{k - 1} USING (code) GROUP BY j, v) USING (j, v),
              (SELECT sum(n * q) AS tg, sum(n * (1 - q)) AS tb FROM pat JOIN q{k - 1} USING (code)))""",
            f"q{k} AS MATERIALIZED (SELECT code, 1 / (1 + exp(-sum(o))) AS q FROM dig JOIN m{k} USING (j, v) GROUP BY code)",
        ]
    return "WITH " + ",\n".join(ctes) + f"""
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= {KEEP_AT} AS kept FROM v JOIN q{ROUNDS} USING (code)"""


SQL = _sql()
