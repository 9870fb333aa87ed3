"""Quality classifier: a generalised additive model with pairwise interactions.

The model is a sum of lookup tables: one for each feature, over the feature's bins, and one for each of the few pairs of
features whose interaction explains most of what is left. Tables are learned by boosting in cycles: in every round each
feature in turn gets one shallow tree, fitted to the current residuals by Newton steps on that feature's histogram, and
its leaves, times a small rate, are added to the feature's table. Pairs are boosted likewise with trees of one cut on one
feature and one on the other for each side. Scoring looks bins up and adds, vectorised over Arrow batches.

Features are counts of the text alone: its length, its characters by kind, its words, lines and repeats; no label,
language, source or id. Learning runs on at most SAMPLE labelled documents (a documented bound; those with the smallest
hash of doc_id), of which a crc32 remainder marks one fold in FOLDS as held out; their features are small, texts stay
where they are. Every document is scored by its whole text, in one pass without a shuffle.

Defined cases: a null or empty text scores by its (zero) features; labels that are null are not used; a doc_id labelled
twice counts once, with its higher label, and one that stands twice in documents once, with its smallest features; no
labels at all, or only one kind, gives a constant score of the label's smoothed share; a null doc_id is not held out;
repeated rows score alike; an empty table gives an empty result; other columns pass through score().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridoc.llm.shared import map_arrow, table, written

SAMPLE, FOLDS = 20_000, 5
BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST, RIDGE = 120, 60, 0.1, 3, 5.0, 2.0
CUT = 0.3  # predicted is 1 from this score on

FEATURES = [
    "words", "word_length", "longest_word", "symbols", "shouts", "capitals", "digits", "stops", "other_marks", "wide", "spaces", "lines",
    "distinct", "distinct_triples", "repeated_lines", "ends_well", "single_letters",
]
_kinds = np.zeros((256, 8), np.float64)  # capitals, small letters, digits, symbols, shouts, stops, other marks, wide
for _b in range(256):
    _c = chr(_b)
    _kinds[_b] = [_b < 128 and _c.isupper(), _b < 128 and _c.islower(), _c in "0123456789", _c in "#*$%&|<>", _c == "!", _c in ".,;:?", _b < 128 and _c in "\"'()[]{}/\\@^_`~+=-", _b >= 128]


def features_of(text: str | None) -> np.ndarray:
    """FEATURES of a text."""
    text = text or ""
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(raw, minlength=256) @ _kinds if len(raw) else np.zeros(8)
    words = text.split()
    n = len(words)
    size = max(1, len(raw))
    letters = max(1.0, kinds[0] + kinds[1])
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = list(map(len, words))
    chars = sum(lengths)
    triples = max(1, n - 2)
    per_word = max(1, n)
    return np.array([
        math.log1p(n), chars / per_word, math.log1p(max(lengths, default=0)), kinds[3] / size, kinds[4] / per_word, kinds[0] / letters, kinds[2] / size,
        kinds[5] / per_word, kinds[6] / size, kinds[7] / size, (len(text) - chars) / size, len(lines) / per_word, len(set(words)) / per_word,
        len(set(zip(words, words[1:], words[2:], strict=False))) / triples, 1 - len(set(lines)) / max(1, len(lines)), float(text.rstrip()[-1:] in (".", "!", "?", "…", '"')),
        lengths.count(1) / per_word,
    ])


class Model:
    """Edges of bins, one table for each feature, and tables for some pairs."""

    def __init__(self, base: float, edges: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int]], pair_edges: list[np.ndarray], pair_tables: list[np.ndarray]):
        self.base, self.edges, self.tables = base, edges, tables
        self.pairs, self.pair_edges, self.pair_tables = pairs, pair_edges, pair_tables

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of x."""
        total = np.full(len(x), self.base)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, f], "right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], "right") for pair in self.pairs for f in pair}
        for (f, g), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[coarse[f], coarse[g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Edges between bins: quantiles of the column's values."""
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.empty(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The cut of a histogram that explains most: its gain, and how many bins lie left of it (0: none is worth it)."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    all_g, all_h = g.sum(), h.sum()
    gain = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
    gain = np.where((left_h >= LEAST / 4) & (all_h - left_h >= LEAST / 4), gain, 0)
    k = int(np.argmax(gain))
    return (float(gain[k]), k + 1) if gain[k] > 1e-12 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One shallow tree of at most LEAVES leaves on a histogram, as a value for each bin."""
    parts = [(0, len(g))]
    while len(parts) < LEAVES:
        gain, cut, k = max((*_best_cut(g[a:b], h[a:b]), -i) for i, (a, b) in enumerate(parts))
        if not cut:
            break
        a, b = parts[-k]
        parts[-k : 1 - k] = [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut on the first feature, then one on the second for each side; the gain and a value for each cell."""
    best, found = 0.0, np.zeros_like(g)
    for k in range(1, len(g)):
        gain, value = 0.0, np.zeros_like(g)
        for side in (slice(0, k), slice(k, len(g))):
            sg, sh = g[side].sum(axis=0), h[side].sum(axis=0)
            more, cut = _best_cut(sg, sh)
            gain += more + _gain(sg.sum(), sh.sum())
            for part in (slice(0, cut), slice(cut, len(sg))):
                value[side, part] = sg[part].sum() / (sh[part].sum() + RIDGE)
        if gain > best:
            best, found = gain, value
    return best - float(_gain(g.sum(), h.sum())), found


def _histogram(cells: np.ndarray, size: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.bincount(cells, g, size), np.bincount(cells, h, size)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Model:
    """Learns from rows x with labels y (0 or 1). The same rows in any order give the same model."""
    order = np.lexsort([*x.T, y])
    x, y = x[order], y[order]
    width = x.shape[1]
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    edges, coarse = [_cuts(x[:, f], BINS) for f in range(width)], [_cuts(x[:, f], PAIR_BINS) for f in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not len(y) or y.min() == y.max():
        return Model(base, edges, tables, [], coarse, [])
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    total = np.full(len(y), base)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f in range(width):
            step = RATE * _tree(*_histogram(bins[f], len(tables[f]), *residuals()))
            tables[f] += step
            total += step[bins[f]]
    # the pairs whose single tree would explain most of the residuals
    g, h = residuals()
    low = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    shape = [len(e) + 1 for e in coarse]
    cells = lambda a, b: low[a] * shape[b] + low[b]
    ranked = []
    for a in range(width):
        for b in range(a + 1, width):
            if shape[a] > 1 and shape[b] > 1:
                hist = _histogram(cells(a, b), shape[a] * shape[b], g, h)
                ranked.append((-_pair_tree(*(v.reshape(shape[a], shape[b]) for v in hist))[0], a, b))
    chosen = [(a, b) for _, a, b in sorted(ranked)[:pairs]]
    pair_tables = [np.zeros((shape[a], shape[b])) for a, b in chosen]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(chosen):
            at = cells(a, b)
            hist = _histogram(at, shape[a] * shape[b], *residuals())
            step = RATE * _pair_tree(*(v.reshape(shape[a], shape[b]) for v in hist))[1]
            pair_tables[k] += step
            total += step.ravel()[at]
    return Model(base, edges, tables, chosen, coarse, pair_tables)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled documents that are not held out, at most `sample` of them."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = written(known, "gam-labels")  # at most `sample` rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features_of(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    kind = labels.schema["quality"].dataType.simpleString()
    found = map_arrow(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality {kind}, x array<double>")
    found = found.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).toPandas()  # at most `sample` rows
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    return fit(x, found["quality"].to_numpy(float))


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score and predicted, under the given names, in one pass; columns of these names are replaced."""
    own = {c.lower() for c in names}
    kept = [f for f in docs.schema.fields if f.name.lower() not in own]
    passed = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.score(np.array([features_of(t.as_py()) for t in b.column("text")]).reshape(b.num_rows, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in passed), pa.array(p), pa.array((p >= CUT).astype(np.int32))], names=[*passed, *names])

    out = [*kept, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]
    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in passed]), run, T.StructType(out))


def op1_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
