"""Near-duplicate classes by ProbMinHash, banding and verification.

A document is its weighted five-word shingles (weight: how often one occurs). Every shingle is a Poisson process whose
rate is its weight and whose arrivals, all derived from the shingle's hash, fall on random registers; a register keeps
the shingle that arrives first. Arrivals are made in rounds, and a shingle stops as soon as its clock has passed the
last register to be reached, which ends the work early. Two documents agree on a register with probability

    J_P(x, y) = sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i),

the probability Jaccard similarity (for equal weights, the plain one). BANDS bands of ROWS registers make candidates; at
the threshold of 0.8 a pair is missed with probability (1 - 0.8 ** 6) ** 32 = 6e-5. Every pair that decides a class is
verified exactly from the two documents' shingles.

Equal word sequences are one node, whatever their number, so copies cost nothing beyond the sketch. Classes are the
connected components of the links. Buckets are never expanded into all pairs. First each bucket tests its smallest node,
the pivot, with the others, which settles groups of close copies. Of the nodes still unconnected in buckets of more than
BLOCK, those are kept that are near a node of another component by a longer sketch of BITS registers, one bit each,
compared in blocks of WIDE (a pair of blocks yields nodes, not pairs); so a bucket of many texts that look alike but are
below the threshold moves 256 bytes a node once for each WIDE nodes, and no text. What is left is compared in blocks of at
most BLOCK nodes, vectorised, by a byte of each register and then by shingles, best first, unless the block has connected
a pair by then, each pair only in the first bucket it shares. Only links leave a block.

"Near" is an estimate of at least NEAR or NEAR_BITS, both 5 standard deviations below the threshold: of pairs at exactly 0.8
each loses 1e-6 (binomial), a fiftieth of what the banding loses; above 0.8, less. Every other pair was tested, or its
nodes were connected already. Texts in one large bucket that are alike by 0.73 to 0.8, yet not linked, are compared by their
shingles: quadratic work in such a bucket, in blocks, without emitting pairs.

Words are runs of characters other than ASCII white space. Texts are shuffled only for nodes that share a bucket.

The intermediate tables are removed as soon as the components are known.

Defined cases: texts of fewer than five words have one shingle of all their words; texts without words (null, empty) are
copies of each other; a null doc_id is a document as any other, and a class's id is the smallest that is not null;
repeated rows are copies; an empty table gives an empty result; other columns, whatever their names, are ignored by classes()
and kept by deduplicated().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.functions.shipping import ship
from veridoc.llm.shared import drop_written, map_arrow, packed, table, written, written_so_far

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 6
BLOCK = 512  # nodes of a bucket compared in one task with as many others, by shingles
WIDE, BITS = 4096, 2048  # the same by sketches alone, and the registers of those
NEAR = THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / (BANDS * ROWS)) ** 0.5
NEAR_BITS = THRESHOLD - 10 * ((1 + THRESHOLD) / 2 * (1 - THRESHOLD) / 2 / BITS) ** 0.5  # bits agree by chance half the time
BATCH = 128  # texts sketched together
CHARS = 1 << 20  # or as many characters
WORD_CACHE = 500_000

_U = np.uint64
_word = re.compile(r"[^\x20\x09-\x0D]+").findall


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finalizer of SplitMix64)."""
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def words_of(text: str | None) -> list[str]:
    return _word(text or "")


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_hashes) > WORD_CACHE:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and how often each occurs."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = min(size, n)
    z = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        z = _mix(z * _U(0x9E3779B97F4A7C15) + hashes[k : n - size + 1 + k])
    return np.unique(z, return_counts=True)


def node_of(hashes: np.ndarray) -> bytes:
    """128 bits for a word sequence."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sketch(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = BANDS * ROWS) -> np.ndarray:
    """The shingle in each register, for each weighted set; sets must not be empty."""
    count = len(sets)
    clock = np.full(count * registers, np.inf)
    value = np.zeros(count * registers, np.uint64)
    doc = np.repeat(np.arange(count), [len(h) for h, _ in sets])
    h = np.concatenate([h for h, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(float)
    now, step = np.zeros(len(h)), 0
    while len(h):
        many = max(1, min(64, 8192 // len(h)))  # arrivals made at once
        seeds = _mix(h[:, None] + np.arange(step + 1, step + many + 1, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
        step += many
        gaps = -np.log(((seeds >> _U(11)).astype(float) + 0.5) * 2.0**-53) / weight[:, None]
        at = now[:, None] + np.cumsum(gaps, axis=1)
        register = ((_mix(seeds) >> _U(32)) * _U(registers) >> _U(32)).astype(np.int64)
        place, times = (doc[:, None] * registers + register).ravel(), at.ravel()
        np.minimum.at(clock, place, times)
        first = times == clock[place]
        value[place[first]] = np.repeat(h, many)[first]
        now = at[:, -1]
        last = clock.reshape(count, registers).max(axis=1)
        alive = now < last[doc]
        doc, h, weight, now = doc[alive], h[alive], weight[alive], now[alive]
    return value.reshape(count, registers)


def bands_of(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = values.reshape(len(values), bands, rows)
    z = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(values), bands)).copy()
    for k in range(rows):
        z = _mix(z * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return z.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets, in n log n."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])] = a[1]
    y[np.searchsorted(keys, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    both = (x > 0) & (y > 0)
    t = ratio[both]
    upto = np.searchsorted(ratio, t, side="right")
    sum_x, sum_y = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    return float(np.sum(x[both] / (sum_x[upto] + (sum_y[-1] - sum_y[upto]) / t)))


def _texts(batches: Iterator[pa.RecordBatch], columns: list[str], text: str) -> Iterator[tuple[list, list[str]]]:
    """Rows in portions of BATCH texts or CHARS characters: the other columns' values, and the texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist()
        start, total = 0, 0
        for k, size in enumerate([*sizes, None]):
            total += size or 0
            if size is None or k - start >= BATCH or total > CHARS and k > start:
                if k > start:
                    part = batch.slice(start, k - start)
                    yield [part.column(c) for c in columns], part.column(text).to_pylist()
                start, total = k, size or 0


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node, bands (empty if the text has no words), mini (a byte of each register) for each row; texts
    are not shuffled."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, text_hash), texts in _texts(batches, ["doc_id", "text_hash"], "text"):
            hashes = [word_hashes(words_of(t)) for t in texts]
            full = [k for k, x in enumerate(hashes) if len(x)]
            bands: list = [[]] * len(texts)
            mini = [b""] * len(texts)
            if full:
                values = sketch([shingles(hashes[k]) for k in full])
                for k, row, small in zip(full, bands_of(values), (values & _U(255)).astype(np.uint8), strict=True):
                    bands[k], mini[k] = row, small.tobytes()
            columns = [ids, text_hash, pa.array([node_of(x) for x in hashes], pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(mini, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "bands", "mini"])

    return map_arrow(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, node binary, bands array<long>, mini binary")


def weighted_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, hashes, weights (as bytes) for the given nodes (node, doc_id, text_hash of one of its documents)."""
    wanted = nodes.select(F.col("doc_id").alias("_dup_id"), F.col("text_hash").alias("_dup_hash"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    rows = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["_dup_id"]) & (rows["text_hash"] == wanted["_dup_hash"]), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches, [], "text"):
            out = []
            for t in texts:
                h = word_hashes(words_of(t))
                keys, counts = shingles(h)
                out.append({"node": node_of(h), "hashes": keys.tobytes(), "weights": counts.astype(np.int32).tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("node", pa.binary()), ("hashes", pa.binary()), ("weights", pa.binary())]))

    # a document that stands in the table more than once comes more than once
    return map_arrow(rows.select("text"), run, "node binary, hashes binary, weights binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) that are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"), F.col("weights").alias("wa"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"), F.col("weights").alias("wb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch.column(c) for c in ("ha", "wa", "hb", "wb")]
            keep = []
            for k in range(batch.num_rows):
                ha, wa, hb, wb = (np.frombuffer(p[k].as_buffer(), d) for p, d in zip(parts, (np.uint64, np.int32, np.uint64, np.int32), strict=True))
                keep.append(similarity((ha, wa), (hb, wb)) >= threshold - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "wa", "hb", "wb"), run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) for the nodes of links (a, b), by alternating large and small stars.

    A star's hub is a key of a join only, so hubs with very many neighbours can be split. Each round is written down.
    """
    spark, mark = links.sparkSession, written_so_far()
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    told = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "links")
        drop_written(spark, mark, keep=edges)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == told or not now[0]:
            break
        told = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _block_links(key: int, within: bool, side: np.ndarray, comp: np.ndarray, mini: np.ndarray, keys: np.ndarray, sets: list) -> list[tuple[int, int]]:
    """Links that connect components of one pair of blocks (within: of one block), best first; see the module."""
    n = len(comp)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for first in {c: k for k, c in reversed(list(enumerate(comp)))}.values():
        for k in np.flatnonzero(comp == comp[first]):
            parent[k] = first
    near = []
    for i in range(n):
        others = np.arange(i + 1, n) if within else np.flatnonzero(side > side[i])
        others = others[comp[others] != comp[i]]
        if len(others):
            alike = (mini[others] == mini[i]).mean(axis=1)
            others, alike = others[alike >= NEAR], alike[alike >= NEAR]
            shared = keys[others] == keys[i]
            here = keys[i][shared.argmax(axis=1)] == key  # their first shared bucket is this one
            near += [(-a, i, int(k)) for a, k in zip(alike[here], others[here], strict=True)]
    links = []
    for _, i, k in sorted(near):
        if find(i) != find(k) and similarity(sets[i], sets[k]) >= THRESHOLD - 1e-9:
            parent[find(i)] = find(k)
            links.append((i, k))
    return links


def _live(entries: DataFrame) -> DataFrame:
    """The entries (key, node, comp) of buckets that hold more than one component, with n, the bucket's nodes."""
    live = entries.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    return entries.join(live.select("key", "n"), "key")


def _in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows (key, node, n, ..) once for each pair of blocks of their bucket: adds block, first and second."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumns({"first": F.least("block", "_other"), "second": F.greatest("block", "_other")}).drop("_other", "n")


def bit_sketches(sets: DataFrame) -> DataFrame:
    """node, bits: one bit of each of BITS registers, for sets (node, hashes, weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                given = [(np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(w.as_buffer(), np.int32)) for h, w in zip(part.column("hashes"), part.column("weights"), strict=True)]
                bits = np.packbits((sketch(given, BITS) & _U(1)).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([x.tobytes() for x in bits], pa.binary())], names=["node", "bits"])

    return map_arrow(sets.select("node", "hashes", "weights"), run, "node binary, bits binary")


def _near_rows(within: bool, side: np.ndarray, comp: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which rows are near, by sketches, a row of another component (and of the other block, unless within one)."""
    found = np.zeros(len(comp), bool)
    left = np.arange(len(comp)) if within else np.flatnonzero(side == side.min())
    right = left if within else np.flatnonzero(side != side.min())
    most = (1 - NEAR_BITS) / 2 * bits.shape[1] * 64  # bits that differ
    columns = np.ascontiguousarray(bits[right])
    for k, i in enumerate(left):
        start = k + 1 if within else 0
        others = right[start:]
        hit = (np.bitwise_count(columns[start:] ^ bits[i]).sum(axis=1, dtype=np.int64) <= most) & (comp[others] != comp[i])
        if hit.any():
            found[i] = True
            found[others[hit]] = True
    return found


def near_entries(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """Of entries (key, node, comp) those of nodes that are near a node of another component in the same bucket, by
    sketches alone; sets: node, hashes, weights."""
    live = written(_live(entries), "large-buckets")
    bits = written(bit_sketches(sets.join(live.select("node").distinct(), "node")), "bits")
    rows = _in_blocks(live, WIDE).join(bits, "node").select("key", "node", "comp", "bits", "block", "first", "second")

    def run(t: pa.Table) -> pa.Table:
        nodes, keys = t.column("node").combine_chunks(), t.column("key").combine_chunks()
        comp = t.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(nodes), -1)
        within = t.column("first")[0] == t.column("second")[0]
        found = pa.array(_near_rows(within, t.column("block").to_numpy(), comp, bits))
        return pa.table({"key": keys.filter(found), "node": nodes.filter(found)})

    ship(entries.sparkSession)
    near = rows.groupBy("key", "first", "second").applyInArrow(run, "key long, node binary").distinct()
    return entries.join(near, ["key", "node"], "left_semi")


def block_links(entries: DataFrame, payload: DataFrame) -> DataFrame:
    """a, b: links between components inside buckets. entries: key, node, comp; payload: node, mini, bands, hashes, weights."""
    live = _live(entries)
    few = live.where(F.col("n") <= BLOCK)
    many = written(near_entries(live.where(F.col("n") > BLOCK).select("key", "node", "comp"), payload), "near")
    rows = _in_blocks(few.unionByName(_live(many)), BLOCK).join(payload, "node")

    def run(t: pa.Table) -> pa.Table:
        column = {c: t.column(c).combine_chunks() for c in t.column_names}
        nodes = column["node"].to_pylist()
        order = sorted(range(len(nodes)), key=nodes.__getitem__)
        nodes = [nodes[k] for k in order]
        values = {c: [column[c][k].as_py() for k in order] for c in ("comp", "block", "mini", "hashes", "weights")}
        comp = np.unique(np.array([c.hex() for c in values["comp"]]), return_inverse=True)[1]
        mini = np.frombuffer(b"".join(values["mini"]), np.uint8).reshape(len(nodes), -1)
        keys = column["bands"].flatten().to_numpy().reshape(len(nodes), -1)[order]
        sets = [(np.frombuffer(h, np.uint64), np.frombuffer(w, np.int32)) for h, w in zip(values["hashes"], values["weights"], strict=True)]
        within = column["first"][0] == column["second"][0]
        links = _block_links(column["key"][0].as_py(), within, np.array(values["block"]), comp, mini, keys, sets)
        return pa.table({"a": pa.array([nodes[i] for i, _ in links], pa.binary()), "b": pa.array([nodes[k] for _, k in links], pa.binary())})

    ship(entries.sparkSession)
    return rows.groupBy("key", "first", "second").applyInArrow(run, "a binary, b binary")


def node_components(docs: DataFrame, known: DataFrame) -> DataFrame | None:
    """node, comp, n_links (the verified links that decided its component) for all nodes that have a link; None if there
    is none. known: sketches()."""
    mark = written_so_far()
    # one document of each node; the struct's order makes the choice the same in every attempt
    nodes = known.where(F.size("bands") > 0).groupBy("node").agg(F.min(F.struct("doc_id", "text_hash", "bands", "mini")).alias("d"))
    nodes = written(nodes.select("node", "d.*"), "nodes")
    entries = nodes.select("node", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where("n > 1")
    entries = written(entries.join(shared, "key").select("key", "node", "pivot"), "buckets")
    if entries.isEmpty():
        return None
    found = nodes.join(entries.select("node").distinct(), "node")
    sets = written(weighted_sets(docs, found), "sets")
    rest = entries.where("node <> pivot")
    links = written(verified(rest.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), sets), "verified")
    rest = rest.select("key", "node")
    if links.isEmpty():
        rest = rest.withColumn("comp", F.col("node"))
    else:
        rest = rest.join(written(components(links), "comps"), "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    payload = nodes.join(sets, "node").select("node", "mini", "bands", "hashes", "weights")
    links = links.unionByName(written(block_links(rest, payload), "block-links"))
    ended = None
    if not links.isEmpty():
        ends = links.distinct().select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
        ended = written(components(links).join(ends, "node"), "comps")
    drop_written(docs.sparkSession, mark, keep=ended)
    return ended


def memberships(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node, n_links, class_id (the smallest doc_id of the class), class_size, first (the row that
    stands for the class) for each row of docs (doc_id, text)."""
    known = written(sketches(docs), "sketches")
    comps = node_components(docs, known)
    rows = known.select("doc_id", "text_hash", "node")
    none = F.lit(0).cast("long")
    if comps is None:
        rows = rows.withColumns({"comp": F.col("node"), "n_links": none})
    else:
        rows = rows.join(comps, "node", "left").withColumns({"comp": F.coalesce("comp", "node"), "n_links": F.coalesce("n_links", none)})
    least = rows.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(least, "comp")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, n_links for each row. n_links: with how many other word sequences the search verified
    a link for the row's own before they were in one class; 0 if the class is copies of one sequence."""
    return memberships(docs).select("doc_id", "class_id", "class_size", "n_links")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each class: that with the smallest doc_id."""
    members = memberships(docs.select("doc_id", "text"))
    first = members.where(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    first = first.groupBy(F.col("doc_id").alias("_dup_id"), F.col("text_hash").alias("_dup_hash")).agg(F.count(F.lit(1)).alias("_dup_rows"))
    first = written(first, "first")
    rows = packed(docs, _id="doc_id", _text=F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = rows.join(first, rows["_id"].eqNullSafe(first["_dup_id"]) & (rows["_text"] == first["_dup_hash"]))
    once = kept.where("_dup_rows = 1").select("_row")
    more = kept.where("_dup_rows > 1").dropDuplicates(["_dup_id", "_dup_hash"]).select("_row")
    return once.unionByName(more).select("_row.*")


def op10_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
