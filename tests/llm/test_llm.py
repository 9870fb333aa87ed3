"""The training-data operators against brute force, exact round trips and held-out accuracy, with awkward rows."""

import base64
import bisect
import glob
import hashlib
import random
import zlib
from collections import Counter, defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, same
from veridoc.llm import bpe, catalog, chat, gam, minhash, mixing, qalsh, ring, rules, urls, warc
from veridoc.llm.shared import fresh_path

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
#: Nulls, empty and very long texts, repeated rows, a repeated id, extra columns with names that operators use.
AWKWARD = [
    (1, "a b c d e f g", "en", "src1"), (1, "a b c d e f g", "en", "src1"), (2, None, None, None), (3, "", "de", "src2"), (4, LONG, "fr", "src3"),
    (None, "null id text here", "en", "src1"), (5, "x", "en", "src1"), (6, "a b c d e f g", "en", "src9"), (1, "other text of the same id", "en", "src1"), (7, " \n\t ", "es", None),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def docs_of(spark, rows):
    found = spark.createDataFrame(rows, SCHEMA)
    return found.withColumns({"score": F.lit("mine"), "n_words": F.lit(-1), "kept": F.lit("mine"), "ids": F.lit("mine")})


@pytest.fixture(scope="module")
def awkward(spark):
    return docs_of(spark, AWKWARD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, con, name):
    same(catalog.QUERIES[name](spark, FOLDER), con, catalog.ORACLE[name])


# --- 1: classifier ------------------------------------------------------------------------------------------------


def test_gam_held_out_accuracy(spark):
    found = gam.op1_gam_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.quality).mean() > 0.9
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id)


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    shuffled = rng.permutation(2000)
    assert np.array_equal(gam.fit(x[shuffled], y[shuffled]).score(x[:9]), model.score(x[:9]))


def plain_boosting(x, y, asked, rounds, pair_rounds, most_pairs):
    """The same model by plain loops over rows and cuts: cyclic three-leaf trees, then trees of two features."""
    import math

    n, width = len(x), len(x[0])
    cut = lambda f, bins: sorted(set(np.quantile([r[f] for r in x], np.linspace(0, 1, bins + 1)[1:-1]).tolist()))
    fine, coarse = [cut(f, gam.BINS) for f in range(width)], [cut(f, gam.PAIR_BINS) for f in range(width)]
    place = lambda edges, v: sum(v >= e for e in edges)
    bins = [[place(fine[f], r[f]) for f in range(width)] for r in x]
    low = [[place(coarse[f], r[f]) for f in range(width)] for r in x]
    base = math.log((sum(y) + 1) / (n - sum(y) + 1))
    tables = [[0.0] * (len(e) + 1) for e in fine]
    pairs = {}

    def total(b, c):
        return base + sum(t[b[f]] for f, t in enumerate(tables)) + sum(t[c[f]][c[g]] for (f, g), t in pairs.items())

    def slopes():
        p = [1 / (1 + math.exp(-total(b, c))) for b, c in zip(bins, low)]
        return [(yi - pi, max(pi * (1 - pi), 1e-6)) for yi, pi in zip(y, p)]

    gain = lambda part: sum(g for g, _ in part) ** 2 / (sum(h for _, h in part) + gam.RIDGE)
    mean = lambda part: sum(g for g, _ in part) / (sum(h for _, h in part) + gam.RIDGE)
    heavy = lambda part: sum(h for _, h in part) >= gam.LEAST / 4

    def best_cut(rows, lo, hi):
        """rows: (bin, slope). The gain and the first bin of the right side; no cut: 0."""
        found = (0.0, 0)
        for k in range(lo + 1, hi):
            left, right = [s for b, s in rows if b < k], [s for b, s in rows if b >= k]
            more = gain(left) + gain(right) - gain(left + right)
            if heavy(left) and heavy(right) and more > found[0] + 1e-13 and more > 1e-12:
                found = (more, k)
        return found

    for _ in range(rounds):
        for f in range(width):
            rows = [(b[f], s) for b, s in zip(bins, slopes())]
            parts = [(0, len(tables[f]))]
            while len(parts) < gam.LEAVES:
                options = [(*best_cut([r for r in rows if lo <= r[0] < hi], lo, hi), -k) for k, (lo, hi) in enumerate(parts)]
                more, k, at = max(options)
                if not k:
                    break
                lo, hi = parts[-at]
                parts[-at : 1 - at] = [(lo, k), (k, hi)]
            for lo, hi in parts:
                step = gam.RATE * mean([s for b, s in rows if lo <= b < hi])
                tables[f][lo:hi] = [v + step for v in tables[f][lo:hi]]

    def pair_tree(a, b):
        rows, wide, high = [((c[a], c[b]), s) for c, s in zip(low, slopes())], len(coarse[a]) + 1, len(coarse[b]) + 1
        top, found = 0.0, [[0.0] * high for _ in range(wide)]
        for k in range(1, wide):
            value, score = [[0.0] * high for _ in range(wide)], 0.0
            for lo, hi in ((0, k), (k, wide)):
                side = [(c[1], s) for c, s in rows if lo <= c[0] < hi]
                more, at = best_cut(side, 0, high)
                score += more + gain([s for _, s in side])
                for first, last in ((0, at), (at, high)):
                    for i in range(lo, hi):
                        value[i][first:last] = [mean([s for j, s in side if first <= j < last])] * (last - first)
            if score > top:
                top, found = score, value
        return top - gain([s for _, s in rows]), found

    ranked = sorted((-pair_tree(a, b)[0], a, b) for a in range(width) for b in range(a + 1, width) if coarse[a] and coarse[b])
    for _, a, b in ranked[:most_pairs]:
        pairs[a, b] = [[0.0] * (len(coarse[b]) + 1) for _ in range(len(coarse[a]) + 1)]
    for _ in range(pair_rounds):
        for a, b in list(pairs):
            for i, row in enumerate(pair_tree(a, b)[1]):
                pairs[a, b][i] = [v + gam.RATE * w for v, w in zip(pairs[a, b][i], row)]
    return [1 / (1 + math.exp(-total([place(fine[f], r[f]) for f in range(width)], [place(coarse[f], r[f]) for f in range(width)]))) for r in asked]


def test_gam_equals_plain_boosting():
    rng = np.random.default_rng(5)
    x = np.round(rng.random((160, 3)), 2)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4) | (x[:, 2] > 0.9)).astype(float)
    asked = np.round(rng.random((40, 3)), 2)
    model = gam.fit(x, y, rounds=4, pair_rounds=3, pairs=2)
    want = plain_boosting(x.tolist(), y.tolist(), asked.tolist(), 4, 3, 2)
    assert len(model.pairs) == 2 and np.allclose(model.score(asked), want, atol=1e-9)


def test_gam_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (9, 1)], "doc_id long, quality int")
    model = gam.train(awkward, labels)
    found = gam.score(awkward, model).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r.score <= 1 and r.kept == "mine" for r in found)
    assert gam.score(empty, model).count() == 0
    none = gam.train(empty, labels.where("false"))
    assert {r.score for r in gam.score(awkward, none).collect()} == {0.5}


# --- 2: mixture ---------------------------------------------------------------------------------------------------


def test_mix_awkward(spark, awkward, empty):
    found = mixing.mix(awkward, share=1.0).collect()
    assert {r.kept for r in found} == {"mine"} and all(r._mix_epoch < mixing.MAX_EPOCHS for r in found)
    assert mixing.mix(empty).count() == 0
    pairs = Counter((r.doc_id, r.text, r._mix_epoch) for r in found)
    assert all(n == 2 for k, n in pairs.items() if k[1] == "a b c d e f g" and k[0] == 1)  # repeated rows stand together


def test_shortage_goes_to_siblings_first(spark):
    rows = [("domain0", "en", "a", 10), ("domain0", "en", "b", 1000), ("domain1", "en", "c", 1000)]
    leaves = spark.createDataFrame(rows, "_mix_domain string, _mix_lang string, _mix_source string, tokens long")
    weights = {"domain": {"domain0": 50, "domain1": 50}, "lang": {}, "source": {}}
    got = {r._mix_source: r.given for r in mixing.budgets(leaves, share=0.5, max_epochs=1, weights=weights).collect()}
    assert got == {"a": 10, "b": 492, "c": 502}


# --- 3: BPE -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers as P

    return bpe.Codec(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


def test_bpe_equals_tiktoken(codec):
    import public_tokenizers as P
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ids, special_tokens={})
    rng = random.Random(1)
    letters = "abcdeinorstz .,'\n  éß漢字🎉0123456789#"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(600)]
    texts += ["a" * 4000, " " * 4001, "ab" * 3000, "\n" * 700, "漢" * 300, "<|endoftext|>", LONG]
    for t in texts:
        ids = codec.encode(t)
        assert ids == other.encode_ordinary(t) and codec.decode(ids) == t.encode()


def test_bpe_awkward(spark, awkward, empty):
    import public_tokenizers as P

    run = lambda d: bpe.encode_documents(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for r in run(awkward).collect():
        assert len(r.ids) == r.n_tokens and r.kept == "mine"
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
    assert run(empty).count() == 0


# --- 4: WARC ------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/ x\n", "same"), (3, None, None), (4, "http://c/", ""), (5, "u", "é€"), (5, "u", "é€"), (None, "n", "same"), (6, "l", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("copy", F.lit("mine"))
    manifest = warc.write_deduplicated(pages, fresh_path(spark, "test-warc"))
    back = warc.resolve_revisits(warc.read_archives(manifest)).collect()
    assert len(back) == len(rows) and len({r.record_id for r in back}) == len(rows)
    text = defaultdict(list)
    for r in back:
        text[r.page_id].append(r)
    assert {k: sorted(x.record_type for x in v) for k, v in text.items()} == {1: ["revisit"], 2: ["response"], 3: ["revisit"], 4: ["response"], 5: ["response", "revisit"], None: ["revisit"], 6: ["response"]}
    assert text[1][0].refers_to == 2 and text[None][0].refers_to == 2 and text[3][0].refers_to == 4 and text[1][0].payload_bytes == 4
    assert bytes(text[2][0].payload) == b"same" and text[2][0].payload_digest == base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    assert bytes(text[6][0].payload).decode() == LONG
    small = warc.write_deduplicated(pages, fresh_path(spark, "test-warc"), min_payload=1)
    assert sum(r.record_type == "response" for r in warc.read_archives(small, ["record_type"]).collect()) == 5
    none = warc.write_deduplicated(pages.where("false"), fresh_path(spark, "test-warc"))
    assert warc.read_archives(none).count() == 0


def table_folder(tmp_path, df, name):
    df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def revisit_pages(spark):
    rows = [(i, f"http://h/{i % 9}", f"page {i % 11}" if i % 3 else "the one that a third has") for i in range(1, 300)]
    rows += [(500, "http://r/", "same row")] * 60 + [(None, "http://n/", "same row")] * 40 + [(None, f"http://n/{i}", None) for i in range(30)] + [(None, None, "no id, once")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_revisits_equal_sql(spark, tmp_path, monkeypatch):
    """One payload on a third of the pages, equal rows, null ids; copies are spelled out in several portions."""
    import duckdb

    monkeypatch.setattr(warc, "COPIES", 7)
    folder = table_folder(tmp_path, revisit_pages(spark), "pages")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    found = warc.op4_warc_revisits(spark, folder)
    same(found, con, warc.SQL)
    assert found.where("record_type = 'revisit'").count() > 300


def test_warc_moves_a_payload_once_for_each_task(spark, tmp_path):
    """One long payload on every page: what the writers get is one response and headers."""
    rows = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"), F.lit("x" * 10_000).alias("html"))
    manifest = warc.write_deduplicated(rows.repartition(4), fresh_path(spark, "test-warc"))
    back = warc.read_archives(manifest)
    assert Counter(r.record_type for r in back.collect()) == {"response": 1, "revisit": 1999} and len({r.record_id for r in back.collect()}) == 2000


def test_warc_rejects_damage():
    row = {"page_id": 1, "url": "u", "copy": 0, "payload": b"abc", "payload_digest": "A" * 32, "payload_bytes": 3, "record_type": "response", "refers_to": None, "refers_to_url": None}
    with pytest.raises(ValueError):
        warc.parse(warc.record(row))


# --- 5: neighbours ------------------------------------------------------------------------------------------------


def test_ann_recall(spark):
    folder = "/root/testdata/sf0.1"
    found = qalsh.op5_collision_counting_ann(spark, folder).toPandas()
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    v, ids = np.array(rows.embedding.tolist(), float), rows.vec_id.to_numpy()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
        best = [i for _, i in sorted((x, i) for x, i in zip(d, ids, strict=True) if i != q)[:10]]
        mine = found[found.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and np.allclose(mine.score, [d[ids == i][0] for i in mine.vec_id])
        hits, total = hits + len(set(best) & set(mine.vec_id)), total + 10
    assert hits / total >= 0.95


def test_ann_recall_over_blocks(spark, monkeypatch):
    """Five blocks: the queries meet all of them, each vector is in one."""
    monkeypatch.setattr(qalsh, "BLOCK", 400)
    test_ann_recall(spark)


def test_ann_verifies_few():
    import duckdb

    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet'").fetchall()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    index, asked = qalsh.Index(ids, v), np.flatnonzero(ids % 100 == 0)
    for q in asked:
        index.search(v[q], int(ids[q]))
    assert index.verified / len(asked) / len(ids) < 0.08


def test_ann_of_equal_vectors():
    """All equal, all but one equal, and tiny ones: few steps, all found."""
    import time

    began = time.time()
    v = np.full((3000, 8), 0.1)
    ids = np.arange(3000)
    assert list(qalsh.Index(ids, v).search(v[5], 5)[0]) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    v[7] = 5.0
    found, scores = qalsh.Index(ids, v).search(v[7], 7)
    assert list(found) == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10] and np.allclose(scores, 4.9 * 8**0.5)
    small = np.random.default_rng(1).standard_normal((50, 4)) * 1e-200
    assert len(qalsh.Index(np.arange(50), small).search(small[0], 0)[0]) == 10
    assert time.time() - began < 10


def test_ann_repeated_rows(spark):
    """A third of the rows are one vector under one id; another third is one vector under many ids."""
    rng = np.random.default_rng(3)
    rows = [(5, [1.0, 2.0, 3.0])] * 300 + [(1000 + i, [3.0, 2.0, 1.0]) for i in range(300)] + [(2000 + i, [float(x) for x in rng.standard_normal(3)]) for i in range(300)] + [(0, [1.0, 2.0, 3.5])]
    vectors = qalsh.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = qalsh.search(vectors, vectors.where("vec_id IN (0, 1000, 2000)").distinct()).orderBy("query_id", "rank").collect()
    got = defaultdict(list)
    for r in found:
        got[r.query_id].append((r.vec_id, r.score))
    assert got[0] == [(5, 0.5)] * 10 and got[1000] == [(1001 + i, 0.0) for i in range(10)]
    x = np.array(rows[600][1])
    brute = sorted((float(np.sqrt(((np.array(v) - x) ** 2).sum())), i) for i, v in rows if i != 2000)[:10]
    assert len(got[2000]) == 10 and got[2000][0] == (brute[0][1], pytest.approx(brute[0][0]))


def test_ann_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]), (8, [inf, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [2.0, 0.0]), (200, [1e9, 1e9])]
    vectors = qalsh.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    asks = vectors.where("vec_id % 100 = 0").groupBy("vec_id").agg(F.min("v").alias("v"))
    got = defaultdict(list)
    for r in qalsh.search(vectors, asks).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 6)))
    assert got[0][:2] == [(1, 0.0), (2, 0.0)] and got[0][2] == (None, 1.0) and len(got[0]) == 5
    assert len(got[100]) == 6 and len(got[200]) == 6
    assert qalsh.search(vectors.where("false"), asks.where("false")).count() == 0


# --- 6: URL lists -------------------------------------------------------------------------------------------------


def test_url_lists(spark):
    day = lambda x: F.to_date(F.lit(x))
    captures = [(1, "http://www.a.com/x/1", "2024-01-05"), (2, "http://www.a.com/x/1", "2024-01-15"), (3, "https://user@A.com:80/", "2024-01-10"), (4, None, "2024-01-05"), (5, "no url", None), (6, "http://b.com/bad/page", "2024-01-05"), (6, "http://b.com/bad/page", "2024-01-05"), (7, "http://ba.com/", "2024-01-05")]
    entries = [("l", "a.com", "2024-01-01", "add"), ("l", "a.com", "2024-01-10", "remove"), ("l", "a.com", "2024-01-01", "add"), ("m", "b.com/bad", "2024-01-05", "add"), ("m", "c.com", None, "add")]
    cast = lambda rows, schema, c: spark.createDataFrame(rows, schema).withColumn(c, F.col(c).cast("date"))
    c, e = cast(captures, "page_id int, url string, fetched string", "fetched"), cast(entries, "list string, pattern string, day string, action string", "day")
    got = [(r.page_id, r.blocked, r.lists, r.longest) for r in urls.judge(c, e).orderBy("page_id").collect()]
    assert got == [(1, True, "l", "a.com"), (2, False, "", None), (3, False, "", None), (4, False, "", None), (5, False, "", None), (6, True, "m", "b.com/bad"), (6, True, "m", "b.com/bad"), (7, False, "", None)]
    assert urls.judge(c, e.where("false")).where("blocked").count() == 0 and urls.judge(c.where("false"), e).count() == 0
    assert day is not None


def url_verdicts(captures, entries):
    """Every capture against every entry, by another way of reading URLs."""
    from datetime import date
    from urllib.parse import urlsplit

    def parts(text):
        u = urlsplit(text)
        host = (u.netloc.rpartition("@")[2].lower() + "]").split("]")[0] + "]" if "[" in u.netloc else u.netloc.rpartition("@")[2].lower().partition(":")[0]
        return host.strip("."), u.path.rstrip("/")

    log = defaultdict(set)
    for name, pattern, day, action in entries:
        if pattern is not None and day is not None:
            plain = pattern if "://" in pattern else f"x://{pattern}"
            host, path = parts(plain.replace("://*.", "://"))
            if host:
                log[name, host, path].add((date.fromisoformat(day), action != "remove", action))
    out = []
    for page, url, day in captures:
        hits = []
        host, path = parts(url) if url and "://" in url else ("", "")
        numeric = host.startswith("[") or all(x.isdigit() for x in host.split("."))
        for (name, h, p), events in log.items():
            if not host or day is None or not (host == h or not p and not numeric and host.endswith("." + h)) or not (not p or path == p or path.startswith(p + "/")):
                continue
            now = [e for e in sorted(events) if e[0] <= date.fromisoformat(day)]
            if now and now[-1][2] == "add":
                hits.append((len(h + p), h + p, name))
        out.append((page, url, day, len(hits), ",".join(sorted({x[2] for x in hits})), max(hits)[1] if hits else None))
    return out


def test_url_lists_equal_brute_force(spark):
    rng = random.Random(6)
    hosts = ["a.com", "www.A.com", "b.a.com.", "ba.com", "9.1.2.3", "2.3", "1.9.1.2.3", "[::1]", "x.Co.uk", "user:pw@a.com:8080", "com", "a"]
    paths = ["", "/", "/Bad", "/bad", "/bad/x", "/Bad/x/", "/bad/x/y?q=1", "/b%20d#f", "/badly", "//bad", "?x=/bad"]
    day = lambda: f"2024-01-{rng.randint(1, 28):02d}"
    captures = [(i, f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(paths)}", day()) for i in range(400)]
    captures += [(None, "http://a.com/bad", day()), (1, None, day()), (2, "http://a.com/", None), (3, "no url", day()), (4, "http:///path", day()), (5, "", day())] + captures[:20]
    entries = [(rng.choice("lm"), rng.choice(["", "", "", "http://", "*."]) + rng.choice(hosts) + rng.choice(paths[:9]), day(), rng.choice(["add", "add", "remove"])) for _ in range(150)]
    entries += [("l", None, day(), "add"), ("l", "a.com", None, "add"), ("l", "", day(), "add"), ("l", "/bad", day(), "add")] + entries[:10]
    c = spark.createDataFrame(captures, "page_id int, url string, day string").select("page_id", "url", F.col("day").cast("date").alias("fetched"), F.lit(1).alias("host"))
    e = spark.createDataFrame(entries, "list string, pattern string, day string, action string").withColumn("day", F.col("day").cast("date"))
    got = Counter((r.page_id, r.url, r.fetched and str(r.fetched), r.n_active, r.lists, r.longest) for r in urls.judge(c, e).collect())
    assert got == Counter(url_verdicts(captures, entries)) and sum(n for k, n in got.items() if k[3]) > 100


# --- 7: ring ------------------------------------------------------------------------------------------------------


def test_ring_equals_walk(spark):
    found = ring.op7_ring_bounded_load(spark, FOLDER).toPandas()
    at = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    nodes = sorted((at(f"node:{i}"), i // ring.VNODES) for i in range(ring.SHARDS * ring.VNODES))
    rows = sorted((at(str(i)), i) for i in found.doc_id)
    room = [len(rows) // 40 + (s < len(rows) % 40) for s in range(40)]
    used, arcs, queue, want = [0] * 40, [[] for _ in range(len(nodes) + 1)], deque(), {}
    for h, i in rows:
        arcs[bisect.bisect_left([a for a, _ in nodes], h)].append(i)
    owners = [s for _, s in nodes] + [nodes[0][1]]
    for turn in range(2):
        for k, s in enumerate(owners):
            queue.extend(arcs[k] if not turn else [])
            while queue and used[s] < room[s]:
                want[queue.popleft()] = (s, used[s])
                used[s] += 1
    assert {i: (s, k) for i, s, k in zip(found.doc_id, found["shard"], found.slot, strict=True)} == want


def test_ring_awkward(spark, monkeypatch):
    monkeypatch.setattr(ring, "COPIES", 4)
    rows = spark.createDataFrame([(1, 5, 7)] * 30 + [(None, 5, 7)] * 3 + [(2, 9, 9)], "doc_id long, size long, text_crc32 long")
    found = ring.assign(rows, shards=4, vnodes=8).collect()
    sizes = Counter(r.shard for r in found)
    assert len(found) == 34 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == {(1, 5, 7): 30, (None, 5, 7): 3, (2, 9, 9): 1}
    assert ring.assign(rows.where("false"), shards=4, vnodes=8).count() == 0


def test_ring_equals_sql_on_awkward_tables(spark, tmp_path):
    """Null and repeated ids, repeated rows, a third of the rows alike, null and empty texts."""
    import duckdb

    rows = [(i, f"text {i}", None, None) for i in range(60)] + [(7, f"é {i}", None, None) for i in range(40)] + [(None, f"no id {i % 9}", None, None) for i in range(50)] + [(8, "the same", None, None)] * 70 + [r for r in AWKWARD if r[1] != LONG]
    folder = table_folder(tmp_path, spark.createDataFrame(rows, SCHEMA), "documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    same(ring.op7_ring_bounded_load(spark, folder), con, ring.SQL)


def test_ring_spreads_rows_without_an_id_of_their_own(spark):
    """Half of the rows have no id and a quarter share one: no task gets more than a few arcs' rows."""
    n = 20_000
    rows = spark.range(n).select(F.expr("CASE WHEN id % 2 = 0 THEN NULL WHEN id % 4 = 1 THEN 7 ELSE id END").alias("doc_id"), F.lit(20).cast("long").alias("size"), F.crc32(F.col("id").cast("string")).alias("text_crc32"))
    seen = []
    keep, ring.written = ring.written, lambda df, what: seen.append((what, keep(df, what))) or seen[-1][1]
    try:
        found = ring.assign(rows).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    finally:
        ring.written = keep
    numbered = dict(seen)["ring-rows"]
    assert numbered.groupBy("_arc").count().agg(F.max("count")).first()[0] < n / 100
    assert len(found) == 40 and all(r.n == n // 40 == r.d == r.m + 1 for r in found)


def test_ring_moves_few_rows(spark):
    """One more shard takes about a 41st of the rows; few others move, as all shards stay full to the mean."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(20).cast("long").alias("size"), F.col("id").alias("text_crc32"))
    before, after = (ring.assign(rows, shards=k).select("doc_id", F.col("shard").alias(f"s{k}")) for k in (40, 41))
    both = before.join(after, "doc_id")
    assert both.where("s41 = 40").count() / 20_000 < 0.026 and both.where("s40 <> s41 AND s41 <> 40").count() / 20_000 < 0.04


# --- 8: rules -----------------------------------------------------------------------------------------------------


def test_rules_keep_clean_and_drop_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    found = rules.score_rules(docs).select("quality", "_rules.*").toPandas()
    judged = found[~found.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.99 and judged[judged.quality == 0].kept.mean() < 0.1


def test_rules_awkward(spark, awkward, empty):
    found = rules.score_rules(awkward).collect()
    assert len(found) == len(AWKWARD) and all(r.kept == "mine" and r.n_words == -1 for r in found)
    by_id = {r.doc_id: r._rules for r in found}
    assert by_id[2].n_words == by_id[3].n_words == by_id[7].n_words == 0 and by_id[2].base_failed and not by_id[2].kept
    assert by_id[4].n_words == 30_000 and by_id[4].n_repeat_words == 0 and by_id[4].kept
    assert rules.score_rules(empty).count() == 0


def votes_of(spark, groups):
    """Documents of the label model: (names of the rules that vote bad, all others good; fails the base rule; how many)."""
    code = lambda names: sum((rules.BAD if r in names else rules.GOOD) * 3 ** (len(rules.RULES) - 1 - i) for i, r in enumerate(rules.RULES))
    rows = spark.createDataFrame([(code(names), failed, n) for names, failed, n in groups], "code int, base_failed boolean, n int")
    return rows.select(F.struct("code", "base_failed").alias("_rules"), F.explode(F.sequence(F.lit(1), F.col("n")))).select("_rules"), code


@pytest.mark.parametrize("share", [0.1, 0.2, 0.33])
@pytest.mark.parametrize(("hot", "failed"), [(("repeats", "variety"), True), (("lines", "repeats", "variety"), True), (("capitals",), False), (("capitals", "shouts"), False), (("lines", "capitals", "shouts"), False)])
def test_rules_hot_junk_does_not_hide_other_junk(spark, hot, failed, share):
    voted, code = votes_of(spark, [((), False, 7861), (("symbols",), False, 591), (("lines",), False, 63), (("capitals", "shouts"), False, 23), (hot, failed, int(9000 * share / (1 - share)))])
    found = {r.code: r.posterior for r in rules.label_model(voted).collect()}
    assert found[code(("symbols",))] < 0.5 and found[code(("lines",))] < 0.5 and found[code(hot)] < 0.5 <= found[code(())]


def test_repeat_words(spark):
    def brute(text):
        w = text.split(" ") if text else []
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        return len({i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)})

    rng = random.Random(2)
    texts = ["", "a", "a b", "a b c", "a a a a", "a b c a b c", "a b c d a b c"] + [" ".join(rng.choice("abcd") for _ in range(rng.randint(3, 60))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r._rules.n_repeat_words for r in rules.counts(rows).collect()}
    assert [got[i] for i in range(len(texts))] == [brute(t) for t in texts]


# --- 9: chat ------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "back\\slash <\\| \\\\<|", "", "a\nb\n", "<", "|", "\\", "<|im_end|>\n", LONG]
    turns = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hard)]
    turns += [(2, 0, "user", None), (2, 0, None, "x"), (3, 1, "odd\nrole\\<|", "t"), (None, None, "assistant", "n"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    made = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)))
    back = {r.conv_id: r for r in made.withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    examples = defaultdict(list)
    for r in chat.explode_examples(made).withColumn("said", chat.unescape(F.col("reply"))).orderBy("example").collect():
        examples[r.conv_id].append(r)
    for conv in (1, 2, 3, 4, None):
        want = sorted(((t, r or "", x or "") for c, t, r, x in turns if c == conv), key=lambda x: (x[0] is not None, x))
        assert [(t.role, t.text) for t in back[conv].turns] == [(r, x) for _, r, x in want]
        replies = [x for _, r, x in want if r == "assistant"]
        assert [e.said for e in examples[conv]] == (replies or [None]) and [e.example for e in examples[conv]] == (list(range(1, len(replies) + 1)) or [None])
    spelt = chat.spell_out(chat.explode_examples(made)).where("conv_id = 1").orderBy("example").collect()
    text = back[1].formatted
    assert len(spelt) == 4 and all(text.startswith(e.context + e.reply + chat.END) and text[e.loss_start : e.loss_end] == e.reply for e in spelt)
    assert [e.turn for e in spelt] == [1, 3, 5, 7] and all(e.context.endswith("<|im_start|>assistant\n") for e in spelt)
    assert chat.format_conversations(made.sparkSession.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_query_on_awkward_tables(spark, tmp_path):
    """Conversations without a reply, with null ids and texts, and one with a third of all rows, by a plain walk."""
    rows = [(i % 40, i, "assistant" if i % 2 else "user", f"text {i} <|im_end|>") for i in range(400)] + [(77, i, ("user", "assistant")[i % 2], f"é{i}\\") for i in range(200)]
    rows += [(50, 0, "user", "no reply"), (None, 0, "assistant", None), (51, None, None, None)]
    folder = table_folder(tmp_path, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(9)), "conversations")
    got = {r.conv_id: r for r in chat.op9_chat_prefix_target(spark, folder).collect()}
    rows += [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        mine = sorted(((t is not None, t or 0, a or "", x or "") for c, t, a, x in rows if c == conv))
        said = "".join(x for _, _, a, x in mine if a == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(mine), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for _, _, a, x in mine).encode()).hexdigest()


# --- 10: near-duplicates ------------------------------------------------------------------------------------------


def brute_classes(rows):
    sets = [minhash.shingles(minhash.word_hashes(minhash.words_of(t))) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if minhash.similarity(sets[a], sets[b]) >= minhash.THRESHOLD - 1e-9:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), str(least.get(find(k)))) for k, (i, _) in enumerate(rows))


def test_similarity_and_sketch():
    rng = np.random.default_rng(0)
    u = rng.integers(0, 2**63, 60).astype(np.uint64)
    for _ in range(4):
        a, b = ((np.unique(u[rng.random(60) < 0.8])) for _ in range(2))
        a, b = (a, rng.integers(1, 4, len(a))), (b, rng.integers(1, 4, len(b)))
        x, y = (dict(zip(s[0].tolist(), s[1].tolist(), strict=True)) for s in (a, b))
        want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x | y) for i in x.keys() & y.keys())
        assert minhash.similarity(a, b) == pytest.approx(want)
        s = minhash.sketch([a, b], 20_000)
        assert abs((s[0] == s[1]).mean() - want) < 0.02


def test_classes_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 60, 200]))]
        for _ in range(rng.choice([1, 2, 8])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((k, " ".join(copy)))
            k += 1
    rows += [(None, rows[0][1]), (900, None), (901, ""), (902, " \n"), (3, rows[3][1]), (903, LONG), (904, LONG + " end")]
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got.collect()) == brute_classes(rows)


def look_alikes(rng, n, shared, own, twins):
    """n texts of `shared` common words and `own` of their own, some with a twin that differs in one word."""
    base = [f"base{i}" for i in range(shared)]
    rows = []
    for i in range(n):
        text = base + [f"own{i}x{k}" for k in range(own)]
        rows.append(" ".join(text))
        if i < twins:
            text[rng.randrange(len(text))] = "changed"
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("wide", [16, 4096])
def test_classes_in_large_buckets_equal_brute_force(spark, monkeypatch, wide):
    """Look-alikes at 0.6 fill buckets of several blocks; only their twins are linked."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "WIDE", wide)
    rows = look_alikes(random.Random(9), 90, 75, 25, 30)
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == brute_classes(rows)
    assert Counter(r.class_size for r in got) == {1: 60, 2: 60} and all((r.n_links > 0) == (r.class_size > 1) for r in got)


def test_look_alikes_send_few_to_the_comparison(spark):
    """Of a bucket of look-alikes at 0.6, all of them beyond one block, only the twins are near by their sketches."""
    rows = look_alikes(random.Random(9), 1500, 75, 25, 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = minhash.sketches(docs).checkpoint()
    entries = known.select(F.lit(1).cast("long").alias("key"), "node", F.col("node").alias("comp"))
    near = {r.node for r in minhash.near_entries(entries, minhash.weighted_sets(docs, known)).collect()}
    twins = {r.node for r in known.collect() if any(0 < len(set(a.split()) ^ set(rows[r.doc_id][1].split())) <= 2 for _, a in rows)}
    assert twins <= near and len(near) <= len(twins) + 5


def test_deduplicated_awkward(spark, awkward, empty):
    found = minhash.deduplicated(awkward).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in found) == sorted([("1", "a b c d e f g"), ("2", ""), ("4", LONG), ("None", "null id text here"), ("5", "x"), ("1", "other text of the same id")])
    assert minhash.deduplicated(empty).count() == 0 and minhash.classes(empty).count() == 0


# --- the pipeline -------------------------------------------------------------------------------------------------

CLASHING = ["_rules", "_row", "score", "predicted", "_text", "_dup_id", "_dup_rows", "_mix_domain", "_mix_tokens", "_mix_epoch", "n_words", "_w", "copies"]


def stage_docs(spark, rows):
    found = spark.createDataFrame(rows, SCHEMA)
    return found.withColumns({"n_chars": F.length("text").cast("long"), **{c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING}})


@pytest.mark.parametrize("at", range(5))
def test_stages_on_awkward_and_empty_tables(spark, at):
    import corpus_pipeline as P

    name, stage = P.STAGES[at]
    docs = stage_docs(spark, AWKWARD)
    found = stage(spark, docs, FOLDER)
    last = at == len(P.STAGES) - 1
    assert found.columns == docs.columns if not last else set(docs.columns) - {"text"} <= set(found.columns)
    rows = found.collect()
    assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHING)
    given = Counter((r.doc_id, r.n_chars) for r in docs.collect())
    assert set(Counter((r.doc_id, r.n_chars) for r in rows)) <= set(given) and (not last or Counter((r.doc_id, r.n_chars) for r in rows) == given)
    none = stage(spark, docs.where("false"), FOLDER)
    assert none.count() == 0 and none.columns == found.columns


def brute_mixture(rows):
    """(doc_id, text) and how often each is taken, by budgets poured down the tree and a walk along each leaf's epochs."""
    import re as regular

    at = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    tokens = lambda t: len(regular.findall(r"[^\x20\x09-\x0D]+", t or ""))
    leaves = defaultdict(list)
    for i, text, lang, source in rows:
        number = regular.search("([0-9]{1,9})$", source or "")
        leaves["domain" + (str(int(number[1]) % 4) if number else "?"), lang or "", source or ""].append((i, text, tokens(text)))
    size = {k: sum(x[2] for x in v) for k, v in leaves.items()}

    def pour(budget, children, level):
        """Whole shares, again and again: a child that cannot take its share takes all it can and leaves the game."""
        weight = {c: mixing.WEIGHTS[level].get(c, mixing.DEFAULT_WEIGHT) for c in children}
        given, open_ = {}, dict(children)
        while open_:
            total = sum(weight[c] for c in open_)
            full = [c for c in open_ if open_[c] * total <= budget * weight[c]]
            if not full:
                return given | {c: budget * weight[c] // total for c in open_}
            for c in full:
                given[c] = open_.pop(c)
            budget = budget - sum(given[c] for c in full)
        return given

    cap = lambda test: sum(n * mixing.MAX_EPOCHS for k, n in size.items() if test(k))
    taken = Counter()
    domains = pour(int(sum(size.values()) * mixing.SHARE), {d: cap(lambda k: k[0] == d) for d in {k[0] for k in size}}, "domain")
    for d, budget in domains.items():
        for lang, below in pour(budget, {x: cap(lambda k: k[:2] == (d, x)) for x in {k[1] for k in size if k[0] == d}}, "lang").items():
            for source, tokens_of in pour(below, {x: cap(lambda k: k == (d, lang, x)) for x in {k[2] for k in size if k[:2] == (d, lang)}}, "source").items():
                leaf, total = leaves[d, lang, source], size[d, lang, source]
                if not total:
                    continue
                whole, rest = divmod(tokens_of, total)
                so_far = 0
                order = sorted(leaf, key=lambda x: (at(f"{mixing.SEED}:{whole}:{-1 if x[0] is None else x[0]}"), x[0] is not None, x[0] or 0))
                for i, text, n in order:
                    taken[i, text] += whole + (so_far < rest)
                    so_far += n
    return +taken


def test_pipeline(spark):
    import corpus_pipeline as P

    folder = FOLDER
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, made = docs.columns, {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, folder).checkpoint()
        made[name] = docs
        assert name == P.STAGES[-1][0] or docs.columns == columns
    ruled = made["quality_rules"].toPandas()
    judged = rules.op8_quality_rules(spark, folder).where("kept").toPandas()
    assert set(ruled.doc_id) == set(judged.doc_id)
    good = made["quality_classifier"].toPandas()
    assert set(good.doc_id) <= set(ruled.doc_id)
    kept = made["near_dedup"].toPandas()
    classes = defaultdict(list)
    for i, c in brute_classes(list(zip(good.doc_id, good.text, strict=True))):
        classes[c].append(i)
    assert {str(i) for i in kept.doc_id} == set(classes)
    x = gam.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    want = x.score(np.array([gam.features_of(t) for t in ruled.text])) >= gam.CUT
    assert set(good.doc_id) == set(ruled.doc_id[want])
    mixed, coded = made["source_mix"].toPandas(), made["byte_bpe"].toPandas()
    assert Counter(zip(mixed.doc_id, mixed.text, strict=True)) == brute_mixture(list(zip(kept.doc_id, kept.text, kept.lang, kept.source, strict=True)))
    assert len(coded) == len(mixed) and (coded.n_tokens == coded.ids.map(len)).all() and "text" not in coded.columns
    by_id = {r.doc_id: r.text for r in mixed.itertuples()}
    assert all(r.decoded_sha256 == hashlib.sha256(by_id[r.doc_id].encode()).hexdigest() for r in coded.itertuples())


def test_pipeline_removes_what_it_no_longer_reads(spark):
    import corpus_pipeline as P
    from veridoc.llm import shared

    mark = shared.written_so_far()
    assert P.run(spark, FOLDER).count() > 0
    assert sorted(x.rsplit("/", 1)[1].rsplit("-", 1)[0] for x in shared._written[mark:]) == ["pipeline-source_mix"]


def test_text_tables_are_held_in_small_portions(spark):
    import pyarrow.parquet as pq

    import corpus_pipeline as P
    from veridoc.llm import shared

    key, some = "spark.sql.parquet.columnarReaderBatchSize", random.Random(7)
    with shared.read_in_portions(spark, 300):
        assert spark.conf.get(key) == "300"
        with shared.read_in_portions(spark, 400):
            assert spark.conf.get(key) == "300"
        assert spark.conf.get(key) == "300"
    assert spark.conf.get(key, None) is None
    rows = [(i, some.randbytes(15_000).hex(" ", 3), "en", "src1") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert {r.doc_id for r in P.quality_rules(spark, docs, FOLDER).collect()} == set(range(400))
    path = next(x for x in reversed(shared._written) if "rule-votes" in x).removeprefix("file://")
    groups = [m.row_group(k).total_byte_size for p in sorted(glob.glob(f"{path}/*.parquet")) for m in [pq.ParquetFile(p).metadata] for k in range(m.num_row_groups)]
    assert sum(groups) > 3 * shared.TEXT_GROUP and max(groups) < 2 * shared.TEXT_GROUP
    assert spark.conf.get(key, None) is None
