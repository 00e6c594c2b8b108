"""Ranked search, fill-in-the-middle texts and near-duplicate vectors against brute force, odd rows included."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundwatch.llm import fill_in_middle, product_quantisation, ranked_search

from .conftest import TEXTS


def plain_terms(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def plain_search(docs, items, k):
    own = [(i, Counter(plain_terms(t))) for i, t in docs if plain_terms(t)]
    n, length, df = len(own), sum(sum(c.values()) for _, c in own), Counter(t for _, c in own for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(plain_terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, c in own:
            m = 10 + (90 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores)[:k])]
    return Counter(out)


ITEMS = [(1, "the quick brown fox"), (1, "RIVER bank"), (2, ""), (3, None), (None, "words text"), (4, "word1 word2 THE the"), (5, "nowhere"), (6, "日本語 ünïcödé x"), (7, "line a two 3")]


@pytest.mark.parametrize("width,size", [(1024, 1 << 23), (2, 1 << 23), (64, 300)])
def test_search_of_odd_rows(spark, odd, width, size):
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id bigint, text string, doc_id string, score int").repartition(2)
    got = ranked_search.ranked_search(odd, items, 3, width, size)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain_search(TEXTS, ITEMS, 3)


def test_search_of_many_documents(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{int(r.paretovariate(0.7)) % 700}" for _ in range(60_000)]
    docs = [(i // 2 if i % 50 == 0 else i, " ".join(words[i * 15 : i * 15 + r.randrange(1, 40)])) for i in range(3000)] + [(9000 + i, "w1 w2 w3 copies of one text") for i in range(900)]
    items = [(i, " ".join(r.choices(words, k=12))) for i in range(40)] + [(77, "w1 copies text")]
    found = ranked_search.ranked_search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6), spark.createDataFrame(items, "item_id bigint, text string"))
    assert Counter(map(tuple, found.collect())) == plain_search(docs, items, 10)


def test_search_in_small_blocks():
    """Blocks of a few documents and entries give the same best rows as one block."""
    import pyarrow as pa

    r = random.Random(3)
    numbers = {b"%d" % i: i for i in range(50)}
    queries = ranked_search.Batch([1, 2], [np.array(sorted(r.sample(range(50), 6))) for _ in range(2)], numbers, np.array([i % 7 for i in range(50)]), np.array([r.randrange(0, 900) for _ in range(50)]), 500, 9000)
    ids = [sorted(r.sample(range(50), r.randrange(0, 20))) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array([len(i) + 3 for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([[1 + k % 3 for k in i] for i in ids], pa.list_(pa.int32()))], names=["doc_id", "n", "ids", "times"])
    shared = type("B", (), {"value": queries})
    whole = list(ranked_search._searched(shared, 5, 7)(iter([batch])))[-1].to_pylist()
    for block, entries in ((7, 1 << 20), (4096, 30), (3, 10)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(ranked_search, "BLOCK", block)
            m.setattr(ranked_search, "ENTRIES", entries)
            assert list(ranked_search._searched(shared, 5, 7)(iter([batch.slice(0, 100), batch.slice(100)])))[-1].to_pylist() == whole


def test_search_of_nothing(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert ranked_search.ranked_search(none, items).count() == 0
    assert ranked_search.ranked_search(odd, items.filter("item_id = 2")).count() == 0
    assert ranked_search.ranked_search(odd, items.filter("false")).count() == 0


def plain_middle(doc_id, text, percent=50, spm=80):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, len(u), "plain", None, None, text
    return (doc_id, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (doc_id, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("percent,spm", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_fill_in_the_middle(spark, odd, none, percent, spm):
    r = random.Random(2)
    pieces = ["a", " ", "\n", "\t", "wörd", "𝔘𝔫𝔦", "$1", "\\", " ", "\x0b", "\x1c", "{2}", "é"]
    texts = TEXTS + [(100 + i, "".join(r.choices(pieces, k=r.randrange(12)))) for i in range(300)] + [(1, "x <P> y"), (2, "a<M>"), (3, "<S>"), (4, "< P>"), (7, "  x " * 200_000)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(texts[len(TEXTS) :], "doc_id bigint, text string"))
    made = fill_in_middle.transform(docs.withColumns({"n": F.lit("x"), "form": F.lit(1), "output": F.lit("o"), "_a": F.lit(3)}), percent=percent, spm_percent=spm)
    rows = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(x)[:6] for x in rows) == Counter(plain_middle(i, t, percent, spm) for i, t in texts)
    assert Counter((x.doc_id, x.back) for x in rows) == Counter((i, t or "") for i, t in texts)
    assert fill_in_middle.transform(none).count() == 0


def plain_links(rows, similarity=0.95):
    """Per row: links, component, kept; vectors of unequal length never link."""
    fine = lambda v: bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)
    own = [np.array(v, float) / max(map(abs, v)) if fine(v) else None for _, v in rows]
    own = [None if v is None else v / np.linalg.norm(v) for v in own]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    counts = [0] * len(rows)
    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if a is not None and b is not None and len(a) == len(b) and a @ b >= similarity:
                counts[i] += 1
                counts[j] += 1
                if rows[i][0] is not None and rows[j][0] is not None:
                    x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                    parent[y] = x
    return counts, [None if i is None else find(i) for i, _ in rows]


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 0.1]), (4, [0.0, 1.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [1.0, None]), (9, [inf, 1.0]), (10, [nan, 1.0]), (11, [1.0, 0.0, 0.0]), (12, [1e300, 1e299]),
            (13, [-1.0, 0.0]), (14, [1e-300, 0.0]), (15, [7.0]), (16, [8.0]), (17, [-1.0]), (20, [0.0, 1.0]), (21, [0.0, 2.0]), (21, [9.0]), (22, [-0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, kept string, n_links int").repartition(3)
    got = sorted(map(tuple, product_quantisation.near_duplicates(df).collect()))
    counts, roots = plain_links(rows)
    assert got == sorted((i, c, root, i == root) for (i, _), c, root in zip(rows, counts, roots))
    assert product_quantisation.near_duplicates(df.filter("false")).count() == 0
    assert [tuple(r) for r in product_quantisation.near_duplicates(df.filter("vec_id = 5")).collect()] == [(5, 0, 5, True)]
    named = spark.createDataFrame([(None, [1.0, 2.0]), (4, [1.0, 2.0]), (None, [5.0, -5.0]), (None, None)], "vec_id bigint, embedding array<float>")
    assert Counter(map(tuple, product_quantisation.near_duplicates(named).collect())) == Counter([(None, 1, 4, False), (4, 1, 4, True), (None, 0, None, False), (None, 0, None, False)])


def cloud(n, dim, seed):
    """Single vectors, groups around a similarity of 0.95, a tight group, and copies."""
    draw = np.random.default_rng(seed)
    x = [draw.normal(size=(n, dim))]
    for spread, size in [(0.1, 60), (0.2, 80), (0.23, 80), (0.03, 300), (0.0, 200)]:
        x.append(draw.normal(size=dim) + spread * draw.normal(size=(size, dim)))
    x = np.concatenate(x)
    return [(int(i), row.tolist()) for i, row in zip(draw.permutation(len(x)), x)]


@pytest.mark.parametrize("lists,piece", [(1, 4096), (12, 4096), (12, 64), (1, 100)])
def test_vectors_in_lists_and_pieces(spark, monkeypatch, lists, piece):
    rows = cloud(700, 16, 1)
    monkeypatch.setattr(product_quantisation, "PIECE", piece)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in product_quantisation.near_duplicates(df, lists=lists).collect()}
    counts, roots = plain_links(rows)
    want = {i: (c, root) for (i, _), c, root in zip(rows, counts, roots)}
    found, real = (sum(c for c, _ in x.values()) for x in (got, want))
    assert found >= 0.99 * real and all(got[i][0] <= want[i][0] for i in want)
    if lists == 1:
        assert got == want


def test_rows_handed_on_grow_with_the_group(spark, monkeypatch):
    """Counts and links of one dense group: at most one of each a member, whatever the pairs."""
    handed = []
    for n in (200, 400, 800):
        draw = np.random.default_rng(n)
        x = draw.normal(size=24) + 0.17 * draw.normal(size=(n, 24))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
        keyed = df.select(F.xxhash64("embedding").alias("k1"), F.lit(0).cast("bigint").alias("k2"), F.col("vec_id").alias("rep"), F.lit(1).cast("bigint").alias("weight"), F.col("embedding").alias("v"))
        handed.append(product_quantisation._links(keyed, 24, 0.95, 0.999, 1).count())
        assert handed[-1] <= 3 * n
