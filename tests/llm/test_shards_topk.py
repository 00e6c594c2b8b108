"""Shards and exact search against brute force, odd rows included."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fundwatch.llm import shards, topk
from fundwatch.llm.scratch import new_folder

from .conftest import TEXTS


def check_shards(rows, texts, n):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(n)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def loads(rows):
    out = Counter()
    for r in rows:
        out[r.shard] += r["size"]
    return out


@pytest.mark.parametrize("ranges", [1, 7, 384])
def test_shards_are_even_and_keep_groups(spark, ranges):
    r = random.Random(ranges)
    texts = [(i, "x" * r.randrange(300)) for i in range(3000)] + [(5000 + i, "a group of copies " * 4) for i in range(120)] + [(6000 + i, "hot copy " * 30) for i in range(1500)]
    rows = shards.assign(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5), 8, ranges).collect()
    check_shards(rows, texts, 8)
    sizes = loads(rows)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) < 0.04 * sum(sizes.values()) / 8
    of = {r.doc_id: r.shard for r in rows}
    assert len({of[5000 + i] for i in range(120)}) == 1 and len({of[6000 + i] for i in range(1500)}) > 1


def test_shards_of_odd_rows(odd, none):
    rows = shards.assign(odd, 3).collect()
    check_shards(rows, TEXTS, 3)
    assert shards.assign(none).count() == 0
    one = shards.assign(odd.filter("doc_id = 6"), 24).collect()
    assert [r.slot for r in one] == [0]


def test_write_shards(spark):
    docs = spark.createDataFrame([(i, f"text {i}", i % 3) for i in range(200)], "doc_id bigint, text string, shard int")
    folder = new_folder(spark, "shards")
    shards.write_shards(docs, folder, 4)
    got = spark.read.parquet(folder)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((i, f"text {i}") for i in range(200)) and got.select("shard").distinct().count() == 4


def plain_top(rows, step, k, scale=256):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and len(v) == 4:
            usable.setdefault(i, []).append([math.floor(scale * x) for x in v])
    out = []
    for q in sorted(usable):
        if q % step == 0:
            scores = sorted((-sum(a * b for a, b in zip(usable[q][0], v)), i) for i, vs in usable.items() if i != q for v in vs)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return out


@pytest.mark.parametrize("unit,first", [(2048, 4), (7, 1)])
def test_top_k_is_exact(spark, monkeypatch, unit, first):
    monkeypatch.setattr(topk, "UNIT", unit)
    monkeypatch.setattr(topk, "FIRST", first)
    r = random.Random(unit)
    rows = [(i, [r.gauss(0, 1) * (1 + i % 5) for _ in range(4)]) for i in range(400)] + [(400 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)] + [(500 + i, [3.0 + r.random() * 0.01, 0.0, 0.0, 0.0]) for i in range(60)]
    rows += [(600, None), (601, []), (602, [1.0, None, 0.0, 0.0]), (603, [float("nan")] * 4), (604, [float("inf"), 0.0, 0.0, 0.0]), (605, [1.0, 2.0]), (None, [1.0] * 4), (606, [0.0] * 4), (400, [0.5] * 4), (-20, [9.0, 9.0, -9.0, 0.1])]
    table = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id bigint, embedding array<double>, annulus bigint, query string")
    got = sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 20 == 0, 5).collect()))
    assert got == plain_top(rows, 20, 5)


def test_top_k_of_few_or_none(spark):
    rows = [(0, [1.0] * 4), (1, [2.0] * 4), (2, [3.0e6] * 4)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(table, F.col("vec_id") == 0, 5).collect())) == plain_top(rows, 3, 5)
    assert topk.top_k(table.filter("false"), F.lit(True)).count() == 0 and topk.top_k(table.filter("vec_id = 0"), F.lit(True)).count() == 0
    assert topk.top_k(table, F.lit(False)).count() == 0
