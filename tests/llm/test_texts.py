"""Language, quality, near duplicates, decontamination, licences and the pipeline on small and odd tables."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fundwatch.llm.ngrams import frequencies
from fundwatch.llm import components, decontaminate, language, licenses, minhash, quality, queries, simhash

from .conftest import TEXTS

SF = "/root/testdata/sf0.01"
minhash_filed = minhash._filed
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, n, words="alpha bravo carol delta echo fox golf hotel india juliet kilo lima mike".split()):
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(n))


def plain_fingerprint(text, k):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


# near duplicates

def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)] + [(7, 7), (8, None)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    known = [(a, b) for a, b in links if b is not None and a != b]
    assert got == plain_components({x for p in known for x in p}, known)


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("k", [3, 5])
def test_fingerprint(k):
    for _, text in TEXTS:
        if len(text or "") < 1000:
            assert simhash.fingerprint(text, k) == [plain_fingerprint(text, k)]


@pytest.mark.parametrize("distance", [0, 1, 3, 6])
def test_plan_keeps_the_pigeonhole(distance):
    sample = np.random.default_rng(distance).integers(0, 2**63, 200).astype(np.uint64)
    for total in (10, 10**5, 10**9):
        parts = simhash.plan(sample, total, distance)
        assert sum(t + 1 for _, t in parts) == distance + 1
        assert sum(m for m, _ in parts) == np.bitwise_or.reduce(np.array([m for m, _ in parts], np.uint64))


@pytest.mark.parametrize("bucket", [40_000, 5])
def test_near_links_lose_nothing(spark, monkeypatch, bucket):
    """Random fingerprints, dense clusters and a chain, with and without buckets that are filed again."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(bucket)
    values = {r.getrandbits(64) for _ in range(300)}
    for centre in (0, r.getrandbits(64)):
        values |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    chain = r.getrandbits(64)
    for b in range(0, 60, 3):
        chain ^= 7 << b
        values.add(chain)
    rows = [(i, v - (1 << 64) if v >> 63 else v, b"") for i, v in enumerate(sorted(values))]
    got = simhash.near_links(spark.createDataFrame(rows, "rep bigint, fp bigint, more binary"))
    found = plain_components(range(len(rows)), [(x.a, x.b) for x in got.collect()])
    ordered = sorted(values)
    want = plain_components(range(len(rows)), [(i, j) for i, j in combinations(range(len(rows)), 2) if (ordered[i] ^ ordered[j]).bit_count() <= 3])
    assert found == want


def test_near_duplicates_on_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in TEXTS)
    of = {(r.doc_id, r.fp): r.component_id for r in got}
    assert {r.component_id for r in got if r.fp == 0} == {3} and of[None, 0] == 3
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1} and {r.component_id for r in got if r.doc_id in (7, 13)} == {7}
    assert [r.component_id for r in got if r.doc_id is None and r.fp != 0] == [None]
    assert simhash.near_duplicates(none).count() == 0


def test_one_of_each(spark, odd, none):
    base = [prose(i, 200) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        words = t.split()
        words[50] = "changed"
        rows.append((200 + i, " ".join(words)))
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == set(range(12))
    stay = simhash.one_of_each(odd)
    assert stay.columns == odd.columns and Counter(r.doc_id for r in stay.collect() if r.doc_id is not None and r.doc_id < 6) == Counter({1: 1, 3: 1, -5: 1})
    assert simhash.one_of_each(none).count() == 0


def test_one_of_each_takes_its_candidates_from_simhash(spark, monkeypatch):
    """Without bands the near copies within three bits are still found; groups that only the bits link are verified and stay apart."""
    monkeypatch.setattr(minhash, "_filed", lambda batches: (b.slice(0, 0) for b in minhash_filed(batches)))
    base = [prose(i, 300) for i in range(10)]
    line = "the same line again and once more " * 400
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " end") for i, t in enumerate(base)] + [(200 + i, line + prose(3000 + i, 60)) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, 5).collect()}
    near = {i for i, c in groups.items() if 100 <= i < 200 and c == i - 100}
    assert near and groups[201] == 200
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert kept == {i for i, _ in rows} - near


def test_all_pairs_of_a_simhash_group_are_verified(spark, monkeypatch):
    """Without bands: the near copies of a group stand on either side of a text that is none, and still meet."""
    monkeypatch.setattr(minhash, "_filed", lambda batches: (b.slice(0, 0) for b in minhash_filed(batches)))
    line = "the same line again and once more " * 400
    words = prose(41, 60).split()
    rows = [(1, line + " ".join(words)), (2, line + prose(42, 60)), (3, line + " ".join([*words[:30], "changed", *words[31:]]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.component_id for r in simhash.near_duplicates(docs, 5).collect()} == {1}
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == {1, 2}


@pytest.mark.parametrize("bucket,together", [(20_000, 8_000_000), (4, 8_000_000), (6, 600)])
def test_near_copies_are_verified(spark, monkeypatch, bucket, together):
    """Planted pairs at 0.6 to 0.95, a dense group and a repeated line, against brute force on distinct shingles."""
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    monkeypatch.setattr(minhash, "TOGETHER", together)
    r = random.Random(5)
    rows = []
    for i in range(60):
        words = prose(500 + i, 204).split()
        rows.append((2 * i, " ".join(words)))
        # n of 200 shingles changed at the end: similarity (200 - n) / (200 + n)
        n = round(200 * (1 - (goal := 0.6 + 0.35 * i / 59)) / (1 + goal))
        rows.append((2 * i + 1, " ".join(words[: 204 - n] + prose(9000 + i, n).split())))
    words = prose(77, 150).split()
    for i in range(40):
        some = list(words)
        for at in r.sample(range(150), r.randrange(8)):
            some[at] = f"other{i}x{at}"
        rows.append((1000 + i, " ".join(some)))
    line = "the same line again and again " * 400
    rows += [(2000 + i, line + prose(3000 + i, 60)) for i in range(2)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    alike = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert 20 < sum(b == a + 1 and b < 120 for a, b in alike) < 40
    got = minhash.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 0.8)
    assert {x.doc_id: x.component_id for x in got.collect()} == plain_components(sets, alike)
    kept = {x.doc_id for x in simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {i for i, c in plain_components(sets, alike).items() if i == c}


def test_rows_handed_on_grow_with_a_group_around_the_threshold():
    """Texts at a similarity of about 0.75 or 0.8: suspects and links are never more than the entries, at any size."""
    import numpy as np
    import pyarrow as pa

    for changed in (5, 4):
        for n in (125, 250, 500):
            r = random.Random(n)
            words, sets = prose(7, 204).split(), []
            for i in range(n):
                some = list(words)
                for at in r.sample(range(204), changed):
                    some[at] = f"new{i}x{at}"
                sets.append(minhash.shingles(" ".join(some), 5))
            signs = [minhash.signature(s, 228) for s in sets]
            rep = pa.array(range(n), pa.int64())
            zero = pa.array([0] * n, pa.int64())
            batch = pa.RecordBatch.from_arrays([zero, zero.cast(pa.int32()), rep, rep, pa.array([0] * n, pa.int32()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in signs], pa.binary())], names=["value", "piece", "rep", "label", "band", "size", "sign"])
            assert sum(b.num_rows for b in minhash._suspects(0.8)(iter([batch.slice(0, 50), batch.slice(50)]))) <= n
            hashed = [np.unique(np.array([hash(x) & (2**64 - 1) for x in s], np.uint64)) for s in sets]
            links = minhash.spanning(hashed, np.arange(n), 0.8)
            assert len(links) < n
            alike = [(a, b) for a, b in combinations(range(n), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            assert plain_components(range(n), links) == plain_components(range(n), alike)


# decontamination

def plain_containment(docs, items, k=5, threshold=0.8):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    out = Counter()
    for doc, text in docs:
        w = words(text)
        for item, wanted in {*items}:
            v = words(wanted)
            size = min(k, len(v))
            own = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
            both = own & {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
            if own and len(both) >= threshold * len(own) - 1e-9:
                out[doc, item, len(both), len(own)] += 1
    return out


def test_contained_items(spark, odd, none, monkeypatch):
    items = [(i, prose(1000 + i, n)) for i, n in enumerate([1, 2, 4, 5, 6, 12, 40, 300, 900])] + [(20, None), (21, ""), (22, "!!!"), (3, prose(1003, 5)), (3, prose(77, 9)), (None, prose(5, 8))]
    r = random.Random(1)
    docs = list(TEXTS)
    for n, (_, text) in enumerate(items):
        words = (text or "").split()
        for share in (1.0, 0.9, 0.7, 0.5):
            part = words[: int(len(words) * share)]
            docs.append((500 + 20 * n + int(share * 10), prose(r.random(), 300) + " " + " ".join(part).upper() + ", " + prose(r.random(), 50)))
        half = len(words) // 2
        docs.append((500 + 20 * n, " ".join(words[:half]) + " split " + prose(r.random(), 100) + " " + " ".join(words[half:])))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = plain_containment(docs, items)
    assert len(want) > 20
    for size in (1 << 24, 100):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = Counter((x.doc_id, x.item_id, x.shared, x.shingles) for x in decontaminate.contained_items(frame, benchmark).collect())
        assert got == want
        left = Counter(x.doc_id for x in decontaminate.without_items(frame, benchmark).collect())
        hit = {d for d, *_ in want}
        assert left == Counter(d for d, _ in docs if d not in hit)
    assert decontaminate.contained_items(none, benchmark).count() == 0 and decontaminate.contained_items(odd, benchmark.filter("false")).count() == 0
    kept = decontaminate.without_items(odd, benchmark.filter("item_id = 8"))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_minima_leave_no_room_for_a_miss():
    for n in range(1, 16):
        absent = n - int(np.ceil(0.8 * n - 1e-9))
        assert decontaminate.minima_wanted((1 << n.bit_length()) - 1, 0.8) > absent


# language and quality

def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.QUERIES["op4_language_id"](spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(list(truth)) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_looks_at_nothing_but_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs, 50)
    changed = docs.select((-F.col("doc_id")).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit("?").alias("source"))
    a = {r.doc_id: (r.lang_pred, r.lang_score) for r in language.predict(docs, model).collect()}
    b = {-r.doc_id: (r.lang_pred, r.lang_score) for r in language.predict(changed, model).collect()}
    assert a == b
    labels = language.sample(docs, 50)
    held = docs.select("doc_id", "lang", "text", F.when(language.held_out(), F.lit("held")).otherwise(F.col("lang")).alias("lang2"))
    again = language.sample(held.select("doc_id", F.col("lang2").alias("lang"), "text"), 50)
    assert [x[0] for x in labels] == [x[0] for x in again] and "held" not in {x[0] for x in again}


def test_language_on_odd_rows(odd, none):
    model = language.train(odd)
    got = language.predict(odd, model).collect()
    assert model.languages == ["xx"] and Counter(r.doc_id for r in got) == Counter(i for i, _ in TEXTS)
    assert all((r.lang_pred == "und" and r.lang_score == 0 and r.lang_rejected) == (not any(c.isalpha() for c in r.text or "")) for r in got)
    kept = language.accepted(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect())[1] == 2
    empty = language.train(none)
    assert empty.languages == [] and language.predict(none, empty).count() == 0 and {r.lang_pred for r in language.predict(odd, empty).collect()} == {"und"}


def test_quality_against_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op5_quality"](spark, SF).collect()}
    good, bad = ([got[d].keep for d, q in labels.items() if q == want and d in got] for want in (1, 0))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.2
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got.values())


def test_posteriors_find_planted_accuracies():
    r = np.random.default_rng(5)
    truth = r.random(20_000) < 0.8
    right = [(0.99, 0.6), (0.97, 0.5), (0.95, 0.7), (0.98, 0.4)]
    votes = ["".join("-" if r.random() < 0.1 else str(int((r.random() < right[j][0]) if y else (r.random() >= right[j][1]))) for j in range(4)) for y in truth]
    q = quality.posteriors(Counter(votes))
    found = np.array([q[v] for v in votes])
    assert abs(found.mean() - 0.8) < 0.03 and ((found >= 0.5) == truth).mean() > 0.9
    assert quality.posteriors({}) == {}


def test_quality_on_odd_rows(odd, none):
    model = quality.train(odd)
    got = quality.classify(odd, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in TEXTS)
    assert all(not r.quality_keep and r.quality_score == 0 for r in got if not (r.text or "").strip())
    kept = quality.good_ones(odd)
    assert kept.columns == odd.columns and 1 in {r.doc_id for r in kept.collect()}
    assert quality.classify(none, quality.train(none)).count() == 0


def test_quality_learns_from_every_text(spark):
    """Each text has n-grams of its own: all of them have a weight, and the least score is set on all texts."""
    rows = [(i, f"w{i}x{i * 7919 % 10007} holds " + prose(i, 12)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    model = quality.train(docs)
    used = np.unique(np.concatenate([frequencies(t.encode())[0] for _, t in rows]))
    assert (model.table[0, used] != 0).all()
    got = quality.classify(docs, model).collect()
    good = [r for r in got if r.quality_posterior >= 0.9]
    assert good and sum(not r.quality_keep for r in good) <= quality.LOST * len(good)
    assert sorted((r.doc_id, r.quality_keep) for r in quality.judged(docs).collect()) == sorted((r.doc_id, r.quality_keep) for r in got)


# licences

def test_licenses(spark, odd, none):
    mit, apache = "x y\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [(1, "a/LICENSE", apache), (2, "a/b/c.txt", "nothing"), (3, "a/b/COPYING.md", "some words\n\n" + mit), (4, "a/b/d/e.txt", None), (5, "a/f.txt", mit), (6, "z/g.txt", "plain"), (7, None, "plain"), (8, "a", "plain"),
             (9, "ab/h.txt", ""), (10, "a/NOTICE", "no licence"), (11, "a/i.txt", "The software licence of a product is not free to be under this version, however it is written."), (12, "a/LICENSE", apache), (None, "a/b/j", "x"),
             (13, "q/k.txt", licenses.STATEMENTS[6][1].replace(", ", ",\n# "))]
    got = {(r.doc_id, r.path): (r.license, r.basis, r.licensed_by) for r in licenses.scan(spark.createDataFrame(files, "doc_id bigint, path string, text string")).collect()}
    assert len(got) == len(files)
    want = {1: ("Apache-2.0", "file", None), 2: ("MIT", "inherited", "a/b"), 3: ("MIT", "file", None), 4: ("MIT", "inherited", "a/b"), 5: ("MIT", "header", None), 6: (None, "none", None), 7: (None, "none", None), 8: (None, "none", None),
            9: (None, "none", None), 10: ("Apache-2.0", "inherited", "a"), 11: ("Apache-2.0", "inherited", "a"), 12: ("Apache-2.0", "file", None), None: ("MIT", "inherited", "a/b"), 13: ("GPL-3.0", "header", None)}
    assert {d: x for (d, _), x in got.items()} == want
    odd_files = odd.withColumn("path", F.concat_ws("/", "source", "doc_id"))
    assert Counter(r.doc_id for r in licenses.scan(odd_files).collect()) == Counter(i for i, _ in TEXTS)
    assert licenses.scan(none.withColumn("path", F.lit("a"))).count() == 0


def test_licenses_of_shuffled_files(spark):
    """Rows that come out of a shuffle, read by several jobs that may partition it differently."""
    mit = "Released under the MIT License."
    files = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("d/"), "id", F.lit(".txt")).alias("path"), F.when(F.expr("id % 3 = 0"), F.concat(F.lit("words of file "), "id", F.lit(f"\n{mit}"))).otherwise(F.concat(F.lit("other words "), "id")).alias("text"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        got = licenses.scan(files.repartition(40).dropDuplicates(["doc_id", "path", "text"])).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert {r.doc_id: r.license for r in got} == {i: "MIT" if i % 3 == 0 else None for i in range(3000)} and all(r.path == f"d/{r.doc_id}.txt" for r in got)


def test_whole_licence_texts(spark):
    """Licence files with a copyright line and line breaks, the same texts as comment blocks, and texts that only look alike."""
    of = dict(reversed(licenses.TEXTS))
    wrapped = lambda text, lead: "\n".join(lead + " ".join(text.split()[i : i + 12]) for i in range(0, len(text.split()), 12))
    files = [(k, f"p{k}/LICENSE", f"{name} licence\n\nCopyright (c) 2024 Some Body\n\n{wrapped(text, '')}\n") for k, (name, text) in enumerate(of.items())]
    files += [(100 + k, f"q{k}/x.c", f"/*\n{wrapped(text, ' * ')}\n */\n\nint main() {{ return 0; }}") for k, (_, text) in enumerate(of.items())]
    files += [(200 + k, f"p{k}/sub/y.c", "int main;") for k in range(len(of))]
    files += [(300, "z/LICENSE", "This software is a product of some authors; redistribution is a matter of the conditions and the warranty."), (301, "z/a.c", "software as is, and any express or implied things")]
    got = {r.doc_id: (r.license, r.basis) for r in licenses.scan(spark.createDataFrame(files, "doc_id bigint, path string, text string")).collect()}
    for k, name in enumerate(of):
        assert (got[k], got[100 + k], got[200 + k]) == ((name, "file"), (name, "header"), (name, "inherited"))
    assert got[300] == got[301] == (None, "none")


def test_root_license_reaches_every_directory(spark):
    files = [(1, "LICENSE", "Released under the MIT License."), (2, "a/b/c", "x"), (3, "d", "y")]
    got = licenses.scan(spark.createDataFrame(files, "doc_id bigint, path string, text string")).collect()
    assert {r.doc_id: (r.license, r.licensed_by) for r in got} == {1: ("MIT", None), 2: ("MIT", ""), 3: ("MIT", "")}


# pipeline

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, before, SF), name)
        assert after.schema.simpleString() == docs.schema.simpleString() and 0 < after.count() <= before.count()
        assert after.exceptAll(before).count() == 0
        before = after
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    left = [(r.doc_id, r.text) for r in before.collect()]
    assert not plain_containment(left, items) and len({t for _, t in left}) == len(left)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {d for d, _ in left}


def test_pipeline_on_odd_rows(spark, none, tmp_path):
    rows = [(i, t, "en" if i else None, "s", len(t or "")) for i, t in TEXTS]
    for docs in (spark.createDataFrame(rows, DOCS), spark.createDataFrame([], DOCS)):
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        packed = corpus_pipeline.run(spark, str(tmp_path))
        assert (packed.filter("doc_id = 1").count() > 0) == (docs.count() > 0)
