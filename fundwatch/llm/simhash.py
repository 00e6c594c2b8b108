"""SimHash near duplicates with a generalised pigeonhole index.

Fingerprints are grouped first, so a text copied a million times is one entry. Two entries
link when at most ``distance`` of 64 bits differ (and, if the fingerprints are wider, at most
``wide`` of all bits). The 64 bits are dealt to m partitions, correlated bits together;
partition i gets a threshold T_i (-1: unused) with the sum of T_i equal to distance - m + 1, so
two linked entries differ in at most T_i bits of some partition. A dynamic programme picks
m and the thresholds that make probes and estimated candidates cheapest. An entry is filed
under its value of a partition and, up to T_i, probes the values nearby; entries of a bucket
are compared inside the task, and only a spanning forest of the links found leaves it. A
bucket above ``BUCKET`` rows is filed again under parts of its remaining bits (pigeonhole once
more, ``AGAIN`` times at most); one that is dense even then is cut into pieces, and each pair
of pieces is compared on its own. No entry is dropped and no large group meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components
from .minhash import mixed, similar_components
from .scratch import written

BITS, DISTANCE, SEED, SAMPLE, BUCKET, AGAIN = 64, 3, 42, 1024, 40_000, 2
#: Microseconds for a row (filed, shuffled, sorted, read by Python) and for a candidate pair compared in numpy, as measured.
ROW_COST, PAIR_COST = 5.0, 0.002


def fingerprint(text: str | None, words_per_shingle: int = 3, parts: int = 1) -> list[int]:
    """SimHash of the word shingles, 64 bits a part; ASCII letters in lower case, words split at ASCII white space, no words: 0."""
    words = text.encode().lower().split() if text else []
    if not words:
        return [0] * parts
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(words_per_shingle, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())), np.uint64, len(starts))
    found = []
    for _ in range(parts):
        ones = np.zeros(BITS, np.int64)
        for i in range(0, len(hashes), 50_000):
            some = hashes[i : i + 50_000].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        found.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]))
        hashes = mixed(hashes)
    return found


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, parts: int = 1) -> DataFrame:
    """doc_id, fp (the first 64 bits as a signed long), more (the other parts' bytes) of every whole text of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words_per_shingle, parts) for t in batch.column(1).to_pylist()], "<u8").reshape(-1, parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[:, 0].view(np.int64)), pa.array([x.tobytes() for x in found[:, 1:]], pa.binary())], names=["doc_id", "fp", "more"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint, more binary")


def bit_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m groups of nearly equal size, each around a bit and those most correlated with it."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    centred = bits - bits.mean(axis=0) if len(bits) else np.zeros((1, BITS))
    spread = np.sqrt((centred**2).sum(axis=0)) + 1e-9
    alike, free, groups = np.abs(centred.T @ centred) / np.outer(spread, spread), list(range(BITS)), []
    for i in range(m):
        size = len(free) // (m - i)
        group = [max(free, key=lambda b: spread[b])]
        while len(group) < size:
            group.append(max((b for b in free if b not in group), key=lambda b: alike[b, group].mean()))
        free = [b for b in free if b not in group]
        groups.append(sorted(group))
    return groups


def plan(sample: np.ndarray, total: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(mask, threshold) of the partitions in use, the cheapest over 1 to distance + 1 partitions."""
    best, chosen = None, []
    pairs = sample[:, None] ^ sample[None, :]
    off = ~np.eye(len(sample), dtype=bool)
    for m in range(1, distance + 2):
        masks = [sum(1 << b for b in g) for g in bit_groups(sample, m)]
        cost = []
        for mask in masks:
            width, apart = mask.bit_count(), np.bitwise_count(pairs & np.uint64(mask))[off] if len(sample) > 1 else np.zeros(0)
            balls = [sum(comb(width, j) for j in range(t + 1)) for t in range(distance + 1)]
            share = [max(float((apart <= t).mean()) if len(apart) else 0.0, b / 2**width) for t, b in enumerate(balls)]
            cost.append([0.0] + [total * b * ROW_COST + total**2 / 2 * s * PAIR_COST for b, s in zip(balls, share)])
        ways = {0: (0.0, [])}  # by the sum of thresholds + 1 so far: least cost and thresholds
        for own in cost:
            after: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in ways.items():
                for t, more in enumerate(own, -1):
                    if (k := s + t + 1) <= distance + 1 and (k not in after or c + more < after[k][0]):
                        after[k] = (c + more, [*ts, t])
            ways = after
        if best is None or ways[distance + 1][0] < best:
            best, chosen = ways[distance + 1][0], [(mask, t) for mask, t in zip(masks, ways[distance + 1][1]) if t >= 0]
    return chosen


ROW = ["mask", "value", "probe", "rep", "fp", "more"]
KEY = ["mask", "value", "piece"]
ROW_SCHEMA = "mask bigint, value bigint, probe boolean, rep bigint, fp bigint, more binary"


def _file(parts: list[tuple[int, int]]):
    """Rows (mask, value, probe, rep, fp, more): each entry under its own value and, as a probe, under those up to the threshold away."""
    flips = [(mask, [0] + [sum(1 << b for b in c) for n in range(1, t + 1) for c in combinations([b for b in range(BITS) if mask >> b & 1], n)]) for mask, t in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for mask, changes in flips:
                own = fp & np.uint64(mask)
                for change in changes:
                    n = len(own)
                    columns = [np.full(n, mask, np.uint64).view(np.int64), (own ^ np.uint64(change)).view(np.int64), np.full(n, change != 0)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *batch.columns], names=ROW)

    return run


def _refile(distance: int):
    """Rows of a large bucket under distance + 1 parts of the bits outside its mask: linked entries agree on one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, value, fp = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1, 4))
            for one in np.unique(mask).tolist():
                at = np.flatnonzero(mask == one)
                free = [b for b in range(BITS) if not one >> b & 1]
                for bits in np.array_split(free, distance + 1):
                    more = np.uint64(sum(1 << int(b) for b in bits))
                    columns = [np.full(len(at), np.uint64(one) | more).view(np.int64), (value[at] | fp[at] & more).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(batch.column(i).take(pa.array(at)) for i in range(2, 6))], names=ROW)

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links with the least node of its component, where they differ."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        least, before = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _compare(distance: int, wide: int):
    """Links inside the buckets of a partition sorted by ``KEY``, as a forest; at most one incomplete bucket is carried over."""

    def links(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        mask, value, probe, rep, fp, more, piece = rows
        bucket = np.cumsum(np.concatenate([[0], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]) | (piece[1:] != piece[:-1])])) if len(mask) else mask
        found, held, at, step = [], 0, np.arange(len(mask)), 0
        while len(at):
            step += 1
            at = at[at < len(mask) - step]
            at = at[bucket[at + step] == bucket[at]]
            apart = np.bitwise_count(fp[at] ^ fp[at + step])
            near = at[(apart <= distance) & ~(probe[at] & probe[at + step])]
            if more.shape[1]:
                apart = np.bitwise_count(fp[near] ^ fp[near + step]) + np.bitwise_count(more[near] ^ more[near + step]).sum(axis=1, dtype=np.int64)
                near = near[apart <= wide]
            found.append((rep[near], rep[near + step]))
            held += len(near)
            if held > 1_000_000:
                found, held = [forest(*map(np.concatenate, zip(*found)))], 0
        return forest(*map(np.concatenate, zip(*found))) if found else (rep[:0], rep[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []

        def flush(last: bool):
            rows = [np.concatenate(c) for c in zip(*kept)]
            other = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[6] != rows[6][-1]))
            whole = len(rows[0]) if last else other[-1] + 1 if len(other) else 0
            a, b = links([c[:whole] for c in rows])
            kept[:] = [[c[whole:] for c in rows]]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            arrays = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            more = np.frombuffer(b"".join(batch.column(5).to_pylist()), "<u8").reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0), np.uint64)
            kept.append([arrays[0], arrays[1], arrays[2].astype(bool), arrays[3], arrays[4].view(np.uint64), more, batch.column(6).to_numpy(zero_copy_only=False)])
            kept[:] = [k for k in kept if len(k[0])]
            if sum(len(k[0]) for k in kept) > 200_000:
                yield flush(False)
        if kept:
            yield flush(True)

    return run


def near_links(entries: DataFrame, distance: int = DISTANCE, wide: int = DISTANCE) -> DataFrame:
    """Spanning links (a, b) between the entries (rep, fp, more) that differ in at most ``distance`` bits of fp and ``wide`` of all."""
    sample = entries.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).toArrow()["fp"].to_numpy().view(np.uint64)
    rows = entries.select("rep", "fp", "more").mapInArrow(_file(plan(sample, max(1, entries.count()), distance)), ROW_SCHEMA)
    links = []
    for turn in range(AGAIN + 1):
        counts = written(rows.groupBy("mask", "value").count().filter(F.col("count") > BUCKET), "large")
        large = bool(counts.take(1))
        small = rows.join(counts, ["mask", "value"], "left_anti") if large else rows
        links.append(_linked(small.withColumn("piece", F.lit(0)), distance, wide))
        if not large:
            break
        rows = rows.join(counts, ["mask", "value"], "left_semi" if turn < AGAIN else "inner")
        if turn < AGAIN:
            rows = written(rows.select(ROW).mapInArrow(_refile(distance), ROW_SCHEMA), "refiled")
        else:
            # About BUCKET / 2 rows a piece; each row goes to the pairs of its piece with every piece.
            n = F.ceil(2 * F.col("count") / BUCKET).cast("int")
            own, other = F.pmod(F.xxhash64("rep", "fp", "probe"), n).cast("int"), F.explode(F.sequence(F.lit(0), n - 1))
            pairs = rows.select(*ROW, n.alias("n"), own.alias("own"), other.alias("other"))
            links.append(_linked(pairs.withColumn("piece", F.least("own", "other") * F.col("n") + F.greatest("own", "other") + 1), distance, wide))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _linked(rows: DataFrame, distance: int, wide: int) -> DataFrame:
    ordered = rows.select(*ROW, F.col("piece").cast("int").alias("piece")).repartition(*KEY).sortWithinPartitions(*KEY)
    return written(ordered.mapInArrow(_compare(distance, wide), "a bigint, b bigint"), "near")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, distance: int = DISTANCE, parts: int = 1, wide: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most ``distance`` differing
    bits of the first 64, and ``wide`` of all 64 * ``parts``. Null and empty texts have
    fingerprint 0. Rows with equal doc_id are one node; a row with a null doc_id takes the
    component of its fingerprint if another row has that one, else null. Other columns are
    ignored; an empty table gives no row.
    """
    rows = written(fingerprints(docs, words_per_shingle, parts), "fingerprints")
    key = ["fp", "more"]
    entries = written(rows.groupBy(key).agg(F.min("doc_id").alias("rep")), "entries")
    groups = components(near_links(entries.filter(F.col("rep").isNotNull()), distance, wide))
    known = written(entries.join(groups, entries["rep"] == groups["node"], "left").select(*key, F.coalesce("component", "rep").alias("component_id")), "members")
    return rows.join(known, key).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without near copies: of each component the rows of its smallest doc_id stay, repeated rows once.

    Two texts are near copies when the exact Jaccard similarity of their distinct shingles is at
    least ``similarity``; a component is connected by such pairs. The groups of ``near_duplicates``
    are candidates, and since three of 64 bits reach few pairs near the threshold, bands of MinHash add theirs
    (``minhash``); all are verified. A row with a null doc_id stays if no other row has its shingles.
    """
    found = similar_components(docs, words_per_shingle, similarity, near_duplicates(docs, words_per_shingle).select("doc_id", "component_id"))
    stay = found.filter(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select("doc_id").distinct()
    kept = docs.join(stay, docs["doc_id"].eqNullSafe(stay["doc_id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])
