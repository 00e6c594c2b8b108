"""Weighted pairs of nodes inside many sets at once, counted on the sets' bits inside tasks.

A join of the pairs with sets in words of 64 makes a row for every pair and word, and 64 sums of
each. Here a block of sets meets a range of sources and a range of targets as bitmaps; a pair is
one AND of two rows, and the rows are summed by full adders on whole words (bit k of the counts of
64 sets in one word), so 64 sets cost a few operations of a word. Nothing but the counts leaves a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.session import cut
from . import words as W

RANGE, TASKS, LEAST, MOST = 1 << 15, 48, 16, 512  # nodes of a range, blocks aimed at, words of a block
PAIRS, CHUNK = 100_000, 4096  # pairs of an array, pairs worked on side by side


def counted_inside(pairs: DataFrame, inside: DataFrame) -> DataFrame:
    """word, bit, n: for every set the ``n`` (1 or more) of the ``pairs`` (src, dst, n; no pair twice) with both ends in it, summed.

    ``inside`` has one row (node, word, bits) a node and word. Sets without a pair have no row.
    """
    inside = cut(inside)
    place = W.numbered(inside.select(F.col("node").alias("account")))
    ids = cut(place.select(F.col("account").alias("node"), (F.col("word").cast("bigint") * W.BITS + F.col("bit")).alias("id")))
    at = lambda end: ids.select(F.col("node").alias(end), F.floor(F.col("id") / RANGE).cast("int").alias(f"{end}_range"), (F.col("id") % RANGE).alias(f"{end}_place"))
    met = cut(pairs.select("src", "dst", "n").join(at("src"), "src").join(at("dst"), "dst").drop("src", "dst"))
    last, ranges = inside.agg(F.max("word")).first()[0], ids.agg(F.max("id")).first()[0]
    if last is None or ranges is None:
        return inside.select("word", F.lit(0).alias("bit"), F.lit(0).cast("bigint").alias("n")).limit(0)
    per = min(MOST, max(LEAST, -(-(last + 1) // TASKS)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n))))
    chunk = F.pmod(F.xxhash64("src_place", "dst_place"), F.lit(max(1, met.count() // PAIRS))).alias("chunk")
    packed = met.groupBy("src_range", "dst_range", "n", chunk).agg(F.collect_list(F.col("src_place") * RANGE + F.col("dst_place")).alias("codes"))
    right = packed.select(each(last // per).alias("block"), "src_range", "dst_range", "n", "codes")
    rows = inside.join(at("node"), "node").select(F.floor(F.col("word") / per).cast("int").alias("block"), "node_range", F.col("node_place").alias("place"), (F.col("word") % per).cast("int").alias("word"), "bits")
    other = rows.withColumn("other", each(ranges // RANGE))
    side = lambda src, dst, target: other.select("block", F.col(src).alias("src_range"), F.col(dst).alias("dst_range"), F.lit(target).alias("target"), "place", "word", "bits")
    left = side("node_range", "other", False).unionByName(side("other", "node_range", True))

    span, step = RANGE, CHUNK

    def count(key: tuple, sets: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return _count(int(key[0]), per, span, step, sets, found)

    key = ["block", "src_range", "dst_range"]
    counts = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(count, "word int, bit int, n bigint")
    return counts.groupBy("word", "bit").agg(F.sum("n").alias("n"))


def reduced(rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """At most two rows of the same sums in every bit, and the carries (rows that count twice)."""
    carries = []
    while len(rows) > 2:
        n = len(rows) // 3
        a, b, c = rows[:n], rows[n:2 * n], rows[2 * n:3 * n]
        odd = a ^ b
        carries.append((a & b) | (odd & c))
        rows = np.concatenate([odd ^ c, rows[3 * n:]])
    return rows, carries


class Counter:
    """Sums of rows of words, bit by bit, kept as rows that count 1, 2, 4, ..."""

    def __init__(self, words: int):
        self.words, self.planes = words, []

    def add(self, rows: np.ndarray, weight: int) -> None:
        coming = [[rows] if weight >> k & 1 else [] for k in range(weight.bit_length())]
        k = 0
        while k < len(coming):
            if k == len(self.planes):
                self.planes.append(np.zeros((0, self.words), np.uint64))
            if coming[k]:
                self.planes[k], carries = reduced(np.concatenate([self.planes[k], *coming[k]]))
                if carries:
                    coming += [[] for _ in range(k + 2 - len(coming))]
                    coming[k + 1] += carries
            k += 1

    def sums(self) -> np.ndarray:
        """One sum a bit, in order of words and bits."""
        out = np.zeros(self.words * W.BITS, np.int64)
        for k, rows in enumerate(self.planes):
            for row in rows:
                out += np.unpackbits(row.astype("<u8").view(np.uint8), bitorder="little").astype(np.int64) << k
        return out


def _count(block: int, per: int, span: int, step: int, sets: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Counts of the sets of one block over the pairs of one range of sources and one of targets."""
    nodes, maps = [], []
    for target in (False, True):
        own = sets[sets["target"] == target]
        known, at = np.unique(own["place"].to_numpy(dtype=np.int64), return_inverse=True)
        rows = np.zeros((len(known), per), np.uint64)
        rows[at, own["word"].to_numpy(dtype=np.int64)] = own["bits"].to_numpy(dtype=np.int64).view(np.uint64)
        nodes.append(known)
        maps.append(rows)
    if found.empty or not len(nodes[0]) or not len(nodes[1]):
        return pd.DataFrame({"word": [], "bit": [], "n": []})
    total = Counter(per)
    for weight, codes in zip(found["n"], found["codes"]):
        codes = np.asarray(codes, dtype=np.int64)
        ends = codes // span, codes % span
        at = [np.minimum(np.searchsorted(known, end), len(known) - 1) for known, end in zip(nodes, ends)]
        both = np.flatnonzero((nodes[0][at[0]] == ends[0]) & (nodes[1][at[1]] == ends[1]))
        for low in range(0, len(both), step):
            some = both[low:low + step]
            total.add(maps[0][at[0][some]] & maps[1][at[1][some]], int(weight))
    sums = total.sums()
    place = np.flatnonzero(sums)
    return pd.DataFrame({"word": (block * per + place // W.BITS).astype(np.int32), "bit": (place % W.BITS).astype(np.int32), "n": sums[place]})
