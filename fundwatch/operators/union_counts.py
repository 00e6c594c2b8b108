"""Weighted edges inside the joined neighbourhoods of many pairs of nodes, counted inside tasks.

With A and B the closed neighbourhoods of u and v and D = A without B, the edges inside A and B together are
those inside B, those between D and B, and those inside D. Those inside B and the sums of every node's
edges from and to B belong to v, and D is looked up in a mask of B, so a pair costs the neighbours of u and the edges among
them. Blocks of pairs meet ranges of sources and of targets; a task holds what lies in its ranges, and only counts leave it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.session import cut
from . import words as W

RANGE, TASKS, PAIRS, CHUNK = 1 << 17, 24, 200_000, 100_000  # nodes of a range, blocks aimed at, pairs of a block, edges of an array
HELD = 4_000_000  # inner edges worked on at once


def counted_in_unions(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """u, v, n: for every row of ``pairs`` (u, v; no pair twice) the ``n`` of the ``edges`` (src, dst, n) with both ends among u, v and their neighbours, summed."""
    names = edges.select(F.explode(F.array("src", "dst")).alias("account")).unionByName(pairs.select(F.explode(F.array("u", "v")).alias("account")))
    place = W.numbered(names)
    ids = cut(place.select(F.col("account").alias("name"), (F.col("word").cast("bigint") * W.BITS + F.col("bit")).alias("id")))
    at = lambda end: ids.select(F.col("name").alias(end), F.col("id").alias(f"_{end}"))
    met = cut(edges.join(at("src"), "src").join(at("dst"), "dst").select(F.col("_src").alias("s"), F.col("_dst").alias("d"), "n"))
    placed = cut(pairs.join(at("u"), "u").join(at("v"), "v"))
    number, top, links = placed.count(), ids.agg(F.max("id")).first()[0], met.count()
    if not number:
        return pairs.select("u", "v", F.lit(0).cast("bigint").alias("n"))
    blocks = max(1, min(max(TASKS, number // PAIRS), number // 1000))
    last = top // RANGE
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n))))
    block = F.pmod(F.xxhash64("_u"), F.lit(blocks)).cast("int").alias("block")
    none = F.lit(None).cast("array<int>")
    part, rest = (lambda c: F.floor(F.col(c) / RANGE).cast("int")), (lambda c: (F.col(c) % RANGE).cast("int"))
    # Closed neighbourhoods of the asked nodes, by range.
    ends = placed.select(F.explode(F.array("_u", "_v")).alias("a")).distinct()
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("m"))
    near = met.select(F.inline(F.array(way("s", "d"), way("d", "s")))).join(ends, "a", "left_semi").unionByName(ends.select("a", F.col("a").alias("m"))).distinct()
    near = cut(near.groupBy("a", part("m").alias("range")).agg(F.collect_list(rest("m")).alias("x")))
    asked = placed.select(block, "_u", "_v")
    needed = asked.select("block", F.explode(F.array("_u", "_v")).alias("a")).distinct().join(near, "a")
    row = lambda df, sr, dr, kind, a, x, y: df.select("block", sr.alias("sr"), dr.alias("dr"), F.lit(kind).alias("kind"), a.cast("bigint").alias("a"), x.alias("x"), y.alias("y"))
    c = F.col
    sides = needed.withColumn("other", each(last))
    chunk = F.pmod(F.xxhash64("s", "d"), F.lit(max(1, links // CHUNK))).alias("chunk")
    packed = met.groupBy(part("s").alias("sr"), part("d").alias("dr"), "n", chunk).agg(F.collect_list(F.struct(rest("s").alias("s"), rest("d").alias("d"))).alias("e"))
    packed = packed.withColumn("block", each(blocks - 1))
    wanted = asked.groupBy("block", "_u").agg(F.collect_list(c("_v").cast("int")).alias("x")).withColumn("sr", each(last)).withColumn("dr", each(last))
    # In a cell on the diagonal sources and targets are the same range, and one copy serves both.
    rows = (row(packed, c("sr"), c("dr"), 0, c("n"), c("e")["s"], c("e")["d"])
            .unionByName(row(sides, c("range"), c("other"), 1, c("a"), c("x"), none))
            .unionByName(row(sides.filter("range <> other"), c("other"), c("range"), 2, c("a"), c("x"), none))
            .unionByName(row(wanted, c("sr"), c("dr"), 3, c("_u"), c("x"), none)))
    span, held = RANGE, HELD

    def count(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        return _count(int(key[1]) == int(key[2]), span, held, found)

    counts = rows.groupBy("block", "sr", "dr").applyInPandas(count, "_u bigint, _v bigint, n bigint")
    return placed.join(counts.groupBy("_u", "_v").agg(F.sum("n").alias("n")), ["_u", "_v"]).select("u", "v", "n")


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start`` to ``start + size`` of all runs, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class _Runs:
    """Arrays of many keys, end to end."""

    def __init__(self, arrays: list[np.ndarray]):
        self.size = np.array([len(a) for a in arrays], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.all = np.concatenate(arrays).astype(np.int64) if len(arrays) else np.zeros(0, np.int64)

    def of(self, i: int) -> np.ndarray:
        return self.all[self.start[i]: self.start[i] + self.size[i]]

    def many(self, at: np.ndarray) -> np.ndarray:
        return self.all[_spread(self.start[at], self.size[at])]


def _count(diagonal: bool, span: int, held: int, found: pd.DataFrame) -> pd.DataFrame:
    """Counts of the pairs of one block over the edges from one range of nodes to another."""
    kind = found["kind"].to_numpy()
    cell, asked = found[kind == 0], found[kind == 3]
    if cell.empty or asked.empty:
        return pd.DataFrame({"_u": [], "_v": [], "n": []})
    sizes = np.array([len(x) for x in cell["x"]])
    s, d = (np.concatenate([np.asarray(x, np.int64) for x in cell[side]]) for side in "xy")
    n = np.repeat(cell["a"].to_numpy(np.int64), sizes)
    order = np.argsort(s * span + d)
    s, d, n = s[order], d[order], n[order]
    code, out = s * span + d, np.bincount(s, minlength=span)
    first = np.cumsum(out) - out

    def members(which: int) -> dict[int, np.ndarray]:
        own = found[kind == which]
        return {int(a): np.asarray(x, np.int64) for a, x in zip(own["a"], own["x"])}

    sources = members(1)
    targets = sources if diagonal else members(2)
    us = asked["a"].to_numpy(np.int64)
    pair_u = np.repeat(np.arange(len(us)), [len(x) for x in asked["x"]])
    pair_v = np.concatenate([np.asarray(x, np.int64) for x in asked["x"]])
    order = np.argsort(pair_v, kind="stable")
    pair_u, pair_v = pair_u[order], pair_v[order]
    vs, begin = np.unique(pair_v, return_index=True)
    stop = np.append(begin[1:], len(pair_v))
    none = np.zeros(0, np.int64)
    from_a, to_a = (_Runs([side.get(int(u), none) for u in us]) for side in (sources, targets))
    total = np.zeros(len(pair_v), np.int64)
    in_s, in_d = np.zeros(span, bool), np.zeros(span, bool)
    # Edges inside B, and between D and B.
    for v, b, e in zip(vs.tolist(), begin, stop):
        own_s, own_d, at = sources.get(v, none), targets.get(v, none), pair_u[b:e]
        in_s[own_s], in_d[own_d] = True, True
        to_b = np.rint(np.bincount(s, weights=n * in_d[d], minlength=span)).astype(np.int64)
        from_b = np.rint(np.bincount(d, weights=n * in_s[s], minlength=span)).astype(np.int64)
        x, y = from_a.many(at), to_a.many(at)
        inside = to_b[own_s].sum()
        to_b[own_s], from_b[own_d] = 0, 0
        total[b:e] = inside + _sums(to_b[x], from_a.size[at]) + _sums(from_b[y], to_a.size[at])
        in_s[own_s], in_d[own_d] = False, False

    def inner(i: int) -> np.ndarray:
        """Edges among the neighbours of a node, from the end with less to look at."""
        a, b = from_a.of(i), to_a.of(i)
        light = out[a] <= len(b)
        in_d[b] = True
        few = _spread(first[a[light]], out[a[light]])
        few = few[in_d[d[few]]]
        in_d[b] = False
        wanted = (a[~light, None] * span + np.sort(b)[None, :]).ravel()
        at = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
        return np.concatenate([few, at[code[at] == wanted]])

    # Edges inside D, for as many nodes at a time as their inner edges allow.
    low = 0
    while low < len(us):
        kept, size, high = [], 0, low
        while high < len(us) and (high == low or size < held):
            kept.append(inner(high))
            size += len(kept[-1])
            high += 1
        runs = _Runs(kept)
        for v, b, e in zip(vs.tolist(), begin, stop):
            own = b + np.flatnonzero((pair_u[b:e] >= low) & (pair_u[b:e] < high))
            if not len(own):
                continue
            own_s, own_d, at = sources.get(v, none), targets.get(v, none), pair_u[own] - low
            in_s[own_s], in_d[own_d] = True, True
            edge = runs.many(at)
            total[own] += _sums(n[edge] * ~(in_s[s[edge]] | in_d[d[edge]]), runs.size[at])
            in_s[own_s], in_d[own_d] = False, False
        low = high
    return pd.DataFrame({"_u": us[pair_u], "_v": pair_v, "n": total})
