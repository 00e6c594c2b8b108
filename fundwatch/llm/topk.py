"""Exact top-k inner products over a pivot-distance index.

An inner product becomes a distance: with every vector lengthened by one component to the
greatest norm M, and queries by a zero, |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the highest
products are the nearest vectors. The index keys each vector by its nearest pivot (a cell) and
its distance to it; a cell's range of distances is cut into annuli, and large annuli into
slices of about ``UNIT`` vectors, stored as one packed row each. All vectors are indexed; only
the pivots and the annuli's borders come from a sample of at most ``SAMPLE`` vectors.

A query first visits the annuli nearest to its own distance, ``FIRST`` of them; its k-th best
product so far bounds what can still matter, and the search expands to exactly those annuli
that the triangle inequality does not exclude: an annulus [low, high] around pivot p holds
nothing nearer than max(low - |q - p|, |q - p| - high). Queries travel in blocks; a block meets
a slice only if one of its queries wants it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import dropped, written

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
PIVOTS, ANNULI, SAMPLE, UNIT, BLOCK, FIRST, SEED = 32, 8, 4096, 2048, 1024, 4, 3


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (floor(scale * component) as long integers) of the usable vectors.

    A vector that is null or empty, or has a null or non-finite component, takes no part; nor
    does one with a null vec_id, or with another length than the most frequent one.
    """
    x = F.col("embedding")
    usable = vectors.filter(F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    lengths = usable.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), "n").first()
    floor = lambda c: F.floor(c.cast("double") * scale).cast("bigint")
    return usable.filter(F.size(x) == (lengths["n"] if lengths else 0)).select(F.col("vec_id").cast("bigint"), F.transform(x, floor).alias("v"))


@dataclass
class Pivots:
    """Pivots (with the added component), greatest squared norm, and the borders of each cell's annuli."""

    at: np.ndarray
    norm: float
    borders: np.ndarray

    def distances(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        """Distance of each vector (or query) to each pivot."""
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(0.0, self.norm - (v * v).sum(axis=1)))
        squares = (v * v).sum(axis=1) + extra**2
        return np.sqrt(np.maximum(0.0, squares[:, None] + (self.at**2).sum(axis=1) - 2 * (v @ self.at[:, :-1].T + extra[:, None] * self.at[:, -1])))


def _matrix(column) -> np.ndarray:
    """The list column as a matrix; the products below are exact in doubles up to 2**53, and in long integers beyond."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS, annuli: int = ANNULI) -> Pivots | None:
    """Farthest-first pivots among a sample chosen by hash, and quantiles of the sample's distances as borders."""
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    norm = rows.agg(F.max(square)).first()[0]
    if norm is None:
        return None
    v = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE).select("v").collect()], float)
    full = np.column_stack([v, np.sqrt(np.maximum(0.0, norm - (v * v).sum(axis=1)))])
    chosen, gap = [0], ((full - full[0]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(full)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((full - full[chosen[-1]]) ** 2).sum(axis=1))
    made = Pivots(full[chosen], norm, np.zeros((len(chosen), annuli - 1)))
    d = made.distances(v)
    cell = d.argmin(axis=1)
    for p in range(len(chosen)):
        own = d[cell == p, p]
        made.borders[p] = np.quantile(own, np.linspace(0, 1, annuli + 1)[1:-1]) if len(own) else 0.0
    return made


def _keyed(shared):
    """vec_id, v with the cell and annulus (one number) and the distance to the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            if batch.num_rows:
                d = pivots.distances(_matrix(batch.column(1)).astype(float))
                cell = d.argmin(axis=1)
                own = d[np.arange(len(d)), cell]
                annulus = (own[:, None] >= pivots.borders[cell]).sum(axis=1)
                key = cell * (pivots.borders.shape[1] + 1) + annulus
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key.astype(np.int32)), pa.array(own)], names=["vec_id", "v", "annulus", "distance"])

    return run


def build_index(rows: DataFrame, pivots: Pivots) -> tuple[DataFrame, DataFrame]:
    """(units, annuli): packed slices (annulus, slice, n, ids, vectors), and each annulus with its least and greatest distance and number of slices."""
    keyed = written(rows.mapInArrow(_keyed(rows.sparkSession.sparkContext.broadcast(pivots)), "vec_id bigint, v array<bigint>, annulus int, distance double"), "keyed")
    annuli = written(keyed.groupBy("annulus").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).withColumn("slices", F.ceil(F.col("n") / UNIT)), "annuli")
    # A slice is a draw by hash, so the number of its vectors stays near UNIT even where very many are equal.
    sliced = keyed.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(annuli.select("annulus", "slices")), "annulus").withColumn("slice", F.pmod(F.xxhash64("vec_id", "row"), F.col("slices")).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def packed():
            ids, vectors = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([vectors.astype("<i8").tobytes()], pa.binary())], names=["annulus", "slice", "n", "ids", "vectors"])

        for batch in batches:
            annulus, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids, vectors = batch.column(2).to_numpy(), _matrix(batch.column(3))
            edges = [0, *(np.flatnonzero((annulus[1:] != annulus[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(ids)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    if key != (now := (int(annulus[a]), int(part[a]))) and held:
                        yield packed()
                        held = []
                    key = now
                    held.append((ids[a:b], vectors[a:b]))
        if held:
            yield packed()

    order = ["annulus", "slice"]
    ordered = sliced.select(*order, "vec_id", "v").repartition(*order).sortWithinPartitions(*order, "vec_id")
    units = written(ordered.mapInArrow(run, "annulus int, slice int, n int, ids binary, vectors binary"), "units")
    dropped(keyed)
    return units, annuli


def _wanted(shared, first: int, rest: bool):
    """Per query the annuli to visit: the ``first`` nearest, or (``rest``) the later ones that its k-th product does not exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, annulus, low, high, slices = shared.value
        cell = annulus // (pivots.borders.shape[1] + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1)).astype(float)
            d = pivots.distances(v, query=True)[:, cell]
            nearest = np.maximum(0.0, np.maximum(low - d, d - high))
            order = np.argsort(nearest, axis=1, kind="stable")
            rank = np.argsort(order, axis=1)
            if rest:
                worst = batch.column(2).to_numpy(zero_copy_only=False).astype(float)  # null (fewer than k so far): nothing is excluded
                reach = (v * v).sum(axis=1) + pivots.norm - 2 * worst
                visit = (rank >= first) & ~(nearest**2 > (reach * (1 + 1e-9) + 1e-6)[:, None])
            else:
                visit = rank < first
            query, at = np.nonzero(visit)
            times = slices[at]
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            query, at = np.repeat(query, times), np.repeat(at, times)
            for i in range(0, len(query), 20_000):
                q, a = query[i : i + 20_000], at[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(annulus[a]), pa.array(part[i : i + 20_000].astype(np.int32)), batch.column(0).take(pa.array(q))], names=["annulus", "slice", "query_id"])

    return run


def _scored(k: int):
    """Top k of each (slice, query block) pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                v = np.frombuffer(row["vectors"], "<i8").reshape(len(ids), -1)
                queries, asked = np.array(row["query_ids"], np.int64), np.array(row["queries"], np.int64)
                exact = float(np.abs(v).max(initial=0)) * float(np.abs(asked).max(initial=0)) * v.shape[1] < 2**53
                score = (asked.astype(float) @ v.T.astype(float)).astype(np.int64) if exact else asked @ v.T
                usable = queries[:, None] != ids[None, :]
                query, rank_id, best = [], [], []
                for q, s, u in zip(queries.tolist(), score, usable):
                    at = np.flatnonzero(u)
                    if len(at) > k:
                        least = np.partition(s[at], len(at) - k)[len(at) - k]
                        at = at[s[at] >= least]
                    at = at[np.lexsort((ids[at], -s[at]))[:k]]
                    query += [q] * len(at)
                    rank_id.append(ids[at])
                    best.append(s[at])
                if query:
                    yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(np.concatenate(rank_id)), pa.array(np.concatenate(best))], names=["query_id", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all other rows.

    Vectors are those of ``integers``; queries the usable ones that meet ``is_query`` (of
    repeated ids, one row). A row never meets a row of its own id; repeated candidates are each
    ranked. Ties go to the smaller vec_id. An empty table gives no row.
    """
    spark = vectors.sparkSession
    rows = written(integers(vectors, scale), "vectors")
    pivots = choose_pivots(rows)
    if pivots is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    units, annuli = build_index(rows, pivots)
    asked = written(rows.filter(is_query).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("v").alias("query")), "queries")
    # PIVOTS * ANNULI rows at most.
    known = annuli.orderBy("annulus").toPandas()
    shared = spark.sparkContext.broadcast((pivots, known["annulus"].to_numpy(np.int32), known["low"].to_numpy(), known["high"].to_numpy(), known["slices"].to_numpy(np.int64)))
    blocks = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() // BLOCK))))

    def visit(queries: DataFrame, rest: bool) -> DataFrame:
        wanted = queries.mapInArrow(_wanted(shared, FIRST, rest), "annulus int, slice int, query_id bigint")
        blocked = wanted.join(asked, "query_id").groupBy("annulus", "slice", blocks.alias("block")).agg(F.collect_list("query_id").alias("query_ids"), F.collect_list("query").alias("queries"))
        blocked = written(blocked, "blocks")
        met = blocked.join(units, ["annulus", "slice"]).select("ids", "vectors", "query_ids", "queries")
        # A row holds a slice and a block of queries, so few go to Python at a time.
        rows = spark.conf.get(BATCH)
        spark.conf.set(BATCH, "4")
        try:
            return written(_best(met.mapInArrow(_scored(k), "query_id bigint, vec_id bigint, score bigint"), k).select("query_id", "vec_id", "score"), "scores")
        finally:
            spark.conf.set(BATCH, rows)

    near = visit(asked.select("query_id", "query"), False)
    bound = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("worst"))
    far = visit(asked.join(bound, "query_id", "left").select("query_id", "query", F.col("worst").cast("double")), True)
    return _best(near.unionByName(far), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
