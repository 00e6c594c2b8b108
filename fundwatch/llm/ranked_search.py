"""Ranked lexical search: the best documents for many queries, by bounds from hashed max-sketches.

A term's impact in a document is its weight times a saturated frequency, and a document's score
the sum of the impacts of the query's terms. A document is folded into a sketch of ``WIDTH``
cells: every term falls into a cell by its hash, and a cell keeps the greatest impact in it. For
any query, the cells of its terms add up to at least the score. Tasks fold their documents into
blocks of sketches, look up all queries of a batch in a block at once, and rescore documents
exactly in descending order of the bound until the bound falls below the query's k-th score so
far; each task hands on k rows a query.

Queries come in batches whose distinct terms, with their places in the queries, take at most
``BATCH_BYTES`` (unless one query alone is larger), so what a batch broadcasts is bounded, and
each batch removes what it wrote. Terms that no query of the batch holds cannot add to a score
and are counted in lengths only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import dropped, written

#: Cells of a sketch; documents and entries (term, document) of a block; documents rescored at once; bytes of a batch of queries.
WIDTH, BLOCK, ENTRIES, STEP, BATCH_BYTES = 1024, 4096, 1 << 21, 32, 8 << 20
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
FOUND = "item_id bigint, doc_id bigint, score bigint"


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z become small."""
    return _TERM.findall(text.encode().lower()) if text else []


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item; rows with equal item_id (null too) are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(set(terms(t))) for t in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(own)), [len(o) for o in own])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([t for o in own for t in o], pa.binary())], names=["item_id", "term"])

    return items.select(F.col("item_id").cast("bigint"), "text").mapInArrow(run, "item_id bigint, term binary").distinct()


@dataclass
class Batch:
    """Queries as lists of term numbers, with the terms' sketch cells; weights follow once the documents are counted."""

    items: list[int | None]
    members: list[np.ndarray]
    numbers: dict[bytes, int]
    cells: np.ndarray
    weights: np.ndarray | None = None
    documents: int = 0
    length: int = 0

    @classmethod
    def of(cls, rows: DataFrame, width: int) -> Batch:
        got = rows.orderBy("item_id", "term").collect()
        numbers: dict[bytes, int] = {}
        members: dict[int | None, list[int]] = {}
        for r in got:
            members.setdefault(r["item_id"], []).append(numbers.setdefault(bytes(r["term"]), len(numbers)))
        cells = np.array([xxhash.xxh64_intdigest(t) % width for t in numbers], np.int64)
        return cls(list(members), [np.array(sorted(m), np.int64) for m in members.values()], numbers, cells)


def _counted(shared):
    """doc_id, n (terms with repeats), and the numbers and frequencies of the batch's terms, in ascending numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for batch in batches:
            rows, lengths, ends, ids, times = [], [], [0], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = terms(text)
                if own:
                    hits = sorted((numbers[t], c) for t, c in Counter(own).items() if t in numbers)
                    rows.append(i)
                    lengths.append(len(own))
                    ids.extend(h for h, _ in hits)
                    times.extend(c for _, c in hits)
                    ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(c, pa.int32())) for c in (ids, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "ids", "times"])

    return run


class _Block:
    """Documents with their impacts by (document, term number), and their sketches."""

    def __init__(self, queries: Batch, parts: list[tuple], width: int):
        self.terms = len(queries.numbers)
        self.docs = [d for p in parts for d in p[0]]
        held = np.concatenate([p[2] for p in parts])
        ids, times = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (3, 4))
        at = np.repeat(np.arange(len(self.docs)), held)
        # Python integers: 90 n N may exceed 64 bits.
        norm = np.array([10 + 90 * n * queries.documents // queries.length for p in parts for n in p[1]], np.int64)
        self.impacts = queries.weights[ids] * (1_000_000_000 * times // (1000 * times + 8 * norm[at]))
        self.keys = at * self.terms + ids
        self.sketch = np.zeros((width, len(self.docs)), np.int64)
        np.maximum.at(self.sketch, (queries.cells[ids], at), self.impacts)

    def bounds(self, cells: np.ndarray) -> np.ndarray:
        return self.sketch[cells].sum(axis=0)

    def scores(self, docs: np.ndarray, members: np.ndarray) -> np.ndarray:
        wanted = docs[:, None] * self.terms + members
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[place] == wanted, self.impacts[place], 0).sum(axis=1)


def _search(block: _Block, queries: Batch, best: list[list[tuple]], k: int) -> None:
    """Bring the k best rows (-score, null id last, id) of every query up to date with a block."""
    if not len(block.keys):
        return
    for q, members in enumerate(queries.members):
        bound = block.bounds(queries.cells[members])
        least = -best[q][-1][0] if len(best[q]) == k else 1
        near = np.flatnonzero(bound >= max(least, 1))
        near = near[np.argsort(-bound[near], kind="stable")]
        for i in range(0, len(near), STEP):
            # Equal scores go by id, so a bound that equals the k-th score may still matter.
            if len(best[q]) == k and bound[near[i]] < -best[q][-1][0]:
                break
            some = near[i : i + STEP]
            score = block.scores(some, members)
            new = [(-int(s), block.docs[d] is None, block.docs[d] or 0) for d, s in zip(some.tolist(), score.tolist()) if s > 0]
            best[q] = sorted(best[q] + new)[:k]


def _searched(shared, k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Batch = shared.value
        best: list[list[tuple]] = [[] for _ in queries.items]
        parts, docs, entries = [], 0, 0
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                piece = batch.slice(done, BLOCK - docs)
                held = piece.column(2).value_lengths().to_numpy()
                fits = max(1, int(np.searchsorted(np.cumsum(held), ENTRIES - entries, side="right"))) if not parts else int(np.searchsorted(np.cumsum(held), ENTRIES - entries, side="right"))
                piece, held = piece.slice(0, fits), held[:fits]
                if fits:
                    parts.append((piece.column(0).to_pylist(), piece.column(1).to_pylist(), held, piece.column(2).flatten().to_numpy(), piece.column(3).flatten().to_numpy()))
                done, docs, entries = done + fits, docs + fits, entries + int(held.sum())
                if docs == BLOCK or entries >= ENTRIES or done < batch.num_rows:
                    _search(_Block(queries, parts, width), queries, best, k)
                    parts, docs, entries = [], 0, 0
        if parts:
            _search(_Block(queries, parts, width), queries, best, k)
        rows = [(item, None if missing else doc, -score) for item, own in zip(queries.items, best) for score, missing, doc in own]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _searched_batch(docs: DataFrame, queries: Batch, k: int, width: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    numbers = context.broadcast(queries.numbers)
    counted = written(docs.mapInArrow(_counted(numbers), "doc_id bigint, n bigint, ids array<int>, times array<int>"), "counted")
    queries.documents, length = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    queries.length = length or 0
    found = np.zeros(len(queries.numbers), np.int64)
    for r in counted.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
        found[r["id"]] = r["count"]
    queries.weights = np.array([floor(1000 * log((2 * queries.documents + 2) / (2 * int(n) + 1))) for n in found], np.int64)
    shared = context.broadcast(queries)
    rows = written(_best(counted.mapInArrow(_searched(shared, k, width), FOUND), k), "best")
    numbers.destroy()
    shared.destroy()
    dropped(counted)
    return rows


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, width: int = WIDTH, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best rows of ``docs`` (doc_id, text) with a score above 0 for each item (item_id, text).

    Every row of ``docs`` is a document of its own, whatever its id; equal scores go by ascending
    doc_id, a null one last. A null or empty text, or one without a term, is no document: it
    counts in no statistic and is never found. Rows with equal item_id, null among them, are one
    item with all their terms; an item without a term has no rows. Empty tables give no rows, and
    other columns are left out. Counts and weights are those of all documents.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    wanted = written(query_terms(items), "terms")
    size = wanted.agg(F.sum(F.length("term") + 24)).first()[0] or 0
    batches = max(1, ceil(2 * size / batch_bytes)) if size > batch_bytes else 1
    part = F.pmod(F.xxhash64("item_id"), F.lit(batches))
    out = None
    for i in range(batches):
        queries = Batch.of(wanted.filter(part == i), width)
        if queries.items:
            rows = _searched_batch(docs, queries, k, width)
            out = rows if out is None else out.unionByName(rows)
    dropped(wanted)
    out = spark.createDataFrame([], FOUND + ", rank int") if out is None else out
    return out.select("item_id", F.col("rank").cast("int"), "doc_id", "score")
