"""Benchmark items inside documents: MinHash containment search by item size, then exact containment.

The MinHash of a whole document says little about a short item in it: for an item of 30
shingles in a document of 3,000 the two sets' Jaccard similarity is about 0.01. The search is
therefore asymmetric. Items are partitioned by size (powers of two of their shingles). An
item's signature is its smallest shingle hashes, as many as its partition needs: at the
containment threshold none of them is in the document with a probability of at most ``MISS``
(0 for the small partitions, where the signature outnumbers the shingles that may be absent).
That holds whatever the document's length, so a document is only probed for the minima, each
of its shingles once. A document with at least one is compared with the item exactly, as sets
of word tuples. Benchmarks are taken in blocks of bounded size, one pass a block.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MISS, WORDS, CONTAINMENT = 1e-12, 5, 0.8
#: Bytes of item text in a block; a longer item has a block of its own.
BLOCK_BYTES = 16 << 20
_TABLE = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII characters other than letters and digits separate them."""
    return text.lower().encode().translate(_TABLE).split() if text else []


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """64-bit hashes of the k-word shingles, in order, repeats included."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ codes[i : i + n]) * _ODD
        out ^= out >> np.uint64(29)
    return out


@lru_cache(maxsize=None)
def minima_wanted(largest: int, threshold: float) -> int:
    """Minima after which an item of at most ``largest`` shingles, at the threshold, is missed with a probability of at most ``MISS``."""
    absent, miss, n = ceil((1 - threshold) * largest - 1e-9), 1.0, 0
    while miss > MISS and n < largest:
        miss *= max(0, absent - n) / (largest - n)
        n += 1
    return n


def signature(hashes: np.ndarray, minima: int) -> np.ndarray:
    """The shingles with the smallest values of one mixing function: a random draw without repeats, the same wherever a shingle occurs."""
    found = np.unique(hashes)
    mixed = (found ^ (found >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return found[np.argsort((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F))[:minima]]


class ItemIndex:
    """A block of items by words per shingle (5; for shorter items, their own number of words) and size partition."""

    def __init__(self, items: list[tuple], k: int, threshold: float):
        self.threshold, self.sets, at = threshold, {}, defaultdict(lambda: defaultdict(list))
        for number, (item, text) in enumerate(items):
            words = words_of(text)
            if not words:
                continue
            size = min(k, len(words))
            self.sets[number] = (item, size, {tuple(words[i : i + size]) for i in range(len(words) - size + 1)})
            largest = (1 << len(self.sets[number][2]).bit_length()) - 1  # of its size partition
            for h in signature(shingle_hashes(words, size), minima_wanted(largest, threshold)).tolist():
                at[size][h].append(number)
        self.by_size = {}
        for size, entries in at.items():
            values = np.array(sorted(entries), np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[values >> np.uint64(44)] = True
            self.by_size[size] = (seen, values, entries)

    def find(self, text: str | None) -> list[tuple]:
        """(item, containment, shingles in common, shingles of the item) of the items that the text contains."""
        words, near = words_of(text), set()
        for size, (seen, values, entries) in self.by_size.items():
            hashes = shingle_hashes(words, size)
            hashes = hashes[seen[hashes >> np.uint64(44)]]
            if len(hashes):
                for h in np.unique(hashes[np.isin(hashes, values)]).tolist():
                    near.update(entries[h])
        own: dict[int, set] = {}
        out = []
        for number in sorted(near):
            item, size, wanted = self.sets[number]
            if size not in own:
                own[size] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
            common = len(wanted & own[size])
            if common >= self.threshold * len(wanted) - 1e-9:
                out.append((item, common / len(wanted), common, len(wanted)))
        return out


def _search(shared, k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(shared.value, k, threshold)
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in index.find(text)]
            if rows:
                doc, item, share, common, size = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(share, pa.float64()), pa.array(common, pa.int64()), pa.array(size, pa.int64())], names=["doc_id", "item_id", "containment", "shared", "shingles"])

    return run


def item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Items (item_id, text), streamed to the driver and cut into blocks of at most ``BLOCK_BYTES`` of text."""
    block, held = [], 0
    for row in items.select("item_id", "text").filter(F.length("text") > 0).distinct().toLocalIterator(prefetchPartitions=True):
        size = len(row["text"].encode())
        if block and held + size > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += size
    if block:
        yield block


def contained_items(docs: DataFrame, items: DataFrame, k: int = WORDS, threshold: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, containment, shared, shingles for each document that has at least ``threshold`` of an item's shingles.

    An item of fewer than ``k`` words has one shingle of all its words; null and empty items
    are in no document, null and empty documents contain nothing. A repeated row gives its
    rows again; a repeated item counts once, items of one id and different texts are all
    looked for. Other columns are ignored; an empty table on either side gives no row.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    schema = "doc_id bigint, item_id bigint, containment double, shared bigint, shingles bigint"
    for block in item_blocks(items):
        found = rows.mapInArrow(_search(spark.sparkContext.broadcast(block), k, threshold), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_items(docs: DataFrame, items: DataFrame, k: int = WORDS, threshold: float = CONTAINMENT) -> DataFrame:
    """``docs`` (all columns) without the rows whose text contains an item. Rows are judged one by one, by their text."""
    spark, out = docs.sparkSession, docs
    at = docs.columns.index("text")
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, k, threshold)
            for batch in batches:
                yield batch.filter(pa.array([not index.find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
