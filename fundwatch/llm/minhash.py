"""Links between texts whose distinct word shingles have at least a given Jaccard similarity.

Candidates come from MinHash bands; every link is verified on the texts' own distinct shingles.
Texts with equal shingle sets are one entry. A band's bucket is first walked as a chain (each
entry against the next, on the texts). In buckets that still hold several components, sizes and
signatures name the entries that may link to another component; these meet again with the 64-bit
hashes of their shingles, and the task that holds them counts exact similarities and hands on
only the links that join two components. What leaves a task is never more than what enters it:
no pairs are listed, however many there are, and no entry is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .scratch import written

#: Functions a band, chance that a pair at the threshold shares no band, entries of a bucket and shingles of suspects compared in one task.
ROWS, MISS, BUCKET, TOGETHER, SEED = 6, 1e-5, 20_000, 8_000_000, 42
#: Shingles whose sets a worker keeps while it verifies.
HELD = 400_000


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Another 64-bit hash of each hash (the finalizer of SplitMix64)."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words_per_shingle: int) -> set[bytes]:
    """Distinct word shingles; ASCII letters in lower case, words split at ASCII white space; fewer words are one shingle."""
    words = text.encode().lower().split() if text else []
    k = min(words_per_shingle, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def bands(similarity: float) -> int:
    """Bands so that a pair at ``similarity`` shares none with a chance of at most ``MISS``."""
    return max(1, ceil(log(MISS) / log(1 - similarity**ROWS))) if similarity < 1 else 1


def signature(own: set[bytes], n: int) -> np.ndarray:
    """Least values of ``n`` hash functions over the shingles (their upper 32 bits)."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in own), np.uint64, len(own))
    factors = mixed(np.arange(n, dtype=np.uint64)) | np.uint64(1)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        np.minimum(least, (factors[:, None] * hashes[None, i : i + 4096]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def _signed(words_per_shingle: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, signs = [], [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text, words_per_shingle)
                keys.append(xxhash.xxh3_128_digest(b"\n".join(sorted(own))))
                sizes.append(len(own))
                signs.append(signature(own, n).tobytes() if own else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())], names=["doc_id", "key", "size", "sign"])

    return run


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """value, rep, band: each entry under a hash of every band."""
    for batch in batches:
        if batch.num_rows:
            least = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(batch.num_rows, -1, ROWS).astype(np.uint64)
            value = np.broadcast_to(np.arange(least.shape[1], dtype=np.uint64), least.shape[:2])
            for i in range(ROWS):
                value = mixed(value ^ least[:, :, i])
            rep = batch.column(0).to_numpy(zero_copy_only=False)
            band = np.tile(np.arange(least.shape[1], dtype=np.int32), len(rep))
            yield pa.RecordBatch.from_arrays([pa.array(value.ravel().view(np.int64)), pa.array(np.repeat(rep, least.shape[1])), pa.array(band)], names=["value", "rep", "band"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: neighbours of a bucket, in rows sorted by value and rep."""
    before = None
    for batch in batches:
        if batch.num_rows:
            value, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if before is not None:
                value, rep = np.concatenate([before[0], value]), np.concatenate([before[1], rep])
            before = value[-1:], rep[-1:]
            at = np.flatnonzero((value[1:] == value[:-1]) & (rep[1:] != rep[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[at + 1])], names=["a", "b"])


def _grouped(keys: int):
    """The rows of each run of equal first ``keys`` columns, as a table, from batches sorted by them."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for x, y in zip(edges, edges[1:]):
                if held and not np.array_equal(key[x], last):
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                last = key[x]
                held.append(batch.slice(x, y - x))
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    return runs


def _suspects(similarity: float):
    """value, piece, rep, label, size: entries that sizes and signatures do not exclude from a link to another component.

    A pair counts in the first band it shares only, so it asks for its shingles in one bucket. Rows of band -1 (groups
    that are no buckets) count all their pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(2)(batches):
            label, size, band = (table.column(n).to_numpy() for n in ("label", "size", "band"))
            if (label == label[0]).all():
                continue
            sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), "<u4").reshape(len(label), -1)
            n = sign.shape[1]
            least = n * similarity - 5 * (n * similarity * (1 - similarity)) ** 0.5
            met = np.zeros(len(label), bool)
            for i in range(len(label) - 1):
                at = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & (np.minimum(size[i + 1 :], size[i]) >= similarity * np.maximum(size[i + 1 :], size[i]) - 1e-9))
                same = sign[at] == sign[i]
                at, same = at[same.sum(axis=1) >= least], same[same.sum(axis=1) >= least]
                if band[0] >= 0:
                    at = at[same.reshape(len(at), n // ROWS, ROWS).all(axis=2).argmax(axis=1) == band[0]]
                met[at] = True
                met[i] |= len(at) > 0
            yield from table.select(["value", "piece", "rep", "label", "size"]).filter(pa.array(met)).to_batches()

    return run


def _hashes(words_per_shingle: int):
    """node, hashes: the sorted 64-bit hashes of a text's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles(t, words_per_shingle)), np.uint64)).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["node", "hashes"])

    return run


def spanning(sets: list[np.ndarray], label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (positions) that join the components ``label`` of ``sets`` at a Jaccard similarity, each joining two that were apart.

    Every set is counted against all others at once through the lists of the sets that hold its
    members; nothing is kept of a pair that links nothing new.
    """
    size = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    holders = row[np.argsort(ids, kind="stable")]
    held = np.bincount(ids)
    starts = np.cumsum(held) - held
    ends = np.cumsum(size)
    label, links = np.unique(label, return_inverse=True)[1], []
    for i in range(len(sets)):
        if (label == label[0]).all():
            break
        own = ids[ends[i] - size[i] : ends[i]]
        n = held[own]
        place = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(holders[place], minlength=len(sets))
        for j in np.flatnonzero((both >= similarity * (size + size[i] - both) - 1e-9) & (label != label[i])).tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def _joined(similarity: float):
    """a, b: links between entries of a bucket that join two components; fewer than its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(3)(batches):
            rep, label = table.column("rep").to_numpy(), table.column("label").to_numpy()
            links = spanning([np.frombuffer(h, "<u8") for h in table.column("hashes").to_pylist()], label, similarity)
            ends = [sorted((int(rep[i]), int(rep[j]))) for i, j in links]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _verified(words_per_shingle: int, similarity: float):
    """a, b of the rows (a, b, text_a, text_b) whose shingles are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, set[bytes]] = {}
        held = 0

        def own(text: str) -> set[bytes]:
            nonlocal held
            if text not in kept:
                if held > HELD:
                    kept.clear()
                    held = 0
                kept[text] = shingles(text, words_per_shingle)
                held += len(kept[text])
            return kept[text]

        for batch in batches:
            found = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = own(x), own(y)
                both = len(x & y)
                if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    found.append(i)
            at = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return run


def _pieces(rows: DataFrame, parts: Column, name: str) -> DataFrame:
    """``rows`` with a piece number: where ``parts`` is above 2, a row goes to the pairs of its piece with every piece."""
    own = F.pmod(F.xxhash64(F.lit(name), "rep"), "_parts").cast("int")
    other = F.explode(F.when(F.col("_parts") > 2, F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(F.lit(-1))))
    piece = F.when(F.col("_other") < 0, 0).otherwise(F.least("_own", "_other") * F.col("_parts") + F.greatest("_own", "_other") + 1)
    dealt = rows.withColumn("_parts", F.greatest(F.lit(1), parts.cast("int"))).withColumn("_own", own).withColumn("_other", other)
    return dealt.withColumn(name, piece.cast("int")).drop("_parts", "_own", "_other")


def _across(candidates: DataFrame, found: DataFrame, known: DataFrame, texts: DataFrame, words_per_shingle: int, similarity: float) -> DataFrame | None:
    """a, b: links that join two of the components ``found`` inside the buckets or groups of ``candidates`` (value, rep, band, n); None without any."""
    label = F.coalesce("component", "rep").alias("label")
    labelled = written(candidates.filter("n > 2").join(found, F.col("rep") == F.col("node"), "left").select("value", "rep", "band", "n", label), "labelled")
    mixed_up = written(labelled.groupBy("value").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("value"), "open")
    if not mixed_up.take(1):
        return None
    rest = _pieces(labelled.join(mixed_up, "value"), F.ceil(2 * F.col("n") / BUCKET), "piece")
    rest = written(rest.select("value", "piece", "rep", "label", "band"), "rest")
    full = rest.join(known.select("rep", "size", "sign"), "rep").select("value", "piece", "rep", "label", "band", "size", "sign")
    ordered = full.repartition("value", "piece").sortWithinPartitions("value", "piece")
    suspects = written(ordered.mapInArrow(_suspects(similarity), "value bigint, piece int, rep bigint, label bigint, size bigint"), "suspects")
    asked = suspects.select(F.col("rep").alias("node")).distinct()
    hashed = written(texts.join(asked, "node", "left_semi").select("node", "text").mapInArrow(_hashes(words_per_shingle), "node bigint, hashes binary"), "hashes")
    weights = written(suspects.groupBy("value", "piece").agg(F.sum("size").alias("total")), "weights")
    parted = _pieces(suspects.join(weights, ["value", "piece"]), F.ceil(2 * F.col("total") / TOGETHER), "part")
    met = parted.join(hashed, F.col("rep") == F.col("node")).select("value", "piece", "part", "rep", "label", "hashes")
    met = met.repartition("value", "piece", "part").sortWithinPartitions("value", "piece", "part")
    joined = written(met.mapInArrow(_joined(similarity), "a bigint, b bigint").distinct(), "joined")
    return joined if joined.take(1) else None


def similar_components(docs: DataFrame, words_per_shingle: int, similarity: float, groups: DataFrame | None = None) -> DataFrame:
    """doc_id, component_id of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over pairs of texts whose distinct shingles have
    a Jaccard similarity of at least ``similarity``; texts without a word are alike. Rows with
    equal doc_id are one node of the links; a row with a null doc_id takes the component of its
    shingle set if another row has that one, else null. ``groups`` (doc_id, component_id), such as the
    components of SimHash, are chained like the buckets of a band, and after these the pairs of a group that are
    still apart are verified, whatever bands they share.
    """
    n = ROWS * bands(similarity)
    rows = written(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_signed(words_per_shingle, n), "doc_id bigint, key binary, size bigint, sign binary"), "signed")
    entries = written(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("sign").alias("sign")), "entries")
    known = entries.filter("rep is not null and size > 0")
    filed = written(known.select("rep", "sign").mapInArrow(_filed, "value bigint, rep bigint, band int"), "filed")
    buckets = written(filed.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    shared = written(filed.join(buckets, "value"), "shared")
    chained, members = shared.select("value", "rep"), None
    if groups is not None:
        # One entry a doc_id, so that a doc_id on many rows opens no pairs.
        named = rows.filter("doc_id is not null").join(entries.select("key", "rep"), "key").groupBy("doc_id").agg(F.min("rep").alias("rep"))
        members = groups.filter("component_id is not null").join(named, "doc_id").select(F.xxhash64(F.lit("group"), "component_id").alias("value"), "rep").distinct()
        members = members.join(members.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "value")
        members = written(members.select("value", "rep", F.lit(-1).alias("band"), "n"), "groups")
        chained = chained.unionByName(members.select("value", "rep"))
        chained = written(chained, "candidates")
    nodes = written(chained.select(F.col("rep").alias("node")).distinct(), "nodes")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), "text").filter("text is not null")
    texts = written(texts.join(nodes, "node", "left_semi").dropDuplicates(["node", "text"]), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        met = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
        return written(met.mapInArrow(_verified(words_per_shingle, similarity), "a bigint, b bigint").distinct(), "verified")

    chain = chained.repartitionByRange("value", "rep").sortWithinPartitions("value", "rep")
    tested = written(chain.mapInArrow(_chained, "a bigint, b bigint").distinct(), "chained")
    links = verified(tested)
    found = components(links)
    for candidates in (shared, members) if members is not None else (shared,):
        joined = _across(candidates, found, known, texts, words_per_shingle, similarity)
        if joined is not None:
            links = links.unionByName(joined)
            found = components(links)
    named = written(entries.join(found, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("component_id")), "members")
    return rows.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")
