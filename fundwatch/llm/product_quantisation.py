"""Near-duplicate vectors: inverted lists of residual product codes, table-lookup distances, exact cosines.

Equal vectors are one entry with a weight. Entries are scaled to unit length, where a cosine of
at least s is a distance of at most delta = sqrt(2 - 2 s). An entry's home is the list of its
nearest centroid; there it is also a query. It is filed as a guest in every other list whose
border it is near: within the margin that catches ``RECALL`` of partners at exactly the threshold
in random directions, measured on the sample, and never beyond delta, which catches all. In its
list an entry is a code: the nearest codeword of its residual in each of ``SUBSPACES`` subspaces,
with the length e of what the code leaves out. A query's distances to all codes are sums of table
entries, and by the triangle inequality a pair can link only if that distance is at most delta + e;
what remains is decided by the exact cosine in doubles.

Members of a list within half the threshold's angle of its centroid all link with each other and
are counted without being compared. Large lists are cut into pieces and compared in pairs of
pieces. A task hands on one count a member and the links that join components, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .scratch import dropped, written

#: Bounds of the training sample, entries a list aims at, most lists, codes, entries of a list compared in one task, queries at once, partners to catch.
SAMPLE, SAMPLE_BYTES, LIST, LISTS, SUBSPACES, WORDS, PIECE, STEP, RECALL = 16_384, 16 << 20, 512, 2048, 8, 256, 4096, 256, 0.999
FILED = "list int, k1 bigint, k2 bigint, rep bigint, weight bigint, home int, lists array<int>, core boolean, code binary, left float, v array<{}>"
FOUND = "k1 bigint, k2 bigint, n bigint, a bigint, b bigint"


def _vectors(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _units(v: np.ndarray) -> np.ndarray:
    """Scaled by the greatest component first: squares of very large or small ones would leave the doubles."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T)


def _means(x: np.ndarray, k: int, rounds: int, draw: np.random.Generator) -> np.ndarray:
    """k-means from ``k`` drawn rows; a centre without rows stays where it is."""
    centres = x[draw.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _squares(x, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Index:
    """Centroids, codewords by subspace, the similarity and the margin at a list's border."""

    centroids: np.ndarray
    words: list[np.ndarray]
    similarity: float
    margin: float = 0.0

    @property
    def delta(self) -> float:
        return (2 - 2 * self.similarity) ** 0.5

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid, and for every list the distance to its border with the home list (negative at home)."""
        squares = _squares(x, self.centroids)
        home = squares.argmin(axis=1)
        between = np.sqrt(_squares(self.centroids, self.centroids))[home]
        own = squares[np.arange(len(x)), home][:, None]
        border = np.divide(squares - own, 2 * between, out=np.where(squares > own, np.inf, 0.0), where=between > 0)
        border[np.arange(len(x)), home] = -1.0
        return home, border

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.words), axis=1)

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of what they leave out."""
        codes, left = np.zeros((len(residuals), len(self.words)), np.uint8), np.zeros(len(residuals))
        for m, (part, words) in enumerate(zip(self.parts(residuals), self.words)):
            codes[:, m] = _squares(part, words).argmin(axis=1)
            left += ((part - words[codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(left)

    def tables(self, residuals: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each query's parts to all codewords."""
        return [_squares(part, words).astype(np.float32) for part, words in zip(self.parts(residuals), self.words)]


def train(entries: DataFrame, dim: int, similarity: float, recall: float = RECALL, lists: int | None = None) -> Index:
    """The index of ``entries`` (k1, k2, v), learned from at most ``SAMPLE`` of them, the first by hash."""
    size = min(SAMPLE, max(WORDS, SAMPLE_BYTES // (8 * dim)))
    got = entries.orderBy("k1", "k2").limit(size).select("v").toArrow()
    x = _units(_vectors(got.column(0).combine_chunks()))
    draw = np.random.default_rng(42)
    wanted = entries.count() // LIST if lists is None else lists
    centroids = _means(x, max(1, min(wanted, LISTS, len(x) // 8)), 8, draw)
    few = x[draw.permutation(len(x))[: 16 * WORDS]]
    residuals = few - centroids[_squares(few, centroids).argmin(axis=1)]
    words = [_means(part, min(WORDS, len(part)), 6, draw) for part in np.array_split(residuals, min(SUBSPACES, dim), axis=1)]
    index = Index(centroids, words, similarity)
    # Partners at the threshold, in random directions at right angles to the vector.
    aside = draw.normal(size=few.shape)
    aside -= (aside * few).sum(axis=1, keepdims=True) * few
    aside /= np.maximum(1e-300, np.sqrt((aside * aside).sum(axis=1, keepdims=True)))
    partner = _units(similarity * few + (1 - similarity**2) ** 0.5 * aside)
    (home, border), (other, back) = index.places(few), index.places(partner)
    at = np.arange(len(few))
    index.margin = min(index.delta, max(0.0, float(np.quantile(np.minimum(border[at, other], back[at, home]), recall))))
    return index


def _filed(shared):
    """Every entry under its home list and under the lists whose border is near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        half = 0.5 * np.arccos(index.similarity) - 1e-6
        heart = index.centroids / np.maximum(1e-300, np.sqrt((index.centroids**2).sum(axis=1, keepdims=True)))
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                x = _units(_vectors(batch.column(4)))
                home, border = index.places(x)
                row, place = np.nonzero(border <= index.margin)
                ends = np.cumsum(np.bincount(row, minlength=len(x)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(place, pa.int32()))
                codes, left = index.encode(x[row] - index.centroids[place])
                core = (home[row] == place) & ((x[row] * heart[place]).sum(axis=1) >= np.cos(half))
                take = pa.array(row)
                k1, k2, rep, weight, v = (batch.column(i).take(take) for i in range(5))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place, pa.int32()), k1, k2, rep, weight, pa.array(home[row], pa.int32()), lists.take(take), pa.array(core), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left.astype(np.float32)), v],
                    names=["list", "k1", "k2", "rep", "weight", "home", "lists", "core", "code", "left", "v"])

    return run


class _Piece:
    """Rows of a list that one task compares."""

    def __init__(self, batches: list[pa.RecordBatch], index: Index, place: int, first: int, second: int):
        table = pa.Table.from_batches(batches).combine_chunks()
        column = lambda name: table.column(name).chunk(0)
        self.k1, self.k2, self.weight, home, self.left, own = (column(n).to_numpy() for n in ("k1", "k2", "weight", "home", "left", "own"))
        self.core, self.rep = column("core").to_numpy(zero_copy_only=False), column("rep").to_pylist()
        self.x = _units(_vectors(column("v")))
        self.codes = np.frombuffer(b"".join(column("code").to_pylist()), np.uint8).reshape(len(self.x), -1)
        self.own, self.at_home, self.home, self.index, self.place, self.sides = own, home == place, home, index, place, (first, second)
        lists = column("lists")
        self.filed = np.repeat(np.arange(len(home)), lists.value_lengths().to_numpy()) * len(index.centroids) + lists.flatten().to_numpy()
        self.counts, self.label = np.zeros(len(home), np.int64), np.arange(len(home))
        self.links: list[tuple[int, int]] = []

    def compare(self) -> None:
        """All pairs of the two pieces (or within the one), a member of the list at least on one side."""
        first, second = self.sides
        one, two = self.own == first, self.own == second
        self._queries(np.flatnonzero(one & self.at_home), np.flatnonzero(two))
        if first != second:
            self._queries(np.flatnonzero(two & self.at_home), np.flatnonzero(one & ~self.at_home))

    def _queries(self, queries: np.ndarray, entries: np.ndarray) -> None:
        codes = self.codes[entries].T.astype(np.intp)
        limit = (self.index.delta + self.left[entries].astype(float) + 1e-3) ** 2
        for start in range(0, len(queries), STEP):
            q = queries[start : start + STEP]
            squares = np.zeros((len(q), len(entries)), np.float32)
            for table, code in zip(self.index.tables(self.x[q] - self.index.centroids[self.place]), codes):
                squares += table[:, code]
            near = squares <= limit
            # Members of the core are counted together; a pair of members of one piece is met from its first.
            near &= ~(self.core[q][:, None] & self.core[entries])
            near &= ~(self.at_home[entries] & (self.own[entries] == self.own[q][:, None]) & (entries <= q[:, None]))
            u, v = np.nonzero(near)
            u, v = q[u], entries[v]
            for i in range(0, len(u), 1 << 16):
                self._decide(u[i : i + (1 << 16)], v[i : i + (1 << 16)])

    def _decide(self, u: np.ndarray, v: np.ndarray) -> None:
        linked = np.einsum("ij,ij->i", self.x[u], self.x[v]) >= self.index.similarity
        u, v = u[linked], v[linked]
        np.add.at(self.counts, u, self.weight[v])
        # A guest's home list sees the pair as well if the member is its guest; otherwise it is counted here.
        here = self.at_home[v] | ~np.isin(u * len(self.index.centroids) + self.home[v], self.filed)
        np.add.at(self.counts, v[here], self.weight[u[here]])
        apart = self.label[u] != self.label[v]
        for x, y in zip(u[apart].tolist(), v[apart].tolist()):
            p, q = self.label[x], self.label[y]
            if p != q:
                self.label[self.label == max(p, q)] = min(p, q)
                self.links.append((x, y))

    def rows(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.counts)
        ends = [(self.rep[x], self.rep[y]) for x, y in self.links if self.rep[x] is not None and self.rep[y] is not None]
        none, zero = [None] * len(ends), [None] * len(at)
        columns = [self.k1[at].tolist() + none, self.k2[at].tolist() + none, self.counts[at].tolist() + none, zero + [a for a, _ in ends], zero + [b for _, b in ends]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k1", "k2", "n", "a", "b"])


def _compared(shared):
    """Counts and spanning links of each (list, first piece, second piece), in rows sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key: tuple[int, int, int] | None = None

        def found() -> pa.RecordBatch:
            piece = _Piece(held, shared.value, *key)
            piece.compare()
            return piece.rows()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for x, y in zip(edges, edges[1:]):
                here = tuple(keys[x].tolist())
                if held and here != key:
                    yield found()
                    held = []
                key = here
                held.append(batch.slice(x, y - x))
        if held:
            yield found()

    return run


def _links(entries: DataFrame, dim: int, similarity: float, recall: float, lists: int | None) -> DataFrame:
    """Rows (k1, k2, n) of linked weight and (a, b) of spanning links of the entries of one length."""
    context = entries.sparkSession.sparkContext
    shared = context.broadcast(train(entries, dim, similarity, recall, lists))
    kind = entries.schema["v"].dataType.elementType.simpleString()
    filed = written(entries.select("k1", "k2", "rep", "weight", "v").mapInArrow(_filed(shared), FILED.format(kind)), "filed")
    sizes = written(filed.groupBy("list").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("core"), F.col("weight"))).alias("core_weight"), F.min(F.when(F.col("core"), F.col("rep"))).alias("anchor")), "sizes")
    together = filed.filter("core").select("list", "k1", "k2", "rep", "weight").join(sizes, "list")
    counted = together.select("k1", "k2", (F.col("core_weight") - F.col("weight")).alias("n"), F.col("rep").alias("a"), F.col("anchor").alias("b"))
    # Above PIECE, a row goes to the pairs of its piece with every piece of the list.
    parts = filed.join(sizes.select("list", F.ceil(F.col("rows") / PIECE).cast("int").alias("parts")), "list")
    own = parts.withColumn("own", F.pmod(F.xxhash64("k1", "k2"), "parts").cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = other.select("list", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "k1", "k2", "rep", "weight", "home", "lists", "core", "code", "left", "v")
    total = sizes.agg(F.sum(F.col("rows") * F.ceil(F.col("rows") / PIECE))).first()[0] or 0
    tasks = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(total / PIECE))
    ordered = rows.repartition(tasks, "list", "first", "second").sortWithinPartitions("list", "first", "second")
    found = written(ordered.mapInArrow(_compared(shared), FOUND).unionByName(counted), "found")
    shared.destroy()
    for table in (filed, sizes):
        dropped(table)
    return found


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine, F.lit(False))


def near_duplicates(vectors: DataFrame, similarity: float = 0.95, recall: float = RECALL, lists: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding).

    Two rows link if their vectors have equal length and a cosine of at least ``similarity``
    (between 0 and 1); n_links counts other rows. No wrong pair is linked; ``recall`` is the share
    of partners at the threshold itself that the lists are made to catch, in random directions;
    nearer partners are caught more often. A vector that is null, empty or zero, or holds a null or
    non-finite component, links with nothing. component_id is the smallest vec_id reachable, the
    row's own included; usable vectors under one vec_id are one node. A row with a null vec_id counts
    in n_links, takes the component of the rows with the same vector or null, and is kept nowhere.
    Every length is searched by itself. Other columns are left out.
    """
    if not 0 < similarity < 1:
        raise ValueError("the similarity must lie between 0 and 1")
    real = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    given = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast(f"array<{real}>").alias("v"))
    fine = F.when(_usable(F.col("v")), F.col("v"))
    keyed = given.select("vec_id", fine.alias("v")).withColumns({"k1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "k2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))})
    rows = written(keyed.select("vec_id", "k1", "k2"), "rows")
    entries = written(keyed.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v")), "entries")
    found = [_links(entries.filter(F.size("v") == r["dim"]), r["dim"], similarity, recall, lists) for r in entries.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect()]
    known = entries.select("k1", "k2", "rep", "weight")
    counts, links = known.select("k1", "k2", F.lit(0).cast("bigint").alias("n")), None
    for part in found:
        counts = counts.unionByName(part.filter("k1 is not null").select("k1", "k2", "n"))
        links = part.select("a", "b") if links is None else links.unionByName(part.select("a", "b"))
    summed = counts.groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    named = known.join(summed, ["k1", "k2"])
    if links is None:
        named = named.withColumn("component", F.lit(None).cast("bigint"))
    else:
        key = F.struct("k1", "k2")
        several = written(rows.filter("k1 is not null and vec_id is not null").groupBy("vec_id").agg(F.min(key).alias("x"), F.max(key).alias("y")).filter("x <> y").select("vec_id"), "several")
        same = rows.join(several, "vec_id").join(known, ["k1", "k2"]).select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
        named = named.join(components(links.unionByName(same)), F.col("rep") == F.col("node"), "left")
    named = written(named.select("k1", "k2", (F.col("n") + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "named")
    joined = rows.filter("k1 is not null").join(named, ["k1", "k2"]).unionByName(rows.filter("k1 is null").withColumns({"n_links": F.lit(0).cast("bigint"), "component": F.col("vec_id")}))
    return joined.select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))
