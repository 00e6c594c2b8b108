"""Shards of nearly equal bytes by sampled splitters.

Equal texts form a group and stay together. The steps, all on rows of ids and sizes:

1. Groups are summed by text hash; one whose bytes exceed a shard's share is given up as a
   group, and its rows are placed one by one. Groups above a hundredth of a share (at most
   100 a shard, so few) are dealt first, the largest to the emptiest shard.
2. The others are put in order of their key. A size-weighted sample of keys is drawn by a
   hash, and the quantiles of the sample split the key range into ``RANGES`` parts.
3. Bytes are summed by range, then along each range; a range that is overfull for the shard it
   starts in is subdivided where the running sum passes the shard's share. A shard's place for
   dealt groups is left free, so all shards end within a hundredth of a share of each other.

Only key, size and row number are shuffled, never texts.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import written

RANGES, SAMPLES, SEED = 384, 32, 5


def row_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8


def splitters(items: DataFrame, total: int, ranges: int = RANGES, samples: int = SAMPLES) -> list[tuple]:
    """At most ``ranges`` - 1 keys (h, row) between which the items (h, row, bytes) have nearly equal bytes.

    An item is drawn with a probability of its bytes over ``total``, times the ``ranges`` *
    ``samples`` keys wanted; every (samples)-th key of the ordered sample is a splitter.
    """
    draw = F.xxhash64("h", "row", F.lit(SEED)).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    wanted = items.filter(draw < F.col("bytes") * (ranges * samples / max(1, total))).select("h", "row")
    number = F.row_number().over(Window.orderBy("h", "row"))
    size = wanted.count()
    step = max(1, size // ranges)
    return [(r["h"], r["row"]) for r in wanted.select("h", "row", number.alias("n")).filter((F.col("n") % step == 0) & (F.col("n") < size)).orderBy("h", "row").collect()]


def range_of(keys: list[tuple]) -> Column:
    """Number of splitters at or below the key (h, row): looked up by h in steps of the square root, then key by key."""
    if not keys:
        return F.lit(0)
    step = max(1, int(len(keys) ** 0.5))
    blocks = [keys[i : i + step] for i in range(0, len(keys), step)]
    below = lambda key: (F.col("h") > key[0]) | ((F.col("h") == key[0]) & (F.col("row") >= key[1]))
    as_int = lambda c: c.cast("int")
    block = sum((as_int(below(b[0])) for b in blocks), F.lit(0))
    literal = F.array(*(F.array(*(F.struct(F.lit(h).alias("h"), F.lit(r).alias("row")) for h, r in b)) for b in blocks))
    key = F.struct(F.col("h"), F.col("row"))
    inside = F.when(block > 0, F.size(F.filter(F.element_at(literal, block), lambda s: s <= key)) + (block - 1) * step)
    return F.coalesce(inside, F.lit(0))


def assign(docs: DataFrame, shards: int = 24, ranges: int = RANGES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs`` (doc_id, text).

    size: see ``row_size``; text_crc32: unsigned, of the UTF-8 text (null: of nothing); slot
    counts each shard's rows from 0 without gaps. Rows are told apart by their place, so
    repeated or null doc_ids keep their rows; null and empty texts are two groups. Other
    columns are ignored; an empty table gives no row.
    """
    rows = written(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), row_size().alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("bigint").alias("text_crc32"),
            F.coalesce(F.xxhash64("text", F.lit(SEED)), F.lit(0)).alias("h"), F.col("text").isNull().alias("none"), F.monotonically_increasing_id().alias("row"),
        ), "rows")
    group = ["h", "text_crc32", "size", "none"]
    groups = written(rows.groupBy(group).agg(F.sum("size").alias("bytes"), F.min("row").alias("row")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    share = total / shards
    # At most 100 groups a shard are above a hundredth of its share.
    large = groups.filter(F.col("bytes") > share / 100).orderBy(F.desc("bytes"), "h", "row").select(*group, "bytes").collect()
    loads, dealt, scattered = [(0, s) for s in range(shards)], [], []
    for g in large:
        if g["bytes"] > share:
            scattered.append((*g[:4], -1))
        else:
            load, s = heapq.heappop(loads)
            heapq.heappush(loads, (load + g["bytes"], s))
            dealt.append((*g[:4], s))
    fixed = {s: load for load, s in loads}
    spark = docs.sparkSession
    placed = F.broadcast(spark.createDataFrame(dealt + scattered, "h bigint, text_crc32 bigint, size bigint, none boolean, fixed int"))
    # Items in key order: small groups whole, rows of scattered groups one by one.
    small = groups.join(placed, group, "left_anti").select("h", "row", "bytes")
    loose = rows.join(placed.filter("fixed < 0"), group, "left_semi").select("h", "row", F.col("size").alias("bytes"))
    items = small.unionByName(loose)
    keys = splitters(items, total, ranges)
    ranged = written(items.select("*", range_of(keys).alias("range")), "items")
    # A shard's room begins where the room of the shards before it ends.
    room = [max(0.0, share - fixed[s]) for s in range(shards)]
    free = ranged.agg(F.sum("bytes")).first()[0] or 0
    scale, ends, end = (free / sum(room) if sum(room) else 1.0), [], 0.0
    for r in room:
        end += r * scale
        ends.append(end)
    sums = ranged.groupBy("range").agg(F.sum("bytes").alias("n"))
    base = F.broadcast(sums.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("base")))
    along = F.sum("bytes").over(Window.partitionBy("range").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = F.col("base") + F.col("along") - F.col("bytes") / 2
    shard = F.least(F.lit(shards - 1), sum(((middle >= e).cast("int") for e in ends[:-1]), F.lit(0)))
    settled = written(ranged.withColumn("along", along).join(base, "range").select("h", "row", "range", shard.cast("int").alias("shard")), "settled")
    # Rows of dealt groups, of scattered groups, and of small groups through the group's item.
    whole = rows.join(placed.filter("fixed >= 0"), group).select("doc_id", "size", "text_crc32", F.col("fixed").alias("shard"), (F.lit(ranges) + F.col("row") % ranges).cast("int").alias("range"), "row")
    alone = rows.join(placed.filter("fixed < 0"), group, "left_semi").join(settled, ["h", "row"]).select("doc_id", "size", "text_crc32", "shard", "range", "row")
    members = groups.join(placed, group, "left_anti").select(*group, F.col("row").alias("first")).join(settled.withColumnRenamed("row", "first"), ["h", "first"]).select(*group, "shard", "range")
    kept = rows.join(placed, group, "left_anti").join(members, group).select("doc_id", "size", "text_crc32", "shard", "range", "row")
    found = written(whole.unionByName(alone).unionByName(kept), "placed")
    # Slots: within a shard by range, within a range by row.
    parts = found.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.broadcast(parts.select("shard", "range", (F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("before")))
    place = F.row_number().over(Window.partitionBy("shard", "range").orderBy("row")) - 1
    return found.withColumn("place", place).join(before, ["shard", "range"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place")).alias("slot"))


def write_shards(docs: DataFrame, folder: str, shards: int = 24) -> None:
    """``docs``, all columns, written under ``shard=`` folders. doc_id has to be unique and not null."""
    placed = assign(docs, shards).select("doc_id", "shard")
    files = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    docs.drop("shard").join(placed, "doc_id").repartition("shard", files).write.partitionBy("shard").parquet(folder)
