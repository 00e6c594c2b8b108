"""Exact order statistics of many groups at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.session import cut

#: Bits of a level: a histogram of at most 65,536 bins for each group and place still open.
STEP = 16


def kth_smallest(df: DataFrame, groups: list[str], key: Column, ranks: Mapping[str, Column]) -> DataFrame:
    """``groups`` and one column per entry of ``ranks``: the key at that place in ascending order within the group.

    ``key`` is a whole number; null keys take no part. A rank is a column over ``n``, the
    group's number of keys; the result is null where it is not in 1 to ``n``. Repeated keys
    hold as many places as they have rows. A null group is a group of its own, a group without
    keys gives no row.

    Radix refinement: a level counts the keys below each prefix still open by their next 16
    bits, and running sums of that histogram show in which bin each place falls. No group
    is sorted or gathered: counts are combined before the shuffle, a task holds at most 65,536
    bins of a prefix, and the keys are read once a level.
    """
    g = F.struct(*[F.col(c) for c in groups]).alias("_g")
    keys = cut(df.select(g, key.cast("long").alias("_k")).filter(F.col("_k").isNotNull()))
    low, high = keys.agg(F.min("_k"), F.max("_k")).first()
    names = list(ranks)
    if low is None:
        return keys.select("_g.*", *[F.col("_k").alias(c) for c in names])
    places = F.array(*[F.struct(F.lit(c).alias("_name"), r.cast("long").alias("_rank")) for c, r in ranks.items()])
    # Groups of all sizes travel along, so that one without a valid place keeps its row.
    sizes = cut(keys.groupBy("_g").agg(F.count(F.lit(1)).alias("n")))
    opened = sizes.select("_g", "n", F.inline(places)).filter(F.col("_rank").between(1, F.col("n"))).select("_g", "_name", "_rank", F.lit(0).cast("long").alias("_prefix"))
    offset = F.col("_k") - low
    for shift in range(STEP * ((int(high - low).bit_length() - 1) // STEP), -1, -STEP) if high > low else ():
        prefix = F.shiftrightunsigned(offset, shift + STEP) if shift + STEP < 64 else F.lit(0)
        digit = F.shiftrightunsigned(offset, shift).bitwiseAND(F.lit((1 << STEP) - 1))
        marked = keys.select("_g", prefix.cast("long").alias("_prefix"), digit.cast("long").alias("_digit"))
        bins = marked.join(opened.select("_g", "_prefix").distinct(), ["_g", "_prefix"], "left_semi").groupBy("_g", "_prefix", "_digit").agg(F.count(F.lit(1)).alias("_n"))
        # A bin is one value here, so running sums by group and prefix need no frame over equal digits.
        bins = bins.selectExpr("_g", "_prefix", "_digit", "_n", "sum(_n) OVER (PARTITION BY _g, _prefix ORDER BY _digit ROWS UNBOUNDED PRECEDING) AS _upto")
        inside = (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n"))
        opened = cut(opened.join(bins, ["_g", "_prefix"]).filter(inside).select(
            "_g", "_name", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), (F.shiftleft("_prefix", STEP) + F.col("_digit")).alias("_prefix")))
    found = opened.groupBy("_g").agg(*[F.max(F.when(F.col("_name") == c, F.col("_prefix") + low)).alias(c) for c in names])
    return sizes.select("_g").join(found, "_g", "left").select("_g.*", *names)
