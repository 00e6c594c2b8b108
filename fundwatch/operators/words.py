"""Sets of accounts as words of 64 bits, so that searches from many accounts advance together.

A search from every account would need a row for each (account, reached node). Here the
accounts are numbered, and a row ``(node, word, bits)`` holds up to 64 of them: bit k of word w is
account 64 w + k. One hop is a join of the rows with the steps and a ``bit_or`` by (node, word),
combined before the shuffle. Where few accounts meet a node, there is one row an account and
node, as in a plain search; where many do, 64 times fewer. All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import strip_prefix
from ..functions.session import cut

BITS = 64


def numbered(accounts: DataFrame, kin: str | None = None) -> DataFrame:
    """account, word, bit: dense places of the distinct accounts.

    Rows are written with their partition; a row's number is its place there plus the rows of
    the partitions before (a small table of counts). Accounts alike in ``kin`` (largest first) get
    neighbouring places: where few accounts are met by very many nodes, they fill few words.
    """
    if kin is None:
        kept = accounts.select("account").distinct().withColumn("_kin", F.lit(0))
    else:
        kept = accounts.groupBy("account").agg(F.max(kin).alias("_kin")).repartitionByRange(F.desc("_kin"), "account")
    placed = cut(kept.select("account", "_kin", F.spark_partition_id().alias("part")))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("_kin"), "account")) - 1
    number = F.col("before") + F.col("place")
    rows = placed.withColumn("place", place).join(F.broadcast(before), "part")
    return cut(rows.select("account", F.floor(number / BITS).cast("int").alias("word"), (number % BITS).cast("int").alias("bit")))


def with_kin(accounts: DataFrame, edges: DataFrame) -> DataFrame:
    """``accounts`` with ``kin``, the number of different nodes with an edge to the account (names without prefix)."""
    met = edges.select(strip_prefix("dst").alias("account"), "src").distinct().groupBy("account").agg(F.count(F.lit(1)).alias("kin"))
    return accounts.join(met, "account", "left").fillna(0, ["kin"])


def own_bit() -> Column:
    """The set of one account, from its column ``bit``."""
    return F.expr("shiftleft(1L, bit)").alias("bits")


def spread(sets: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """The sets one hop on: ``steps`` has ``from``, ``to`` and any of the ``keys`` it depends on."""
    shared = [k for k in keys if k in steps.columns]
    moved = sets.withColumnRenamed("node", "from").join(steps, ["from", *shared])
    return moved.groupBy(*keys, F.col("to").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))


def walk(start: DataFrame, steps: DataFrame, hops: int, keys: list[str] | None = None, within: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """Breadth-first search of all sets of ``start`` (keys, node, word, bits) at once: keys, node, word, bits, depth.

    An account is in one row of a node at most, that of its least depth. ``within`` (node, word,
    bits, or a function of the rows met and the hop) limits the walk; ``blocked`` rows count as visited. Every hop is written.
    """
    keys = keys or []
    key = [*keys, "node", "word"]
    steps = cut(steps)
    frontier = cut(start.select(*key, "bits").withColumn("depth", F.lit(0)))
    levels, seen = frontier, frontier.select(*key, "bits")
    if blocked is not None:
        seen = seen.unionByName(blocked.select(*key, "bits"))
    for hop in range(1, hops + 1):
        met = spread(frontier, steps, keys)
        if within is not None and not callable(within):
            met = met.join(within.select("node", "word", F.col("bits").alias("_in")), ["node", "word"]).withColumn("bits", F.col("bits").bitwiseAND(F.col("_in")))
        before = seen.groupBy(*key).agg(F.bit_or("bits").alias("_seen"))
        met = met.join(before, key, "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("bigint")))))
        met = met.filter(F.col("bits") != 0)
        if callable(within):
            met = within(met, hop)
        frontier = cut(met.select(*key, "bits").withColumn("depth", F.lit(hop)))
        levels, seen = levels.unionByName(frontier), seen.unionByName(frontier.select(*key, "bits"))
        if hop < hops and frontier.isEmpty():
            break
    return levels


def merged(sets: DataFrame) -> DataFrame:
    """node, word, bits: rows of all depths as one set."""
    return sets.groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))


def per_account(sets: DataFrame, accounts: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """account, by, n: rows (or their ``weight``) whose set holds the account; accounts without a row are left out.

    The 64 places of a word are summed side by side, so rows are not listed by account.
    """
    one = (lambda k: F.getbit("bits", F.lit(k))) if weight is None else (lambda k: F.getbit("bits", F.lit(k)) * F.col(weight))
    sums = sets.groupBy("word", *by).agg(*[F.sum(one(k)).alias(f"_{k}") for k in range(BITS)])
    each = sums.select("word", *by, F.posexplode(F.array(*[F.col(f"_{k}") for k in range(BITS)])).alias("bit", "n")).filter(F.col("n") > 0)
    return each.join(accounts, ["word", "bit"]).select("account", *by, "n")


def listed(sets: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row an account and row that holds it; columns of ``sets`` without word and bits."""
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda k: F.getbit(F.col("bits"), k) == 1))
    keep = [c for c in sets.columns if c not in ("word", "bits")]
    return sets.select("word", *keep, bit.alias("bit")).join(accounts, ["word", "bit"]).select("account", *keep)


def both(one: DataFrame, two: DataFrame, on: list[str]) -> DataFrame:
    """Rows of two tables with sets, joined on their columns and the word, with the accounts that both hold."""
    met = one.withColumnRenamed("bits", "_one").join(two.withColumnRenamed("bits", "_two"), [*on, "word"])
    return met.withColumn("bits", F.col("_one").bitwiseAND(F.col("_two"))).drop("_one", "_two").filter(F.col("bits") != 0)
