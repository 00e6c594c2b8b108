"""Continuous versions of scoring, pass-through, velocity and cross-bank matching.

Each function turns a streaming DataFrame into another one (or a started query). State
is bounded by watermarks, or by the number of banks per account.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import micros, ratio
from ..functions.timeline import MONEY_SCALE, money_units
from ..operators.fusion import fuse, signals
from ..operators.rules import evaluate_rules


def read_stream(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score_stream(
    transfers: DataFrame, profile: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, delay: str = "1 hour", active: list[str] | None = None
):
    """Score arriving transfers against precomputed account profiles and hand each micro-batch to ``sink``.

    ``profile`` is a static table keyed by ``sender_account`` with the rule inputs of the
    batch job (history counts, linked counts, cycle flag); it is read again in every
    micro-batch. Repeated transaction ids within the watermark are dropped. ``sink`` gets
    the batch id, so a replayed batch can overwrite its own output.
    """
    unique = transfers.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["transaction_id"])

    def score(batch: DataFrame, batch_id: int) -> None:
        rows = batch.join(profile, "sender_account", "left").fillna(0).fillna(False)
        judged = evaluate_rules(rows, active=active).withColumn("rule_count", F.size("matches"))
        sink(fuse(signals(judged)), batch_id)

    return unique.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)


def _bucket(ts: str, span: int):
    """Number of the time bucket of ``span`` microseconds."""
    us = micros(ts)
    return ((us - F.pmod(us, F.lit(span))) / span).cast("long")


def pass_through_stream(transfers: DataFrame, max_delay: int = 900, delay: str = "1 hour") -> DataFrame:
    """Inflow and outflow pairs as a stream-stream interval join; both sides forget rows older than the watermark.

    As in the batch job a time bucket of the length of the delay is part of the key, and an
    inflow also waits in the next bucket, so the state of a hot account is spread over as many
    keys as it has buckets. A pair meets in the bucket of its outflow only.
    """
    span = int(max_delay) * 1_000_000
    into = transfers.select(F.col("receiver_account").alias("account"), F.col("transaction_id").alias("incoming_id"), F.col("ts").alias("in_ts"), F.col("amount").alias("in_amount"))
    out = transfers.select(F.col("sender_account").alias("out_account"), F.col("transaction_id").alias("outgoing_id"), F.col("ts").alias("out_ts"), F.col("amount").alias("out_amount"))
    into = into.withWatermark("in_ts", delay).withColumn("bucket", F.explode(F.array(_bucket("in_ts", span), _bucket("in_ts", span) + 1)))
    out = out.withWatermark("out_ts", delay).withColumn("out_bucket", _bucket("out_ts", span))
    within = F.expr(f"account = out_account AND bucket = out_bucket AND out_ts >= in_ts AND out_ts <= in_ts + interval {int(max_delay)} seconds")
    pairs = into.join(out, within)
    seconds = (micros("out_ts") - micros("in_ts")) / 1e6
    return pairs.select("account", "incoming_id", "outgoing_id", seconds.alias("delay_seconds"), ratio(F.col("out_amount"), F.col("in_amount")).alias("pass_through_ratio"))


def velocity_stream(transfers: DataFrame, window: str = "1 hour", slide: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Transfers and amount per sender and sliding window, once per closed window.

    Sliding windows start on multiples of ``slide``; they approximate the trailing window
    ending at each transfer, which the batch job computes exactly.
    """
    w = F.window("ts", window, slide)
    agg = transfers.withWatermark("ts", delay).groupBy(w, "sender_account").agg(F.count(F.lit(1)).alias("transfers"), F.sum("amount").alias("amount"))
    return agg.select("sender_account", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "transfers", "amount")


TRAILING = "account string, transaction_id string, us bigint, n bigint, amount double"
LEGS = pa.schema([("account", pa.string()), ("transaction_id", pa.string()), ("us", pa.int64()), ("units", pa.int64()), ("own", pa.bool_())])


def _packed(legs: pd.DataFrame) -> bytes:
    """Legs as one value of the state: one by one they cost more to hand over than to count."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, LEGS) as stream:
        stream.write_table(pa.Table.from_pandas(legs, LEGS, preserve_index=False))
    return out.getvalue().to_pybytes()


class TrailingCounts(StatefulProcessor):
    """The legs of a share of the accounts in one time bucket and the end of the one before it, as list state.

    Figures of a leg are given when it arrives, and again whenever a late leg enters its
    window. A timer at the end of the bucket clears the state: once the watermark is there, no
    leg can arrive that the bucket would count.
    """

    def __init__(self, span: int, width: int):
        self.span, self.width = span, width

    def init(self, handle) -> None:
        self.handle = handle
        self.legs = handle.getListState("legs", "legs binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [pa.ipc.open_stream(bytes(packed)).read_pandas() for packed, in self.legs.get()]
        known = sum(map(len, held))
        legs = pd.concat([*held, *[chunk[LEGS.names] for chunk in rows]], ignore_index=True)
        # The first of repeated legs counts.
        came = np.arange(len(legs)) >= known
        first = ~legs.duplicated(["account", "transaction_id"]).to_numpy()
        legs, came = legs[first], came[first]
        if not came.any():
            return
        if not known:
            self.handle.registerTimer((key[1] + 1) * self.width // 1000)
        self.legs.appendValue((_packed(legs[came]),))
        account, us = pd.factorize(legs["account"])[0], legs["us"].to_numpy(np.int64)
        order = np.lexsort((us, account))
        account, us, came = account[order], us[order], came[order]
        sums = np.concatenate([[0], np.cumsum(legs["units"].to_numpy(np.int64)[order])])
        # Places in (account, time): times of a bucket and the one before it are a small range, so accounts stand apart.
        least = us.min()
        apart = us.max() - least + self.span + 2
        at = account * apart + (us - least + self.span + 1)
        low, high = np.searchsorted(at, at - self.span, "left"), np.searchsorted(at, at, "right")
        new = at[came]
        changed = np.searchsorted(new, at, "right") > np.searchsorted(new, at - self.span, "left")
        give = np.flatnonzero(changed & legs["own"].to_numpy(bool)[order])
        if len(give):
            low, high, shown = low[give], high[give], legs.iloc[order[give]]
            yield pd.DataFrame({"account": shown["account"].to_numpy(), "transaction_id": shown["transaction_id"].to_numpy(), "us": us[give], "n": high - low, "amount": (sums[high] - sums[low]) / MONEY_SCALE})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.legs.clear()
        yield from ()

    def close(self) -> None:
        pass


def trailing_stream(transfers: DataFrame, seconds: int = 3600, bucket_seconds: int | None = None, delay: str = "1 hour", shares: int = 64) -> DataFrame:
    """Exact count and sum of the closed trailing window ending at each transfer, for both its accounts, in update mode.

    ``account, transaction_id, us, n, amount`` as in the batch job's ``rolling``; the last row
    of an (account, transaction_id) is its current one (``current``), also for windows that are
    still open when the stream stops. A key is one of ``shares`` of the accounts (by hash) and a time bucket (``bucket_seconds``,
    at least the window, by default six windows), since a call of the state store costs far more than a leg; a leg goes to its own bucket, where it is judged,
    and in the last window of a bucket also to the next, where it only counts. A hot account is
    thus in as many states as it has buckets. Legs of a share that are in its state are read for each micro-batch that
    has more of them, so many accounts need more shares. Repeated transaction
    ids count once; rows later than ``delay`` are dropped; a self-transfer is one leg; rows without
    account, id or time are left out, and one without an amount adds nothing to the sum.
    The query needs the RocksDB state store (``run_available`` sets it).
    """
    span = int(seconds) * 1_000_000
    width = 6 * span if bucket_seconds is None else max(span, int(bucket_seconds) * 1_000_000)
    sides = F.when(F.col("sender_account") == F.col("receiver_account"), F.array("sender_account")).otherwise(F.array("sender_account", "receiver_account"))
    legs = transfers.filter(F.col("transaction_id").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay).select(
        "transaction_id", "ts", micros("ts").alias("us"), F.coalesce(money_units("amount"), F.lit(0)).cast("long").alias("units"),
        _bucket("ts", width).alias("_b"), F.explode(sides).alias("account")).filter(F.col("account").isNotNull())
    copy = lambda b, own: F.struct(b.alias("bucket"), F.lit(own).alias("own"))
    here, following = copy(F.col("_b"), True), copy(F.col("_b") + 1, False)
    copies = F.when(F.pmod(F.col("us"), F.lit(width)) >= width - span, F.array(here, following)).otherwise(F.array(here))
    return legs.select("account", "transaction_id", "ts", "us", "units", F.inline(copies)).withColumn("share", F.pmod(F.xxhash64("account"), F.lit(shares))).groupBy("share", "bucket").transformWithStateInPandas(
        TrailingCounts(span, width), TRAILING, "Update", "EventTime")


def current(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """The last row of each key among the micro-batches that ``run_available`` wrote under ``path``."""
    rows = spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch_id=*")
    others = [c for c in rows.columns if c not in keys and c != "batch_id"]
    numbered = rows if "batch_id" in rows.columns else rows.withColumn("batch_id", F.regexp_extract(F.col("_metadata.file_path"), r"batch_id=(\d+)", 1).cast("long"))
    return numbered.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("_r")).select(*keys, "_r.*")


ALERT = "account_hash string, contributing_banks int, aggregate_risk double, pattern_type string"
STATE = "banks array<string>, risks array<double>, pattern string"


def _merge_reports(key: tuple, chunks, state: GroupState):
    """Keep the first report of each bank; emit the account's alert whenever its banks change and are at least two."""
    banks, risks, pattern = state.get if state.exists else ([], [], None)
    banks, risks = list(banks), list(risks)
    known = len(banks)
    first: dict[str, tuple] = {}
    for chunk in chunks:
        # Only the earliest report per bank of a chunk matters, so memory follows the number of banks.
        chunk = chunk.sort_values(["ts", "report_id"]).drop_duplicates("bank_id")
        for row in chunk.itertuples(index=False):
            entry = (row.ts, row.report_id, row.risk_score, row.pattern_type)
            if row.bank_id not in first or entry[:2] < first[row.bank_id][:2]:
                first[row.bank_id] = entry
    for bank, (_, _, risk, kind) in sorted(first.items(), key=lambda e: e[1][:2]):
        if bank not in banks:
            banks.append(bank)
            risks.append(float(risk))
            if len(banks) == 2:
                pattern = kind
    state.update((banks, risks, pattern))
    if len(banks) >= 2 and len(banks) > known:
        yield pd.DataFrame({"account_hash": [key[0]], "contributing_banks": [len(banks)], "aggregate_risk": [sum(risks) / len(risks)], "pattern_type": [pattern]})


def cross_bank_stream(reports: DataFrame) -> DataFrame:
    """Alerts as reports arrive, in update mode: the last row per account is its current alert."""
    return reports.groupBy("account_hash").applyInPandasWithState(_merge_reports, ALERT, STATE, "update", GroupStateTimeout.NoTimeout)


@contextmanager
def _rocksdb(spark: SparkSession):
    """List state and timers need RocksDB; a query keeps the provider it was started with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available now and write it under ``path``; each micro-batch owns one folder, so a replay overwrites itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    with _rocksdb(df.sparkSession):
        started = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
