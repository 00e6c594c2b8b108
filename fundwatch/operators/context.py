"""What the rules need to know about each transfer.

One row per transfer travels through a chain of windows as payload. No step joins the
transfers back to themselves, and the account-side steps share one partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import haversine_km, micros, number
from ..functions.session import cut, lookup
from ..functions.timeline import MONEY_SCALE, find_hot, money_units, neighbours, trailing, trailing_distinct
from .dashboard import linked_accounts
from .temporal import legs

DAY_US = 86_400_000_000


def _renamed(hot: DataFrame | str | None, key: str) -> DataFrame | str | None:
    return hot.withColumnRenamed("account", key) if isinstance(hot, DataFrame) else hot


def history(tx: DataFrame, hours: float = 24, hot: DataFrame | str | None = "auto") -> DataFrame:
    """Counts over the sender's recent transfers on either side, without the transfer itself.

    ``history_1h``, ``history_n`` (whole window), ``recent_sum`` and ``inbound_sum`` (15
    minutes), ``channels_1h`` (with the current channel) and ``previous_us``.
    """
    sender = F.col("sender_account")
    payload = F.struct(*tx.columns)
    out = F.struct(sender.alias("account"), F.lit("out").alias("side"), payload.alias("row"))
    into = F.struct(F.col("receiver_account").alias("account"), F.lit("in").alias("side"), F.lit(None).cast(tx.select(payload.alias("p")).schema[0].dataType).alias("row"))
    own = F.struct(sender.alias("account"), F.lit("self").alias("side"), payload.alias("row"))
    leg = tx.select(
        "transaction_id", micros("ts").alias("us"), "amount", "channel",
        F.inline(F.when(sender == F.col("receiver_account"), F.array(own)).otherwise(F.array(out, into))),
    )
    hot = find_hot(legs(tx), ["account"], "us") if isinstance(hot, str) else hot
    units = money_units("amount")
    received = F.when(F.col("side") != "out", units).otherwise(F.lit(0).cast("long"))
    measures = {"n": F.lit(1), "units": units, "in": received}
    windows = {"1h": 3600, "15m": 900, "all": int(hours * 3600)}
    w = trailing(leg, ["account"], "us", measures, windows, order="transaction_id", hot=hot)
    w = w.drop("units_1h", "in_1h", "n_15m", "units_all", "in_all")
    w = trailing_distinct(w, ["account"], "channel", "us", "transaction_id", 3600, "channels_1h", hot=hot)
    mine = w.filter(F.col("side") != "in")
    self_in = F.when(F.col("side") == "self", units).otherwise(F.lit(0))
    return mine.select(
        "row.*",
        (F.col("n_1h") - 1).alias("history_1h"),
        (F.col("n_all") - 1).alias("history_n"),
        ((F.col("units_15m") - units) / MONEY_SCALE).alias("recent_sum"),
        ((F.col("in_15m") - self_in) / MONEY_SCALE).alias("inbound_sum"),
        "channels_1h",
        F.col("prev_t").alias("previous_us"),
    )


def fan_counts(tx: DataFrame, hours: float = 24, hot: DataFrame | str | None = "auto") -> DataFrame:
    """``fan_in``: other senders' count to this receiver, ``fan_out``: receivers of this sender, in the window."""
    rows = tx.withColumn("us", micros("ts"))
    seconds = int(hours * 3600)
    rows = trailing_distinct(rows, ["receiver_account"], "sender_account", "us", "transaction_id", seconds, "_in", hot=_renamed(hot, "receiver_account"))
    rows = trailing_distinct(rows, ["sender_account"], "receiver_account", "us", "transaction_id", seconds, "_out", hot=_renamed(hot, "sender_account"))
    return rows.withColumnsRenamed({"_in_before": "fan_in", "_out_before": "fan_out"}).drop("_in", "_out", "us")


def dormant_days(previous_us: Column | str, us: Column | str) -> Column:
    """Whole days since the account's previous transfer; 0 for its first one."""
    p = F.col(previous_us) if isinstance(previous_us, str) else previous_us
    u = F.col(us) if isinstance(us, str) else us
    return F.coalesce(F.floor((u - p) / DAY_US), F.lit(0)).cast("int")


def account_age(tx: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """``account_age``: the age given with the transfer, else whole days since the account was opened."""
    given = number(F.try_element_at("metadata", F.lit("account_age_days"))).cast("int")
    if accounts is None:
        return tx.withColumn("account_age", given)
    opened = accounts.select(F.col("account_number").alias("sender_account"), "opened_at")
    since = F.floor((micros("ts") - micros("opened_at")) / DAY_US).cast("int")
    return tx.join(opened, "sender_account", "left").withColumn("account_age", F.coalesce(given, since)).drop("opened_at")


def travel_speed(tx: DataFrame, hot: DataFrame | str | None = "auto") -> DataFrame:
    """``travel_speed_kmh`` between successive located transfers of a sender.

    Null for the first one; a change of place within one instant has no finite speed and
    is reported as infinity.
    """
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    rows = tx.withColumn("_us", micros("ts"))
    near = neighbours(rows.filter(located), ["sender_account"], "_us", "transaction_id", ["_us", "latitude", "longitude"], hot=_renamed(hot, "sender_account"))
    km = haversine_km("prev_latitude", "prev_longitude", "latitude", "longitude")
    hours = (F.col("_us") - F.col("prev__us")) / 3.6e9
    speed = F.when(F.col("prev__us").isNotNull(), F.when(hours > 0, km / F.nullif(hours, F.lit(0.0))).when(km > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
    near = near.withColumn("travel_speed_kmh", speed).select(*tx.columns, "travel_speed_kmh")
    return near.unionByName(tx.filter(~located), allowMissingColumns=True)


LINKED = {"device_id": "linked_devices", "ip_address": "linked_ips", "beneficiary_id": "linked_beneficiaries"}


def linked_counts(tx: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Accounts sharing the transfer's device, IP and beneficiary; 1 when there is none.

    The count per entity is aggregated on distinct pairs and written before it meets the
    transfers: between two plain shuffles AQE can split the transfers of a popular entity.
    Transfers without the entity go round the join.
    ``population`` is counted instead of ``tx`` when ``tx`` is only a part of it.
    """
    population = tx if population is None else population
    for entity, name in LINKED.items():
        counts = cut(linked_accounts(population, entity).withColumnRenamed("linked_accounts", name))
        tx = lookup(tx, counts, entity).withColumn(name, F.coalesce(F.col(name), F.lit(1)).cast("int"))
    return tx


CONTEXT_COLUMNS = [
    "transaction_id", "ts", "sender_account", "receiver_account", "amount", "channel", "device_id", "ip_address",
    "beneficiary_id", "latitude", "longitude", "metadata",
]
# Which rules need which step; a step no active rule needs is left out of the plan.
STEPS = {
    "age": {"R008"}, "linked": {"R006", "R010", "R013"}, "fan": {"R002", "R003"}, "travel": {"R011"},
    "history": {"R001", "R004", "R007", "R008", "R009"}, "circular": {"R014"},
}


def rule_context(
    tx: DataFrame,
    accounts: DataFrame | None = None,
    circular: DataFrame | None = None,
    hours: float = 24,
    *,
    active: set[str] | list[str] | None = None,
    population: DataFrame | None = None,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Every input of the active rules (all by default), one row per transfer, and the ``carried`` columns of ``tx``.

    ``circular`` has (account, in_cycle). ``population`` is the table device, IP and
    beneficiary counts refer to when ``tx`` holds only the transfers of some accounts.
    """
    needs = {step for step, rules in STEPS.items() if active is None or rules & set(active)}
    hot = find_hot(legs(tx), ["account"], "us") if needs & {"fan", "travel", "history"} else None
    rows = tx.select(*dict.fromkeys([*CONTEXT_COLUMNS, *carried]))
    left = lambda *names: rows.drop(*[c for c in names if c not in carried])
    if "age" in needs:
        rows = account_age(rows, accounts)
    if "linked" in needs:
        rows = linked_counts(rows, population)
    rows = left("metadata", "beneficiary_id", "device_id", "ip_address")
    if "fan" in needs:
        rows = fan_counts(rows, hours, hot)
    if "travel" in needs:
        rows = travel_speed(rows, hot)
    rows = left("latitude", "longitude")
    if "history" in needs:
        rows = history(rows, hours, hot)
        rows = rows.withColumn("dormant_days", dormant_days(F.col("previous_us"), micros("ts"))).drop("previous_us")
    if "circular" not in needs:
        return rows
    if circular is None:
        return rows.withColumn("in_cycle", F.lit(False))
    flag = circular.select(F.col("account").alias("sender_account"), "in_cycle")
    return rows.join(flag, "sender_account", "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
