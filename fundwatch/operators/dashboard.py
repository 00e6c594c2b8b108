"""Dashboard aggregates, encodings and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import severity_name, severity_rank
from ..functions.session import cut, lookup
from ..schema import RISK_LEVELS

# Alert states that count as active.
ACTIVE_STATES = ["NEW", "UNDER_INVESTIGATION", "ESCALATED"]


def channel_breakdown(tx: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("amount"), F.lit(0.0))
    return tx.groupBy("channel").agg(F.count(F.lit(1)).alias("transfers"), total.alias("volume")).orderBy(F.desc("volume"))


def kpis(tx: DataFrame, accounts: DataFrame, alerts: DataFrame, asof: Column | str | None = None, risk: float = 80) -> DataFrame:
    """One row of headline figures. ``asof`` defaults to the newest transfer.

    Each input is reduced to a single row first; the rows are stacked and folded, so no
    join is involved.
    """
    if asof is None:
        asof = F.lit(tx.agg(F.max("ts")).first()[0])
    else:
        asof = F.lit(asof).cast("timestamp")
    t = tx.agg(
        F.count_if(F.col("ts") >= asof - F.expr("interval 24 hours")).alias("transactions_24h"),
        F.coalesce(F.sum(F.when(F.col("risk_score") >= risk, F.col("amount"))), F.lit(0.0)).alias("volume_at_risk"),
    )
    a = accounts.agg(F.count_if(F.col("is_flagged_mule")).alias("flagged_accounts"))
    b = alerts.agg(F.count_if(F.col("alert_status").isin(ACTIVE_STATES)).alias("active_alerts"))
    stacked = t.unionByName(a, allowMissingColumns=True).unionByName(b, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def risk_distribution(accounts: DataFrame) -> DataFrame:
    """Accounts per level, with zero for levels that do not occur."""
    counts = accounts.agg(*[F.count_if(F.col("risk_level") == level).alias(level) for level in RISK_LEVELS])
    pairs = F.array(*[F.struct(F.lit(level).alias("risk_level"), F.col(level).alias("accounts")) for level in RISK_LEVELS])
    return counts.select(F.inline(pairs))


def top_patterns(matches: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent patterns among rule matches (``pattern_name``, ``severity``)."""
    hits = matches.groupBy("pattern_name").agg(
        F.count(F.lit(1)).alias("hit_count"), severity_name(F.max(severity_rank("severity"))).alias("severity")
    )
    return hits.orderBy(F.desc("hit_count"), "pattern_name").limit(n)


def daily_series(tx: DataFrame, alerts: DataFrame, risk: float = 80) -> DataFrame:
    """Per day: total volume, flagged volume and alert count. Days from either input are kept."""
    day = lambda c: F.to_date(c).alias("day")
    volume = tx.groupBy(day("ts")).agg(
        F.sum("amount").alias("total_volume"),
        F.coalesce(F.sum(F.when(F.col("risk_score") >= risk, F.col("amount"))), F.lit(0.0)).alias("flagged_volume"),
    )
    count = alerts.groupBy(day("triggered_at")).agg(F.count(F.lit(1)).alias("alerts"))
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z)).alias(c)
    return volume.join(count, "day", "full").select("day", zero("total_volume", 0.0), zero("flagged_volume", 0.0), zero("alerts", 0))


def geo_clusters(tx: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per city and state: distinct flagged senders and their alerts."""
    home = tx.groupBy("location_city", "location_state", F.col("sender_account").alias("account_id")).agg(
        F.max("is_fraud").alias("flagged")
    )
    per_account = alerts.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        home.join(per_account, "account_id", "left")
        .groupBy("location_city", "location_state")
        .agg(F.count_if(F.col("flagged") == 1).alias("active_mules"), F.coalesce(F.sum("n"), F.lit(0)).alias("alerts"))
    )


def mule_share(tx: DataFrame) -> DataFrame:
    return tx.groupBy("channel").agg((F.avg(F.col("is_fraud").cast("double")) * 100).alias("mule_percentage"))


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """Share of rows per value, from counts only."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = max(df.count(), 1)
    return counts.select(column, (F.col("n") / F.lit(total)).alias(f"{column}_freq"))


def frequency_encode(df: DataFrame, columns: list[str], fitted: dict[str, DataFrame] | None = None) -> DataFrame:
    """Add ``<column>_freq``; values the table does not know get 0."""
    for c in columns:
        freq = (fitted or {}).get(c)
        freq = frequency_table(df, c) if freq is None else freq
        df = lookup(df, cut(freq), c).withColumn(f"{c}_freq", F.coalesce(f"{c}_freq", F.lit(0.0)))
    return df


def linked_accounts(tx: DataFrame, entity: str, approximate: bool = False) -> DataFrame:
    """Distinct sender accounts per device, IP or beneficiary."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return (
        tx.filter(F.col(entity).isNotNull())
        .groupBy(entity)
        .agg(count(F.col("sender_account")).alias("linked_accounts"))
    )


def profile(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """One row per column: nulls, and mean, deviation, minimum and maximum of numbers. One pass."""
    kinds = dict(df.dtypes)
    numeric = [c for c, t in kinds.items() if t in ("double", "float", "int", "bigint")]
    flat = [c for c, t in kinds.items() if not t.startswith(("map", "array", "struct"))]
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("share")]
    for c in flat:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"null_{c}"))
        if c in numeric:
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"mean_{c}"), F.stddev(x).alias(f"std_{c}"), F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}")]
    none = F.lit(None).cast("double")
    stat = lambda s, c: (F.col(f"{s}_{c}") if c in numeric else none).alias(s)
    rows = [F.struct(F.lit(c).alias("column"), F.col("n").alias("rows"), F.col(f"null_{c}").alias("nulls"), stat("mean", c),
                     stat("std", c), stat("min", c), stat("max", c), F.col("share").alias("fraud_share")) for c in flat]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))
