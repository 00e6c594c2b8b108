"""Transfers, accounts, alerts and reports derived from the given parquet tables.

Every frame is computed by Spark from the whole input table; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import map_bank
from ..functions.session import ensure_session

CHANNEL_OF = {"click": "UPI", "view": "NEFT", "purchase": "IMPS", "signup": "RTGS", "error": "CARD"}
PATTERN_OF = {"click": "High Velocity", "view": "Fan In", "purchase": "Mule Chain", "signup": "Smurfing", "error": "Shared Device"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_transfers(table(spark, sf_dir, "events"))


def as_transfers(e: DataFrame) -> DataFrame:
    """``events`` rows (batch or stream) as canonical transfers plus ``is_fraud`` (label) and ``risk_score``."""
    k = F.get_json_object("props", "$.k").cast("long")
    sender = F.concat(F.lit("ACC-"), F.col("user_id"))
    receiver = F.concat(F.lit("ACC-"), k)
    error = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("TX-"), F.col("event_id")).alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        sender.alias("sender_account"),
        receiver.alias("receiver_account"),
        F.round(F.col("value") * 1000, 2).alias("amount"),
        F.lit("INR").alias("currency"),
        _lookup(CHANNEL_OF, F.col("event_type")).alias("channel"),
        map_bank(sender).alias("sender_bank"),
        map_bank(receiver).alias("receiver_bank"),
        F.concat(F.lit("Holder "), F.col("user_id")).alias("sender_name"),
        F.concat(F.lit("Holder "), k).alias("receiver_name"),
        F.concat(F.lit("DEV-"), F.floor(F.col("user_id") / 4)).alias("device_id"),
        F.concat(F.lit("IP-"), F.col("user_id") % 20).alias("ip_address"),
        F.lit(None).cast("string").alias("wallet_id"),
        F.concat(F.lit("BEN-"), k).alias("beneficiary_id"),
        F.concat(F.lit("City "), F.col("user_id") % 25).alias("location_city"),
        F.concat(F.lit("State "), F.col("user_id") % 5).alias("location_state"),
        (F.lit(8.0) + (k % 20) * 0.5).alias("latitude"),
        (F.lit(70.0) + (F.col("user_id") % 20) * 0.5).alias("longitude"),
        F.lit(None).cast("string").alias("narration"),
        F.create_map(
            F.lit("account_age_days"), (F.col("user_id") % 400).cast("string"),
            F.lit("velocity_l6h"), (k % 12).cast("string"),
            F.lit("user_risk_score"), (F.col("user_id") % 100).cast("string"),
            F.lit("is_vpn_or_proxy"), F.when(k % 7 == 0, "1"),
        ).alias("metadata"),
        error.cast("int").alias("is_fraud"),
        F.least(F.lit(99.0), F.floor(F.col("value") / 2) + F.when(error, 40).otherwise(0)).cast("double").alias("risk_score"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as the accounts table; opening dates spread over the 400 days before 2024-02-01."""
    c = table(spark, sf_dir, "customer")
    risk = (F.col("c_custkey") * 7 % 100).cast("int")
    level = F.when(risk >= 90, "CRITICAL").when(risk >= 70, "HIGH").when(risk >= 40, "MEDIUM").otherwise("LOW")
    return c.select(
        F.concat(F.lit("ACC-"), F.col("c_custkey")).alias("account_number"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("account_type"),
        F.col("c_acctbal").alias("balance"),
        risk.alias("risk_score"),
        level.alias("risk_level"),
        (risk >= 85).alias("is_flagged_mule"),
        F.expr("timestamp '2024-02-01 00:00:00' - make_interval(0, 0, 0, c_custkey % 400)").alias("opened_at"),
        F.col("c_nationkey").alias("nation_key"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as alerts; the alert state follows the event id."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.concat(F.lit("ALT-"), F.col("event_id")).alias("alert_number"),
        F.concat(F.lit("ACC-"), F.col("user_id")).alias("account_id"),
        F.element_at(F.array(*[F.lit(p) for p in PATTERN_OF.values()]), (k % 5 + 1).cast("int")).alias("pattern_type"),
        F.element_at(F.array(*[F.lit(s) for s in ("LOW", "MEDIUM", "HIGH", "CRITICAL")]), (k % 4 + 1).cast("int")).alias("severity"),
        F.element_at(F.array(*[F.lit(s) for s in ("NEW", "UNDER_INVESTIGATION", "ESCALATED", "RESOLVED", "DISMISSED")]),
                     (F.col("event_id") % 5 + 1).cast("int")).alias("alert_status"),
        k.alias("risk_score"),
        F.col("ts").cast("timestamp").alias("triggered_at"),
        F.concat(F.lit("CASE-"), F.col("user_id")).alias("case_id"),
    )


def complaints_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted complaints, one per conversation turn of a user."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return c.select(
        F.concat(F.lit("TX-"), F.col("conv_id")).alias("transaction_id"),
        F.concat(F.lit("Victim "), F.col("conv_id")).alias("victim_name"),
        F.concat(F.lit("victim"), F.col("conv_id"), F.lit("@example.org")).alias("victim_email"),
        F.lit(None).cast("string").alias("victim_phone"),
        F.when(F.col("turn") % 4 == 0, "UPI Fraud").otherwise("Phishing Fraud").alias("incident_type"),
        (F.length("text") * 10.0).alias("amount_lost"),
        F.lit(None).cast("string").alias("incident_date"),
        F.col("text").alias("description"),
        F.col("conv_id"), F.col("turn"),
    )
