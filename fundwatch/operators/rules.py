"""The fourteen forensic rules as column expressions over the rule context.

A rule is a function ``rule(**thresholds) -> Column`` giving the match condition. All of
them are evaluated in one narrow stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from inspect import signature

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import any_of, money, severity_name, severity_rank


def r001(threshold: int = 20) -> Column:
    return F.col("history_1h") >= threshold


def r002(threshold: int = 10) -> Column:
    return F.col("fan_in") >= threshold


def r003(threshold: int = 10) -> Column:
    return F.col("fan_out") >= threshold


def r004(ratio: float = 0.90, mode: str = "reference") -> Column:
    """``reference`` sums every recent transfer of the sender, ``inbound`` only what it received."""
    base = F.col({"reference": "recent_sum", "inbound": "inbound_sum"}[mode])
    return (F.col("amount") > 0) & (base > 0) & (F.col("amount") / F.nullif(base, F.lit(0.0)) >= ratio)


def r005(low: float = 48_000.0, high: float = 49_999.0) -> Column:
    return F.col("amount").between(low, high)


def r006(limit: int = 3) -> Column:
    return F.col("linked_devices") > limit


def r007(days: int = 90) -> Column:
    return F.col("dormant_days") > days


def r008(age: int = 7, count: int = 15) -> Column:
    return F.col("account_age").isNotNull() & (F.col("account_age") < age) & (F.col("history_n") > count)


def r009(threshold: int = 3) -> Column:
    return F.col("channels_1h") >= threshold


def r010(limit: int = 5) -> Column:
    return F.col("linked_ips") > limit


def r011(speed: float = 500.0) -> Column:
    return F.col("travel_speed_kmh") > speed


def r012(start: int = 0, end: int = 5, amount: float = 50_000.0) -> Column:
    hour = F.hour("ts")
    return (hour >= start) & (hour < end) & (F.col("amount") >= amount)


def r013(threshold: int = 5) -> Column:
    return F.col("linked_beneficiaries") >= threshold


def r014() -> Column:
    return F.col("in_cycle") | (F.col("sender_account") == F.col("receiver_account"))


def _says(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Code, name, pattern, score, severity and narrative of each rule, in evaluation order.
RULES: dict[str, tuple[Callable[..., Column], str, str, int, str, Callable[[], Column]]] = {
    "R001": (r001, "High Velocity Transactions", "High Velocity", 25, "HIGH", lambda: _says(
        "High velocity detected: ", F.col("history_1h"), " transactions executed in the past hour.")),
    "R002": (r002, "Fan-In Aggregation", "Fan In", 30, "HIGH", lambda: _says(
        "Fan-In Collector detected: ", F.col("fan_in"), " unique senders transferred to account.")),
    "R003": (r003, "Fan-Out Dispersion", "Fan Out", 30, "HIGH", lambda: _says(
        "Fan-Out Distributor detected: funds scattered to ", F.col("fan_out"), " receivers.")),
    "R004": (r004, "Mule Chain Rapid Pass-Through", "Mule Chain", 40, "CRITICAL", lambda: _says(
        "Mule Chain Pass-Through detected: >90% of funds (₹", money("amount"), ") forwarded within 15 minutes.")),
    "R005": (r005, "Smurfing / Structuring", "Smurfing", 35, "HIGH", lambda: _says(
        "Smurfing / Structuring detected: transfer of ₹", money("amount"), " just under reporting threshold.")),
    "R006": (r006, "Shared Hardware Device", "Shared Device", 35, "HIGH", lambda: _says(
        "Shared Device pattern detected: hardware fingerprint linked to ", F.col("linked_devices"), " accounts.")),
    "R007": (r007, "Dormant Account Reactivation", "Dormant Reactivation", 30, "HIGH", lambda: _says(
        "Dormant Account Reactivation detected: sudden activity on account dormant >90 days.")),
    "R008": (r008, "New Account Abuse", "New Account Abuse", 25, "HIGH", lambda: _says(
        "New Account Abuse detected: ", F.col("history_n"), " transactions on account created ", F.col("account_age"), " days ago (<7 days).")),
    "R009": (r009, "Cross-Channel Hopping", "Cross-Channel Hopping", 25, "MEDIUM", lambda: _says(
        "Cross-Channel Hopping detected: cycling across ", F.col("channels_1h"), " distinct rails within 1 hour.")),
    "R010": (r010, "Shared IP Address Clustering", "Shared IP", 30, "HIGH", lambda: _says(
        "Shared IP pattern detected: public IP address linked to ", F.col("linked_ips"), " accounts.")),
    "R011": (r011, "Impossible Travel Velocity", "Impossible Travel", 35, "HIGH", lambda: _says(
        "Impossible Travel detected: physical transit speed between transactions exceeds 500 km/h.")),
    "R012": (r012, "Night Activity Anomalies", "Night Activity", 20, "MEDIUM", lambda: _says(
        "Night Activity anomaly detected: high-value transfer (₹", money("amount"), ") executed between 12 AM and 5 AM.")),
    "R013": (r013, "Shared Beneficiary Convergence", "Shared Beneficiary", 30, "HIGH", lambda: _says(
        "Shared Beneficiary detected: beneficiary account shared by ", F.col("linked_beneficiaries"), " unrelated accounts.")),
    "R014": (r014, "Circular Flow / Wash Laundering", "Circular Flow", 40, "CRITICAL", lambda: _says(
        "Circular Flow detected: funds traverse intermediate accounts and return to originator.")),
}

# Flags a caller may already have; a true flag matches whatever the measured value is.
FLAGS = {
    "R007": ["is_dormant"], "R011": ["impossible_travel"], "R012": ["is_night_anomaly"],
    "R013": ["is_shared_beneficiary"], "R014": ["has_circular_flow", "circular_flow_detected"],
}


def condition(code: str, columns: Iterable[str], overrides: Mapping | None = None) -> Column:
    match = RULES[code][0](**(overrides or {}))
    given = [F.coalesce(F.col(f), F.lit(False)) for f in FLAGS.get(code, []) if f in columns]
    return F.coalesce(any_of([*given, F.coalesce(match, F.lit(False))]), F.lit(False))


def result(code: str, columns: Iterable[str], overrides: Mapping | None = None) -> Column:
    """The result struct of one rule: score 0, severity LOW and no narrative without a match."""
    _, name, pattern, score, severity, narrative = RULES[code]
    hit = condition(code, columns, overrides)
    return F.struct(
        F.lit(code).alias("rule_code"), F.lit(name).alias("rule_name"), F.lit(pattern).alias("pattern_name"),
        hit.alias("matched"), F.when(hit, score).otherwise(0).alias("score"),
        F.when(hit, severity).otherwise("LOW").alias("severity"), F.when(hit, narrative()).otherwise("").alias("narrative"),
    )


def evaluate_rule(context: DataFrame, code: str, **overrides) -> DataFrame:
    return context.withColumn("_m", result(code, context.columns, overrides)).select(*context.columns, "_m.*")


def evaluate_rules(
    context: DataFrame, active: Iterable[str] | None = None, overrides: Mapping[str, Mapping] | None = None
) -> DataFrame:
    """Add ``matches`` (array of result structs), ``patterns``, ``rule_score`` and ``highest_severity``."""
    codes = [c for c in RULES if active is None or c in set(active)]
    found = F.filter(
        F.array(*[result(c, context.columns, (overrides or {}).get(c)) for c in codes]), lambda m: m["matched"]
    )
    rank = F.array_max(F.transform("matches", lambda m: severity_rank(m["severity"])))
    return (
        context.withColumn("matches", found)
        .withColumn("patterns", F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["pattern_name"]))))
        .withColumn("rule_score", F.aggregate("matches", F.lit(0), lambda a, m: a + m["score"]))
        .withColumn("highest_severity", severity_name(F.coalesce(rank, F.lit(1))))
    )


def active_rules(rules: DataFrame) -> list[str]:
    """Codes switched on in the rules table (at most one row per rule: fourteen)."""
    rows = rules.filter(F.col("is_active") & F.col("rule_code").isin(list(RULES))).select("rule_code").distinct()
    return [r["rule_code"] for r in rows.collect()]


def rule_overrides(rules: DataFrame) -> dict[str, dict[str, float]]:
    """Thresholds of the rules table for ``evaluate_rules``: a rule's ``threshold_value``, where it has one, replaces its first threshold (R012: the amount)."""
    rows = rules.filter(F.col("threshold_value").isNotNull() & F.col("rule_code").isin(list(RULES))).select("rule_code", "threshold_value").distinct()
    first = {code: next(iter(signature(rule[0]).parameters), None) for code, rule in RULES.items()} | {"R012": "amount"}
    return {r["rule_code"]: {first[r["rule_code"]]: r["threshold_value"]} for r in rows.collect() if first[r["rule_code"]]}


def registry(spark) -> DataFrame:
    rows = [(i, code, r[1], r[2], r[3], r[4]) for i, (code, r) in enumerate(RULES.items(), 1)]
    return spark.createDataFrame(rows, "position int, rule_code string, rule_name string, pattern_name string, score int, severity string")


def exploded_matches(evaluated: DataFrame) -> DataFrame:
    return evaluated.select("transaction_id", "sender_account", F.inline("matches"))
