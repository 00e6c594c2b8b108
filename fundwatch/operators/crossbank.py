"""Cross-bank matching of hashed accounts and federated averaging on long weight tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import severity_rank

CELL = ["layer", "i", "j"]


def severity(risk: Column, banks: Column, low: bool = True) -> Column:
    """``low=False`` is the query scale, which has no LOW tier."""
    s = F.when((risk >= 90.0) | (banks >= 3), "CRITICAL").when(risk >= 75.0, "HIGH")
    return s.when(risk >= 50.0, "MEDIUM").otherwise("LOW") if low else s.otherwise("MEDIUM")


def first_reports(reports: DataFrame) -> DataFrame:
    """First report per (account hash, bank). An aggregate: repeats are dropped before the shuffle."""
    row = F.struct("ts", "report_id", "risk_score", "pattern_type")
    return reports.groupBy("account_hash", "bank_id").agg(F.min(row).alias("_r")).select("account_hash", "bank_id", "_r.*")


def cross_bank_alerts(reports: DataFrame, min_banks: int = 2) -> DataFrame:
    """Accounts reported by at least ``min_banks`` banks; the pattern is that of the report which made it so.

    Banks per account are at most the registered banks, so the per-account array is small.
    """
    arrivals = F.array_sort(F.collect_list(F.struct("ts", "report_id", "pattern_type")))
    agg = first_reports(reports).groupBy("account_hash").agg(
        F.count(F.lit(1)).alias("contributing_banks"), F.avg("risk_score").alias("aggregate_risk"), arrivals.alias("_a"))
    agg = agg.filter(F.col("contributing_banks") >= min_banks)
    # Fixed value: the narrative.
    text = F.concat(F.lit("Cross-bank mule network detected: Entity hash "), F.substring("account_hash", 1, 12), F.lit("... flagged independently across "),
                    F.col("contributing_banks").cast("string"), F.lit(" participating financial institutions."))
    raised = F.get("_a", F.lit(min_banks - 1))
    return agg.select("account_hash", "contributing_banks", F.round("aggregate_risk", 2).alias("aggregate_risk"),
                      severity(F.col("aggregate_risk"), F.col("contributing_banks")).alias("severity"), raised["pattern_type"].alias("pattern_type"),
                      raised["ts"].alias("created_at"), F.concat(F.lit("ALT-FED-"), F.upper(F.substring("account_hash", 1, 16))).alias("alert_id"), text.alias("narrative"))


def query_hashes(queries: DataFrame, reports: DataFrame) -> DataFrame:
    """Match submitted hashes against the registry, one row per (bank, hash) found."""
    registry = first_reports(reports).groupBy("account_hash").agg(
        F.count(F.lit(1)).alias("matched_banks"), F.avg("risk_score").alias("_risk"), F.min("ts").alias("first_flagged_at"))
    hit = queries.select("query_bank_id", "account_hash").distinct().join(registry, "account_hash")
    return hit.select("query_bank_id", "account_hash", "matched_banks", F.round("_risk", 2).alias("aggregate_risk"),
                      severity(F.col("_risk"), F.col("matched_banks"), low=False).alias("severity"), "first_flagged_at")


def alerts_at_least(alerts: DataFrame, level: str) -> DataFrame:
    return alerts.filter(severity_rank("severity") >= severity_rank(F.lit(level)))


def acknowledged(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """Alerts with the flag of the log, which names accounts by their whole hash; ``alert_id`` is a short form for display."""
    seen = log.select("account_hash").distinct().withColumn("is_acknowledged", F.lit(True))
    return alerts.join(seen, "account_hash", "left").withColumn("is_acknowledged", F.coalesce("is_acknowledged", F.lit(False)))


def _uploads(weights: DataFrame) -> DataFrame:
    return weights.select("round_id", "bank_id", "n_samples", "loss").distinct()


def fed_avg(weights: DataFrame) -> DataFrame:
    """Sample-weighted mean of every weight and bias cell per round.

    If no bank reports samples the divisor is the number of uploads, as in the definition.
    """
    totals = _uploads(weights).groupBy("round_id").agg(F.sum("n_samples").alias("_n"), F.count(F.lit(1)).alias("_k"))
    divisor = F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.col("_k"))
    # One row per training round: rounds are counted in hundreds.
    cells = weights.groupBy("round_id", *CELL).agg(F.sum(F.col("value") * F.col("n_samples")).alias("_s"))
    return cells.join(totals, "round_id").select("round_id", *CELL, (F.col("_s") / divisor).alias("value"))


def round_stats(weights: DataFrame, epsilon: float = 1.0) -> DataFrame:
    u = _uploads(weights)
    n = F.sum("n_samples")
    return u.groupBy("round_id").agg(
        F.count(F.lit(1)).alias("participants"), n.alias("total_samples"), (F.count(F.lit(1)) * epsilon).alias("epsilon_consumed"),
        (F.sum(F.col("loss") * F.col("n_samples")) / F.when(n > 0, n).otherwise(F.count(F.lit(1)))).alias("aggregated_loss"))


def bank_stats(weights: DataFrame) -> DataFrame:
    return _uploads(weights).groupBy("bank_id").agg(F.count_distinct("round_id").alias("rounds"), F.max("round_id").alias("last_round"))


def clip(weights: DataFrame, c: float = 1.0) -> DataFrame:
    """Scale each bank's layer so that its Frobenius norm is at most ``c``.

    The norm is an aggregate joined back, so a large layer is never held by one task.
    """
    key = ["round_id", "bank_id", "layer"]
    norms = weights.groupBy(*key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"))
    scaled = F.when(F.col("_norm") > c, F.col("value") * (c / F.col("_norm"))).otherwise(F.col("value"))
    return weights.join(norms, key).withColumn("value", scaled).drop("_norm").select(*weights.columns)


def noise_scale(epsilon: float, delta: float, c: float = 1.0) -> float:
    if epsilon <= 0 or not 0 < delta < 1:
        raise ValueError("epsilon must be positive and delta inside (0, 1)")
    return c * math.sqrt(2.0 * math.log(1.25 / delta)) / epsilon


def add_noise(weights: DataFrame, epsilon: float, delta: float, c: float = 1.0, seed: int = 0) -> DataFrame:
    """Clip, then add Gaussian noise. The noise follows from cell and seed (52 bits of md5), so a retried task draws the same value."""
    cell = lambda salt: F.concat_ws(":", F.lit(f"{seed}:{salt}"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("round_id", "bank_id", *CELL)])
    uniform = lambda salt: (F.conv(F.substring(F.md5(cell(salt)), 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)
    normal = F.sqrt(-2.0 * F.log(uniform("r"))) * F.cos(2 * math.pi * uniform("a"))
    return clip(weights, c).withColumn("value", F.col("value") + normal * noise_scale(epsilon, delta, c))


def privacy_ledger(rounds: DataFrame, budget: float = 10.0) -> DataFrame:
    """Cumulative epsilon, what remains, and whether the budget is used up (one row per round)."""
    w = Window.orderBy("round_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = rounds.withColumn("cumulative_epsilon", F.sum("epsilon").over(w))
    return spent.withColumns({"remaining": F.greatest(F.lit(0.0), budget - F.col("cumulative_epsilon")), "exhausted": F.col("cumulative_epsilon") >= budget})


def mask(weights: DataFrame, masks: DataFrame) -> DataFrame:
    key = ["round_id", "bank_id", *CELL]
    m = masks.select(*key, F.col("value").alias("_m"))
    return weights.join(m, key, "left").withColumn("value", F.col("value") + F.coalesce("_m", F.lit(0.0))).drop("_m").select(*weights.columns)


def unmask(masked: DataFrame, masks: DataFrame) -> DataFrame:
    """Sum of the true weights per cell: the masked sum less the sum of the masks."""
    key = ["round_id", *CELL]
    both = masked.select(*key, "value").unionByName(masks.select(*key, (-F.col("value")).alias("value")))
    return both.groupBy(*key).agg(F.sum("value").alias("value"))


def platform_status(banks: DataFrame, rounds: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: banks, active banks, rounds, alerts and spent budget. Each input is reduced first, then folded."""
    b = banks.agg(F.count(F.lit(1)).alias("registered_banks"), F.count_if(F.col("status") == "ACTIVE").alias("active_banks"))
    r = rounds.agg(F.count(F.lit(1)).alias("training_rounds"), F.sum("epsilon_consumed").alias("epsilon_spent"))
    a = alerts.agg(F.count(F.lit(1)).alias("cross_bank_alerts"))
    rows = b.unionByName(r, allowMissingColumns=True).unionByName(a, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
