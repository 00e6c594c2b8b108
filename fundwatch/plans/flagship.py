"""Which accounts forward at least 90 % of money received within 15 minutes, and how risky are they?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.context import rule_context
from ..operators.fusion import fuse, signals
from ..operators.graph import circular_flags
from ..operators.rules import RULES, evaluate_rules
from ..operators.temporal import pass_through, temporal_features
from ..sources.driver_tables import accounts, transfers
from ..functions.session import cut
from ..sources.ingest import account_pairs


def score_forwarders(tx: DataFrame, ratio: float = 0.90, accounts: DataFrame | None = None) -> DataFrame:
    """Forwarding accounts with their pairs, worst transfer by all fourteen rules, fused score and tier."""
    # Parsed once; four parts read it.
    tx = cut(tx)
    pairs = pass_through(tx).filter(F.col("pass_through_ratio") >= ratio)
    forwarded = pairs.groupBy("account").agg(F.count(F.lit(1)).alias("forwarded_pairs"), F.max("pass_through_ratio").alias("highest_ratio"))
    judged = evaluate_rules(rule_context(tx, accounts, circular_flags(account_pairs(tx))))
    worst = judged.groupBy(F.col("sender_account").alias("account")).agg(
        F.max_by(F.struct("rule_score", "highest_severity", F.size("matches").alias("rule_count")), F.struct("rule_score", "transaction_id")).alias("_w"))
    worst = worst.select("account", "_w.*")
    record = temporal_features(tx).join(forwarded, "account").join(worst, "account", "left")
    return fuse(signals(record)).select(
        "account", "forwarded_pairs", "highest_ratio", "rule_score", "highest_severity", "burst_count", "n_24h", "rapid_in_out_delay",
        "composite_risk_score", "risk_level")


def forwarders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_forwarders(transfers(spark, sf_dir), accounts=accounts(spark, sf_dir)).orderBy(F.desc("composite_risk_score"), "account")
