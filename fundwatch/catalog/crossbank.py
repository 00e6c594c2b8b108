"""Cross-bank matching and federated averaging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import hmac_sha256, ts_text
from ..operators import crossbank as X
from ..sources.driver_tables import table, transfers
from .base import TX, query, ts, with_
from .temporal import round_up

KEY = "example-matching-key"
_pad = lambda b: bytes(x ^ b for x in KEY.encode().ljust(64, b"\0")).hex()
HASH = f"sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(account))))"


def as_reports(tx):
    """Fraud-labelled transfers as reports of the sender's bank about the receiver."""
    return tx.filter("is_fraud = 1").select(hmac_sha256("receiver_account", KEY).alias("account_hash"), F.col("sender_bank").alias("bank_id"), "ts", F.col("transaction_id").alias("report_id"),
                     "risk_score", F.col("location_city").alias("pattern_type"))


def reports(spark, sf):
    return as_reports(transfers(spark, sf))


REPORTS = f"""hashes AS MATERIALIZED (SELECT account, {HASH} AS account_hash FROM (SELECT DISTINCT receiver_account AS account FROM tx)),
reports AS MATERIALIZED (SELECT account_hash, sender_bank AS bank_id, ts, transaction_id AS report_id, risk_score, location_city AS pattern_type FROM tx JOIN hashes ON account = receiver_account WHERE is_fraud = 1),
firsts AS MATERIALIZED (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY account_hash, bank_id ORDER BY ts, report_id) = 1),
per AS MATERIALIZED (SELECT account_hash, count(*) AS banks, avg(risk_score) AS risk, min(ts) AS first_ts, max(pattern_type) FILTER (r = 2) AS pattern_type, max(ts) FILTER (r = 2) AS created
  FROM (SELECT *, row_number() OVER (PARTITION BY account_hash ORDER BY ts, report_id) AS r FROM firsts) GROUP BY 1),
alerts AS MATERIALIZED (SELECT *, CASE WHEN risk >= 90 OR banks >= 3 THEN 'CRITICAL' WHEN risk >= 75 THEN 'HIGH' WHEN risk >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM per WHERE banks >= 2)"""


@query("x01_hmac", with_(TX, f"SELECT DISTINCT account, {HASH} AS account_hash FROM (SELECT sender_account AS account FROM tx)"))
def x01(spark, sf):
    return transfers(spark, sf).select(F.col("sender_account").alias("account")).distinct().withColumn("account_hash", hmac_sha256("account", KEY))


@query("x02_first_reports", with_(TX, REPORTS, "SELECT account_hash, bank_id, report_id, risk_score FROM firsts"))
def x02(spark, sf):
    return X.first_reports(reports(spark, sf)).select("account_hash", "bank_id", "report_id", "risk_score")


@query("x03_cross_bank_alerts", with_(TX, REPORTS, f"SELECT account_hash, banks AS contributing_banks, round(risk, 2) AS aggregate_risk, severity, pattern_type, {ts('created')} AS created_at FROM alerts"))
def x03(spark, sf):
    a = X.cross_bank_alerts(reports(spark, sf))
    return a.select("account_hash", "contributing_banks", "aggregate_risk", "severity", "pattern_type", ts_text("created_at").alias("created_at"))


@query("x04_query_hashes", with_(TX, REPORTS, f"""SELECT q.bank AS query_bank_id, account_hash, banks AS matched_banks, round(risk, 2) AS aggregate_risk,
  CASE WHEN risk >= 90 OR banks >= 3 THEN 'CRITICAL' WHEN risk >= 75 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, {ts('first_ts')} AS first_flagged_at
  FROM (SELECT DISTINCT sender_bank AS bank, receiver_account AS account FROM tx) q JOIN hashes USING (account) JOIN per USING (account_hash)"""))
def x04(spark, sf):
    q = transfers(spark, sf).select(F.col("sender_bank").alias("query_bank_id"), hmac_sha256("receiver_account", KEY).alias("account_hash"))
    m = X.query_hashes(q, reports(spark, sf))
    return m.withColumn("first_flagged_at", ts_text("first_flagged_at"))


@query("x05_alerts_at_least", with_(TX, REPORTS, "SELECT account_hash, severity FROM alerts WHERE severity IN ('HIGH', 'CRITICAL')"))
def x05(spark, sf):
    return X.alerts_at_least(X.cross_bank_alerts(reports(spark, sf)), "HIGH").select("account_hash", "severity")


@query("x06_acknowledged", with_(TX, REPORTS, "SELECT account_hash, account_hash < '8' AS is_acknowledged FROM alerts"))
def x06(spark, sf):
    a = X.cross_bank_alerts(reports(spark, sf))
    return X.acknowledged(a, a.filter(F.col("account_hash") < "8").select("account_hash")).select("account_hash", "is_acknowledged")


def weights(spark, sf):
    """Embeddings as uploads: one vector per bank and round; positions 0–47 are a 6 × 8 matrix, the rest a bias."""
    e = table(spark, sf, "embeddings")
    long = e.select("vec_id", "label", F.posexplode("embedding").alias("pos", "value"))
    return long.select(
        F.concat(F.lit("BANK-"), F.col("vec_id") % 10).alias("bank_id"), F.floor(F.col("vec_id") / 10).alias("round_id"),
        F.when(F.col("pos") < 48, "W1").otherwise("b1").alias("layer"), F.when(F.col("pos") < 48, F.floor(F.col("pos") / 8)).otherwise(0).cast("int").alias("i"),
        F.when(F.col("pos") < 48, F.col("pos") % 8).otherwise(F.col("pos") - 48).cast("int").alias("j"), F.col("value").cast("double").alias("value"),
        (F.col("label") * 10 + 50).cast("long").alias("n_samples"), (F.col("label") / 10).alias("loss"))


WEIGHTS = """w AS MATERIALIZED (SELECT 'BANK-' || (vec_id % 10) AS bank_id, vec_id // 10 AS round_id, CASE WHEN pos < 48 THEN 'W1' ELSE 'b1' END AS layer, (CASE WHEN pos < 48 THEN pos // 8 ELSE 0 END)::INT AS i,
    (CASE WHEN pos < 48 THEN pos % 8 ELSE pos - 48 END)::INT AS j, value::DOUBLE AS value, label * 10 + 50 AS n_samples, label / 10 AS loss
  FROM (SELECT vec_id, label, unnest(embedding) AS value, unnest(range(len(embedding))) AS pos FROM embeddings)),
up AS MATERIALIZED (SELECT DISTINCT round_id, bank_id, n_samples, loss FROM w)"""


@query("x07_fed_avg", with_(WEIGHTS, "SELECT round_id, layer, i, j, round(sum(value * n_samples) / sum(n_samples), 6) AS value FROM w GROUP BY 1, 2, 3, 4"))
def x07(spark, sf):
    return X.fed_avg(weights(spark, sf)).withColumn("value", F.round("value", 6))


@query("x08_round_stats", with_(WEIGHTS, "SELECT round_id, count(*) AS participants, sum(n_samples)::BIGINT AS total_samples, count(*) * 1.0::DOUBLE AS epsilon_consumed, round(sum(loss * n_samples) / sum(n_samples), 6) AS aggregated_loss FROM up GROUP BY 1"))
def x08(spark, sf):
    return X.round_stats(weights(spark, sf)).withColumn("aggregated_loss", F.round("aggregated_loss", 6))


@query("x09_bank_stats", with_(WEIGHTS, "SELECT bank_id, count(DISTINCT round_id) AS rounds, max(round_id) AS last_round FROM up GROUP BY 1"))
def x09(spark, sf):
    return X.bank_stats(weights(spark, sf))


CLIPPED = "clipped AS MATERIALIZED (SELECT * EXCLUDE (value), CASE WHEN n > 0.5 THEN value * 0.5 / n ELSE value END AS value FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY round_id, bank_id, layer)) AS n FROM w))"


@query("x10_clip", with_(WEIGHTS, CLIPPED, "SELECT bank_id, round_id, layer, i, j, round(value, 6) AS value FROM clipped"))
def x10(spark, sf):
    return X.clip(weights(spark, sf), 0.5).select("bank_id", "round_id", "layer", "i", "j", F.round("value", 6).alias("value"))


def _uniform(salt: str) -> str:
    return f"((('0x' || md5(concat_ws(':', '7:{salt}', round_id, bank_id, layer, i, j))[:13])::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)"


# The deviation for epsilon 1, delta 1e-5 and a norm of 0.5.
@query("x11_add_noise", with_(WEIGHTS, CLIPPED, f"""SELECT bank_id, round_id, layer, i, j,
  floor((value + sqrt(-2.0::DOUBLE * ln({_uniform('r')})) * cos(2 * pi() * {_uniform('a')}) * 0.5::DOUBLE * sqrt(2.0::DOUBLE * ln(125000.0::DOUBLE))) * 1e6 + 0.5) / 1e6 AS value FROM clipped"""))
def x11(spark, sf):
    noisy = X.add_noise(weights(spark, sf), epsilon=1.0, delta=1e-5, c=0.5, seed=7)
    return noisy.select("bank_id", "round_id", "layer", "i", "j", round_up("value", 6).alias("value"))


@query("x12_privacy_ledger", with_(WEIGHTS, """SELECT round_id, epsilon, cumulative_epsilon, greatest(0, 10 - cumulative_epsilon) AS remaining, cumulative_epsilon >= 10 AS exhausted FROM (
  SELECT round_id, epsilon, sum(epsilon) OVER (ORDER BY round_id) AS cumulative_epsilon FROM (SELECT round_id, count(*) * 0.125::DOUBLE AS epsilon FROM up GROUP BY 1))"""))
def x12(spark, sf):
    rounds = X.round_stats(weights(spark, sf), epsilon=0.125).select("round_id", F.col("epsilon_consumed").alias("epsilon"))
    return X.privacy_ledger(rounds)


@query("x13_mask_unmask", with_(WEIGHTS, "SELECT round_id, layer, i, j, round(sum(value), 6) AS value FROM w GROUP BY 1, 2, 3, 4"))
def x13(spark, sf):
    w = weights(spark, sf)
    masks = w.withColumn("value", F.sin(F.xxhash64("bank_id", "round_id", "layer", "i", "j").cast("double")))
    return X.unmask(X.mask(w, masks), masks).withColumn("value", F.round("value", 6))


@query("x14_platform_status", with_(TX, REPORTS, WEIGHTS, """SELECT (SELECT count(DISTINCT bank_id) FROM up) AS registered_banks, (SELECT count(DISTINCT bank_id) FROM up WHERE round_id = (SELECT max(round_id) FROM up)) AS active_banks,
  (SELECT count(DISTINCT round_id) FROM up) AS training_rounds, (SELECT count(*) FROM up) * 1.0::DOUBLE AS epsilon_spent, (SELECT count(*) FROM alerts) AS cross_bank_alerts"""))
def x14(spark, sf):
    w = weights(spark, sf)
    banks, rounds = X.bank_stats(w), X.round_stats(w)
    last = rounds.agg(F.max("round_id")).first()[0]
    banks = banks.withColumn("status", F.when(F.col("last_round") == last, "ACTIVE").otherwise("INACTIVE"))
    return X.platform_status(banks, rounds, X.cross_bank_alerts(reports(spark, sf)))
