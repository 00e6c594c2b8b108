"""Dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboard as D
from ..operators.rules import evaluate_rules, exploded_matches
from ..sources.driver_tables import accounts, alerts, transfers
from .base import ACCOUNTS, ALERTS, TX, query, with_
from .rules import CONTEXT, MATCHES, context


@query("a01_channel_breakdown", with_(TX, "SELECT channel, count(*) AS transfers, round(sum(amount), 2) AS volume FROM tx GROUP BY 1"))
def a01(spark, sf):
    return D.channel_breakdown(transfers(spark, sf)).withColumn("volume", F.round("volume", 2))


KPI = """SELECT (SELECT count(*) FROM tx WHERE ts >= (SELECT max(ts) FROM tx) - INTERVAL 24 HOUR) AS transactions_24h,
  (SELECT round(coalesce(sum(amount), 0), 2) FROM tx WHERE risk_score >= 80) AS volume_at_risk,
  (SELECT count(*) FROM accounts WHERE is_flagged_mule) AS flagged_accounts,
  (SELECT count(*) FROM alerts WHERE alert_status IN ('NEW', 'UNDER_INVESTIGATION', 'ESCALATED')) AS active_alerts"""


def _kpis(spark, sf):
    return D.kpis(transfers(spark, sf), accounts(spark, sf), alerts(spark, sf)).withColumn("volume_at_risk", F.round("volume_at_risk", 2))


for name, column in [("a02_transfers_24h", "transactions_24h"), ("a03_flagged_accounts", "flagged_accounts"),
                     ("a04_active_alerts", "active_alerts"), ("a05_volume_at_risk", "volume_at_risk")]:
    query(name, with_(TX, ACCOUNTS, ALERTS, f"SELECT {column} FROM ({KPI})"))(lambda spark, sf, c=column: _kpis(spark, sf).select(c))


@query("a06_risk_distribution", with_(ACCOUNTS, """SELECT l AS risk_level, count(risk_level) AS accounts
  FROM (SELECT unnest(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS l) LEFT JOIN accounts ON l = risk_level GROUP BY 1"""))
def a06(spark, sf):
    return D.risk_distribution(accounts(spark, sf))


@query("a07_top_patterns", with_(*CONTEXT, MATCHES, """SELECT pattern_name, count(*) AS hit_count,
  (['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)] AS severity FROM hits GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""))
def a07(spark, sf):
    return D.top_patterns(exploded_matches(evaluate_rules(context(spark, sf))))


@query("a08_daily_series", with_(TX, ALERTS, """SELECT coalesce(d, e)::VARCHAR AS day, round(coalesce(v, 0), 2) AS total_volume, round(coalesce(f, 0), 2) AS flagged_volume,
  coalesce(n, 0) AS alerts FROM (SELECT ts::DATE AS d, sum(amount) AS v, sum(amount) FILTER (risk_score >= 80) AS f FROM tx GROUP BY 1)
  FULL JOIN (SELECT triggered_at::DATE AS e, count(*) AS n FROM alerts GROUP BY 1) ON d = e"""))
def a08(spark, sf):
    d = D.daily_series(transfers(spark, sf), alerts(spark, sf))
    return d.select(F.col("day").cast("string").alias("day"), F.round("total_volume", 2).alias("total_volume"), F.round("flagged_volume", 2).alias("flagged_volume"), "alerts")


@query("a09_geo_clusters", with_(TX, ALERTS, """SELECT location_city, location_state, count(*) FILTER (flagged = 1) AS active_mules, coalesce(sum(n), 0)::BIGINT AS alerts
  FROM (SELECT location_city, location_state, sender_account, max(is_fraud) AS flagged FROM tx GROUP BY 1, 2, 3)
  LEFT JOIN (SELECT account_id, count(*) AS n FROM alerts GROUP BY 1) ON account_id = sender_account GROUP BY 1, 2"""))
def a09(spark, sf):
    return D.geo_clusters(transfers(spark, sf), alerts(spark, sf))


@query("a10_mule_share", with_(TX, "SELECT channel, round(avg(is_fraud) * 100, 6) AS mule_percentage FROM tx GROUP BY 1"))
def a10(spark, sf):
    return D.mule_share(transfers(spark, sf)).select("channel", F.round("mule_percentage", 6).alias("mule_percentage"))


@query("a11_kpi_row", with_(TX, ACCOUNTS, ALERTS, KPI))
def a11(spark, sf):
    return _kpis(spark, sf)


@query("a12_frequency_encode", with_(TX, """SELECT transaction_id, count(*) OVER (PARTITION BY receiver_account) / (SELECT count(*) FROM tx) AS receiver_account_freq,
  count(*) OVER (PARTITION BY ip_address) / (SELECT count(*) FROM tx) AS ip_address_freq FROM tx"""))
def a12(spark, sf):
    enc = D.frequency_encode(transfers(spark, sf), ["receiver_account", "ip_address"])
    return enc.select("transaction_id", "receiver_account_freq", "ip_address_freq")


@query("a13_linked_accounts", with_(TX, """SELECT 'device' AS kind, device_id AS entity, count(DISTINCT sender_account) AS linked_accounts FROM tx GROUP BY 2
  UNION ALL SELECT 'ip', ip_address, count(DISTINCT sender_account) FROM tx GROUP BY 2
  UNION ALL SELECT 'beneficiary', beneficiary_id, count(DISTINCT sender_account) FROM tx GROUP BY 2"""))
def a13(spark, sf):
    tx = transfers(spark, sf)
    part = lambda kind, c: D.linked_accounts(tx, c).select(F.lit(kind).alias("kind"), F.col(c).alias("entity"), "linked_accounts")
    return part("device", "device_id").unionByName(part("ip", "ip_address")).unionByName(part("beneficiary", "beneficiary_id"))


@query("a14_profile", with_(TX, """SELECT c AS "column", n AS rows, nulls, round(m, 4) AS mean, round(s, 4) AS std, lo AS min, hi AS max, round(f, 6) AS fraud_share FROM (
  SELECT 'amount' AS c, count(*) AS n, count(*) - count(amount) AS nulls, avg(amount) AS m, stddev(amount) AS s, min(amount) AS lo, max(amount) AS hi, avg(is_fraud) AS f FROM tx
  UNION ALL SELECT 'channel', count(*), count(*) - count(channel), NULL, NULL, NULL, NULL, avg(is_fraud) FROM tx
  UNION ALL SELECT 'risk_score', count(*), 0, avg(risk_score), stddev(risk_score), min(risk_score), max(risk_score), avg(is_fraud) FROM tx
  UNION ALL SELECT 'is_fraud', count(*), 0, avg(is_fraud), stddev(is_fraud), min(is_fraud), max(is_fraud), avg(is_fraud) FROM tx)"""))
def a14(spark, sf):
    p = D.profile(transfers(spark, sf).select("amount", "channel", "risk_score", "is_fraud"))
    return p.select("column", "rows", "nulls", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max", F.round("fraud_share", 6).alias("fraud_share"))
