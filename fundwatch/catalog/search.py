"""Filters, lookups, complaint JSON and graph view queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ts_text
from ..operators import search as S
from ..sources.driver_tables import accounts, alerts, complaints_input, transfers
from .base import ACCOUNTS, ALERTS, TX, query, ts, with_

SHOWN = ["transaction_id", "channel", "amount"]
UPI = dict(channel="UPI", min_amount=1000.0, max_amount=150000.0, start="2024-01-05 00:00:00", end="2024-01-25 00:00:00")
UPI_SQL = "channel = 'UPI' AND amount BETWEEN 1000 AND 150000 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'"


@query("f01_search_transfers", with_(TX, f"""SELECT transaction_id, channel, amount, {ts('ts')} AS at FROM tx WHERE {UPI_SQL}
  ORDER BY ts DESC, transaction_id DESC LIMIT 20 OFFSET 40"""))
def f01(spark, sf):
    return S.search_transfers(transfers(spark, sf), skip=40, limit=20, **UPI).select(*SHOWN, ts_text("ts").alias("at"))


@query("f01_filter_transfers", with_(TX, f"SELECT transaction_id, channel, amount FROM tx WHERE {UPI_SQL}"))
def f01_all(spark, sf):
    return S.filter_transfers(transfers(spark, sf), **UPI).select(*SHOWN)


@query("f02_count_transfers", with_(TX, f"SELECT count(*) AS total FROM tx WHERE {UPI_SQL}"))
def f02(spark, sf):
    return S.count_transfers(transfers(spark, sf), **UPI)


@query("f03_search_accounts", with_(ACCOUNTS, """SELECT account_number, risk_score, risk_level FROM accounts
  WHERE risk_level = 'HIGH' AND NOT is_flagged_mule ORDER BY risk_score DESC, account_number LIMIT 50"""))
def f03(spark, sf):
    return S.search_accounts(accounts(spark, sf), risk_level="HIGH", is_flagged_mule=False, limit=50).select("account_number", "risk_score", "risk_level")


@query("f04_search_alerts", with_(ALERTS, """SELECT alert_number, account_id, risk_score FROM alerts WHERE severity = 'HIGH' AND alert_status = 'NEW'
  AND pattern_type = 'Mule Chain' ORDER BY triggered_at DESC, alert_number DESC LIMIT 20"""))
def f04(spark, sf):
    found = S.search_alerts(alerts(spark, sf), severity="HIGH", alert_status="NEW", pattern_type="Mule Chain")
    return found.select("alert_number", "account_id", "risk_score")


def _reports(spark, sf):
    built = S.build_complaints(complaints_input(spark, sf))
    return built.withColumns({"generated_at": F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60),
                              "case_id": F.concat(F.lit("CASE-"), F.col("conv_id") % 100)})


REPORTS = """reports AS MATERIALIZED (
  SELECT conv_id, turn, text, 'CMP-' || upper(substr(sha256('TX-' || conv_id || ':' || text), 1, 12)) AS report_number,
    'VICTIM_COMPLAINT' AS report_type, 'victim' || conv_id || '@example.org' AS victim_email,
    CASE WHEN turn % 4 = 0 THEN 'UPI Fraud' ELSE 'Phishing Fraud' END AS incident_type, length(text) * 10.0::DOUBLE AS amount_lost,
    'CASE-' || (conv_id % 100) AS case_id FROM conversations WHERE role = 'user')"""


@query("f05_search_reports", with_(REPORTS, """SELECT report_number, case_id FROM reports WHERE case_id = 'CASE-7' ORDER BY turn DESC, report_number DESC LIMIT 30"""))
def f05(spark, sf):
    return S.search_reports(_reports(spark, sf), report_type="VICTIM_COMPLAINT", case_id="CASE-7", limit=30).select("report_number", "case_id")


@query("f06_lookup", with_(TX, f"SELECT transaction_id, sender_account, receiver_account, amount, {ts('ts')} AS at FROM tx WHERE transaction_id = 'TX-123'"))
def f06(spark, sf):
    return S.lookup(transfers(spark, sf), "transaction_id", "TX-123").select("transaction_id", "sender_account", "receiver_account", "amount", ts_text("ts").alias("at"))


@query("f07_page_meta", with_(TX, f"""SELECT count(*) AS total, 3 AS page, 20 AS page_size, ceil(count(*) / 20.0)::BIGINT AS pages,
  3 < ceil(count(*) / 20.0) AS has_next, true AS has_prev FROM tx WHERE {UPI_SQL}"""))
def f07(spark, sf):
    return S.page_meta(S.filter_transfers(transfers(spark, sf), **UPI), page=3, size=20)


@query("f08_complaints_by_email", with_(REPORTS, "SELECT report_number, turn FROM reports WHERE victim_email = 'victim7@example.org'"))
def f08(spark, sf):
    return S.complaints_by_email(_reports(spark, sf), "victim7@example.org").select("report_number", "turn")


@query("f09_expand_complaints", with_(REPORTS, """SELECT report_number, victim_email, incident_type, amount_lost, sha256(text) AS description_hash FROM reports"""))
def f09(spark, sf):
    return S.expand_complaints(_reports(spark, sf)).select(
        "report_number", "victim_email", "incident_type", "amount_lost", F.sha2("description", 256).alias("description_hash"))


@query("f10_build_complaints", with_(REPORTS, """SELECT sha256('TX-' || conv_id || ':' || text) AS report_key, report_number, report_type, 'Victim Complaint: ' || incident_type || ' — Victim ' || conv_id AS title FROM reports"""))
def f10(spark, sf):
    return _reports(spark, sf).select("report_key", "report_number", "report_type", "title")


@query("f11_account_history", with_(TX, """SELECT account, transaction_id, side, position FROM (
  SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts DESC, transaction_id DESC) AS position FROM (
    SELECT sender_account AS account, transaction_id, ts, CASE WHEN sender_account = receiver_account THEN 'self' ELSE 'out' END AS side FROM tx
    UNION ALL SELECT receiver_account, transaction_id, ts, 'in' FROM tx WHERE sender_account <> receiver_account)) WHERE position <= 50"""))
def f11(spark, sf):
    return S.account_history(transfers(spark, sf), 50).select("account", "transaction_id", "side", F.col("position").cast("long").alias("position"))


@query("f12_recent", with_(TX, "SELECT transaction_id, amount FROM tx ORDER BY ts DESC, transaction_id DESC LIMIT 20"))
def f12(spark, sf):
    return S.recent(transfers(spark, sf)).select("transaction_id", "amount")


def _network(spark, sf):
    """Accounts as nodes with risk, transfers as edges."""
    tx = transfers(spark, sf)
    sent = tx.groupBy(F.col("sender_account").alias("id")).agg(F.max("risk_score").alias("risk_score"), F.max("sender_bank").alias("bank"), (F.sum("is_fraud") >= 20).alias("is_mule"))
    return sent.withColumn("type", F.lit("account")), tx.select(
        F.col("sender_account").alias("source"), F.col("receiver_account").alias("target"), "transaction_id", "amount")


NODES = """nodes AS MATERIALIZED (SELECT sender_account AS id, max(risk_score) AS risk_score, max(sender_bank) AS bank, sum(is_fraud) >= 20 AS is_mule FROM tx GROUP BY 1)"""


@query("f13_graph_view", with_(TX, NODES, """kept AS (SELECT * FROM nodes WHERE risk_score >= 75 AND bank = 'HDFC Bank')""", """SELECT transaction_id, sender_account AS source, receiver_account AS target FROM tx
  WHERE amount >= 5000 AND sender_account IN (SELECT id FROM kept) AND receiver_account IN (SELECT id FROM kept)"""))
def f13(spark, sf):
    nodes, edges = _network(spark, sf)
    return S.graph_view(nodes, edges, risk="HIGH", kind="account", bank="HDFC Bank", min_amount=5000)[1].select("transaction_id", "source", "target")


@query("f14_top_nodes", with_(TX, NODES, "top AS MATERIALIZED (SELECT * FROM nodes ORDER BY risk_score DESC, id LIMIT 85)", """SELECT transaction_id, sender_account AS source,
  receiver_account AS target FROM tx WHERE sender_account IN (SELECT id FROM top) AND receiver_account IN (SELECT id FROM top)"""))
def f14(spark, sf):
    return S.top_nodes(*_network(spark, sf))[1].select("transaction_id", "source", "target")


@query("f15_search_reference", with_(TX, "SELECT transaction_id FROM tx WHERE lower(transaction_id) LIKE '%x-77%'"))
def f15(spark, sf):
    return S.search_ref(transfers(spark, sf), "X-77").select("transaction_id")


@query("f16_latest_state", with_(ALERTS, """SELECT account_id, arg_max(alert_status, triggered_at) AS alert_status FROM alerts GROUP BY 1"""))
def f16(spark, sf):
    return S.latest_state(alerts(spark, sf), "account_id", "triggered_at", "alert_status").select("account_id", "alert_status")
