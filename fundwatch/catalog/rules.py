"""Rule context and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import micros
from ..operators import context as C
from ..operators import rules as R
from ..operators.graph import circular_flags
from ..sources.driver_tables import accounts, transfers
from ..functions.session import cut
from ..sources.ingest import account_pairs
from .base import ACCOUNTS, LEGS, TX, query, with_

HIST = """hist AS MATERIALIZED (
  SELECT transaction_id, amount, us, side, count(*) OVER (p RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) - 1 AS history_1h,
    count(*) OVER (p RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - 1 AS history_n,
    round(sum(amount) OVER (p RANGE BETWEEN 900000000 PRECEDING AND CURRENT ROW) - amount, 4) AS recent_sum,
    round(sum(CASE WHEN side <> 'out' THEN amount ELSE 0 END) OVER (p RANGE BETWEEN 900000000 PRECEDING AND CURRENT ROW)
      - CASE WHEN side = 'self' THEN amount ELSE 0 END, 4) AS inbound_sum,
    count(DISTINCT channel) OVER (p RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS channels_1h,
    lag(us) OVER (PARTITION BY account ORDER BY us, transaction_id) AS previous_us
  FROM legs WINDOW p AS (PARTITION BY account ORDER BY us))"""
FAN = """fan AS MATERIALIZED (SELECT transaction_id,
    count(DISTINCT sender_account) OVER (PARTITION BY receiver_account ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS fan_in,
    count(DISTINCT receiver_account) OVER (PARTITION BY sender_account ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS fan_out FROM tx)"""
TRAVEL = """travel AS MATERIALIZED (SELECT transaction_id, CASE WHEN pu IS NULL THEN NULL ELSE
    2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(latitude) - radians(pa)) / 2), 2) + cos(radians(pa)) * cos(radians(latitude)) * pow(sin((radians(longitude) - radians(po)) / 2), 2))))
    / ((us - pu) / 3.6e9) END AS speed
  FROM (SELECT *, lag(us) OVER w AS pu, lag(latitude) OVER w AS pa, lag(longitude) OVER w AS po FROM tx WINDOW w AS (PARTITION BY sender_account ORDER BY us, transaction_id)))"""
LINKED = """dev AS (SELECT device_id AS d, count(DISTINCT sender_account) AS linked_devices FROM tx GROUP BY 1),
ips AS (SELECT ip_address AS i, count(DISTINCT sender_account) AS linked_ips FROM tx GROUP BY 1),
ben AS (SELECT beneficiary_id AS b, count(DISTINCT sender_account) AS linked_beneficiaries FROM tx GROUP BY 1)"""
CIRCULAR = """p AS MATERIALIZED (SELECT DISTINCT sender_account AS s, receiver_account AS d FROM tx),
w2 AS MATERIALIZED (SELECT DISTINCT a.s, b.d FROM p a JOIN p b ON a.d = b.s),
w3 AS MATERIALIZED (SELECT DISTINCT a.s, b.d FROM w2 a JOIN p b ON a.d = b.s),
w4 AS MATERIALIZED (SELECT DISTINCT a.s, b.d FROM w3 a JOIN p b ON a.d = b.s),
w5 AS MATERIALIZED (SELECT DISTINCT a.s, b.d FROM w4 a JOIN p b ON a.d = b.s),
circ AS MATERIALIZED (SELECT s AS account, min(l) AS shortest_cycle FROM (SELECT s, 1 AS l FROM p WHERE s = d UNION ALL SELECT s, 2 FROM w2 WHERE s = d
  UNION ALL SELECT s, 3 FROM w3 WHERE s = d UNION ALL SELECT s, 4 FROM w4 WHERE s = d UNION ALL SELECT s, 5 FROM w5 WHERE s = d) GROUP BY 1)"""
CTX = """ctx AS MATERIALIZED (SELECT t.transaction_id, t.ts, t.sender_account, t.receiver_account, t.amount, t.channel, t.account_age_days AS account_age,
    coalesce(linked_devices, 1) AS linked_devices, coalesce(linked_ips, 1) AS linked_ips, coalesce(linked_beneficiaries, 1) AS linked_beneficiaries,
    fan_in, fan_out, speed AS travel_speed_kmh, history_1h, history_n, recent_sum, inbound_sum, channels_1h,
    coalesce(floor((h.us - previous_us) / 86400000000), 0)::INT AS dormant_days, c.account IS NOT NULL AS in_cycle
  FROM tx t JOIN hist h ON h.transaction_id = t.transaction_id AND h.side <> 'in' JOIN fan f ON f.transaction_id = t.transaction_id
  JOIN travel v ON v.transaction_id = t.transaction_id LEFT JOIN dev ON d = device_id LEFT JOIN ips ON i = ip_address LEFT JOIN ben ON b = beneficiary_id
  LEFT JOIN circ c ON c.account = t.sender_account)"""
CONTEXT = (TX, LEGS, HIST, FAN, TRAVEL, LINKED, CIRCULAR, CTX)


def context(spark, sf, active=None, carried=()):
    tx = cut(transfers(spark, sf))
    circular = circular_flags(account_pairs(tx)) if active is None or "R014" in active else None
    return C.rule_context(tx, accounts(spark, sf), circular, active=active, carried=carried)


@query("c01_history", with_(TX, LEGS, HIST, "SELECT transaction_id, history_1h, history_n, recent_sum, inbound_sum, channels_1h FROM hist WHERE side <> 'in'"))
def c01(spark, sf):
    h = C.history(transfers(spark, sf))
    return h.select("transaction_id", "history_1h", "history_n", F.round("recent_sum", 4).alias("recent_sum"), F.round("inbound_sum", 4).alias("inbound_sum"), "channels_1h")


@query("c01_fan_counts", with_(TX, FAN, "SELECT * FROM fan"))
def c01_fan(spark, sf):
    return C.fan_counts(transfers(spark, sf)).select("transaction_id", "fan_in", "fan_out")


@query("c02_dormant_days", with_(TX, LEGS, HIST, "SELECT transaction_id, coalesce(floor((us - previous_us) / 86400000000), 0)::INT AS dormant_days FROM hist WHERE side <> 'in'"))
def c02(spark, sf):
    h = C.history(transfers(spark, sf))
    return h.select("transaction_id", C.dormant_days(F.col("previous_us"), micros("ts")).alias("dormant_days"))


@query("c03_account_age", with_(TX, ACCOUNTS, """SELECT transaction_id, account_age_days::INT AS account_age, floor((us - epoch_us(opened_at)) / 86400000000)::INT AS age_from_opening
  FROM tx LEFT JOIN accounts ON account_number = sender_account"""))
def c03(spark, sf):
    tx, acc = transfers(spark, sf), accounts(spark, sf)
    with_meta = C.account_age(tx, acc)
    bare = C.account_age(with_meta.withColumnRenamed("account_age", "given").withColumn("metadata", F.create_map().cast("map<string,string>")), acc)
    return bare.select("transaction_id", F.col("given").alias("account_age"), F.col("account_age").alias("age_from_opening"))


@query("c04_travel_speed", with_(TX, TRAVEL, "SELECT transaction_id, round(speed, 4) AS travel_speed_kmh FROM travel"))
def c04(spark, sf):
    return C.travel_speed(transfers(spark, sf)).select("transaction_id", F.round("travel_speed_kmh", 4).alias("travel_speed_kmh"))


@query("c05_linked_counts", with_(TX, LINKED, """SELECT transaction_id, linked_devices::INT AS linked_devices, linked_ips::INT AS linked_ips, linked_beneficiaries::INT AS linked_beneficiaries
  FROM tx JOIN dev ON d = device_id JOIN ips ON i = ip_address JOIN ben ON b = beneficiary_id"""))
def c05(spark, sf):
    return C.linked_counts(transfers(spark, sf)).select("transaction_id", *C.LINKED.values())


@query("c06_circular_flags", with_(TX, CIRCULAR, "SELECT account, shortest_cycle, true AS in_cycle FROM circ"))
def c06(spark, sf):
    return circular_flags(account_pairs(transfers(spark, sf)))


# Thresholds: the defaults where they fire on this data, lower ones where they do not.
CASES = {
    "r01_high_velocity": ("R001", {"threshold": 2}, "history_1h >= 2"),
    "r02_fan_in": ("R002", {}, "fan_in >= 10"),
    "r03_fan_out": ("R003", {"threshold": 5}, "fan_out >= 5"),
    "r04_mule_chain": ("R004", {}, "amount > 0 AND recent_sum > 0 AND amount / recent_sum >= 0.90"),
    "r04_mule_chain_inbound": ("R004", {"mode": "inbound"}, "amount > 0 AND inbound_sum > 0 AND amount / inbound_sum >= 0.90"),
    "r05_smurfing": ("R005", {}, "amount BETWEEN 48000 AND 49999"),
    "r06_shared_device": ("R006", {}, "linked_devices > 3"),
    "r07_dormant": ("R007", {"days": 1}, "dormant_days > 1"),
    "r08_new_account": ("R008", {"age": 30, "count": 5}, "account_age < 30 AND history_n > 5"),
    "r09_cross_channel": ("R009", {}, "channels_1h >= 3"),
    "r10_shared_ip": ("R010", {}, "linked_ips > 5"),
    "r11_impossible_travel": ("R011", {}, "travel_speed_kmh > 500"),
    "r12_night_activity": ("R012", {}, "hour(ts) < 5 AND amount >= 50000"),
    "r13_shared_beneficiary": ("R013", {}, "linked_beneficiaries >= 5"),
    "r14_circular_flow": ("R014", {}, "in_cycle OR sender_account = receiver_account"),
}


DEFAULTS = {
    "R001": "history_1h >= 20", "R002": "fan_in >= 10", "R003": "fan_out >= 10",
    "R004": "amount > 0 AND recent_sum > 0 AND amount / recent_sum >= 0.90", "R005": "amount BETWEEN 48000 AND 49999",
    "R006": "linked_devices > 3", "R007": "dormant_days > 90", "R008": "account_age < 7 AND history_n > 15", "R009": "channels_1h >= 3",
    "R010": "linked_ips > 5", "R011": "coalesce(travel_speed_kmh > 500, false)", "R012": "hour(ts) < 5 AND amount >= 50000",
    "R013": "linked_beneficiaries >= 5", "R014": "in_cycle OR sender_account = receiver_account",
}
RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
# The rules' pattern, score, severity and narrative, written out for the SQL side.
FIXED = {
    "R001": ("High Velocity", 25, "HIGH", "'High velocity detected: ' || history_1h || ' transactions executed in the past hour.'"),
    "R002": ("Fan In", 30, "HIGH", "'Fan-In Collector detected: ' || fan_in || ' unique senders transferred to account.'"),
    "R003": ("Fan Out", 30, "HIGH", "'Fan-Out Distributor detected: funds scattered to ' || fan_out || ' receivers.'"),
    "R004": ("Mule Chain", 40, "CRITICAL", "'Mule Chain Pass-Through detected: >90% of funds (₹' || format('{:,.2f}', amount) || ') forwarded within 15 minutes.'"),
    "R005": ("Smurfing", 35, "HIGH", "'Smurfing / Structuring detected: transfer of ₹' || format('{:,.2f}', amount) || ' just under reporting threshold.'"),
    "R006": ("Shared Device", 35, "HIGH", "'Shared Device pattern detected: hardware fingerprint linked to ' || linked_devices || ' accounts.'"),
    "R007": ("Dormant Reactivation", 30, "HIGH", "'Dormant Account Reactivation detected: sudden activity on account dormant >90 days.'"),
    "R008": ("New Account Abuse", 25, "HIGH", "'New Account Abuse detected: ' || history_n || ' transactions on account created ' || account_age::INT || ' days ago (<7 days).'"),
    "R009": ("Cross-Channel Hopping", 25, "MEDIUM", "'Cross-Channel Hopping detected: cycling across ' || channels_1h || ' distinct rails within 1 hour.'"),
    "R010": ("Shared IP", 30, "HIGH", "'Shared IP pattern detected: public IP address linked to ' || linked_ips || ' accounts.'"),
    "R011": ("Impossible Travel", 35, "HIGH", "'Impossible Travel detected: physical transit speed between transactions exceeds 500 km/h.'"),
    "R012": ("Night Activity", 20, "MEDIUM", "'Night Activity anomaly detected: high-value transfer (₹' || format('{:,.2f}', amount) || ') executed between 12 AM and 5 AM.'"),
    "R013": ("Shared Beneficiary", 30, "HIGH", "'Shared Beneficiary detected: beneficiary account shared by ' || linked_beneficiaries || ' unrelated accounts.'"),
    "R014": ("Circular Flow", 40, "CRITICAL", "'Circular Flow detected: funds traverse intermediate accounts and return to originator.'"),
}
MATCHES = "hits AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT transaction_id, '{c}' AS rule_code, '{p}' AS pattern_name, '{severity}' AS severity, {text} AS narrative FROM ctx WHERE {DEFAULTS[c]}" for c, (p, _, severity, text) in FIXED.items()) + ")"


def _register(name, code, overrides, where):
    pattern, score, severity, _ = FIXED[code]
    sql = with_(*CONTEXT, f"SELECT transaction_id, '{pattern}' AS pattern_name, {score} AS score, '{severity}' AS severity FROM ctx WHERE {where}")

    @query(name, sql)
    def run(spark, sf):
        hit = R.evaluate_rule(context(spark, sf, [code]), code, **overrides).filter("matched")
        return hit.select("transaction_id", "pattern_name", "score", "severity")


for _name, (_code, _overrides, _where) in CASES.items():
    _register(_name, _code, _overrides, _where)

def evaluated_sql(codes, where=DEFAULTS) -> str:
    score = " + ".join(f"CASE WHEN {where[c]} THEN {FIXED[c][1]} ELSE 0 END" for c in codes)
    rank = ", ".join(f"CASE WHEN {where[c]} THEN {RANK[FIXED[c][2]]} ELSE 1 END" for c in codes)
    hits = ", ".join(f"CASE WHEN {where[c]} THEN '{c}' END" for c in codes)
    return (f"evaluated AS MATERIALIZED (SELECT *, ({score})::INT AS rule_score, (['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[greatest({rank})] AS highest_severity, "
            f"coalesce(array_to_string([{hits}], ','), '') AS codes FROM ctx)")


@query("r15_evaluate_rules", with_(*CONTEXT, evaluated_sql(R.RULES), "SELECT transaction_id, rule_score, highest_severity, codes FROM evaluated"))
def r15(spark, sf):
    e = R.evaluate_rules(context(spark, sf))
    return e.select("transaction_id", "rule_score", "highest_severity", F.array_join(F.transform("matches", lambda m: m["rule_code"]), ",").alias("codes"))


WHITELIST = ["R004", "R009", "R012"]


@query("r16_active_rules", with_(*CONTEXT, evaluated_sql(WHITELIST, {**DEFAULTS, "R009": "channels_1h >= 2", "R012": "hour(ts) < 5 AND amount >= 20000"}), "SELECT transaction_id, rule_score, highest_severity, codes FROM evaluated"))
def r16(spark, sf):
    limits = F.when(F.col("rule_code") == "R009", 2.0).when(F.col("rule_code") == "R012", 20_000.0)
    rules = R.registry(spark).withColumns({"is_active": F.col("rule_code").isin(WHITELIST), "threshold_value": limits})
    active = R.active_rules(rules)
    e = R.evaluate_rules(context(spark, sf, active), active=active, overrides=R.rule_overrides(rules))
    return e.select("transaction_id", "rule_score", "highest_severity", F.array_join(F.transform("matches", lambda m: m["rule_code"]), ",").alias("codes"))


@query("r17_narratives", with_(*CONTEXT, MATCHES, "SELECT transaction_id, rule_code, severity, narrative FROM hits"))
def r17(spark, sf):
    return R.exploded_matches(R.evaluate_rules(context(spark, sf))).select("transaction_id", "rule_code", "severity", "narrative")
