"""Fusion queries over all transfers and accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.session import cut
from ..operators import fusion as U
from ..operators import graph as G
from ..operators.context import rule_context
from ..operators.rules import RULES, evaluate_rules
from ..operators.temporal import temporal_features
from ..plans.flagship import RULES as FLAGSHIP_RULES
from ..plans.flagship import score_forwarders
from ..schema import MODALITIES
from ..sources.driver_tables import accounts, transfers
from ..sources.ingest import build_graph
from .base import LEGS, TX, query, with_
from .graph import FOCAL, DENSITY, EDGES, FAN, PAIRS, SHARED, ego_sql
from .rules import CONTEXT, evaluated_sql
from .temporal import LAST, PAIRS as PASS_PAIRS, RECORD, ROLLING, SUMMARY, burst_sql

TEMPORAL = (ROLLING, LAST, burst_sql(5), PASS_PAIRS, SUMMARY, RECORD)
GRAPH = (FOCAL, EDGES, PAIRS, ego_sql(1), FAN, DENSITY, SHARED, """gsig AS MATERIALIZED (SELECT account, circ.account IS NOT NULL AS has_cycle, fan_in_ratio, fan_out_ratio, neighbourhood_density,
  coalesce(shared_device_count, 0) AS shared_device_count, coalesce(shared_ip_count, 0) AS shared_ip_count FROM focal JOIN fm USING (account) JOIN dens USING (account)
  LEFT JOIN circ USING (account) LEFT JOIN (SELECT account, count(*) FILTER (kind = 'device' AND accounts > 1) AS shared_device_count,
    count(*) FILTER (kind = 'ip' AND accounts > 1) AS shared_ip_count FROM shared GROUP BY 1) USING (account))""")
S_RULES = "round(least(1.0, greatest(least(1.0, rule_score / 100.0::DOUBLE), CASE highest_severity WHEN 'CRITICAL' THEN 0.85 WHEN 'HIGH' THEN 0.65 WHEN 'MEDIUM' THEN 0.4 ELSE 0 END::DOUBLE)), 4)"
S_TEMPORAL = """round(0.35::DOUBLE * burst_detected::INT + 0.35::DOUBLE * CASE WHEN rapid_in_out_detected THEN least(1.0, rapid_in_out_ratio) ELSE 0 END
  + 0.15::DOUBLE * least(1.0, n_1h / 10.0::DOUBLE) + 0.15::DOUBLE * temporal_concentration_raw, 4)"""
S_GRAPH = """round(0.35::DOUBLE * has_cycle::INT + 0.35::DOUBLE * least(1.0, (shared_device_count * 0.6::DOUBLE + shared_ip_count * 0.4::DOUBLE) / 3.0::DOUBLE)
  + 0.15::DOUBLE * least(1.0, greatest(fan_in_ratio, fan_out_ratio)) + 0.15::DOUBLE * least(1.0, neighbourhood_density), 4)"""
RAW = "traw AS (SELECT t.*, b.peak / b.events AS temporal_concentration_raw FROM temporal t JOIN burst b USING (account))"


def account_graph(spark, sf):
    """Graph inputs of the fusion for every account: one-hop density, fan ratios, shared entities, cycle flag."""
    nodes, edges = build_graph(transfers(spark, sf))
    edges = cut(edges)
    everyone = G.accounts_in_large_transfers(transfers(spark, sf), 0.0)
    g = G.fan_metrics(edges).join(G.density(G.ego(nodes, edges, everyone, 1), edges), "account")
    flags = G.circular_flags(edges).select("account", F.col("in_cycle").alias("has_cycle"))
    g = g.join(flags, "account", "left").join(G.shared_counts(G.shared_entities(edges)), "account", "left")
    return g.fillna({"has_cycle": False, "shared_device_count": 0, "shared_ip_count": 0})


def scored_transfers(spark, sf):
    """Every transfer with its rule result and the temporal and graph record of its sender."""
    g = cut(account_graph(spark, sf))
    judged = evaluate_rules(rule_context(transfers(spark, sf), accounts(spark, sf), g.select("account", F.col("has_cycle").alias("in_cycle"))))
    judged = judged.withColumn("rule_count", F.size("matches")).select("transaction_id", F.col("sender_account").alias("account"), "rule_score", "highest_severity", "rule_count")
    t = temporal_features(transfers(spark, sf))
    return judged.join(t, "account", "left").join(g, "account", "left")


def _signal(df, name, *keys):
    s = F.element_at("signals", name)
    return U.signals(df).select(*keys, s["value"].alias("value"), s["status"].alias("status"))


@query("u01_rules_signal", with_(*CONTEXT, evaluated_sql(RULES), f"SELECT transaction_id, {S_RULES} AS value, 'available' AS status FROM evaluated"))
def u01(spark, sf):
    from .rules import context

    return _signal(evaluate_rules(context(spark, sf)).withColumn("rule_count", F.size("matches")), "rules", "transaction_id")


@query("u02_temporal_signal", with_(TX, LEGS, *TEMPORAL, RAW, f"SELECT account, {S_TEMPORAL} AS value, 'available' AS status FROM traw"))
def u02(spark, sf):
    return _signal(temporal_features(transfers(spark, sf)), "temporal", "account")


from .rules import CIRCULAR  # noqa: E402


@query("u03_graph_signal", with_(TX, CIRCULAR, *GRAPH, f"SELECT account, {S_GRAPH} AS value, 'available' AS status FROM gsig"))
def u03(spark, sf):
    return _signal(account_graph(spark, sf), "graph", "account")


@query("u04_model_signal", with_(TX, """SELECT transaction_id, CASE WHEN risk_score >= 40 THEN round(least(1.0, risk_score / 80), 4) ELSE 0 END::DOUBLE AS value,
  CASE WHEN risk_score >= 40 THEN 'available' WHEN risk_score >= 20 THEN 'model_unavailable' ELSE 'missing' END AS status FROM tx"""))
def u04(spark, sf):
    tx = transfers(spark, sf).select(
        "transaction_id", (F.col("risk_score") / 80).alias("tabular_ml_probability"), F.col("risk_score").cast("int").alias("tabular_ml_score"), F.lit("v1").alias("tabular_ml_version"),
        F.when(F.col("risk_score") >= 40, True).when(F.col("risk_score") >= 20, False).alias("tabular_ml_available"))
    return _signal(tx, "tabular_ml", "transaction_id")


@query("u05_weights", """SELECT unnest(['rules', 'temporal', 'graph', 'tabular_ml', 'graph_ml']) AS modality, round(unnest([2, 1, 1, 4, 2]) / 10, 6) AS weight, count(*) AS transfers FROM events GROUP BY ALL""".replace(
    "SELECT unnest", "SELECT modality, weight, (SELECT count(*) FROM events) AS transfers FROM (SELECT unnest").replace(", count(*) AS transfers FROM events GROUP BY ALL", ")"))
def u05(spark, sf):
    w = U.normalized_weights(dict(zip(MODALITIES, [2, 1, 1, 4, 2])))
    n = transfers(spark, sf).agg(F.count(F.lit(1)).alias("transfers"))
    pairs = F.array(*[F.struct(F.lit(m).alias("modality"), F.lit(round(v, 6)).alias("weight")) for m, v in w.items()])
    return n.select("transfers", F.inline(pairs))


JOINED = f"""joined AS MATERIALIZED (SELECT transaction_id, {S_RULES} AS s1, {S_TEMPORAL} AS s2, {S_GRAPH} AS s3 FROM evaluated e JOIN traw ON traw.account = e.sender_account JOIN gsig ON gsig.account = e.sender_account)"""
CTES = (*CONTEXT, evaluated_sql(RULES), *TEMPORAL, RAW, *GRAPH, JOINED)
SCORE = {
    "renormalize_available": "round(100 * least(1.0, 0.25 / 0.6 * s1 + 0.15 / 0.6 * s2 + 0.2 / 0.6 * s3), 6)",
    "zero_contribution": "round(100 * least(1.0, 0.25 * s1 + 0.15 * s2 + 0.2 * s3), 6)",
    "penalty_baseline": "round(100 * least(1.0, 0.25 * s1 + 0.15 * s2 + 0.2 * s3 + 0.4 * 0.2), 6)",
}
TIER = "CASE WHEN score < 30 THEN 'LOW' WHEN score < 65 THEN 'MEDIUM' WHEN score < 85 THEN 'HIGH' ELSE 'CRITICAL' END"



def raw_score():
    """The score before it is rounded to two places; a tie in the last place is then no difference between engines."""
    total = sum((F.element_at("contributions", m)["contribution"] for m in MODALITIES), F.lit(0.0))
    return F.round(F.least(F.lit(1.0), total) * 100, 6).alias("score")


for _policy, _score in SCORE.items():
    @query(f"u06_fuse_{_policy}", with_(*CTES, f"SELECT transaction_id, {_score.replace('0.25', '0.25::DOUBLE')} AS score FROM joined"))
    def _fuse(spark, sf, policy=_policy):
        f = U.fuse(U.signals(scored_transfers(spark, sf)), policy=policy)
        return f.select("transaction_id", raw_score())


@query("u07_contributions", with_(*CTES, """SELECT transaction_id, round(0.25 / 0.6 * s1, 6) AS rules, round(0.15 / 0.6 * s2, 6) AS temporal, round(0.2 / 0.6 * s3, 6) AS graph FROM joined"""))
def u07(spark, sf):
    f = U.fuse(U.signals(scored_transfers(spark, sf)))
    part = lambda m: F.element_at("contributions", m)["weighted_score"].alias(m)
    return f.select("transaction_id", part("rules"), part("temporal"), part("graph"))


@query("u08_tiers", with_(TX, f"SELECT tier AS risk_level, count(*) AS transfers FROM (SELECT {TIER.replace('score', 'risk_score')} AS tier FROM tx) GROUP BY 1"))
def u08(spark, sf):
    return transfers(spark, sf).groupBy(U.tier(F.col("risk_score")).alias("risk_level")).agg(F.count(F.lit(1)).alias("transfers"))


@query("u09_explanations", with_(TX, LEGS, *TEMPORAL, RAW, f"""SELECT account, 'TEMPORAL: normalized=' || printf('%.4f', s) || ', effective_weight=1.0000 (configured=0.1500) -> contribution=' || printf('%.4f', s) ||
  '. Status: Evaluated (burst=' || CASE WHEN burst_detected THEN 'True' ELSE 'False' END || ', rapid=' || CASE WHEN rapid_in_out_detected THEN 'True' ELSE 'False' END || ', tx_1h=' || n_1h || ')' AS explanation,
  'temporal' AS available, 'rules,graph,tabular_ml,graph_ml' AS unavailable FROM (SELECT *, {S_TEMPORAL} AS s FROM traw)"""))
def u09(spark, sf):
    f = U.fuse(U.signals(temporal_features(transfers(spark, sf))))
    return f.select("account", F.element_at("contributions", "temporal")["explanation"].alias("explanation"),
                    F.array_join("available_modalities", ",").alias("available"), F.array_join("unavailable_modalities", ",").alias("unavailable"))


FLAGSHIP = f"""fw AS MATERIALIZED (SELECT account, count(*) AS forwarded_pairs, max(ratio) AS highest_ratio FROM pairs WHERE ratio >= 0.9 GROUP BY 1),
wr AS MATERIALIZED (SELECT sender_account AS account, arg_max(rule_score, o) AS rule_score, arg_max(highest_severity, o) AS highest_severity FROM (SELECT *, (rule_score, transaction_id) AS o FROM evaluated) GROUP BY 1)"""


@query("flagship_forwarders", with_(*CONTEXT, evaluated_sql(FLAGSHIP_RULES), *TEMPORAL, RAW, FLAGSHIP, f"""SELECT account, forwarded_pairs, round(highest_ratio, 4) AS highest_ratio, rule_score, highest_severity,
  {TIER} AS risk_level FROM (SELECT fw.*, rule_score, highest_severity, round(100 * (0.625::DOUBLE * {S_RULES} + 0.375::DOUBLE * {S_TEMPORAL}), 6) AS score FROM fw JOIN traw USING (account) LEFT JOIN wr USING (account))"""))
def flagship(spark, sf):
    f = score_forwarders(transfers(spark, sf), accounts=accounts(spark, sf))
    return f.select("account", "forwarded_pairs", F.round("highest_ratio", 4).alias("highest_ratio"), "rule_score", "highest_severity", "risk_level")
