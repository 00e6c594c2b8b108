"""Features, splits, models and metrics."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from ..functions.session import cut
from ..operators import features as T
from ..operators import ml as M
from ..sources.driver_tables import transfers
from .base import LEGS, TX, query, with_
from .graph import FEATURE_CTES, FOCAL, numbers as graph_record
from .temporal import PAIRS, ROLLING, asof_sql, round_up, to_places

NATIVE_SQL = """SELECT transaction_id, amount, round(log10(amount + 1), 4) AS log_amount, (channel = 'UPI')::INT::DOUBLE AS channel_upi, (channel = 'NEFT')::INT::DOUBLE AS channel_neft,
  (channel = 'RTGS')::INT::DOUBLE AS channel_rtgs, (channel = 'IMPS')::INT::DOUBLE AS channel_imps, (channel = 'CARD')::INT::DOUBLE AS channel_other, (sender_bank <> receiver_bank)::INT::DOUBLE AS is_interbank,
  1.0::DOUBLE AS has_device_id, 1.0::DOUBLE AS has_ip_address, hour(ts)::DOUBLE AS hour_of_day, (isodow(ts) - 1)::DOUBLE AS day_of_week, (isodow(ts) >= 6)::INT::DOUBLE AS is_weekend,
  (hour(ts) < 6 OR hour(ts) >= 22)::INT::DOUBLE AS is_night"""


def _features(spark, sf):
    """The 57 features; the canonical transfers are written once and read by all three parts."""
    tx = cut(transfers(spark, sf))
    return T.build_features(tx, graph=graph_record(tx), history=tx)


def _dataset(spark, sf, target="is_fraud"):
    df = _features(spark, sf)
    return cut(T.split_random(T.dataset(df, target)))


@query("m01_native_features", with_(TX, NATIVE_SQL + " FROM tx"))
def m01(spark, sf):
    return T.native_features(transfers(spark, sf)).select("transaction_id", *T.NATIVE)


@query("m02_telemetry_features", with_(TX, """SELECT transaction_id, account_age_days::DOUBLE AS account_age_days, velocity_l6h::DOUBLE AS velocity_l6h, 0.01::DOUBLE AS churn_rate, user_risk_score::DOUBLE AS user_risk_score,
  85.0::DOUBLE AS device_trust_score, is_vpn::INT::DOUBLE AS is_vpn_or_proxy, 0.0::DOUBLE AS is_rooted_or_emulator, 15.0::DOUBLE AS network_risk_score FROM tx"""))
def m02(spark, sf):
    return T.telemetry_features(transfers(spark, sf)).select("transaction_id", "account_age_days", "velocity_l6h", "churn_rate", "user_risk_score", "device_trust_score", "is_vpn_or_proxy", "is_rooted_or_emulator", "network_risk_score")


# Each transfer's sender at the transfer's own time.
OWN_TIME = (LEGS, ROLLING, PAIRS, asof_sql("SELECT transaction_id AS id, sender_account AS account, us FROM tx"))


@query("m03_temporal_join", with_(TX, *OWN_TIME, """SELECT id AS transaction_id, n_5m::DOUBLE AS temporal_tx_count_5m, n_15m::DOUBLE AS temporal_tx_count_15m, n_1h::DOUBLE AS temporal_tx_count_1h, n_24h::DOUBLE AS temporal_tx_count_24h,
  round(amount_5m, 2)::DOUBLE AS temporal_amount_sum_5m, round(amount_1h, 2)::DOUBLE AS temporal_amount_sum_1h, """ + to_places("coalesce(average_interval, 0)", 4) + """ AS temporal_avg_interval_seconds,
  (burst_detected OR burst_count > 0)::INT::DOUBLE AS temporal_burst_detected, burst_count::DOUBLE AS temporal_burst_count, rapid_in_out_detected::INT::DOUBLE AS temporal_rapid_in_out_detected,
  round(rapid_in_out_ratio, 6) AS temporal_rapid_in_out_ratio, round(activity_change_ratio, 6) AS temporal_activity_change_ratio FROM then_"""))
def m03(spark, sf):
    places = {"temporal_amount_sum_5m": 2, "temporal_amount_sum_1h": 2, "temporal_rapid_in_out_ratio": 6, "temporal_activity_change_ratio": 6}
    j = T.temporal_features_at(cut(transfers(spark, sf)))
    return j.select("transaction_id", *[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in T.TEMPORAL]).withColumn("temporal_avg_interval_seconds", round_up("temporal_avg_interval_seconds", 4))


# Written out, in the order of the vector: name, and its value in SQL.
GRAPH_SQL = """in_degree AS graph_in_degree, out_degree AS graph_out_degree, total_degree AS graph_total_degree, unique_senders AS graph_unique_inbound_counterparties,
  unique_receivers AS graph_unique_outbound_counterparties, fan_in_ratio AS graph_fan_in_ratio, fan_out_ratio AS graph_fan_out_ratio, neighbouring_accounts AS graph_neighboring_accounts_count,
  neighbouring_devices AS graph_neighboring_devices_count, neighbouring_ips AS graph_neighboring_ips_count, neighbourhood_density AS graph_neighborhood_density,
  reachable_accounts AS graph_reachable_node_count, max_path_length AS graph_max_downstream_path_length, has_cycle AS graph_has_cycle, cycle_count AS graph_cycle_count,
  shared_device_count AS graph_shared_device_count, shared_ip_count AS graph_shared_ip_count"""
GRAPH_DOUBLES = "gd AS MATERIALIZED (SELECT account, COLUMNS(* EXCLUDE (account))::DOUBLE FROM (SELECT account, " + GRAPH_SQL + " FROM feats))"


@query("m04_graph_join", with_(TX, FOCAL, *FEATURE_CTES, GRAPH_DOUBLES, "SELECT transaction_id, gd.* EXCLUDE (account) FROM tx JOIN gd ON account = sender_account"))
def m04(spark, sf):
    return T.join_graph(transfers(spark, sf), graph_record(transfers(spark, sf))).select("transaction_id", *T.GRAPH)


VECTOR = f"""vec AS MATERIALIZED (SELECT n.*, account_age_days::DOUBLE AS v14, velocity_l6h::DOUBLE AS v15, 0.01::DOUBLE AS v16, 1.0::DOUBLE AS v17, 1.0::DOUBLE AS v18, 0.1::DOUBLE AS v19, user_risk_score::DOUBLE AS v20, 85.0::DOUBLE AS v21,
  0.0::DOUBLE AS v22, 10.0::DOUBLE AS v23, 0.0::DOUBLE AS v24, 5.0::DOUBLE AS v25, is_vpn::INT::DOUBLE AS v26, 15.0::DOUBLE AS v27,
  t.n_5m::DOUBLE AS v28, n_15m::DOUBLE AS v29, n_1h::DOUBLE AS v30, n_24h::DOUBLE AS v31, amount_5m::DOUBLE AS v32, amount_1h::DOUBLE AS v33, coalesce(average_interval, 0)::DOUBLE AS v34,
  (burst_count > 0 OR burst_detected)::INT::DOUBLE AS v35, burst_count::DOUBLE AS v36, rapid_in_out_detected::INT::DOUBLE AS v37, rapid_in_out_ratio::DOUBLE AS v38, activity_change_ratio::DOUBLE AS v39,
  gd.* EXCLUDE (account), is_fraud::DOUBLE AS label
  FROM ({NATIVE_SQL} FROM tx) n JOIN tx USING (transaction_id) JOIN then_ t ON t.id = transaction_id JOIN gd ON gd.account = sender_account)"""


@query("m05_feature_vector", with_(TX, *OWN_TIME, FOCAL, *FEATURE_CTES, GRAPH_DOUBLES, VECTOR, """SELECT transaction_id, generate_subscripts(v, 1)::INT - 1 AS position, """ + to_places("unnest(v)", 4) + """ AS value
  FROM (SELECT transaction_id, list_value(*COLUMNS(* EXCLUDE (transaction_id, label))) AS v FROM vec)"""))
def m05(spark, sf):
    v = T.feature_vector(_features(spark, sf)).select("transaction_id", vector_to_array("features").alias("v"))
    return v.select("transaction_id", F.posexplode("v").alias("position", "value")).withColumn("value", round_up("value", 4))


@query("m06_dataset", with_(TX, *OWN_TIME, FOCAL, *FEATURE_CTES, GRAPH_DOUBLES, VECTOR, """SELECT transaction_id, label, len(v) AS features, round(list_sum(v), 2) AS total
  FROM (SELECT transaction_id, label, list_value(*COLUMNS(* EXCLUDE (transaction_id, label))) AS v FROM vec)"""))
def m06(spark, sf):
    d = T.dataset(_features(spark, sf))
    total = F.round(sum((F.col(c) for c in T.FEATURES), F.lit(0.0)), 2)
    return d.select("transaction_id", "label", F.lit(len(T.FEATURES)).cast("long").alias("features"), total.alias("total"))


@query("m07_split_chronological", with_(TX, """SELECT transaction_id, CASE WHEN r <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.85 + 1e-9) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT transaction_id, row_number() OVER (ORDER BY ts, transaction_id) AS r, count(*) OVER () AS n FROM tx)"""))
def m07(spark, sf):
    return T.split_chronological(transfers(spark, sf)).select("transaction_id", "split")


HASHED = "hashed AS MATERIALIZED (SELECT transaction_id, is_fraud, ('0x' || md5('42:' || transaction_id)[:15])::BIGINT AS h FROM tx)"


@query("m08_split_random", with_(TX, HASHED, """SELECT transaction_id, is_fraud, CASE WHEN rank() OVER (PARTITION BY is_fraud ORDER BY h) <= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY is_fraud) + 1e-9) THEN 'train' ELSE 'test' END AS split FROM hashed"""))
def m08(spark, sf):
    return T.split_random(transfers(spark, sf), strata="is_fraud").select("transaction_id", "is_fraud", "split")


@query("m08_split_unstratified", with_(TX, HASHED, "SELECT transaction_id, CASE WHEN h / 1152921504606846976.0::DOUBLE < 0.8::DOUBLE THEN 'train' ELSE 'test' END AS split FROM hashed"))
def m08_unstratified(spark, sf):
    return T.split_random(transfers(spark, sf)).select("transaction_id", "split")


# Categories by falling frequency, equal ones by name; behind them one slot for those unseen.
PREPARED = """channels AS (SELECT channel, row_number() OVER (ORDER BY count(*) DESC, channel) - 1 AS i, count(*) OVER () AS kinds FROM tx GROUP BY 1),
banks AS (SELECT sender_bank, row_number() OVER (ORDER BY count(*) DESC, sender_bank) - 1 AS j, count(*) OVER () AS m FROM tx GROUP BY 1),
moments AS (SELECT avg(amount) AS ma, stddev_samp(amount) AS sa, avg(risk_score) AS mr, stddev_samp(risk_score) AS sr FROM tx)"""


@query("m09_preprocess", with_(TX, PREPARED, f"""SELECT transaction_id, {to_places('(amount - ma) / sa', 6)} AS amount, {to_places('(risk_score - mr) / sr', 6)} AS risk_score,
  i::INT AS channel_slot, j::INT AS bank_slot, (2 + kinds + 1 + m + 1)::INT AS width FROM tx JOIN channels USING (channel) JOIN banks USING (sender_bank), moments"""))
def m09(spark, sf):
    """The scaled numbers, the places of the two hot entries, and the width of the vector."""
    tx = transfers(spark, sf)
    fitted = Pipeline(stages=T.preprocess_stages(["channel", "sender_bank"], ["amount", "risk_score"])).fit(tx)
    v = vector_to_array("features")
    channels = next(len(st.labelsArray[0]) for st in fitted.stages if hasattr(st, "labelsArray"))
    out = fitted.transform(tx).select("transaction_id", v[0].alias("amount"), v[1].alias("risk_score"), v.alias("_v"))
    hot = lambda first, width: (F.array_position(F.slice("_v", first, width), 1.0) - 1).cast("int")
    return out.select("transaction_id", round_up("amount", 6).alias("amount"), round_up("risk_score", 6).alias("risk_score"),
                      hot(3, F.lit(channels + 1)).alias("channel_slot"), hot(4 + channels, F.size("_v") - 3 - channels).alias("bank_slot"), F.size("_v").alias("width"))


@query("m10_drop_leakage", with_(TX, "SELECT amount, channel AS trans_type, count(*) AS rows FROM tx GROUP BY 1, 2"))
def m10(spark, sf):
    raw = transfers(spark, sf).select(F.col("transaction_id").alias("txn_id"), F.col("sender_account").alias("account_number"), "receiver_account", "amount", F.col("channel").alias("trans_type"), "is_fraud", "risk_score")
    return T.drop_leakage(raw, "classification").groupBy("amount", "trans_type").agg(F.count(F.lit(1)).alias("rows"))


@query("m11_rf_regressor")
def m11(spark, sf):
    d = _dataset(spark, sf, "risk_score")
    model = M.fit_rf_regressor(d.filter("split = 'train'"), trees=20, depth=8)
    return M.regression_metrics(model.transform(T.feature_vector(d.filter("split = 'test'"))))


@query("m12_rf_classifier")
def m12(spark, sf):
    d = _dataset(spark, sf)
    model = M.fit_rf_classifier(d.filter("split = 'train'"), trees=20, depth=8)
    scored = model.transform(T.feature_vector(d.filter("split = 'test'"))).withColumn("p", vector_to_array("probability")[1])
    return M.classification_metrics(scored, probability="p")


@query("m13_gbt_classifier")
def m13(spark, sf):
    d = _dataset(spark, sf)
    model = M.fit_gbt(d.filter("split = 'train'"), "classifier", rounds=5, depth=4)
    return M.classification_metrics(model.transform(T.feature_vector(d.filter("split = 'test'"))))


@query("m14_grid_search")
def m14(spark, sf):
    d = _dataset(spark, sf, "risk_score").filter("split = 'train'")
    cv = M.grid_search(d, RandomForestRegressor(labelCol="label", seed=42), {"numTrees": [5, 10], "maxDepth": [4]}, "r2")
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(cv.avgMetrics)], "candidate int, r2 double")


@query("m15_logistic")
def m15(spark, sf):
    d = _dataset(spark, sf)
    model = M.fit_logistic(d.filter("split = 'train'"), iterations=50)
    test = T.feature_vector(M.with_linear_inputs(d.filter("split = 'test'")), [f"x{i}" for i in range(8)])
    return M.classification_metrics(model.transform(test))


@query("m16_linear_risk", with_(TX, """SELECT transaction_id, round(greatest(0, least(100, 25.0::DOUBLE * amount / 50000 + 30.0 * user_risk_score / 100 + 20.0 * 0.1 + 15.0 * 0.15 + 10.0 * is_vpn::INT
  + 12.0 * least(1.0, velocity_l6h / 20) + 8.0 * 1.0 + 5.0))::DOUBLE, 6) AS linear_risk FROM tx"""))
def m16(spark, sf):
    return M.linear_risk(T.telemetry_features(transfers(spark, sf))).select("transaction_id", F.round("linear_risk", 6).alias("linear_risk"))


@query("m17_classification_metrics", with_(TX, """SELECT tp, fp, tn, fn, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round((tp + fn) / n, 6) AS positive_rate FROM (SELECT count(*) FILTER (is_fraud = 1 AND p) AS tp, count(*) FILTER (is_fraud = 0 AND p) AS fp, count(*) FILTER (is_fraud = 0 AND NOT p) AS tn,
  count(*) FILTER (is_fraud = 1 AND NOT p) AS fn, count(*) AS n FROM (SELECT *, risk_score >= 50 AS p FROM tx))"""))
def m17(spark, sf):
    tx = transfers(spark, sf).withColumn("prediction", F.when(F.col("risk_score") >= 50, 1.0).otherwise(0.0))
    m = M.classification_metrics(tx, "is_fraud")
    return m.select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "positive_rate")])


@query("m18_regression_metrics", with_(TX, """SELECT round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - sum(e * e) / (var_pop(risk_score) * count(*)), 6) AS r2 FROM (SELECT risk_score, risk_score - user_risk_score AS e FROM tx)"""))
def m18(spark, sf):
    tx = T.telemetry_features(transfers(spark, sf))
    m = M.regression_metrics(tx, "risk_score", "user_risk_score")
    return m.select(*[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2")])


HEURISTIC = "(CASE WHEN amount > 50000 THEN least(99, floor(amount / 500)) ELSE floor(amount / 2000) END)::INT"


@query("m19_heuristic_score", with_(TX, f"SELECT transaction_id, {HEURISTIC} AS ml_score, {HEURISTIC} >= 70 AS ml_is_fraud FROM tx"))
def m19(spark, sf):
    return M.heuristic_score(transfers(spark, sf)).select("transaction_id", "ml_score", "ml_is_fraud")


@query("m20_predict")
def m20(spark, sf):
    d = _dataset(spark, sf)
    model = M.fit_rf_classifier(d.filter("split = 'train'"), trees=10, depth=5)
    return M.predict(model, d, "rf_v1").select("transaction_id", "tabular_ml_probability", "tabular_ml_score", "tabular_ml_is_fraud", "tabular_ml_version", "tabular_ml_available")


@query("m21_amount_anomaly", with_(TX, """q AS (SELECT channel AS c, quantile_disc(amount, 0.95) AS cut, quantile_disc(amount, 0.5) AS med FROM tx GROUP BY 1),
  d AS (SELECT channel AS c2, quantile_disc(abs(amount - med), 0.5) AS mad FROM tx JOIN q ON c = channel GROUP BY 1)""", "SELECT transaction_id, amount > cut AS is_anomaly, round((amount - med) / (1.4826 * mad), 4) AS robust_z FROM tx JOIN q ON c = channel JOIN d ON c2 = channel"))
def m21(spark, sf):
    return M.amount_anomaly(transfers(spark, sf)).select("transaction_id", "is_anomaly", F.round("robust_z", 4).alias("robust_z"))


@query("m22_importances")
def m22(spark, sf):
    model = M.fit_rf_regressor(_dataset(spark, sf, "risk_score"), trees=10, depth=5)
    return M.importances(spark, model, k=20)


@query("m23_compare_models", with_(TX, """m AS (SELECT 'rule_50' AS model, 2 * count(*) FILTER (is_fraud = 1 AND risk_score >= 50) / (count(*) FILTER (is_fraud = 1) + count(*) FILTER (risk_score >= 50)) AS f1 FROM tx
  UNION ALL SELECT 'rule_30', 2 * count(*) FILTER (is_fraud = 1 AND risk_score >= 30) / (count(*) FILTER (is_fraud = 1) + count(*) FILTER (risk_score >= 30)) FROM tx)""", "SELECT arg_max(model, f1) AS best_model, round(max(f1), 6) AS f1 FROM m"))
def m23(spark, sf):
    tx = transfers(spark, sf)
    one = lambda name, cut_: M.classification_metrics(tx.withColumn("prediction", (F.col("risk_score") >= cut_).cast("double")), "is_fraud").withColumn("model", F.lit(name))
    return M.compare(one("rule_50", 50).unionByName(one("rule_30", 30)), "f1").select("best_model", F.round("f1", 6).alias("f1"))


@query("m24_blend", with_(TX, f"SELECT transaction_id, least(99, greatest(0, round_even(0.6::DOUBLE * risk_score + 0.4::DOUBLE * {HEURISTIC}, 0)))::INT AS risk_score FROM tx"))
def m24(spark, sf):
    h = M.heuristic_score(transfers(spark, sf)).withColumnRenamed("risk_score", "rule_score")
    return M.blend(h).select("transaction_id", "risk_score")
