"""Sources, canonicalisation and graph ingest."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..functions.columns import format_inr, map_bank, mask_account, sanitize, ts_text, parse_ts, ensure_utc
from ..functions.session import checkpoint_folder, cut
from ..sources import ingest as I
from ..sources.driver_tables import table, transfers
from ..sources.readers import append_batch, read_scored, read_transfers_csv, write_scored
from .base import TX, query, ts, with_


def raw_records(spark, sf_dir):
    """Events under alias names, with blanks, bad amounts and bad dates, as a raw feed delivers them."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    bad = F.col("event_id") % 50
    return e.select(
        F.when(bad == 1, "").otherwise(F.concat(F.lit("TX-"), "event_id")).alias("transaction_ref"),
        F.when(bad == 2, F.lit(None)).otherwise(F.col("event_id").cast("string")).alias("id"),
        F.when(bad == 3, "not a date").when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).alias("timestamp"),
        F.when(bad == 4, "").otherwise(F.concat(F.lit("ACC-"), "user_id")).alias("account_number"),
        F.when(bad == 5, F.lit(None)).otherwise(F.concat(F.lit("ACC-"), k)).alias("receiver_account"),
        F.when(bad == 6, "n/a").when(bad == 7, "-5").otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("amount"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.upper("event_type")).alias("trans_type"),
        F.when(bad == 8, "95.5").otherwise("12.25").alias("latitude"),
        F.col("event_type").alias("kind"),
        F.when(F.col("event_id") % 4 == 0, F.lit(None)).otherwise(F.col("user_id").cast("string")).alias("branch"),
    )


RAW = """raw AS MATERIALIZED (
  SELECT event_id, event_id % 50 AS bad,
    CASE WHEN event_id % 50 = 1 THEN event_id::VARCHAR ELSE 'TX-' || event_id END AS transaction_id,
    CASE WHEN event_id % 50 <> 3 THEN date_trunc('second', ts) END AS ts,
    CASE WHEN event_id % 50 <> 4 THEN 'ACC-' || user_id END AS sender_account,
    CASE WHEN event_id % 50 <> 5 THEN 'ACC-' || json_extract_string(props, '$.k') END AS receiver_account,
    CASE WHEN event_id % 50 = 6 THEN NULL WHEN event_id % 50 = 7 THEN -5.0 ELSE value::DECIMAL(18,2)::DOUBLE END AS amount,
    'INR' AS currency, CASE WHEN event_id % 3 = 0 THEN 'UPI' ELSE upper(event_type) END AS channel,
    CASE WHEN event_id % 50 = 8 THEN 95.5 ELSE 12.25 END::DOUBLE AS latitude, event_type AS kind,
    CASE WHEN event_id % 4 <> 0 THEN user_id::VARCHAR END AS branch
  FROM events)"""
REASON = """CASE WHEN ts IS NULL THEN 'bad_timestamp' WHEN sender_account IS NULL THEN 'missing_sender'
  WHEN receiver_account IS NULL THEN 'missing_receiver' WHEN amount IS NULL THEN 'bad_amount'
  WHEN amount <= 0 THEN 'amount_not_positive' WHEN latitude > 90 THEN 'bad_latitude' END"""


@query("s01_csv_round_trip", with_(TX, """SELECT transaction_id AS txn_id, sender_account AS account_number,
  receiver_account, amount, channel AS trans_type, account_age_days::INT AS account_age_days, is_fraud FROM tx"""))
def s01(spark, sf):
    path = f"{checkpoint_folder(spark)}/csv-{tempfile.mktemp(dir='')}"
    out = transfers(spark, sf).select(
        F.col("transaction_id").alias("txn_id"), F.col("sender_account").alias("account_number"), "receiver_account", "amount",
        F.col("channel").alias("trans_type"), F.element_at("metadata", "account_age_days").cast("int").alias("account_age_days"), "is_fraud")
    out.write.option("header", True).csv(path)
    return read_transfers_csv(spark, path, out.schema)


@query("s02_relational_tables", """SELECT n_name AS nation, r_name AS region, count(*) AS customers FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def s02(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    per = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    return per.join(n, "n_nationkey").select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "customers")


@query("s03_canonicalize", with_(RAW, f"""SELECT transaction_id, {ts('ts')} AS ts, sender_account, receiver_account, amount,
  currency, channel, latitude FROM raw"""))
def s03(spark, sf):
    c = I.canonicalize(raw_records(spark, sf))
    return c.select("transaction_id", ts_text("ts").alias("ts"), "sender_account", "receiver_account", "amount", "currency", "channel", "latitude")


@query("s04_defaults", with_(RAW, "SELECT channel, currency, count(*) AS transfers FROM raw GROUP BY 1, 2"))
def s04(spark, sf):
    return I.canonicalize(raw_records(spark, sf)).groupBy("channel", "currency").agg(F.count(F.lit(1)).alias("transfers"))


@query("s05_parse_timestamp", with_(RAW, f"SELECT transaction_id, {ts('ts')} AS ts, ts IS NULL AS failed FROM raw"))
def s05(spark, sf):
    r = raw_records(spark, sf)
    parsed = parse_ts("timestamp")
    tid = F.coalesce(F.nullif("transaction_ref", F.lit("")), F.col("id"))
    return r.select(tid.alias("transaction_id"), ts_text(parsed).alias("ts"), parsed.isNull().alias("failed"))


@query("s06_ensure_utc", f"SELECT event_id, {ts('ts')} AS utc, {ts('ts - INTERVAL 330 MINUTE')} AS from_india FROM events")
def s06(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", ts_text(ensure_utc("ts")).alias("utc"), ts_text(ensure_utc("ts", F.lit("Asia/Kolkata"))).alias("from_india"))


@query("s07_sanitize", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 7.0 WHEN event_id % 5 = 1 THEN 7.0 WHEN event_id % 5 = 2 THEN 7.0
  ELSE value END::DOUBLE AS clean FROM events""")
def s07(spark, sf):
    text = (F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 == 1, "NaN").when(F.col("event_id") % 5 == 2, "Infinity")
            .otherwise(F.col("value").cast("string")))
    return table(spark, sf, "events").select("event_id", sanitize(text, 7.0).alias("clean"))


@query("s08_metadata", with_(RAW, "SELECT transaction_id, kind, branch, CASE WHEN branch IS NULL THEN 1 ELSE 2 END AS entries FROM raw"))
def s08(spark, sf):
    c = I.canonicalize(raw_records(spark, sf))
    return c.select("transaction_id", F.try_element_at("metadata", F.lit("kind")).alias("kind"),
                    F.try_element_at("metadata", F.lit("branch")).alias("branch"), F.size("metadata").alias("entries"))


@query("s09_validate", with_(RAW, f"SELECT coalesce({REASON}, 'ok') AS reason, count(*) AS transfers FROM raw GROUP BY 1"))
def s09(spark, sf):
    ok, bad = I.validate(I.canonicalize(raw_records(spark, sf)))
    both = ok.select(F.lit("ok").alias("reason")).unionByName(bad.select("reason"))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("transfers"))


@query("s10_dedup_first", with_(TX, """SELECT transaction_id, amount FROM tx"""))
def s10(spark, sf):
    tx = transfers(spark, sf)
    later = tx.select("transaction_id", (F.col("ts") + F.expr("interval 1 hour")).alias("ts"), F.lit(9999.0).alias("amount"))
    return I.dedup_first(tx.select("transaction_id", "ts", "amount").unionByName(later)).select("transaction_id", "amount")


@query("s11_legacy_projection", with_(TX, """SELECT transaction_id, transaction_id AS transaction_ref, transaction_id AS txn_id,
  sender_account, sender_account AS sender_account_number, channel AS trans_type, sender_bank AS bank_name,
  device_id AS device, ip_address AS ip_address_str, location_city AS city, account_age_days::VARCHAR AS account_age_days FROM tx"""))
def s11(spark, sf):
    legacy = I.to_legacy(transfers(spark, sf), ["account_age_days", "amount"])
    return legacy.select("transaction_id", "transaction_ref", "txn_id", "sender_account", "sender_account_number", "trans_type",
                         "bank_name", "device", "ip_address_str", "city", "account_age_days")


@query("s12_map_bank", with_(TX, "SELECT sender_account, sender_bank FROM tx"))
def s12(spark, sf):
    return transfers(spark, sf).select("sender_account", map_bank("sender_account").alias("sender_bank"))


@query("s13_graph_nodes", with_(TX, """SELECT 'account:' || a AS id, 'account' AS type, arg_max(bank, (us, transaction_id, role)) AS bank_name FROM (
    SELECT sender_account AS a, sender_bank AS bank, us, transaction_id, 0 AS role FROM tx UNION ALL
    SELECT receiver_account, receiver_bank, us, transaction_id, 1 FROM tx) GROUP BY a
  UNION ALL SELECT DISTINCT 'device:' || device_id, 'device', NULL FROM tx
  UNION ALL SELECT DISTINCT 'ip:' || ip_address, 'ip', NULL FROM tx"""))
def s13_nodes(spark, sf):
    nodes, _ = I.build_graph(transfers(spark, sf))
    return nodes.select("id", "type", "bank_name")


@query("s13_graph_edges", with_(TX, """SELECT 'account:' || sender_account AS src, 'account:' || receiver_account AS dst, transaction_id AS key,
    'TRANSFERRED_FUNDS' AS relationship, amount FROM tx
  UNION ALL SELECT DISTINCT 'account:' || sender_account, 'device:' || device_id,
    'link:account:' || sender_account || '->device:' || device_id, 'USES_DEVICE', NULL FROM tx
  UNION ALL SELECT DISTINCT 'account:' || sender_account, 'ip:' || ip_address,
    'ip_link:account:' || sender_account || '->ip:' || ip_address, 'USES_IP', NULL FROM tx"""))
def s13_edges(spark, sf):
    tx = transfers(spark, sf)
    _, edges = I.build_graph(tx.unionByName(tx))
    return edges.select("src", "dst", "key", "relationship", "amount")


def _export_input(spark, sf):
    k = F.substring("receiver_account", 5, 12).cast("int")
    return transfers(spark, sf).withColumns({
        "fraud_type": F.when(k % 11 == 0, "Phishing Fraud").when(k % 13 == 0, "Shared Device").otherwise("None"),
        "device_risk_score": F.lit(10.0), "network_risk_score": F.lit(15.0),
        "is_rooted_or_emulator": (k % 17 == 0).cast("int"), "is_vpn_or_proxy": (k % 7 == 0).cast("int")})


@query("s14_export_edges", with_(TX, """SELECT relationship, count(*) AS edges, count(DISTINCT source) AS sources, sum(amount) AS amount FROM (
  SELECT 'acc-' || sender_account AS source, 'TRANSFERRED_FUNDS' AS relationship, round_even(amount, 0) AS amount FROM tx
  UNION ALL SELECT 'acc-' || sender_account, 'SHARED_DEVICE', NULL FROM tx WHERE k % 17 = 0 OR (k % 13 = 0 AND k % 11 <> 0)
  UNION ALL SELECT 'acc-' || sender_account, 'SHARED_IP', NULL FROM tx WHERE k % 7 = 0) GROUP BY 1"""))
def s14_edges(spark, sf):
    _, edges = I.export_graph(_export_input(spark, sf))
    return edges.groupBy("relationship").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("source").alias("sources"), F.sum("amount").alias("amount"))


@query("s14_export_nodes", with_(TX, """, """.join(["""seen AS (
  SELECT 'acc-' || sender_account AS id, 'account' AS type, round_even(risk_score, 0) AS risk, is_fraud = 1 AS is_mule, (us, transaction_id, 0) AS ord FROM tx
  UNION ALL SELECT 'acc-' || receiver_account, CASE WHEN k % 11 = 0 THEN 'victim' ELSE 'account' END,
    round_even(CASE WHEN is_fraud = 1 THEN risk_score * 0.8 ELSE risk_score END, 0), false, (us, transaction_id, 1) FROM tx
  UNION ALL SELECT 'dev-' || device_id, 'device', 10, false, (us, transaction_id, 2) FROM tx
  UNION ALL SELECT 'ip-' || ip_address, 'ip', 15, false, (us, transaction_id, 3) FROM tx)"""]),
  """SELECT id, arg_min(type, ord) AS type, arg_min(risk, ord)::INT AS risk_score, arg_min(is_mule, ord) AS is_mule FROM seen GROUP BY id"""))
def s14_nodes(spark, sf):
    nodes, _ = I.export_graph(_export_input(spark, sf))
    return nodes.select("id", "type", "risk_score", "is_mule")


@query("s15_write_scored", with_(TX, "SELECT CAST(ts AS DATE)::VARCHAR AS dt, count(*) AS transfers, sum(risk_score) AS score FROM tx GROUP BY 1"))
def s15(spark, sf):
    path = f"{checkpoint_folder(spark)}/scored-{tempfile.mktemp(dir='')}"
    write_scored(transfers(spark, sf).select("transaction_id", "ts", "amount", "risk_score"), path)
    back = read_scored(spark, path)
    return back.groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count(F.lit(1)).alias("transfers"), F.sum("risk_score").alias("score"))


@query("s15_append_batches", with_(TX, "SELECT 'week-' || ((dayofyear(ts) - 1) // 7)::INT AS batch, CAST(ts AS DATE)::VARCHAR AS dt, count(*) AS transfers, sum(risk_score) AS score FROM tx GROUP BY 1, 2"))
def s15_batches(spark, sf):
    """Every week is one batch, and every batch is delivered twice; each row counts once."""
    path = f"{checkpoint_folder(spark)}/scored-{tempfile.mktemp(dir='')}"
    tx = cut(transfers(spark, sf).select("transaction_id", "ts", "amount", "risk_score", F.floor((F.dayofyear("ts") - 1) / 7).alias("week")))
    for _ in range(2):
        for (week,) in sorted(tx.select("week").distinct().collect()):  # at most 53
            append_batch(tx.filter(F.col("week") == week).drop("week"), path, f"week-{week}")
    back = read_scored(spark, path)
    return back.groupBy(F.col("batch").cast("string").alias("batch"), F.col("dt").cast("string").alias("dt")).agg(F.count(F.lit(1)).alias("transfers"), F.sum("risk_score").alias("score"))


@query("s16_mask_and_format", with_(TX, """SELECT transaction_id, CASE WHEN length(sender_account) <= 4 THEN sender_account
  ELSE 'XXXX' || right(sender_account, 4) END AS masked, '₹' || format('{:,.2f}', amount) AS shown FROM tx"""))
def s16(spark, sf):
    return transfers(spark, sf).select("transaction_id", mask_account("sender_account").alias("masked"), format_inr("amount").alias("shown"))
