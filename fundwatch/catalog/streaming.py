"""Streaming jobs driven to completion over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.session import checkpoint_folder, cut
from ..sources import driver_tables as D
from ..streaming import jobs as K
from .base import LEGS, TX, query, ts, with_
from .crossbank import REPORTS, as_reports
from .rules import CONTEXT, FIXED, context, evaluated_sql
from .temporal import PAIRS, ROLLING


def stream_transfers(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = K.read_stream(spark, sf, schema, "events.parquet")
    return D.as_transfers(events)


def _run(spark, df, mode="append"):
    out = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = df.schema
    K.run_available(df, f"{out}/data", f"{out}/checkpoint", mode)
    return spark.read.schema(schema).parquet(f"{out}/data/*")


# Rule inputs of the profile: what the batch job knew of an account at its last transfer.
INPUTS = ["history_1h", "history_n", "recent_sum", "inbound_sum", "channels_1h", "dormant_days", "account_age", "linked_devices", "linked_ips", "linked_beneficiaries", "fan_in", "fan_out", "travel_speed_kmh", "in_cycle"]
PROFILE = "latest AS MATERIALIZED (SELECT sender_account, " + ", ".join(f"{c}" for c in INPUTS) + """ FROM ctx QUALIFY row_number() OVER (PARTITION BY sender_account ORDER BY ts DESC, transaction_id DESC) = 1),
live AS MATERIALIZED (SELECT transaction_id, ts, receiver_account, amount, channel, latest.* FROM tx JOIN latest USING (sender_account))"""


@query("k01_score_stream", with_(*CONTEXT, PROFILE, evaluated_sql(FIXED).replace("FROM ctx)", "FROM live)"), "SELECT transaction_id, rule_score, highest_severity, codes FROM evaluated"))
def k01(spark, sf):
    """All fourteen rules on arriving transfers, against the written profile of their sender."""
    latest = context(spark, sf).groupBy("sender_account").agg(F.max_by(F.struct(*INPUTS), F.struct("ts", "transaction_id")).alias("_p"))
    profile = cut(latest.select("sender_account", "_p.*"))
    out = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    codes = F.array_join(F.transform("matches", lambda m: m["rule_code"]), ",").alias("codes")

    def sink(batch, batch_id):
        batch.select("transaction_id", "rule_score", "highest_severity", codes).write.mode("overwrite").parquet(f"{out}/data/batch_id={batch_id}")

    started = K.score_stream(stream_transfers(spark, sf), profile, sink, f"{out}/checkpoint")
    started.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data/*").select("transaction_id", "rule_score", "highest_severity", "codes")


@query("k02_pass_through_stream", with_(TX, PAIRS, "SELECT account, incoming_id, outgoing_id, delay_seconds, round(ratio, 6) AS pass_through_ratio FROM pairs"))
def k02(spark, sf):
    return _run(spark, K.pass_through_stream(stream_transfers(spark, sf))).withColumn("pass_through_ratio", F.round("pass_through_ratio", 6))


@query("k03_velocity_stream", with_(TX, """w AS (SELECT sender_account, amount, to_timestamp(300 * (us // 300000000) - 300 * o)::TIMESTAMP AS s FROM tx, (SELECT unnest(range(12)) AS o))""", f"""SELECT sender_account, {ts('s')} AS window_start, count(*) AS transfers, round(sum(amount), 2) AS amount
  FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM tx) - INTERVAL 1 HOUR GROUP BY 1, 2"""))
def k03(spark, sf):
    v = _run(spark, K.velocity_stream(stream_transfers(spark, sf)))
    return v.select("sender_account", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("window_start"), "transfers", F.round("amount", 2).alias("amount"))


@query("k03_trailing_stream", with_(TX, LEGS, ROLLING, "SELECT account, transaction_id, n_1h AS n, round(amount_1h, 2) AS amount FROM roll"))
def k03_trailing(spark, sf):
    """Exact trailing windows from keyed state; equal to the batch figures, open windows included."""
    out = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = K.trailing_stream(stream_transfers(spark, sf), bucket_seconds=86_400)
    K.run_available(stream, f"{out}/data", f"{out}/checkpoint", "update")
    got = K.current(spark, f"{out}/data", stream.schema, ["account", "transaction_id"])
    return got.select("account", "transaction_id", "n", F.round("amount", 2).alias("amount"))


@query("k04_cross_bank_stream", with_(TX, REPORTS, "SELECT account_hash, banks::INT AS contributing_banks, round(risk, 4) AS aggregate_risk, pattern_type FROM alerts"))
def k04(spark, sf):
    alerts = _run(spark, K.cross_bank_stream(as_reports(stream_transfers(spark, sf))), mode="update")
    return alerts.withColumn("aggregate_risk", F.round("aggregate_risk", 4))
