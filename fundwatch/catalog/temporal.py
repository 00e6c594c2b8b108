"""Windows, bursts and pass-through."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as P
from ..schema import WINDOWS
from ..sources.driver_tables import accounts, transfers
from .base import LEGS, TX, query, with_

US = {w: s * 1_000_000 for w, s in WINDOWS.items()}


def frame(us: int) -> str:
    return f"(PARTITION BY account ORDER BY us RANGE BETWEEN {us} PRECEDING AND CURRENT ROW)"


ROLLING = "roll AS MATERIALIZED (SELECT *, " + ", ".join(
    f"count(*) OVER {frame(u)} AS n_{w}, sum(amount) OVER {frame(u)} AS amount_{w}" for w, u in US.items()
) + f", count(*) OVER {frame(2 * US['1h'])} AS n_2h, count(*) OVER {frame(US['1h'] - 1)} AS n_open, lag(us) OVER (PARTITION BY account ORDER BY us, transaction_id) AS prev FROM legs)"
COUNTS = ", ".join(f"n_{w}" for w in WINDOWS)
AMOUNTS = ", ".join(f"round(amount_{w}, 2) AS amount_{w}" for w in WINDOWS)
LAST = f"""last AS MATERIALIZED (SELECT * FROM roll QUALIFY row_number() OVER (PARTITION BY account ORDER BY us DESC, transaction_id DESC) = 1)"""


def to_places(column: str, places: int) -> str:
    """Rounded by the same steps in SQL and on Spark, so that halves agree."""
    return f"floor({column} * 1e{places} + 0.5) / 1e{places}"


def round_up(column: str, places: int):
    return F.floor(F.col(column) * float(10**places) + 0.5) / float(10**places)


def _rounded(df, *cols, places=2):
    return df.withColumns({c: F.round(c, places) for c in cols})


def _leg(spark, sf):
    return P.legs(transfers(spark, sf))


@query("w01_rolling_counts", with_(TX, LEGS, ROLLING, f"SELECT account, transaction_id, {COUNTS} FROM roll"))
def w01(spark, sf):
    return P.rolling(_leg(spark, sf)).select("account", "transaction_id", *[f"n_{w}" for w in WINDOWS])


@query("w02_rolling_sums", with_(TX, LEGS, ROLLING, f"SELECT account, transaction_id, {AMOUNTS} FROM roll"))
def w02(spark, sf):
    cols = [f"amount_{w}" for w in WINDOWS]
    return _rounded(P.rolling(_leg(spark, sf)).select("account", "transaction_id", *cols), *cols)


@query("w01_snapshot_latest", with_(TX, LEGS, ROLLING, LAST, f"SELECT account, us AS reference_us, {COUNTS}, {AMOUNTS} FROM last"))
def w01_snapshot(spark, sf):
    return _rounded(P.snapshot(_leg(spark, sf)), *[f"amount_{w}" for w in WINDOWS])


ASOF = "2024-01-20 12:00:00"


@query("w01_snapshot_asof", with_(TX, LEGS, "SELECT account, " + ", ".join(
    f"count(*) FILTER (us BETWEEN r - {u} AND r) AS n_{w}, round(coalesce(sum(amount) FILTER (us BETWEEN r - {u} AND r), 0), 2) AS amount_{w}" for w, u in US.items())
    + f" FROM legs, (SELECT epoch_us(TIMESTAMP '{ASOF}') AS r) GROUP BY account"))
def w01_asof(spark, sf):
    return _rounded(P.snapshot(_leg(spark, sf), asof=ASOF).drop("reference_us"), *[f"amount_{w}" for w in WINDOWS])


@query("w03_window_members", with_(TX, LEGS, "ref AS (SELECT account AS a, max(us) AS r FROM legs GROUP BY 1)", " UNION ALL ".join(
    f"SELECT account, '{w}' AS \"window\", transaction_id FROM legs JOIN ref ON account = a WHERE us >= r - {u}" for w, u in US.items())))
def w03(spark, sf):
    return P.window_members(_leg(spark, sf))


@query("w04_intervals", with_(TX, LEGS, ROLLING, """SELECT account, count(*) AS events, round(avg(us - prev) / 1e6, 4) AS average_interval,
  min(us - prev) / 1e6 AS minimum_interval, max(us - prev) / 1e6 AS maximum_interval FROM roll GROUP BY account"""))
def w04(spark, sf):
    return _rounded(P.intervals(_leg(spark, sf)), "average_interval", places=4)


def burst_sql(threshold: int) -> str:
    return f"""burst AS MATERIALIZED (SELECT account, count(*) AS events, max(n_5m) AS peak, min(us) FILTER (n_5m = m) AS end_us FROM (
      SELECT *, max(n_5m) OVER (PARTITION BY account) AS m FROM roll) GROUP BY account),
    bursts AS MATERIALIZED (SELECT account, events, events >= {threshold} AND peak >= {threshold} AS burst_detected,
      CASE WHEN events < {threshold} THEN events ELSE peak END AS burst_count,
      CASE WHEN events >= {threshold} AND peak >= {threshold} THEN end_us END AS burst_end_us,
      round(peak / events, 6) AS temporal_concentration FROM burst)"""


@query("w05_burst_default", with_(TX, LEGS, ROLLING, burst_sql(5), "SELECT * FROM bursts"))
def w05(spark, sf):
    return _rounded(P.burst(_leg(spark, sf)), "temporal_concentration", places=6)


@query("w05_burst_low_threshold", with_(TX, LEGS, ROLLING, burst_sql(2), "SELECT * FROM bursts"))
def w05_low(spark, sf):
    return _rounded(P.burst(_leg(spark, sf), threshold=2), "temporal_concentration", places=6)


@query("w05_burst_members", with_(TX, LEGS, ROLLING, burst_sql(2), """SELECT account, transaction_id FROM legs JOIN bursts USING (account)
  WHERE burst_detected AND us BETWEEN burst_end_us - 300000000 AND burst_end_us"""))
def w05_members(spark, sf):
    leg = _leg(spark, sf)
    return P.burst_members(leg, P.burst(leg, threshold=2)).select("account", "transaction_id")


@query("w06_concentration", with_(TX, LEGS, ROLLING, burst_sql(1), "SELECT account, events, temporal_concentration FROM bursts"))
def w06(spark, sf):
    return _rounded(P.concentration(_leg(spark, sf)), "temporal_concentration", places=6)


PAIRS = """pairs AS MATERIALIZED (SELECT i.receiver_account AS account, i.transaction_id AS incoming_id, o.transaction_id AS outgoing_id,
    i.us AS in_us, o.us AS out_us, (o.us - i.us) / 1e6 AS delay_seconds, o.amount / i.amount AS ratio
  FROM tx i JOIN tx o ON i.receiver_account = o.sender_account AND o.us BETWEEN i.us AND i.us + 900000000)"""
SUMMARY = """summary AS MATERIALIZED (SELECT account, count(*) AS n, arg_min(delay_seconds, ord) AS delay, arg_min(ratio, ord) AS ratio,
    arg_min(incoming_id, ord) AS incoming_id, arg_min(outgoing_id, ord) AS outgoing_id
  FROM (SELECT *, (in_us, incoming_id, out_us, outgoing_id) AS ord FROM pairs) GROUP BY account)"""


@query("w07_pass_through", with_(TX, PAIRS, "SELECT account, incoming_id, outgoing_id, delay_seconds, round(ratio, 6) AS pass_through_ratio FROM pairs"))
def w07(spark, sf):
    p = P.pass_through(transfers(spark, sf)).select("account", "incoming_id", "outgoing_id", "delay_seconds", "pass_through_ratio")
    return _rounded(p, "pass_through_ratio", places=6)


@query("w08_pass_through_summary", with_(TX, LEGS, PAIRS, SUMMARY, """SELECT a.account, coalesce(n, 0) AS pass_through_pairs, n IS NOT NULL AS rapid_in_out_detected,
  delay AS rapid_in_out_delay, round(coalesce(ratio, 0), 6) AS rapid_in_out_ratio, incoming_id AS first_incoming_id, outgoing_id AS first_outgoing_id
  FROM (SELECT DISTINCT account FROM legs) a LEFT JOIN summary USING (account)"""))
def w08(spark, sf):
    return _rounded(P.pass_through_summary(transfers(spark, sf)), "rapid_in_out_ratio", places=6)


CHANGE = "round(CASE WHEN p = 0 AND c = 0 THEN 0 WHEN p = 0 THEN c ELSE c / p END::DOUBLE, 6)"


@query("w09_activity_change", with_(TX, LEGS, ROLLING, LAST, f"""SELECT account, c AS current_count, p AS previous_count, {CHANGE} AS activity_change_ratio
  FROM (SELECT account, n_1h AS c, n_2h - n_open AS p FROM last)"""))
def w09(spark, sf):
    return _rounded(P.activity_change(_leg(spark, sf)), "activity_change_ratio", places=6)


@query("w09_activity_change_asof", with_(TX, LEGS, f"""SELECT account, c AS current_count, p AS previous_count, {CHANGE} AS activity_change_ratio FROM (
  SELECT account, count(*) FILTER (us BETWEEN r - 3600000000 AND r) AS c, count(*) FILTER (us BETWEEN r - 7200000000 AND r - 3600000000) AS p
  FROM legs, (SELECT epoch_us(TIMESTAMP '{ASOF}') AS r) GROUP BY account)"""))
def w09_asof(spark, sf):
    return _rounded(P.activity_change(_leg(spark, sf), asof=ASOF), "activity_change_ratio", places=6)


@query("w10_duration", with_(TX, LEGS, "SELECT account, (max(us) - min(us)) / 1e6 AS sequence_duration FROM legs GROUP BY 1"))
def w10(spark, sf):
    return P.duration(_leg(spark, sf))


RECORD = f"""record AS MATERIALIZED (
  SELECT account, count(*) AS total_events, avg(us - prev) / 1e6 AS average_interval, min(us - prev) / 1e6 AS minimum_interval,
    max(us - prev) / 1e6 AS maximum_interval, (max(us) - min(us)) / 1e6 AS sequence_duration FROM roll GROUP BY account),
temporal AS MATERIALIZED (
  SELECT r.*, l.n_5m, l.n_15m, l.n_1h, l.n_24h, l.amount_5m, l.amount_15m, l.amount_1h, l.amount_24h,
    b.burst_detected, b.burst_count, b.temporal_concentration, l.n_2h - l.n_open AS previous_count,
    {CHANGE.replace('c / p', 'n_1h / (n_2h - n_open)').replace('THEN c', 'THEN n_1h').replace('p = 0', 'n_2h - n_open = 0').replace('c = 0', 'n_1h = 0')} AS activity_change_ratio,
    coalesce(s.n, 0) AS pass_through_pairs, s.n IS NOT NULL AS rapid_in_out_detected, s.delay AS rapid_in_out_delay, coalesce(s.ratio, 0) AS rapid_in_out_ratio
  FROM record r JOIN last l USING (account) JOIN bursts b USING (account) LEFT JOIN summary s USING (account))"""
TEMPORAL = (LEGS, ROLLING, LAST, burst_sql(5), PAIRS, SUMMARY, RECORD)



def asof_sql(instants: str) -> str:
    """The record of an account at each instant (id, account, us), from the events at or before it; ``known`` is the running state after each event."""
    windows = ", ".join(f"count(*) FILTER (l.us >= i.us - {u}) AS n_{w}, coalesce(sum(amount) FILTER (l.us >= i.us - {u}), 0) AS amount_{w}" for w, u in US.items())
    change = CHANGE.replace("c / p", "n_1h / p").replace("THEN c", "THEN n_1h").replace("c = 0", "n_1h = 0")
    return f"""instants AS MATERIALIZED ({instants}),
known AS MATERIALIZED (SELECT i.id, i.account, i.us AS reference_us, count(l.us) AS total_events, {windows},
    count(*) FILTER (l.us BETWEEN i.us - {2 * US['1h']} AND i.us - {US['1h']}) AS p, (max(l.us) - min(l.us)) / 1e6 AS span,
    CASE WHEN count(l.us) > 1 THEN (max(l.us) - min(l.us)) / 1e6 / (count(l.us) - 1) END AS average_interval, min(l.us - prev) / 1e6 AS minimum_interval, max(l.us - prev) / 1e6 AS maximum_interval, max(peak) AS peak
  FROM instants i LEFT JOIN (SELECT *, n_5m AS peak FROM roll) l ON l.account = i.account AND l.us <= i.us GROUP BY 1, 2, 3),
moved AS MATERIALIZED (SELECT id, count(*) AS pairs, arg_min(delay_seconds, ord) AS delay, arg_min(ratio, ord) AS ratio
  FROM (SELECT i.id, p.*, (in_us, incoming_id, out_us, outgoing_id) AS ord FROM instants i JOIN pairs p ON p.account = i.account AND out_us <= i.us) GROUP BY id),
then_ AS MATERIALIZED (SELECT k.* EXCLUDE (p, span, peak), p AS previous_count, coalesce(span, 0) AS sequence_duration, total_events >= 5 AND peak >= 5 AS burst_detected,
    CASE WHEN total_events >= 5 THEN peak ELSE total_events END AS burst_count, coalesce(peak / nullif(total_events, 0), 0) AS temporal_concentration, {change} AS activity_change_ratio,
    coalesce(pairs, 0) AS pass_through_pairs, pairs IS NOT NULL AS rapid_in_out_detected, delay AS rapid_in_out_delay, coalesce(ratio, 0) AS rapid_in_out_ratio
  FROM known k LEFT JOIN moved USING (id))"""


FLAT = ["account", "total_events", *[f"n_{w}" for w in WINDOWS], "minimum_interval", "maximum_interval", "burst_detected", "burst_count",
        "sequence_duration", "previous_count", "pass_through_pairs", "rapid_in_out_detected", "rapid_in_out_delay"]


def _record(df, *more, average=None):
    average = F.round("average_interval", 4) if average is None else average
    return df.select(*more, *FLAT, *[F.round(f"amount_{w}", 2).alias(f"amount_{w}") for w in WINDOWS], average.alias("average_interval"),
                     *[F.round(c, 6).alias(c) for c in ("temporal_concentration", "activity_change_ratio", "rapid_in_out_ratio")])


RECORD_SQL = f"""{', '.join(FLAT)}, {AMOUNTS}, round(average_interval, 4) AS average_interval, round(temporal_concentration, 6) AS temporal_concentration,
  round(activity_change_ratio, 6) AS activity_change_ratio, round(rapid_in_out_ratio, 6) AS rapid_in_out_ratio"""


@query("w12_temporal_features", with_(TX, *TEMPORAL, f"SELECT {RECORD_SQL} FROM temporal"))
def w12(spark, sf):
    return _record(P.temporal_features(transfers(spark, sf)))


HOURS = """SELECT account || '@' || us AS id, account, us FROM (SELECT DISTINCT account, (us // 3600000000 + 1) * 3600000000 AS us FROM legs
  UNION SELECT 'ACC-' || c_custkey, 1705320000000000 FROM customer)"""


@query("w12_temporal_asof", with_(TX, LEGS, ROLLING, PAIRS, asof_sql(HOURS), f"SELECT reference_us, {RECORD_SQL.replace('round(average_interval, 4)', to_places('average_interval', 4))} FROM then_"))
def w12_asof(spark, sf):
    """Every account at the end of each hour it was active in, and every customer at one instant."""
    tx = transfers(spark, sf)
    hours = P.legs(tx).select("account", ((F.floor(F.col("us") / 3_600_000_000) + 1) * 3_600_000_000).alias("reference_us"))
    all_at_once = accounts(spark, sf).select(F.col("account_number").alias("account"), F.lit(1_705_320_000_000_000).alias("reference_us"))
    found = P.temporal_asof(tx, hours.unionByName(all_at_once).distinct())
    return _record(found, "reference_us", average=round_up("average_interval", 4))


@query("w11_focal_with_empty_history", with_(TX, LEGS, "focal AS (SELECT 'ACC-' || c_custkey AS account FROM customer)", """SELECT f.account, count(us) AS total_events,
  (coalesce(max(us) - min(us), 0)) / 1e6 AS sequence_duration FROM focal f LEFT JOIN legs USING (account) GROUP BY 1"""))
def w11(spark, sf):
    focal = accounts(spark, sf).select(F.col("account_number").alias("account"))
    return P.temporal_features(transfers(spark, sf), focal).select("account", "total_events", "sequence_duration")


@query("w12_nested_windows", with_(TX, *TEMPORAL, " UNION ALL ".join(
    f"SELECT account, '{w}' AS window_name, {s} AS window_seconds, n_{w} AS transaction_count, round(amount_{w}, 2) AS amount_sum FROM temporal" for w, s in WINDOWS.items())))
def w12_nested(spark, sf):
    n = P.nest_temporal(P.temporal_features(transfers(spark, sf)))
    return n.select("account", F.explode("windows").alias("window_name", "v")).select(
        "account", "window_name", "v.window_seconds", "v.transaction_count", F.round("v.amount_sum", 2).alias("amount_sum"))
