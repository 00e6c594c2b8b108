"""Registry and the SQL text shared by the oracle queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import BANK_BY_HASH
from ..functions.session import ensure_session

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ensure_session(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _bank(account: str) -> str:
    half = lambda i: f"('0x' || substr(md5({account}), {i}, 16))::UBIGINT % 10"
    names = ", ".join(f"'{b}'" for b in BANK_BY_HASH)
    return f"([{names}])[((({half(1)}) * 6 + {half(17)}) % 10 + 1)::BIGINT]"


# The transfers derived from events, as in sources.driver_tables.transfers.
TX = f"""tx AS MATERIALIZED (
  SELECT *, {_bank("sender_account")} AS sender_bank, {_bank("receiver_account")} AS receiver_bank,
         epoch_us(ts) AS us
  FROM (
    SELECT event_id, user_id, k, 'TX-' || event_id AS transaction_id, ts,
           'ACC-' || user_id AS sender_account, 'ACC-' || k AS receiver_account,
           round(value * 1000, 2) AS amount, 'INR' AS currency,
           CASE event_type WHEN 'click' THEN 'UPI' WHEN 'view' THEN 'NEFT' WHEN 'purchase' THEN 'IMPS'
                WHEN 'signup' THEN 'RTGS' WHEN 'error' THEN 'CARD' END AS channel,
           'DEV-' || (user_id // 4) AS device_id, 'IP-' || (user_id % 20) AS ip_address,
           'BEN-' || k AS beneficiary_id,
           'City ' || (user_id % 25) AS location_city, 'State ' || (user_id % 5) AS location_state,
           8.0::DOUBLE + (k % 20) * 0.5::DOUBLE AS latitude, 70.0::DOUBLE + (user_id % 20) * 0.5::DOUBLE AS longitude,
           user_id % 400 AS account_age_days, k % 12 AS velocity_l6h, user_id % 100 AS user_risk_score,
           k % 7 = 0 AS is_vpn,
           (event_type = 'error')::INT AS is_fraud,
           least(99.0::DOUBLE, floor(value / 2) + CASE WHEN event_type = 'error' THEN 40 ELSE 0 END) AS risk_score
    FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events) e0
  ) e1
)"""

LEGS = """legs AS MATERIALIZED (
  SELECT transaction_id, us, amount, channel, sender_account AS account,
         CASE WHEN sender_account = receiver_account THEN 'self' ELSE 'out' END AS side FROM tx
  UNION ALL
  SELECT transaction_id, us, amount, channel, receiver_account, 'in' FROM tx WHERE sender_account <> receiver_account
)"""

ACCOUNTS = """accounts AS MATERIALIZED (
  SELECT 'ACC-' || c_custkey AS account_number, c_name AS customer_name, c_mktsegment AS account_type,
         c_acctbal AS balance, (c_custkey * 7 % 100)::INT AS risk_score,
         CASE WHEN c_custkey * 7 % 100 >= 90 THEN 'CRITICAL' WHEN c_custkey * 7 % 100 >= 70 THEN 'HIGH'
              WHEN c_custkey * 7 % 100 >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
         c_custkey * 7 % 100 >= 85 AS is_flagged_mule,
         TIMESTAMP '2024-02-01 00:00:00' - to_days((c_custkey % 400)::INT) AS opened_at
  FROM customer
)"""

ALERTS = """alerts AS MATERIALIZED (
  SELECT 'ALT-' || event_id AS alert_number, 'ACC-' || user_id AS account_id,
         (['High Velocity', 'Fan In', 'Mule Chain', 'Smurfing', 'Shared Device'])[k % 5 + 1] AS pattern_type,
         (['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[k % 4 + 1] AS severity,
         (['NEW', 'UNDER_INVESTIGATION', 'ESCALATED', 'RESOLVED', 'DISMISSED'])[event_id % 5 + 1] AS alert_status,
         k::INT AS risk_score, ts AS triggered_at, 'CASE-' || user_id AS case_id
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events) e WHERE event_type = 'error'
)"""


def with_(*parts: str) -> str:
    """``WITH cte, cte, ... SELECT``: the last part is the final SELECT."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
