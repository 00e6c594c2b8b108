"""Canonical schemas, alias lists and rank maps."""

from __future__ import annotations

from pyspark.sql import types as T

TRANSFER_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("sender_account", T.StringType()),
        T.StructField("receiver_account", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("sender_bank", T.StringType()),
        T.StructField("receiver_bank", T.StringType()),
        T.StructField("sender_name", T.StringType()),
        T.StructField("receiver_name", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("wallet_id", T.StringType()),
        T.StructField("beneficiary_id", T.StringType()),
        T.StructField("location_city", T.StringType()),
        T.StructField("location_state", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("narration", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Labelled transfer file with a header row.
CSV_SCHEMA = (
    "txn_id string, timestamp string, name string, account_number string, mobile_number string, "
    "bank_name string, receiver_account string, receiver_name string, receiver_bank string, "
    "pincode string, receiver_pincode string, amount double, trans_type string, narration string, "
    "account_type string, device string, ip_address string, account_age_days int, velocity_l6h int, "
    "churn_rate double, ip_account_density double, amount_deviation_ratio double, "
    "daily_limit_fraction double, user_risk_score double, device_trust_score double, "
    "is_rooted_or_emulator int, device_risk_score double, merchant_chargeback_rate double, "
    "merchant_risk_score double, is_vpn_or_proxy int, network_risk_score double, is_fraud int, "
    "fraud_type string, risk_score double"
)

# Accepted source keys per canonical field, first non-empty one wins.
ALIASES: dict[str, list[str]] = {
    "transaction_id": ["transaction_id", "transaction_ref", "txn_id", "tx_ref", "id"],
    "ts": ["timestamp", "created_at", "date"],
    "sender_account": ["sender_account", "sender_account_number", "account_number", "sender_account_id"],
    "receiver_account": ["receiver_account", "receiver_account_number", "receiver_account_id"],
    "amount": ["amount"],
    "currency": ["currency"],
    "channel": ["channel", "trans_type"],
    "sender_bank": ["sender_bank", "bank_name"],
    "receiver_bank": ["receiver_bank"],
    "sender_name": ["sender_name", "name"],
    "receiver_name": ["receiver_name"],
    "device_id": ["device_id", "device_fingerprint", "device"],
    "ip_address": ["ip_address", "ip_address_str"],
    "wallet_id": ["wallet_id"],
    "beneficiary_id": ["beneficiary_id"],
    "location_city": ["location_city", "city"],
    "location_state": ["location_state", "state"],
    "latitude": ["latitude"],
    "longitude": ["longitude"],
    "narration": ["narration", "narrative", "description"],
}

# Relational tables and their columns.
AUDIT = "created_at timestamp, updated_at timestamp, status string"
TABLES: dict[str, str] = {
    "accounts": "id string, account_number string, customer_id string, customer_name string, "
    "account_type string, currency string, balance double, risk_score int, risk_level string, "
    "is_flagged_mule boolean, opened_at timestamp, branch_id string, " + AUDIT,
    "alerts": "id string, alert_number string, title string, pattern_type string, severity string, "
    "risk_score int, alert_status string, triggered_at timestamp, description string, "
    "account_id string, case_id string, " + AUDIT,
    "transactions": "id string, transaction_ref string, channel string, amount double, currency string, "
    "timestamp timestamp, location_city string, location_state string, latitude double, longitude double, "
    "ip_address_str string, device_fingerprint string, risk_score int, flagged_pattern string, "
    "narrative string, sender_account_id string, receiver_account_id string, " + AUDIT,
    "reports": "id string, report_number string, report_type string, title string, generated_at timestamp, "
    "file_path string, summary_text string, case_id string, " + AUDIT,
    "rules": "id string, rule_code string, rule_name string, pattern_name string, description string, "
    "risk_score_contribution int, is_active boolean, threshold_value double, time_window_minutes int, " + AUDIT,
    "cases": "id string, case_number string, title string, priority string, case_status string, " + AUDIT,
    "devices": "id string, device_fingerprint string, linked_accounts_count int, " + AUDIT,
    "ip_addresses": "id string, ip_address string, is_vpn boolean, is_proxy boolean, "
    "linked_accounts_count int, " + AUDIT,
    "beneficiaries": "id string, account_number string, bank_name string, " + AUDIT,
    "branches": "id string, branch_code string, branch_name string, city string, state string, " + AUDIT,
    "atms": "id string, atm_code string, city string, state string, latitude double, longitude double, " + AUDIT,
}

COMPLAINT_SCHEMA = (
    "transaction_id string, victim_name string, victim_email string, victim_phone string, "
    "incident_type string, amount_lost double, incident_date string, description string"
)

SEVERITY_RANK = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
RISK_LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
MODALITIES = ["rules", "temporal", "graph", "tabular_ml", "graph_ml"]
WINDOWS = {"5m": 300, "15m": 900, "1h": 3600, "24h": 86400}
