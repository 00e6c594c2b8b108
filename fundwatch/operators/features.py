"""Tabular features: 57 columns in a fixed order, data sets and splits."""

from __future__ import annotations

from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import filled, finite, micros, sanitize
from ..functions.session import cut, lookup
from .selection import kth_smallest
from .temporal import temporal_asof

# Feature names, in order.
NATIVE = ["amount", "log_amount", "channel_upi", "channel_neft", "channel_rtgs", "channel_imps", "channel_other", "is_interbank",
          "has_device_id", "has_ip_address", "hour_of_day", "day_of_week", "is_weekend", "is_night"]
TELEMETRY = {
    "account_age_days": 180.0, "velocity_l6h": 1.0, "churn_rate": 0.01, "ip_account_density": 1.0, "amount_deviation_ratio": 1.0,
    "daily_limit_fraction": 0.1, "user_risk_score": 15.0, "device_trust_score": 85.0, "is_rooted_or_emulator": 0.0, "device_risk_score": 10.0,
    "merchant_chargeback_rate": 0.0, "merchant_risk_score": 5.0, "is_vpn_or_proxy": 0.0, "network_risk_score": 15.0,
}
TEMPORAL = {
    "temporal_tx_count_5m": "n_5m", "temporal_tx_count_15m": "n_15m", "temporal_tx_count_1h": "n_1h", "temporal_tx_count_24h": "n_24h",
    "temporal_amount_sum_5m": "amount_5m", "temporal_amount_sum_1h": "amount_1h", "temporal_avg_interval_seconds": "average_interval",
    "temporal_burst_detected": None, "temporal_burst_count": "burst_count", "temporal_rapid_in_out_detected": "rapid_in_out_detected",
    "temporal_rapid_in_out_ratio": "rapid_in_out_ratio", "temporal_activity_change_ratio": "activity_change_ratio",
}
GRAPH = {
    "graph_in_degree": "in_degree", "graph_out_degree": "out_degree", "graph_total_degree": "total_degree",
    "graph_unique_inbound_counterparties": "unique_senders", "graph_unique_outbound_counterparties": "unique_receivers",
    "graph_fan_in_ratio": "fan_in_ratio", "graph_fan_out_ratio": "fan_out_ratio", "graph_neighboring_accounts_count": "neighbouring_accounts",
    "graph_neighboring_devices_count": "neighbouring_devices", "graph_neighboring_ips_count": "neighbouring_ips",
    "graph_neighborhood_density": "neighbourhood_density", "graph_reachable_node_count": "reachable_accounts",
    "graph_max_downstream_path_length": "max_path_length", "graph_has_cycle": "has_cycle", "graph_cycle_count": "cycle_count",
    "graph_shared_device_count": "shared_device_count", "graph_shared_ip_count": "shared_ip_count",
}
FEATURES = [*NATIVE, *TELEMETRY, *TEMPORAL, *GRAPH]
# Identifier and outcome columns that a model must not see.
IDENTIFIERS = ["txn_id", "name", "account_number", "mobile_number", "receiver_account", "receiver_name", "timestamp"]
LEAKS = {"regression": ["risk_score", "is_fraud", "fraud_type"], "classification": ["risk_score", "fraud_type", "is_fraud"]}


def _one(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def native_features(tx: DataFrame) -> DataFrame:
    """Amount, channel, bank, device and calendar features. Monday is 0."""
    amount = F.greatest(F.lit(0.0), finite("amount"))
    channel = F.upper(F.coalesce(filled("channel"), F.lit("UPI")))
    bank = lambda c: F.lower(F.trim(filled(c)))
    hour, day = F.hour("ts").cast("double"), F.weekday("ts").cast("double")
    values = [
        amount, F.round(F.log10(amount + 1.0), 4), *[_one(channel == c) for c in ("UPI", "NEFT", "RTGS", "IMPS")],
        _one(~channel.isin("UPI", "NEFT", "RTGS", "IMPS")), _one(F.coalesce(bank("sender_bank") != bank("receiver_bank"), F.lit(False))),
        _one(filled("device_id").isNotNull()), _one(filled("ip_address").isNotNull()), hour, day, _one(day >= 5), _one((hour < 6) | (hour >= 22)),
    ]
    return tx.withColumns(dict(zip(NATIVE, values)))


def telemetry_features(tx: DataFrame) -> DataFrame:
    """Risk telemetry from ``metadata``, with defaults. The two flags are true for any non-empty value."""
    value = lambda k: F.try_element_at("metadata", F.lit(k))
    made = {k: _one(filled(value(k)).isNotNull()) if k.startswith("is_") else sanitize(value(k), d) for k, d in TELEMETRY.items()}
    return tx.withColumns(made)


def _temporal_columns() -> list[Column]:
    """A burst counts as soon as there is any event."""
    source = lambda s: (F.col("burst_detected") | (F.col("burst_count") > 0)) if s is None else F.col(s)
    return [source(s).cast("double").alias(name) for name, s in TEMPORAL.items()]


def temporal_features_at(tx: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``tx`` with the temporal record of the sender at the transfer's own time, later transfers left out.

    The history is ``tx`` itself unless another table is given. Transfers travel through the
    windows as payload; they are not joined back.
    """
    instants = tx.select(F.col("sender_account").alias("account"), micros("ts").alias("reference_us"), F.struct(*tx.columns).alias("transfer"))
    found = temporal_asof(tx if history is None else history, instants).select("transfer.*", *_temporal_columns())
    return found.fillna(0.0, list(TEMPORAL))


def join_temporal(tx: DataFrame, temporal: DataFrame) -> DataFrame:
    """A given record of the sender (for scoring at one reference time; ``temporal_features_at`` for training rows)."""
    made = _temporal_columns()
    joined = lookup(tx, cut(temporal.select(F.col("account").alias("sender_account"), *made)), "sender_account")
    return joined.fillna(0.0, list(TEMPORAL))


def join_graph(tx: DataFrame, graph: DataFrame, absent: tuple[str, ...] = ()) -> DataFrame:
    """Graph record of the sender. A column that the record lacks is an error unless ``absent`` names it; then it is 0."""
    lacking = [s for s in GRAPH.values() if s not in graph.columns and s not in absent]
    if lacking:
        raise ValueError(f"graph record without {', '.join(lacking)}")
    made = [(F.col(s) if s in graph.columns else F.lit(0.0)).cast("double").alias(n) for n, s in GRAPH.items()]
    joined = lookup(tx, cut(graph.select(F.col("account").alias("sender_account"), *made)), "sender_account")
    return joined.fillna(0.0, list(GRAPH))


def build_features(tx: DataFrame, temporal: DataFrame | None = None, graph: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """All 57 features. ``history`` gives each transfer the record of its own time, ``temporal`` one record an account; without both they are 0."""
    df = telemetry_features(native_features(tx))
    if history is not None:
        df = temporal_features_at(df, history)
    else:
        df = join_temporal(df, temporal) if temporal is not None else df.withColumns({c: F.lit(0.0) for c in TEMPORAL})
    df = join_graph(df, graph) if graph is not None else df.withColumns({c: F.lit(0.0) for c in GRAPH})
    # Native and telemetry columns are finite already.
    return df.withColumns({c: finite(c) for c in [*TEMPORAL, *GRAPH]})


def feature_vector(df: DataFrame, columns: list[str] = FEATURES, output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="error").transform(df)


def dataset(df: DataFrame, target: str = "is_fraud") -> DataFrame:
    """Features, target (0 when there is none), time and id."""
    y = F.col(target).cast("double") if target in df.columns else F.lit(0.0)
    return df.select("transaction_id", "ts", *FEATURES, y.alias("label"))


def split_chronological(df: DataFrame, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Add ``split`` by position in time order: the first ``int(n * train)`` rows, and so on.

    The exact cut instants are found from counts, never by sorting the table in one task:
    rows per second give the second in which each cut falls, and only the rows of those
    seconds are ranked.
    """
    second = F.unix_seconds("ts")
    per = df.groupBy(second.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    cuts = cut_points(per, "s", "n", [train, train + validation])
    ranked = {}
    for name, c in zip(("train", "validation"), cuts):
        if c is None:
            ranked[name] = None
            continue
        s, inside = c
        # Position ``inside`` (1-based) within the second: its rows only.
        row = df.filter(second == s).select("ts", "transaction_id").orderBy("ts", "transaction_id").offset(inside - 1).limit(1).first()
        ranked[name] = (row["ts"], row["transaction_id"])

    def upto(bound) -> Column:
        if bound is None:
            return F.lit(False)
        t, i = F.lit(bound[0]), F.lit(bound[1])
        return (F.col("ts") < t) | ((F.col("ts") == t) & (F.col("transaction_id") <= i))

    return df.withColumn("split", F.when(upto(ranked["train"]), "train").when(upto(ranked["validation"]), "validation").otherwise("test"))


def cut_points(counts: DataFrame, key: str, n: str, shares: list[float]) -> list[tuple[int, int] | None]:
    """For each share, the key in which row number ``int(total * share)`` falls and its place within that key.

    Keys are first summed in wide ranges, so the driver sees at most about a thousand
    sums per level however many keys there are.
    """
    counts = cut(counts)
    total, low, high = counts.agg(F.sum(n), F.min(key), F.max(key)).first()
    out: list[tuple[int, int] | None] = []
    for share in shares:
        want = int(total * share + 1e-9) if total else 0
        if want <= 0:
            out.append(None)
            continue
        lo, hi, before = low, high, 0
        while lo < hi:
            width = max(1, -(-(hi - lo + 1) // 1000))
            part = counts.filter(F.col(key).between(lo, hi)).groupBy(F.floor((F.col(key) - lo) / width).alias("b")).agg(F.sum(n).alias("n"))
            for row in sorted(part.collect(), key=lambda r: r["b"]):
                if before + row["n"] >= want:
                    lo, hi = lo + row["b"] * width, min(hi, lo + (row["b"] + 1) * width - 1)
                    break
                before += row["n"]
            if width == 1:
                hi = lo
        out.append((lo, want - before))
    return out


def split_random(df: DataFrame, train: float = 0.8, seed: int = 42, strata: str | None = None, key: str = "transaction_id") -> DataFrame:
    """Add ``split``. A hash of the key (60 bits of md5) decides, so the split does not change with the partitioning.

    Without ``strata`` each key is drawn with the probability ``train``. With it, the
    ``floor(train * n)`` smallest hashes of a stratum of ``n`` rows are for training, exactly; rows of one
    key stay together, so copies of the last key go with it. A null stratum is one of its own,
    rows without a key are for testing.
    """
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
    if strata is None:
        return df.withColumn("split", F.when(hashed / float(2**60) < train, "train").otherwise("test"))
    limits = kth_smallest(df, [strata], hashed, {"_limit": F.floor(F.col("n") * train + 1e-9)})
    limits = limits.select(F.struct(strata).alias("_g"), "_limit")
    joined = df.withColumn("_g", F.struct(strata)).join(limits, "_g", "left")
    return joined.withColumn("split", F.when(hashed <= F.col("_limit"), "train").otherwise("test")).drop("_g", "_limit")


def preprocess_stages(categorical: list[str], numeric: list[str]) -> list:
    """Scaled numbers and one-hot categories; unknown categories get their own slot."""
    stages = []
    if numeric:
        stages += [Imputer(inputCols=numeric, outputCols=[f"{c}_filled" for c in numeric]),
                   VectorAssembler(inputCols=[f"{c}_filled" for c in numeric], outputCol="numeric"),
                   StandardScaler(inputCol="numeric", outputCol="scaled", withMean=True, withStd=True)]
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=[f"{c}_index" for c in categorical], handleInvalid="keep"),
                   OneHotEncoder(inputCols=[f"{c}_index" for c in categorical], outputCols=[f"{c}_hot" for c in categorical], handleInvalid="keep")]
    parts = (["scaled"] if numeric else []) + [f"{c}_hot" for c in categorical]
    return stages + [VectorAssembler(inputCols=parts, outputCol="features")]


def drop_leakage(df: DataFrame, task: str) -> DataFrame:
    return df.drop(*IDENTIFIERS, *LEAKS[task])
