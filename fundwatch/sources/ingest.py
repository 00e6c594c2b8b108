"""Raw records to canonical transfers, de-duplication and graph ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import filled, iso, node_id, number, parse_ts
from ..schema import ALIASES

DEFAULTS = {"currency": "INR", "channel": "UPI"}


def _first_alias(raw: DataFrame, field: str) -> Column:
    found = [filled(F.col(f"`{a}`")) for a in ALIASES[field] if a in raw.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def canonicalize(raw: DataFrame) -> DataFrame:
    """Canonical columns from any raw record shape; every other column goes to ``metadata``.

    The first non-empty alias wins. Currency and channel get defaults. Unparseable
    timestamps and amounts become null and are caught by ``validate``.
    """
    known = {a for names in ALIASES.values() for a in names} | {"metadata"}
    extra = [c for c in raw.columns if c not in known]
    if dict(raw.dtypes).get("timestamp") in ("timestamp", "timestamp_ntz"):
        ts = F.col("timestamp").cast("timestamp")
    else:
        ts = parse_ts(_first_alias(raw, "ts"))
    cols: list[Column] = []
    for field in ALIASES:
        value = _first_alias(raw, field)
        if field == "ts":
            value = ts
        elif field in ("amount", "latitude", "longitude"):
            value = number(value)
        elif field in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[field]))
        cols.append(value.alias(field))
    captured = F.lit(None).cast("map<string,string>")
    if extra:
        captured = F.map_from_arrays(
            F.array(*[F.lit(c) for c in extra]), F.array(*[F.col(f"`{c}`").cast("string") for c in extra])
        )
        captured = F.map_filter(captured, lambda _, v: v.isNotNull())
    if dict(raw.dtypes).get("metadata") == "map<string,string>":
        given = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
        if extra:
            fresh = F.map_filter(captured, lambda k, _: ~F.map_contains_key(given, k))
            captured = F.map_concat(given, fresh)
        else:
            captured = given
    return raw.select(*cols, captured.alias("metadata"))


def reject_reason(tx: DataFrame) -> Column:
    """Name of the first failed check, or null for a valid transfer."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return (
        F.when(blank("transaction_id"), "missing_transaction_id")
        .when(F.col("ts").isNull(), "bad_timestamp")
        .when(blank("sender_account"), "missing_sender")
        .when(blank("receiver_account"), "missing_receiver")
        .when(F.col("amount").isNull() | F.isnan("amount"), "bad_amount")
        .when(F.col("amount") <= 0, "amount_not_positive")
        .when(F.length("currency") > 5, "bad_currency")
        .when(~F.coalesce(F.col("latitude").between(-90, 90), F.lit(True)), "bad_latitude")
        .when(~F.coalesce(F.col("longitude").between(-180, 180), F.lit(True)), "bad_longitude")
    )


def validate(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into valid transfers and a quarantine with a ``reason`` column."""
    checked = tx.withColumn("reason", reject_reason(tx))
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


def dedup_first(df: DataFrame, key: str = "transaction_id", order: list[str] | str = "ts") -> DataFrame:
    """First row per key by ``order``. An aggregate, so copies are dropped before the shuffle."""
    order = [order] if isinstance(order, str) else order
    others = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return first.select(key, "_r.*").select(*df.columns)


def to_legacy(tx: DataFrame, metadata_keys: list[str] | None = None) -> DataFrame:
    """Canonical columns under every alias a downstream reader may expect.

    ``metadata_keys`` names the metadata entries to unpack; they never overwrite a column.
    """
    aliases = {
        "transaction_id": ["transaction_ref", "txn_id"],
        "sender_account": ["sender_account_number"],
        "receiver_account": ["receiver_account_number"],
        "channel": ["trans_type"],
        "sender_bank": ["bank_name"],
        "sender_name": ["name"],
        "device_id": ["device_fingerprint", "device"],
        "ip_address": ["ip_address_str"],
        "location_city": ["city"],
        "location_state": ["state"],
        "narration": ["narrative", "description"],
    }
    cols = [F.col(c).alias("timestamp" if c == "ts" else c) for c in ALIASES]
    names = {"timestamp", *ALIASES} - {"ts"}
    for source, targets in aliases.items():
        cols += [F.col(source).alias(t) for t in targets]
        names |= set(targets)
    cols += [F.try_element_at("metadata", F.lit(k)).alias(k) for k in metadata_keys or [] if k not in names]
    return tx.select(*cols)


def link_edges(tx: DataFrame, entity: str, kind: str) -> DataFrame:
    """One edge per (account, device) or (account, ip); repeated use changes nothing."""
    src, dst = node_id("sender_account", "account"), node_id(entity, kind)
    link = F.lit("link:" if kind == "device" else "ip_link:")
    return (
        tx.filter(filled(entity).isNotNull())
        .select(src.alias("src"), dst.alias("dst"))
        .distinct()
        .select("src", "dst", F.concat(link, "src", F.lit("->"), "dst").alias("key"),
                F.lit("USES_DEVICE" if kind == "device" else "USES_IP").alias("relationship"))
    )


def transfer_edges(tx: DataFrame) -> DataFrame:
    """One edge per (sender, receiver, transaction); a repeated transaction keeps its last attributes."""
    attrs = ["amount", "currency", "channel", "ts", "narration"]
    edge = tx.select(
        node_id("sender_account", "account").alias("src"),
        node_id("receiver_account", "account").alias("dst"),
        F.col("transaction_id").alias("key"),
        *attrs,
    )
    last = edge.groupBy("src", "dst", "key").agg(F.max_by(F.struct(*attrs), F.struct("ts", "amount")).alias("_a"))
    return last.select(
        "src", "dst", "key", F.lit("TRANSFERRED_FUNDS").alias("relationship"), F.col("key").alias("transaction_id"), "_a.*"
    )


def account_pairs(tx: DataFrame) -> DataFrame:
    """One edge per (sender, receiver): all that cycle flags need of the graph."""
    src, dst = node_id("sender_account", "account").alias("src"), node_id("receiver_account", "account").alias("dst")
    return tx.groupBy(src, dst).agg(F.sum("amount").alias("amount")).withColumn("relationship", F.lit("TRANSFERRED_FUNDS"))


def build_graph(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the transfer, device and IP multigraph."""
    side = lambda who, default: tx.select(
        node_id(f"{who}_account", "account").alias("id"),
        F.col(f"{who}_account").alias("account_number"),
        filled(f"{who}_bank").alias("bank"),
        F.lit(default).alias("fallback"),
        F.struct(F.col("ts"), F.col("transaction_id"), F.lit(0 if who == "sender" else 1)).alias("at"),
    )
    # The last non-empty bank wins; an account that never names one keeps the default of its first role.
    accounts = (
        side("sender", "State Bank of India")
        .unionByName(side("receiver", "HDFC Bank"))
        .groupBy("id")
        .agg(
            F.max("account_number").alias("account_number"),
            F.max_by("bank", F.when(F.col("bank").isNotNull(), F.col("at"))).alias("bank"),
            F.min_by("fallback", "at").alias("fallback"),
        )
        .select("id", F.lit("account").alias("type"), "account_number",
                F.coalesce("bank", "fallback").alias("bank_name"), F.lit(None).cast("string").alias("entity"))
    )
    entity = lambda c, kind: tx.filter(filled(c).isNotNull()).select(
        node_id(c, kind).alias("id"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("account_number"),
        F.lit(None).cast("string").alias("bank_name"), F.col(c).alias("entity")
    ).distinct()
    nodes = accounts.unionByName(entity("device_id", "device")).unionByName(entity("ip_address", "ip"))
    edges = (
        transfer_edges(tx)
        .unionByName(link_edges(tx, "device_id", "device"), allowMissingColumns=True)
        .unionByName(link_edges(tx, "ip_address", "ip"), allowMissingColumns=True)
    )
    return nodes, edges


def export_graph(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges for display.

    ``tx`` carries, besides the canonical columns, ``risk_score``, ``is_fraud``,
    ``fraud_type``, ``device_risk_score``, ``network_risk_score``,
    ``is_rooted_or_emulator`` and ``is_vpn_or_proxy``. The first appearance of a node
    decides its attributes.
    """
    at = lambda n: F.struct(F.col("ts"), F.col("transaction_id"), F.lit(n))
    fraud = F.col("is_fraud") == 1
    ring = F.when(fraud, "COMMUNITY-A12").otherwise("COMMUNITY-B04")
    acc = lambda c: F.concat(F.lit("acc-"), F.col(c))
    dev = F.concat(F.lit("dev-"), "device_id")
    ip = F.concat(F.lit("ip-"), F.regexp_replace("ip_address", r"\.", "_"))
    row = lambda i, label, kind, risk, bank, mule, community, order: F.struct(
        i.alias("id"), label.alias("label"), kind.alias("type"), risk.cast("int").alias("risk_score"),
        bank.alias("bank"), mule.alias("is_mule"), community.alias("community_id"), order.alias("at"))
    none = F.lit(None).cast("string")
    label = lambda c, n: F.concat_ws(" — ", F.col(c), F.col(n))
    appearances = tx.select(F.inline(F.array(
        row(acc("sender_account"), label("sender_account", "sender_name"), F.lit("account"),
            F.bround("risk_score"), F.col("sender_bank"), fraud, ring, at(0)),
        row(acc("receiver_account"), label("receiver_account", "receiver_name"),
            F.when(F.col("fraud_type") == "Phishing Fraud", "victim").otherwise("account"),
            F.bround(F.when(fraud, F.col("risk_score") * 0.8).otherwise(F.col("risk_score"))),
            F.col("receiver_bank"), F.lit(False), ring, at(1)),
        row(dev, F.col("device_id"), F.lit("device"), F.bround("device_risk_score"), none, F.lit(False), F.lit("COMMUNITY-A12"), at(2)),
        row(ip, F.concat("ip_address", F.lit(" (Network)")), F.lit("ip"), F.bround("network_risk_score"), none, F.lit(False), F.lit("COMMUNITY-A12"), at(3)),
    ))).filter(F.col("id").isNotNull())
    nodes = dedup_first(appearances, "id", ["at"]).drop("at")
    edge = lambda dst, rel: F.struct(
        acc("sender_account").alias("source"), dst.alias("target"), F.lit(rel).alias("relationship"),
        (F.bround("amount") if rel == "TRANSFERRED_FUNDS" else F.lit(None)).cast("double").alias("amount"),
        (F.col("channel") if rel == "TRANSFERRED_FUNDS" else none).alias("channel"),
        (iso("ts") if rel == "TRANSFERRED_FUNDS" else none).alias("timestamp"))
    shares_device = (F.col("is_rooted_or_emulator") == 1) | (F.col("fraud_type") == "Shared Device")
    edges = tx.select(F.inline(F.array_compact(F.array(
        edge(acc("receiver_account"), "TRANSFERRED_FUNDS"),
        F.when(shares_device, edge(dev, "SHARED_DEVICE")),
        F.when(F.col("is_vpn_or_proxy") == 1, edge(ip, "SHARED_IP")),
    ))))
    return nodes, edges
