"""Filters, lookups, pages, complaint JSON and graph view filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import COMPLAINT_SCHEMA


def _equal(df: DataFrame, **values) -> DataFrame:
    for name, value in values.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def _page(df: DataFrame, order: list, skip: int, limit: int | None) -> DataFrame:
    df = df.orderBy(*order)
    df = df.offset(skip) if skip else df
    return df if limit is None else df.limit(limit)


def filter_transfers(tx, channel=None, min_amount=None, max_amount=None, start=None, end=None, sender=None, receiver=None):
    """Optional conditions, closed ranges. All of them can reach the scan."""
    df = _equal(tx, channel=channel, sender_account=sender, receiver_account=receiver)
    if min_amount is not None:
        df = df.filter(F.col("amount") >= min_amount)
    if max_amount is not None:
        df = df.filter(F.col("amount") <= max_amount)
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return df


def search_transfers(tx: DataFrame, *, skip: int = 0, limit: int = 20, **filters) -> DataFrame:
    """One page of matching transfers, newest first (a top-k, not a full sort)."""
    return _page(filter_transfers(tx, **filters), [F.desc("ts"), F.desc("transaction_id")], skip, limit)


def count_transfers(tx: DataFrame, **filters) -> DataFrame:
    return filter_transfers(tx, **filters).agg(F.count(F.lit(1)).alias("total"))


def search_accounts(accounts, risk_level=None, is_flagged_mule=None, skip=0, limit=20):
    df = _equal(accounts, risk_level=risk_level, is_flagged_mule=is_flagged_mule)
    return _page(df, [F.desc("risk_score"), F.col("account_number")], skip, limit)


def search_alerts(alerts, severity=None, alert_status=None, pattern_type=None, account_id=None, skip=0, limit=20):
    df = _equal(alerts, severity=severity, alert_status=alert_status, pattern_type=pattern_type, account_id=account_id)
    return _page(df, [F.desc("triggered_at"), F.desc("alert_number")], skip, limit)


def search_reports(reports, report_type=None, case_id=None, skip=0, limit=20):
    df = _equal(reports, report_type=report_type, case_id=case_id)
    return _page(df, [F.desc("generated_at"), F.desc("report_number")], skip, limit)


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def page_meta(df: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """Total rows, pages and neighbours of a page, from one aggregate."""
    if page < 1 or size < 1:
        raise ValueError("page and size must be positive")
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(page).alias("page"),
        F.lit(size).alias("page_size"),
        F.ceil(F.col("total") / size).alias("pages"),
        (F.lit(page) < F.ceil(F.col("total") / size)).alias("has_next"),
        F.lit(page > 1).alias("has_prev"),
    )


def build_complaints(submitted: DataFrame) -> DataFrame:
    """Complaint rows with the JSON payload as a reports table row. ``report_key`` is the key; ``report_number`` its short form for display."""
    fields = [f.split()[0] for f in COMPLAINT_SCHEMA.split(", ")]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    key = F.sha2(F.concat_ws(":", "transaction_id", "description"), 256)
    return submitted.select(
        key.alias("report_key"),
        F.concat(F.lit("CMP-"), F.upper(F.substring(key, 1, 12))).alias("report_number"),
        F.lit("VICTIM_COMPLAINT").alias("report_type"),
        F.concat_ws("", F.lit("Victim Complaint: "), "incident_type", F.lit(" — "), "victim_name").alias("title"),
        body.alias("summary_text"),
        F.lit("active").alias("status"),
        *[c for c in submitted.columns if c not in fields],
    )


def complaints_by_email(reports: DataFrame, email: str) -> DataFrame:
    return reports.filter(
        (F.col("report_type") == "VICTIM_COMPLAINT") & (F.get_json_object("summary_text", "$.victim_email") == email)
    )


def expand_complaints(reports: DataFrame) -> DataFrame:
    """Complaint JSON as columns; a malformed payload gives nulls instead of a failed job."""
    parsed = F.from_json("summary_text", COMPLAINT_SCHEMA, {"mode": "PERMISSIVE"})
    keep = [c for c in reports.columns if c != "summary_text"]
    return reports.filter(F.col("report_type") == "VICTIM_COMPLAINT").select(*keep, parsed.alias("j")).select(*keep, "j.*")


def account_history(tx: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` transfers of every account, on either side.

    Spark drops rows beyond rank ``n`` before the shuffle (group limit), so a hot account
    sends at most ``n`` rows per task.
    """
    out = F.struct(F.col("sender_account").alias("account"), F.lit("out").alias("side"))
    into = F.struct(F.col("receiver_account").alias("account"), F.lit("in").alias("side"))
    own = F.struct(F.col("sender_account").alias("account"), F.lit("self").alias("side"))
    legs = tx.select(
        "*", F.inline(F.when(F.col("sender_account") == F.col("receiver_account"), F.array(own)).otherwise(F.array(out, into)))
    )
    w = Window.partitionBy("account").orderBy(F.desc("ts"), F.desc("transaction_id"))
    return legs.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def recent(tx: DataFrame, n: int = 20) -> DataFrame:
    return tx.orderBy(F.desc("ts"), F.desc("transaction_id")).limit(n)


def search_ref(tx: DataFrame, text: str) -> DataFrame:
    return tx.filter(F.lower("transaction_id").contains(text.lower()))


def latest_state(log: DataFrame, key: str, ts: str, state: str) -> DataFrame:
    """Last state per key from an append-only log."""
    return log.groupBy(key).agg(F.max_by(state, ts).alias(state), F.max(ts).alias(ts))


RISK_BANDS = {
    "CRITICAL": lambda: (F.col("risk_score") >= 90) | F.col("is_mule"),
    "HIGH": lambda: F.col("risk_score") >= 75,
    "MEDIUM": lambda: (F.col("risk_score") >= 45) & (F.col("risk_score") < 75),
    "LOW": lambda: F.col("risk_score") < 45,
    "MULES_ONLY": lambda: F.col("is_mule"),
}


def _induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    source, target = ids.select(F.col("id").alias("source")), ids.select(F.col("id").alias("target"))
    return edges.join(source, "source", "left_semi").join(target, "target", "left_semi")


def graph_view(nodes, edges, risk="ALL", kind="ALL", bank="ALL", min_amount=0.0) -> tuple[DataFrame, DataFrame]:
    """Nodes of a risk band, type and bank, and the edges that keep both ends."""
    if risk != "ALL":
        nodes = nodes.filter(RISK_BANDS[risk]())
    if kind != "ALL":
        nodes = nodes.filter(F.col("type") == kind)
    if bank != "ALL":
        nodes = nodes.filter(F.col("bank") == bank)
    if min_amount > 0:
        edges = edges.filter(F.coalesce("amount", F.lit(0.0)) >= min_amount)
    return nodes, _induced(edges, nodes)


def top_nodes(nodes: DataFrame, edges: DataFrame, n: int = 85) -> tuple[DataFrame, DataFrame]:
    """The ``n`` nodes of highest risk and the edges among them (``n`` rows: broadcast is safe)."""
    top = nodes.orderBy(F.desc("risk_score"), F.col("id")).limit(n)
    return top, _induced(edges, F.broadcast(top))
