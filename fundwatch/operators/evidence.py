"""Evidence items, their de-duplication and ranking, packages and case summaries.

Items are rows. A case holds at most one item per rule, signal and modality after
de-duplication (about thirty), so the per-case arrays and windows below are small.
Collectors read a *case* row: ``case_id``, ``subject_id``, the transfer's columns and
whatever features were joined to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import any_of, filled, iso, money, severity_rank
from ..functions.session import cut
from ..schema import MODALITIES
from .fusion import _fixed, _text

REFS = ["transaction_ids", "account_ids", "device_ids", "ip_addresses", "timestamps"]
# Rank weights, source priorities and version labels.
SOURCE_PRIORITY = {"RULE": 70, "GRAPH": 60, "TEMPORAL": 50, "GRAPH_ML": 40, "TABULAR_ML": 40, "RISK_FUSION": 30, "TRANSACTION": 20}
STRENGTH = [("score_contribution", 1.0), ("fraud_probability", 100.0), ("contribution_points", 1.0), ("cycle_count", 20.0),
            ("shared_device_count", 15.0), ("burst_count", 10.0)]
FUSION_VERSION = "v1.0"
# Collection order of the sources; it decides which of two equal items is "first".
ORDER = {"RULE": 0, "TEMPORAL": 100, "GRAPH": 200, "TABULAR_ML": 300, "GRAPH_ML": 301, "RISK_FUSION": 400, "TRANSACTION": 500}


def _strings(*cs: Column | str) -> Column:
    return F.array_compact(F.array(*[filled(c) for c in cs])) if cs else F.array().cast("array<string>")


def evidence_id(source, reference, category, accounts, transactions) -> Column:
    """``EVD-{source}-{slug}-{digest}`` over the sorted references: equal facts get equal ids."""
    s, r, c = (F.lit(x) if isinstance(x, str) else x for x in (source, reference, category))
    slug = F.substring(F.upper(F.translate(r, ":_", "--")), 1, 16)
    text = F.concat_ws(":", s, r, c, F.array_join(F.array_sort(accounts), ","), F.array_join(F.array_sort(transactions), ","))
    return F.concat(F.lit("EVD-"), s, F.lit("-"), slug, F.lit("-"), F.substring(F.sha2(text, 256), 1, 12))


def case_id(transaction: Column | None = None, subject: Column | None = None) -> Column:
    """Key of a case: the whole id, so different transfers never share a case. ``case_label`` is the short form for display."""
    slug = lambda c: F.concat(F.lit("CASE-"), F.translate(filled(c), " ", "_"))
    anonymous = F.concat(F.lit("CASE-ANON-"), F.substring(F.sha2(F.lit("anonymous_case"), 256), 1, 10))
    return F.coalesce(*[slug(c) for c in (transaction, subject) if c is not None], anonymous)


def case_label(case: Column | str) -> Column:
    """The case key as the reports print it: at most 32 characters of the id. Never a key."""
    return F.substring(case, 1, len("CASE-") + 32)


def valid_provenance(items: DataFrame) -> DataFrame:
    return items.filter(F.col("source").isin(list(SOURCE_PRIORITY)) & (F.length(F.trim("source_reference")) > 0))


def _metrics(**values: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("double"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")


def _item(source, reference, category, title, description, severity, metrics, *, accounts, transactions, id_accounts=None,
          devices=None, ips=None, times=None, position: Column | int = 0) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.array().cast("array<string>")
    offset = F.lit(ORDER[source]) + (F.lit(position) if isinstance(position, int) else position)
    return F.struct(
        offset.alias("position"),
        evidence_id(source, reference, category, accounts if id_accounts is None else id_accounts, transactions).alias("evidence_id"),
        F.lit(category).alias("category"), lit(title).alias("title"), lit(description).alias("description"), lit(severity).alias("severity"),
        F.lit(source).alias("source"), lit(reference).alias("source_reference"), transactions.alias("transaction_ids"), accounts.alias("account_ids"),
        (none if devices is None else devices).alias("device_ids"), (none if ips is None else ips).alias("ip_addresses"),
        (none if times is None else times).alias("timestamps"), metrics.alias("metrics"),
    )


def _few(*items: Column) -> Column:
    """The items that are there, as an array."""
    return F.array_compact(F.array(*items))


def _rows(cases: DataFrame, items: Column) -> DataFrame:
    # An outer generator: for an inner one Spark infers a filter on the array, whose items would be made twice.
    return cases.select("case_id", F.inline_outer(items)).filter("position IS NOT NULL")


BASE_TX = lambda: _strings("transaction_id")
BASE_ACC = lambda: _strings("sender_account", "receiver_account")


def rule_items() -> Column:
    def one(m: Column, i: Column) -> Column:
        text = F.when(m["narrative"] != "", m["narrative"]).otherwise(
            _text("Rule ", m["rule_code"], " (", m["rule_name"], ") flagged suspicious pattern with severity ", m["severity"], "."))
        return _item("RULE", F.concat(F.lit("RULE:"), m["rule_code"]), "RULE_VIOLATION",
                     _text("Forensic Rule ", m["rule_code"], " Triggered (", m["pattern_name"], ")"), text, m["severity"],
                     _metrics(score_contribution=m["score"]), accounts=BASE_ACC(), transactions=BASE_TX(),
                     devices=_strings("device_id"), ips=_strings("ip_address"), times=F.array(iso("ts")), position=i)
    return F.transform("matches", one)


def rule_evidence(cases: DataFrame) -> DataFrame:
    """One item per rule match in ``matches``."""
    return _rows(cases, rule_items())


def temporal_items() -> Column:
    more = lambda c: F.array_distinct(F.concat(BASE_TX(), F.coalesce(F.col(c), F.array().cast("array<string>"))))
    burst_ids = F.when(F.size("burst_ids") > 0, F.col("burst_ids")).otherwise(BASE_TX())
    delay, ratio = F.col("rapid_in_out_delay"), F.col("rapid_in_out_ratio")
    rapid = _item("TEMPORAL", "TEMPORAL:rapid_in_out", "TEMPORAL_ANOMALY", "Rapid In/Out Fund Pass-Through",
                  _text("Funds rapidly routed through account within ", F.coalesce(F.concat(_fixed(delay, 1), F.lit("s")), F.lit("immediate")),
                        " with turnaround ratio of ", _fixed(ratio * 100, 1), "%."),
                  F.when((delay <= 300) & (ratio >= 0.85), "CRITICAL").otherwise("HIGH"),
                  _metrics(delay_seconds=delay, pass_through_ratio=F.round(ratio, 4), events_count=F.col("pass_through_pairs")),
                  accounts=F.array_distinct(F.concat(BASE_ACC(), _strings("subject_id"))), transactions=more("pass_ids"), position=0)
    count = F.col("burst_count")
    burst = _item("TEMPORAL", "TEMPORAL:burst", "TEMPORAL_ANOMALY", _text("High Frequency Transaction Burst (", count, " Txns)"),
                  _text("Sudden concentration of ", count, " transactions executed within a short burst window, indicating automated or coordinated structuring."),
                  F.when(count >= 5, "HIGH").otherwise("MEDIUM"), _metrics(burst_count=count), accounts=BASE_ACC(), transactions=burst_ids, position=1)
    n = F.col("n_1h")
    fast = _item("TEMPORAL", "TEMPORAL:velocity_1h", "TEMPORAL_ANOMALY", _text("Elevated 1-Hour Transaction Velocity (", n, " Txns)"),
                 _text("Account completed ", n, " transactions totaling ₹", money("amount_1h"), " within rolling 1-hour window."),
                 F.when(n >= 10, "HIGH").otherwise("MEDIUM"), _metrics(transaction_count_1h=n, amount_sum_1h=F.round("amount_1h", 2)),
                 accounts=BASE_ACC(), transactions=more("hour_ids"), position=2)
    return _few(F.when(F.col("rapid_in_out_detected"), rapid), F.when(F.col("burst_detected"), burst), F.when(n >= 5, fast))


def temporal_evidence(cases: DataFrame) -> DataFrame:
    """Pass-through, burst and one-hour velocity.

    ``pass_ids``, ``burst_ids`` and ``hour_ids`` list the contributing transfers of the subject.
    """
    return _rows(cases, temporal_items())


def graph_items(fan_threshold: float = 3.0) -> Column:
    me = F.col("subject_id")
    on = F.when(F.array_contains("cycle_nodes", me), F.col("cycle_nodes")).otherwise(F.concat(F.array(me), "cycle_nodes"))
    tx = BASE_TX()
    c = F.col
    cycle = _item("GRAPH", "GRAPH:circular_routing", "CIRCULAR_ROUTING", "Circular Fund Routing Loop",
                  _text("Identified ", c("cycle_count"), " circular fund loop(s) returning money through intermediary accounts: ", F.array_join(on, " -> "), "."),
                  "CRITICAL", _metrics(cycle_count=c("cycle_count")), accounts=on, transactions=tx, position=0)
    dev, ip = c("shared_device_count"), c("shared_ip_count")
    device = _item("GRAPH", "GRAPH:shared_device", "SHARED_INFRASTRUCTURE", _text("Shared Device Hardware Syndicate (", dev, " Device", F.when(dev > 1, "s").otherwise(""), ")"),
                   _text("Focal account shares ", dev, " hardware device fingerprint(s) across multiple distinct account entities, indicating synthetic identity or mule ring coordination."),
                   F.when(dev >= 3, "CRITICAL").otherwise("HIGH"), _metrics(shared_device_count=dev), accounts=F.array(me), transactions=tx, devices=c("associated_devices"), position=1)
    net = _item("GRAPH", "GRAPH:shared_ip", "SHARED_INFRASTRUCTURE", _text("Shared Network IP Cluster (", ip, " IP", F.when(ip > 1, "s").otherwise(""), ")"),
                _text("Focal account co-locates on ", ip, " network IP address(es) with other transacting entities."),
                F.when(ip >= 3, "HIGH").otherwise("MEDIUM"), _metrics(shared_ip_count=ip), accounts=F.array(me), transactions=tx, ips=c("associated_ips"), position=2)
    ratio = F.greatest("fan_in_ratio", "fan_out_ratio")
    kind = F.when(c("fan_in_ratio") >= c("fan_out_ratio"), "Fan-In Aggregation").otherwise("Fan-Out Dispersion")
    fan = _item("GRAPH", "GRAPH:fan_ratio", "TOPOLOGICAL_PATTERN", _text("Topological Anomaly: ", kind, " (Ratio: ", _fixed(ratio, 1), ")"),
                _text("Account demonstrates extreme ", F.lower(kind), " ratio of ", _fixed(ratio, 2), " (", c("unique_senders"), " senders -> ", c("unique_receivers"), " receivers)."),
                F.when(ratio >= 5.0, "HIGH").otherwise("MEDIUM"),
                _metrics(fan_in_ratio=c("fan_in_ratio"), fan_out_ratio=c("fan_out_ratio"), unique_senders=c("unique_senders"), unique_receivers=c("unique_receivers")),
                accounts=F.array(me), transactions=tx, position=3)
    hops, reached = c("max_path_length"), c("reachable_accounts")
    first = lambda n: F.concat(F.array(me), F.slice("downstream", 1, n))
    deep = _item("GRAPH", "GRAPH:downstream_layering", "TOPOLOGICAL_PATTERN", _text("Multi-Hop Layering Chain (", hops, " Hops)"),
                 _text("Fund trail traces through an extended layering path of ", hops, " hops across ", reached, " downstream beneficiary accounts."),
                 "HIGH", _metrics(max_downstream_hops=hops, downstream_accounts_count=reached), accounts=first(5), id_accounts=first(3), transactions=tx, position=4)
    return _few(F.when(c("has_cycle"), cycle), F.when(dev > 0, device), F.when(ip > 0, net), F.when(ratio >= fan_threshold, fan), F.when(hops >= 3, deep))


def graph_evidence(cases: DataFrame, fan_threshold: float = 3.0) -> DataFrame:
    """Cycles, shared devices and IPs, fan ratio and layering depth of the subject.

    A fan ratio is distinct over all transfers, at most 1: with the default threshold of
    3 the fan item never appears. ``downstream`` holds the first five reached accounts.
    """
    return _rows(cases, graph_items(fan_threshold))


# Wording of model evidence.
MODEL_TEXT = {
    "tabular_ml": ("TABULAR_ML", "Tabular ML Fraud Indicator (Prob: ", "Supervised gradient-boosted tabular model (", "fraud probability", " based on 57-dimensional feature schema."),
    "graph_ml": ("GRAPH_ML", "Graph Neural Network (GraphSAGE) Risk Indicator (Prob: ", "Inductive GraphSAGE GNN model (", "mule probability", " via multi-hop neighborhood representation."),
}


def ml_items(columns: list[str]) -> Column:
    items = []
    for prefix, (source, title, lead, name, tail) in MODEL_TEXT.items():
        if f"{prefix}_probability" not in columns:
            continue
        p, score, version = (F.col(f"{prefix}_{k}") for k in ("probability", "score", "version"))
        item = _item(source, F.concat(F.lit(f"{source}:"), version), "MODEL_PREDICTION", _text(title, _fixed(p * 100, 1), "%)"),
                     _text(lead, version, f") produced a {name} of ", _fixed(p * 100, 2), "% (risk score ", score, "/100)", tail),
                     F.when(p >= 0.85, "CRITICAL").when(p >= 0.65, "HIGH").otherwise("MEDIUM"),
                     _metrics(risk_score=score, fraud_probability=F.round(p, 4)), accounts=BASE_ACC(), transactions=BASE_TX())
        items.append(F.when(F.coalesce(F.col(f"{prefix}_available"), F.lit(False)) & ((p >= 0.5) | (score >= 50)), item))
    empty = F.when(F.lit(False), _item("TRANSACTION", "x", "MODEL_PREDICTION", "", "", "LOW", _metrics(), accounts=BASE_ACC(), transactions=BASE_TX()))
    return _few(*(items or [empty]))


def ml_evidence(cases: DataFrame) -> DataFrame:
    """An item per available model whose probability is at least 0.5 or score at least 50."""
    return _rows(cases, ml_items(cases.columns))


def fusion_items() -> Column:
    score, level = F.col("composite_risk_score"), F.col("risk_level")
    active = F.col("available_modalities")
    items = [_item("RISK_FUSION", f"RISK_FUSION:{FUSION_VERSION}", "RISK_FUSION_ASSESSMENT", _text("Risk Fusion Composite Score: ", _fixed(score, 1), "/100 (", level, ")"),
                   _text("Multi-modal Risk Fusion engine synthesized detection signals across ", F.size(active), " active modalities (", F.array_join(active, ", "),
                         ") under policy '", F.col("missing_signal_policy"), "'. Composite risk score: ", _fixed(score, 2), "/100."),
                   level, _metrics(composite_risk_score=score, normalized_risk=F.col("normalized_risk")), accounts=BASE_ACC(), transactions=BASE_TX())]
    for i, m in enumerate(MODALITIES, 1):
        part = F.element_at("contributions", m)
        points = part["weighted_score"] * 100.0
        item = _item("RISK_FUSION", f"RISK_FUSION:contribution_{m}", "RISK_FUSION_ASSESSMENT", _text(f"Significant Modality Contribution: {m.upper()} (+", _fixed(points, 1), " pts)"),
                     part["explanation"], F.when(points >= 30, "CRITICAL").when(points >= 20, "HIGH").otherwise("MEDIUM"),
                     _metrics(normalized_value=F.round(part["normalized_value"], 4), effective_weight=F.round(part["effective_weight"], 4), contribution_points=F.round(points, 2)),
                     accounts=BASE_ACC(), transactions=BASE_TX(), position=i)
        items.append(F.when(part["is_available"] & (points >= 15.0), item))
    return _few(*items)


def fusion_evidence(cases: DataFrame) -> DataFrame:
    """The composite score, and every available modality that gave at least 15 points."""
    return _rows(cases, fusion_items())


def amount_items(medium: float = 200_000.0, high: float = 500_000.0) -> Column:
    inr = F.concat(F.lit("₹"), money("amount"))
    item = _item("TRANSACTION", "TRANSACTION:large_amount", "TRANSACTION_CONTEXT", _text("Large High-Value Transfer (", inr, ")"),
                 _text("Transaction amount of ", inr, " ", F.col("currency"), " executed via ", F.col("channel"), " channel from ", F.col("sender_account"), " to ", F.col("receiver_account"), "."),
                 F.when(F.col("amount") >= high, "HIGH").otherwise("MEDIUM"), _metrics(amount=F.col("amount")), accounts=BASE_ACC(), transactions=BASE_TX(),
                 devices=_strings("device_id"), ips=_strings("ip_address"), times=F.array(iso("ts")))
    return _few(F.when(F.col("amount") >= medium, item))


def amount_evidence(cases: DataFrame, medium: float = 200_000.0, high: float = 500_000.0) -> DataFrame:
    return _rows(cases, amount_items(medium, high))


def case_items(columns: list[str]) -> Column:
    """Items of every collector whose inputs are among the ``columns`` of the case row, as one array."""
    has = set(columns)
    parts = [amount_items()]
    for needed, collector in (("matches", rule_items), ("burst_detected", temporal_items), ("has_cycle", graph_items), ("contributions", fusion_items)):
        if needed in has:
            parts.append(collector())
    if has & {"tabular_ml_probability", "graph_ml_probability"}:
        parts.append(ml_items(columns))
    return F.flatten(F.array_compact(F.array(*parts)))


def collect_evidence(cases: DataFrame) -> DataFrame:
    """Items of every collector whose inputs are present."""
    return _rows(cases, case_items(cases.columns))


def dedup_evidence(items: DataFrame) -> DataFrame:
    """Merge copies of a finding: same source, reference, category and accounts (or transfers, without accounts).

    Title, text and severity come from the most severe copy (the first of equals), ids
    and place from the first, references are united and sorted, later metrics replace
    earlier ones. Copies meet only as distinct references and per-metric maxima, which
    are combined before the shuffle; copies themselves are never collected. Findings without
    a copy, as a rule nearly all, are told by a count of 64-bit hashes and pass as they are
    (equal hashes of different findings are only grouped like copies, by their whole keys).
    """
    who = F.when(F.size("account_ids") > 0, F.col("account_ids")).otherwise(F.col("transaction_ids"))
    keyed = items.withColumn("_key", F.concat_ws(":", "source", "source_reference", "category", F.array_join(F.array_sort(who), ",")))
    key = ["case_id", "_key"]
    keyed = keyed.withColumn("_h", F.xxhash64(*key))
    again = cut(keyed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h"))
    columns = ["case_id", "position", "evidence_id", "category", "title", "description", "severity", "source", "source_reference", *REFS]
    passed = lambda df: df.select(*columns, F.coalesce("metrics", F.create_map().cast("map<string,double>")).alias("metrics"))
    if again.isEmpty():
        return passed(items)
    return passed(keyed.join(again, "_h", "left_anti")).unionByName(_merged(keyed.join(again, "_h", "left_semi"), key))


def _merged(keyed: DataFrame, key: list[str]) -> DataFrame:
    """One row for each ``key`` of the copies, as in ``dedup_evidence``."""
    shown = F.struct("title", "description", "severity")
    first = F.struct("evidence_id", "category", "source", "source_reference", *REFS)
    head = keyed.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.min("position").alias("position"),
        F.max_by(shown, F.struct(severity_rank("severity"), -F.col("position"))).alias("_s"), F.min_by(first, "position").alias("_f"))
    tagged = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("ref")))
    kinds = F.flatten(F.array(*[tagged(r) for r in REFS]))
    refs = keyed.select(*key, F.inline(kinds)).distinct().groupBy(*key).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("kind") == r, F.col("ref")))).alias(f"_u_{r}") for r in REFS])
    metrics = keyed.select(*key, "position", F.explode("metrics").alias("name", "value")).groupBy(*key, "name").agg(F.max_by("value", "position").alias("value"))
    metrics = metrics.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("metrics"))
    merged = head.join(refs, key, "left").join(metrics, key, "left")
    return merged.select(
        "case_id", "position", "_f.evidence_id", "_f.category", "_s.title", "_s.description", "_s.severity", "_f.source", "_f.source_reference",
        *[F.when(F.col("_n") > 1, F.col(f"_u_{r}")).otherwise(F.col(f"_f.{r}")).alias(r) for r in REFS],
        F.coalesce("metrics", F.create_map().cast("map<string,double>")).alias("metrics"))


def signal_strength(metrics: Column | str = "metrics") -> Column:
    m = F.col(metrics) if isinstance(metrics, str) else metrics
    return F.coalesce(*[F.try_element_at(m, F.lit(k)) * f for k, f in STRENGTH], F.lit(0.0))


def _priority(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, source), F.lit(0))


def rank_evidence(items: DataFrame) -> DataFrame:
    """``rank`` within the case: severity, source, strength, id."""
    w = Window.partitionBy("case_id").orderBy(F.desc(severity_rank("severity")), F.desc(_priority(F.col("source"))), F.desc(signal_strength()), "evidence_id")
    return items.withColumn("rank", F.row_number().over(w))


@dataclass(frozen=True)
class Ranked:
    """Cases with their ranked findings.

    ``alone`` holds the cases with an id of their own: their ``items``, in rank order, are made, ranked and
    read inside the row, so that no finding is shuffled. Case rows that share an id, or whose matches name a rule
    twice, are in ``again``, their findings merged and ranked as rows in ``found`` (both None without any).
    """

    alone: DataFrame
    again: DataFrame | None = None
    found: DataFrame | None = None

    def rows(self) -> DataFrame:
        """One row a finding."""
        own = self.alone.select("case_id", F.inline_outer("items")).filter("rank IS NOT NULL")
        return own if self.found is None else own.unionByName(self.found, allowMissingColumns=True)

    def each(self, inside: Callable[[DataFrame], DataFrame], rows: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """``inside`` of the cases with items, and ``rows`` of the findings and cases of the others."""
        own = inside(self.alone)
        return own if self.found is None else own.unionByName(rows(self.found, self.again))


def _ranked_items(items: str) -> Column:
    """The array ``items`` in the order of ``rank_evidence``, with ``rank``."""
    def place(i: Column, k: Column) -> Column:
        strength = signal_strength(i["metrics"])
        down = F.when(F.isnan(strength), F.lit(float("-inf"))).otherwise(-strength)
        return F.struct((-severity_rank(i["severity"])).alias("severity"), (-_priority(i["source"])).alias("source"), down.alias("strength"), i["evidence_id"].alias("id"), k.alias("k"))
    return F.transform(F.array_sort(F.transform(items, place)), lambda o, r: F.get(items, o["k"]).withField("rank", r + 1))


def ranked_cases(cases: DataFrame) -> Ranked:
    """Findings of all collectors with the copies of a case merged, in rank order.

    The collectors give a case row each finding once, so copies come from rows that share a case or from a rule
    matched twice. Such cases are told by a count of 64-bit hashes of their ids; all others never leave their row.
    """
    made = cases.withColumn("_own", F.filter(case_items(cases.columns), lambda i: i["source"].isin(list(SOURCE_PRIORITY)) & (F.length(F.trim(i["source_reference"])) > 0)))
    ranked = lambda df: df.withColumn("items", _ranked_items("_own")).drop("_own")
    codes = F.transform("matches", lambda m: m["rule_code"]) if "matches" in cases.columns else F.array()
    twice = F.coalesce(F.size(F.array_distinct(codes)) < F.size(codes), F.lit(False))
    h = F.xxhash64("case_id").alias("_h")
    again = cut(cases.select(h, twice.alias("_d")).groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("_d").alias("_d")).filter("_n > 1 OR _d").select("_h"))
    if again.isEmpty():
        return Ranked(ranked(made))
    made = made.withColumn("_h", h)
    shared = made.join(again, "_h", "left_semi").drop("_h")
    found = rank_evidence(dedup_evidence(_rows(shared, F.col("_own"))))
    return Ranked(ranked(made.join(again, "_h", "left_anti").drop("_h")), shared.drop("_own"), found)


def coverage(cases: DataFrame) -> DataFrame:
    """``source_coverage``: source to AVAILABLE, UNAVAILABLE or MISSING."""
    present = lambda c: F.when(F.col(c).isNotNull(), "AVAILABLE").otherwise("MISSING") if c in cases.columns else F.lit("MISSING")

    def model(prefix):
        c = f"{prefix}_available"
        if c not in cases.columns:
            return F.lit("MISSING")
        return F.when(F.col(c).isNull(), "MISSING").when(F.col(c), "AVAILABLE").otherwise("UNAVAILABLE")

    states = {"RULE": present("rule_score"), "TEMPORAL": present("burst_detected"), "GRAPH": present("has_cycle"), "TABULAR_ML": model("tabular_ml"),
              "GRAPH_ML": model("graph_ml"), "RISK_FUSION": present("composite_risk_score"), "TRANSACTION": present("transaction_id")}
    return cases.withColumn("source_coverage", F.create_map(*[x for k, v in states.items() for x in (F.lit(k), v)]))


SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]


ITEM = ["rank", "evidence_id", "category", "title", "description", "severity", "source", "source_reference", *REFS, "metrics"]


def packages(ranked: DataFrame | Ranked, cases: DataFrame | None = None) -> DataFrame:
    """One row per case: severity counts, total, items in rank order, and the summary. Cases without items are kept."""
    if isinstance(ranked, Ranked):
        return ranked.each(packaged, packages)
    # Maps cannot be compared, so the rank alone orders the (few) items.
    grouped = ranked.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*ITEM)), lambda a, b: a["rank"] - b["rank"]).alias("items"))
    return packaged(cases.join(grouped, "case_id", "left"))


def packaged(cases: DataFrame) -> DataFrame:
    """The packages of cases that hold their ``items``; nothing is shuffled."""
    defaults = {"composite_risk_score": F.lit(0.0), "risk_level": F.lit("LOW")}
    cases = cases.withColumns({k: v for k, v in defaults.items() if k not in cases.columns}) if not set(defaults) <= set(cases.columns) else cases
    kept = [c for c in ("case_id", "subject_id", "transaction_id", "composite_risk_score", "risk_level", "source_coverage", "unavailable_modalities", "contributions", "action_ids") if c in cases.columns]
    shown = F.when(F.size("items") > 0, F.transform("items", lambda i: F.struct(*[i[c].alias(c) for c in ITEM]))).alias("items")
    number = lambda s: F.size(F.filter("items", lambda i: i["severity"] == s))
    counts = {"total_evidence": F.size("items"), **{f"n_{s.lower()}": number(s) for s in SEVERITIES}}
    out = cases.select(*kept, shown).select(*kept, "items", *[F.when(F.col("items").isNull(), 0).otherwise(n).cast("bigint").alias(k) for k, n in counts.items()])
    out = out.fillna({"composite_risk_score": 0.0, "risk_level": "LOW"})
    return out.withColumn("evidence_summary", package_summary())


def package_summary() -> Column:
    """Header, severity breakdown, the four leading findings and the coverage line."""
    head = _text("Case ", F.col("case_id"), " for subject ", F.col("subject_id"), " evaluated with composite risk score ",
                 _fixed(F.col("composite_risk_score"), 2), "/100 (", F.col("risk_level"), ").")
    counts = F.array_compact(F.array(*[F.when(F.col(f"n_{s.lower()}") > 0, _text(F.col(f"n_{s.lower()}"), f" {s}")) for s in SEVERITIES]))
    some = F.col("total_evidence") > 0
    breakdown = F.when(some, _text("Total evidence items: ", F.col("total_evidence"), " (", F.array_join(counts, ", "), ").")).otherwise(
        "No suspicious forensic evidence items were detected across active analytical sources.")
    lines = F.transform(F.slice("items", 1, 4), lambda i: _text("- [", i["severity"], "] ", i["title"], ": ", i["description"]))
    findings = F.when(some, F.concat(F.lit("Key Forensic Findings:\n"), F.array_join(lines, "\n")))
    states = F.transform(F.array_sort(F.map_entries("source_coverage")), lambda e: _text(e["key"], " (", e["value"], ")"))
    return F.concat_ws("\n\n", head, breakdown, findings, _text("Analytical Coverage: ", F.array_join(states, ", "), "."))


def risk_drivers(cases: DataFrame, k: int = 3) -> DataFrame:
    """Top modalities with a positive weighted score, and the risk sentence."""
    entries = F.transform(F.map_entries("contributions"), lambda e: F.struct((-e["value"]["weighted_score"]).alias("neg"), e["key"].alias("modality")))
    top = F.slice(F.array_sort(F.filter(entries, lambda e: e["neg"] < 0)), 1, k)
    base = _text("Subject assessment indicates a ", F.col("risk_level"), " risk posture with an M10 composite risk score of ", _fixed(F.col("composite_risk_score"), 2), "/100.0.")
    # Rounded in double arithmetic, as the SQL does: 0.575 is 57.49999999999999 hundredths and thus 0.57.
    hundredths = lambda c: F.floor(c * 100.0 + 0.5) / 100.0
    named = F.array_join(F.transform(top, lambda e: _text(e["modality"], " (", _fixed(hundredths(-e["neg"]), 2), ")")), ", ")
    text = F.when(F.size(top) > 0, _text(base, " Primary detection drivers: ", named, ".")).otherwise(base)
    return cases.withColumn("risk_drivers", F.transform(top, lambda e: e["modality"])).withColumn("risk_summary", text)


# Theme of each category.
THEMES = {
    "CIRCULAR_ROUTING": "circular transaction routing", "SHARED_INFRASTRUCTURE": "shared device or network infrastructure",
    "TEMPORAL_ANOMALY": "temporal burst or rapid pass-through velocity", "TOPOLOGICAL_PATTERN": "high-degree structural network topology",
    "MODEL_PREDICTION": "predictive machine learning anomaly scores", "RULE_VIOLATION": "deterministic rule threshold triggers",
}


def themes(packaged: DataFrame) -> DataFrame:
    """``themes`` in rank order of their first item, and the case narrative."""
    table = F.create_map(*[F.lit(x) for kv in THEMES.items() for x in kv])
    names = F.array_compact(F.transform(F.array_distinct(F.transform("items", lambda i: i["category"])), lambda c: F.try_element_at(table, c)))
    df = packaged.withColumn("themes", F.coalesce(names, F.array().cast("array<string>")))
    n = F.size("themes")
    listed = (F.when(n == 0, "correlated forensic anomalies").when(n == 1, F.get("themes", F.lit(0)))
              .when(n == 2, F.array_join("themes", " and "))
              .otherwise(F.concat(F.array_join(F.slice("themes", F.lit(1), n - 1), ", "), F.lit(", and "), F.try_element_at("themes", F.lit(-1)))))
    who = F.coalesce(_text("for subject '", filled("subject_id"), "'"), F.lit("for the evaluated subject"))
    score = _text(F.col("risk_level"), " risk profile (", _fixed(F.col("composite_risk_score"), 2), "/100.0)")
    none = _text("Case analysis ", who, " establishes a ", score, ". No supporting forensic evidence items were recorded in the evidence package for this evaluation.")
    text = _text("Case analysis ", who, " reflects an aggregate ", score, " supported by ", F.col("total_evidence"), " forensic evidence item(s). Key analytical signals demonstrate ",
                 listed, ". Investigative review is recommended to corroborate behavioral patterns across linked entity networks.")
    return df.withColumn("narrative", F.when(F.col("total_evidence") > 0, text).otherwise(none))


def key_findings(ranked: DataFrame | Ranked) -> DataFrame:
    rows = ranked.rows() if isinstance(ranked, Ranked) else ranked
    return rows.select("case_id", "rank", F.concat_ws(": ", "title", "description").alias("finding"), "evidence_id", "severity", "category", "source", "metrics")


def _has(field: Column, *words: str) -> Column:
    return any_of([field.contains(w) for w in words])


def _fields(at: Callable[[str], Column] = F.col):
    """Lower-case texts of an item, whose fields ``at`` gives, and whether it is about shared devices or networks."""
    ref, title, text = (F.lower(at(c)) for c in ("source_reference", "title", "description"))
    shared = at("category") == "SHARED_INFRASTRUCTURE"
    return ref, title, text, shared


def _lowered(items: str) -> Column:
    """The items with what actions and questions look at, texts in lower case."""
    return F.transform(items, lambda i: F.struct(*[i[c].alias(c) for c in ("rank", "evidence_id", "category", "device_ids", "ip_addresses")],
                                                 *[F.lower(i[c]).alias(c) for c in ("source_reference", "title", "description")]))


# Action archetypes (id, title, description, priority, type).
ACTIONS = {
    "shared_device": ("ACT-DEV-001", "Review shared device cluster", "Inspect accounts and authentication events associated with the shared hardware fingerprint(s).", "HIGH", "DEVICE_VERIFICATION"),
    "shared_ip": ("ACT-NET-001", "Review shared IP network entities", "Verify session logs and counterparty accounts originating from the flagged IP address(es).", "MEDIUM", "COUNTERPARTY_VERIFICATION"),
    "circular_routing": ("ACT-CYC-001", "Trace circular fund routing cycle", "Examine intermediary accounts, timing intervals, and balance retention in the detected circular transaction loop.", "CRITICAL", "TOPOLOGY_ANALYSIS"),
    "rapid_passthrough": ("ACT-TEM-001", "Audit rapid pass-through sequence", "Analyze transaction timestamps and amounts to verify inbound deposit and rapid outbound disbursement intervals.", "HIGH", "TEMPORAL_AUDIT"),
    "high_velocity": ("ACT-VEL-001", "Examine high-velocity transaction burst", "Evaluate transaction volume and frequency spikes against established baseline historical activity.", "HIGH", "TEMPORAL_AUDIT"),
    "fan_in": ("ACT-TOP-001", "Analyze fan-in transaction concentration", "Examine source accounts and transfer rationales contributing to aggregated incoming payment flows.", "MEDIUM", "TOPOLOGY_ANALYSIS"),
    "fan_out": ("ACT-TOP-002", "Inspect fan-out disbursement distribution", "Review destination beneficiaries receiving rapid dispersed outbound transfers.", "MEDIUM", "TOPOLOGY_ANALYSIS"),
    "ml_prediction": ("ACT-MOD-001", "Review machine learning anomaly signals", "Inspect predictive model feature deviations and topological embedding scores flagged by automated classifiers.", "MEDIUM", "MODEL_ANOMALY_REVIEW"),
    "rule_violation": ("ACT-RUL-001", "Verify triggered rule criteria", "Validate transaction records against triggered rule thresholds and perimeter constraints.", "MEDIUM", "INVESTIGATIVE_REVIEW"),
    "baseline": ("ACT-GEN-001", "Conduct baseline account audit", "Review subject profile data, KYC documentation, and recent transaction records.", "LOW", "GENERAL_AUDIT"),
}


def _asks(at: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """Which actions an item asks for, but for that of a rule match; ``at`` gives its fields."""
    ref, title, text, shared = _fields(at)
    rapid = _has(ref, "pass_through", "r003") | _has(title, "rapid pass-through") | _has(text, "pass-through")
    return {
        "shared_device": shared & ((F.size(at("device_ids")) > 0) | _has(ref, "device") | _has(title, "device")),
        "shared_ip": shared & ((F.size(at("ip_addresses")) > 0) | _has(ref, "ip") | _has(title, "ip")),
        "circular_routing": (at("category") == "CIRCULAR_ROUTING") | _has(ref, "cycle") | _has(title, "circular") | _has(text, "cycle"),
        "rapid_passthrough": rapid,
        "high_velocity": ((at("category") == "TEMPORAL_ANOMALY") & ~rapid) | _has(ref, "velocity") | _has(title, "burst", "velocity"),
        "fan_in": _has(ref, "fan_in", "in_degree") | _has(title, "fan-in") | _has(text, "fan-in"),
        "fan_out": _has(ref, "fan_out", "out_degree") | _has(title, "fan-out") | _has(text, "fan-out"),
        "ml_prediction": at("category") == "MODEL_PREDICTION",
    }


STRONGER = ("circular_routing", "rapid_passthrough", "shared_device")


def case_actions(cases: DataFrame) -> DataFrame:
    """``actions`` of cases that hold their ``items``; nothing is shuffled."""
    each = with_actions(cases).select("case_id", F.posexplode_outer("_actions").alias("_p", "_a"))
    return each.select("case_id", "_a.*", (F.col("_p") + 1).alias("position"))


def with_actions(cases: DataFrame) -> DataFrame:
    """``_actions``: the actions that the ``items`` of a case ask for, in priority order."""
    low = cases.withColumn("_low", _lowered("items"))
    flags = lambda i: {k: F.coalesce(v, F.lit(False)) for k, v in _asks(lambda c: i[c]).items()}
    asks = F.transform("_low", lambda i: F.struct(i["rank"].alias("rank"), i["evidence_id"].alias("evidence_id"), (i["category"] == "RULE_VIOLATION").alias("rule"), *[v.alias(k) for k, v in flags(i).items()]))
    df = low.withColumn("_asks", asks).drop("_low")
    # A rule item asks for its own action only while no stronger action has appeared at or above its rank.
    strong = F.array_min(F.transform(F.filter("_asks", lambda i: i[STRONGER[0]] | i[STRONGER[1]] | i[STRONGER[2]]), lambda i: i["rank"]))
    df = df.withColumn("_strong", F.coalesce(strong, F.lit(2**31 - 1)))
    ids = lambda keep: F.array_sort(F.transform(F.filter("_asks", keep), lambda i: i["evidence_id"]))
    names = ["action_id", "title", "description", "priority", "action_type"]

    def action(k: str) -> Column:
        keep = (lambda i: i["rule"] & (i["rank"] < F.col("_strong"))) if k == "rule_violation" else lambda i: i[k]
        found = F.transform("items", lambda i: i["evidence_id"]) if k == "baseline" else ids(keep)
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, ACTIONS[k])], found.alias("evidence_ids"))

    order = sorted((k for k in ACTIONS if k != "baseline"), key=lambda k: (-SEVERITIES[::-1].index(ACTIONS[k][3]), ACTIONS[k][0]))
    df = df.withColumn("_hits", F.filter(F.array(*[action(k) for k in order]), lambda a: F.size(a["evidence_ids"]) > 0))
    return df.withColumn("_actions", F.when(F.size("_hits") > 0, F.col("_hits")).otherwise(F.array(action("baseline")))).drop("_asks", "_strong", "_hits")


def actions(ranked: DataFrame | Ranked, cases: DataFrame | None = None) -> DataFrame:
    """Suggested actions per case with their evidence ids, in priority order; a baseline action when none applies."""
    if isinstance(ranked, Ranked):
        return ranked.each(case_actions, actions)
    df = ranked.withColumns({f"_{k}": v for k, v in _asks().items()})
    # A rule item asks for its own action only while no stronger action has appeared at or above its rank.
    upto = Window.partitionBy("case_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stronger = F.max((F.col("_circular_routing") | F.col("_rapid_passthrough") | F.col("_shared_device")).cast("int")).over(upto)
    df = df.withColumn("_rule_violation", (F.col("category") == "RULE_VIOLATION") & (stronger == 0))
    found = [k for k in ACTIONS if k != "baseline"]
    # The few items of a case in one aggregate, placed as the ranking left them.
    per = df.groupBy("case_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col(f"_{k}"), F.col("evidence_id")))).alias(f"_{k}") for k in found], F.collect_list(F.struct("rank", "evidence_id")).alias("_i"))
    given = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("_cases"))
    hits = F.filter(F.array(*[F.struct(F.lit(k).alias("archetype"), F.col(f"_{k}").alias("evidence_ids")) for k in found]), lambda a: F.size(a["evidence_ids"]) > 0)
    every = F.coalesce(F.transform(F.array_sort("_i"), lambda i: i["evidence_id"]), F.array().cast("array<string>"))
    idle = F.array_repeat(F.struct(F.lit("baseline").alias("archetype"), every.alias("evidence_ids")), F.coalesce("_cases", F.lit(0)).cast("int"))
    out = given.join(per, "case_id", "full").withColumn("_hits", hits).select("case_id", F.inline(F.when(F.size("_hits") > 0, F.col("_hits")).otherwise(idle)))
    table = F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.struct(*[F.lit(s) for s in v]))])
    out = out.withColumn("_a", F.element_at(table, F.col("archetype")))
    names = ["action_id", "title", "description", "priority", "action_type"]
    out = out.select("case_id", *[F.col("_a")[f"col{i}"].alias(n) for i, n in enumerate(names, 1)], "evidence_ids")
    order = Window.partitionBy("case_id").orderBy(F.desc(severity_rank("priority")), "action_id")
    return out.withColumn("position", F.row_number().over(order))


def packages_with_actions(ranked: Ranked) -> DataFrame:
    """``packages`` with ``action_ids``, the sorted ids of a case's actions, found inside the row: packages are not joined with their actions."""
    def inside(cases: DataFrame) -> DataFrame:
        return packaged(with_actions(cases).withColumn("action_ids", F.array_sort(F.transform("_actions", lambda a: a["action_id"]))))

    def rows(found: DataFrame, cases: DataFrame) -> DataFrame:
        acts = actions(found, cases).groupBy("case_id").agg(F.array_sort(F.collect_list("action_id")).alias("action_ids"))
        return packages(found, cases).join(acts, "case_id")

    return ranked.each(inside, rows)


def _templates(at: Callable[[str], Column] = F.col) -> dict[str, tuple[Column, Column]]:
    """When an item raises a question, and the question; ``at`` gives the item's fields."""
    ref, title, text, shared = _fields(at)
    named = lambda c: F.when(F.size(at(c)) > 0, _text(" (", F.array_join(at(c), ", "), ")")).otherwise("")
    # Question templates.
    return {
        "device": (shared & ((F.size(at("device_ids")) > 0) | _has(ref, "device")), _text("Which other accounts have authenticated using the identified device ID", named("device_ids"), "?")),
        "ip": (shared & ((F.size(at("ip_addresses")) > 0) | _has(ref, "ip")), _text("Are there concurrent active sessions or proxy/VPN signatures linked to the shared IP", named("ip_addresses"), "?")),
        "cycle": ((at("category") == "CIRCULAR_ROUTING") | _has(ref, "cycle") | _has(title, "circular"), F.lit("What accounts and counterparties participate in the detected circular transaction flow?")),
        "pass": (_has(ref, "pass_through") | _has(title, "pass-through") | _has(text, "pass-through"), F.lit("What is the exact time delta between inbound fund credits and outbound debits across the flagged sequence?")),
        "fan_in": (_has(ref, "fan_in", "in_degree") | _has(title, "fan-in"), F.lit("What is the commercial or personal relationship connecting the multiple originators in the fan-in pattern?")),
        "fan_out": (_has(ref, "fan_out", "out_degree") | _has(title, "fan-out"), F.lit("Are the destination accounts in the outbound distribution cluster newly activated or historically linked?")),
        "velocity": (_has(ref, "velocity") | _has(title, "burst", "velocity"), F.lit("Does the burst in transaction velocity coincide with recent authentication changes or credential updates?")),
    }


def _answered(n: Column) -> Column:
    """The sorted questions ``_q``, or the fallback of a case with ``n`` items."""
    fallback = F.when(n > 0, "Do supplementary behavioral logs or device records exist for the transactions in this package?").otherwise(
        "Are additional transaction logs or counterparty KYC records available for this subject?")
    return F.when(F.size("_q") > 0, F.col("_q")).otherwise(F.array(fallback)).alias("questions")


def case_questions(cases: DataFrame) -> DataFrame:
    """``questions`` of cases that hold their ``items``; nothing is shuffled."""
    low = cases.select("case_id", "items", _lowered("items").alias("_low"))
    names = list(_templates())

    def first(k: str) -> Column:
        raised = F.filter("_low", lambda i: _templates(lambda c: i[c])[k][0])
        return F.get(F.transform(raised, lambda i: _templates(lambda c: i[c])[k][1]), F.lit(0))

    return low.withColumn("_q", F.array_sort(_few(*[first(k) for k in names]))).select("case_id", _answered(F.size("items")))


def questions(ranked: DataFrame | Ranked, cases: DataFrame | None = None) -> DataFrame:
    """Follow-up questions per case, sorted; the first matching item supplies device and IP ids."""
    if isinstance(ranked, Ranked):
        return ranked.each(case_questions, questions)
    per = ranked.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"), *[F.min_by(q, F.when(cond, F.col("rank"))).alias(f"_{k}") for k, (cond, q) in _templates().items()])
    per = per.select("case_id", "_n", F.array_sort(F.array_compact(F.array(*[F.col(f"_{k}") for k in _templates()]))).alias("_q"))
    return cases.select("case_id").join(per, "case_id", "left").select("case_id", _answered(F.col("_n")))


def limitations(packaged: DataFrame) -> DataFrame:
    """Disclosures: the standing ones, then missing sources and modalities."""
    # Standing statements.
    standing = [
        "Investigation guidance and executive narrative are generated deterministically via structured templates without generative AI or external LLM inference.",
        "Risk level and composite score are inherited directly from M10 Risk Fusion without recalculation or scoring drift.",
        "All key findings and recommended actions strictly reference verified evidence items from the M11 EvidencePackage.",
    ]
    empty = F.when(F.col("total_evidence") == 0, F.array(F.lit("No forensic evidence items were provided in the evaluation context."))).otherwise(F.array().cast("array<string>"))
    gaps = F.filter(F.array_sort(F.map_entries("source_coverage")), lambda e: e["value"].isin("UNAVAILABLE", "MISSING"))
    sources = F.transform(gaps, lambda e: _text("Analytical source '", e["key"], "' was marked as ", e["value"], " during evidence collection."))
    modalities = F.transform(F.array_sort("unavailable_modalities"), lambda m: _text("Risk fusion modality '", m, "' was unavailable during composite risk calculation."))
    return packaged.select("case_id", F.concat(F.array(*[F.lit(s) for s in standing]), empty, sources, modalities).alias("limitations"))
