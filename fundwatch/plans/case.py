"""The full case analysis: rules, temporal, graph, models, fusion, evidence and summary, for all cases at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.session import cut
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import temporal as P
from ..operators.context import rule_context
from ..operators.fusion import WEIGHTS, fuse, signals
from ..operators.rules import evaluate_rules
from ..sources.ingest import build_graph


@dataclass(frozen=True)
class CaseResult:
    cases: DataFrame
    evidence: DataFrame
    packages: DataFrame
    actions: DataFrame
    questions: DataFrame
    limitations: DataFrame


def open_cases(tx: DataFrame, min_amount: float) -> DataFrame:
    """One case per transfer of at least ``min_amount``; the sender is the subject."""
    large = tx.filter(F.col("amount") >= min_amount)
    return large.withColumns({"case_id": E.case_id(F.col("transaction_id"), F.col("sender_account")), "subject_id": F.col("sender_account")})


def _contributing(tx: DataFrame, subjects: DataFrame) -> DataFrame:
    """Ids behind the temporal findings of each subject: pass-through, burst and last hour.

    These lists are part of an evidence item, so they are arrays, but only of subjects
    under review and only of findings that become evidence.
    """
    leg = P.legs(tx, subjects)
    ids = lambda df, name: df.groupBy(F.col("account").alias("subject_id")).agg(F.array_sort(F.collect_set("transaction_id")).alias(name))
    moved = P.pass_through(tx, focal=subjects).select("account", F.explode(F.array("incoming_id", "outgoing_id")).alias("transaction_id"))
    hour = P.window_members(leg, {"1h": 3600})
    busy = hour.groupBy("account").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 5)
    out = subjects.select(F.col("account").alias("subject_id"))
    for df, name in ((moved, "pass_ids"), (P.burst_members(leg, P.burst(leg)), "burst_ids"), (hour.join(busy, "account", "left_semi"), "hour_ids")):
        out = out.join(ids(df, name), "subject_id", "left")
    return out


def case_features(
    tx: DataFrame, cases: DataFrame, accounts: DataFrame | None = None, *, hops: int = 2, max_depth: int = 5, list_depth: int | None = None,
    tabular: DataFrame | None = None, graph_ml: DataFrame | None = None, lists: bool = True,
) -> DataFrame:
    """Case rows joined with rule matches, temporal, graph and model results.

    Only transfers that touch a party of a case enter the windows. ``tabular`` is keyed by
    transaction, ``graph_ml`` by account. Without ``lists`` the names and ids that only evidence
    items hold are left out, for scores.
    """
    cases = cut(cases)
    parties = cut(cases.select(F.explode(F.array("sender_account", "receiver_account")).alias("account")).distinct())
    subjects = cut(cases.select(F.col("subject_id").alias("account")).distinct())
    near = tx.join(parties.withColumnRenamed("account", "sender_account"), "sender_account", "left_semi").unionByName(
        tx.join(parties.withColumnRenamed("account", "receiver_account"), "receiver_account", "left_semi")
        .join(parties.withColumnRenamed("account", "sender_account"), "sender_account", "left_anti"))
    near = cut(near)
    nodes, edges = build_graph(tx)
    graph = G.graph_features(nodes, edges, subjects, hops, max_depth, list_depth, lists)
    circular = graph.select("account", F.col("has_cycle").alias("in_cycle"))
    judged = evaluate_rules(rule_context(near, accounts, circular, population=tx))
    judged = judged.join(cases.select("transaction_id"), "transaction_id", "left_semi").select(
        "transaction_id", "matches", "rule_score", "highest_severity", F.size("matches").alias("rule_count"))
    out = cases.join(judged, "transaction_id", "left")
    for features in (P.temporal_features(near, subjects), graph.drop("evidence_signals", "in_graph")):
        out = out.join(features.withColumnRenamed("account", "subject_id"), "subject_id", "left")
    if lists:
        out = out.join(_contributing(near, subjects), "subject_id", "left")
    if tabular is not None:
        out = out.join(tabular, "transaction_id", "left")
    if graph_ml is not None:
        out = out.join(graph_ml.withColumnRenamed("account", "subject_id"), "subject_id", "left")
    return out


def case_pipeline(
    tx: DataFrame, cases: DataFrame, accounts: DataFrame | None = None, *, weights=WEIGHTS, policy: str = "renormalize_available",
    hops: int = 2, max_depth: int = 5, list_depth: int | None = None, tabular: DataFrame | None = None, graph_ml: DataFrame | None = None,
) -> CaseResult:
    """Evidence packages, actions, questions and limitations of every case."""
    features = case_features(tx, cases, accounts, hops=hops, max_depth=max_depth, list_depth=list_depth, tabular=tabular, graph_ml=graph_ml)
    scored = cut(E.coverage(fuse(signals(features), weights, policy)))
    ranked = E.ranked_cases(scored)
    packaged = E.risk_drivers(E.themes(E.packages_with_actions(ranked)))
    return CaseResult(scored, ranked.rows(), packaged, E.actions(ranked), E.questions(ranked), E.limitations(packaged))
