"""Five detection signals normalised to [0, 1] and fused into one score and tier."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import clamp
from ..schema import MODALITIES

# Severity floors, modality weights, tier limits and the neutral baseline.
SEVERITY_FLOOR = {"CRITICAL": 0.85, "HIGH": 0.65, "MEDIUM": 0.40, "LOW": 0.0}
WEIGHTS = {"rules": 0.25, "temporal": 0.15, "graph": 0.20, "tabular_ml": 0.25, "graph_ml": 0.15}
THRESHOLDS = (30.0, 65.0, 85.0)
BASELINE = 0.20
POLICIES = ("renormalize_available", "zero_contribution", "penalty_baseline")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _flag(c: str) -> Column:
    return F.initcap(F.col(c).cast("string"))


def _fixed(c: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", c.cast("double"))


def _signal(available: Column, value: Column, summary: Column, missing: Column | str = "missing") -> Column:
    missing = F.lit(missing) if isinstance(missing, str) else missing
    available = F.coalesce(available, F.lit(False))
    return F.struct(
        F.when(available, F.round(value, 4)).otherwise(F.lit(0.0)).alias("value"),
        available.alias("is_available"),
        F.when(available, F.lit("available")).otherwise(missing).alias("status"),
        F.when(available, summary).alias("summary"),
    )


def rules_signal() -> Column:
    """Score over 100, not below the floor of the highest severity."""
    floors = F.create_map(*[F.lit(x) for kv in SEVERITY_FLOOR.items() for x in kv])
    floor = F.coalesce(F.try_element_at(floors, F.col("highest_severity")), F.lit(0.0))
    value = F.least(F.lit(1.0), F.greatest(clamp(F.col("rule_score") / 100.0), floor))
    text = _text("delta=", F.col("rule_score"), ", severity=", F.col("highest_severity"), ", rules=", F.col("rule_count"))
    return _signal(F.col("rule_score").isNotNull(), value, text)


def temporal_signal() -> Column:
    burst = F.when(F.col("burst_detected"), 1.0).otherwise(0.0)
    rapid = F.when(F.col("rapid_in_out_detected"), clamp(F.col("rapid_in_out_ratio"))).otherwise(0.0)
    value = 0.35 * burst + 0.35 * rapid + 0.15 * clamp(F.col("n_1h") / 10.0) + 0.15 * clamp(F.col("temporal_concentration"))
    text = _text("burst=", _flag("burst_detected"), ", rapid=", _flag("rapid_in_out_detected"), ", tx_1h=", F.col("n_1h"))
    return _signal(F.col("burst_detected").isNotNull(), clamp(value), text)


def graph_signal() -> Column:
    shared = clamp((F.col("shared_device_count") * 0.6 + F.col("shared_ip_count") * 0.4) / 3.0)
    fan = clamp(F.greatest("fan_in_ratio", "fan_out_ratio"))
    value = 0.35 * F.when(F.col("has_cycle"), 1.0).otherwise(0.0) + 0.35 * shared + 0.15 * fan + 0.15 * clamp(F.col("neighbourhood_density"))
    text = _text("cycle=", _flag("has_cycle"), ", shared_dev=", F.col("shared_device_count"), ", shared_ip=", F.col("shared_ip_count"))
    return _signal(F.col("has_cycle").isNotNull(), clamp(value), text)


def model_signal(prefix: str) -> Column:
    """From ``<prefix>_probability``, ``_score``, ``_version`` and ``_available``; null means no prediction."""
    p = clamp(F.col(f"{prefix}_probability"))
    text = _text("proba=", _fixed(p, 4), ", score=", F.col(f"{prefix}_score"), ", version=", F.col(f"{prefix}_version"))
    missing = F.when(F.col(f"{prefix}_available").isNull(), "missing").otherwise("model_unavailable")
    return _signal(F.col(f"{prefix}_available"), p, text, missing)


INPUTS = {
    "rules": {"rule_score": "int", "highest_severity": "string", "rule_count": "int"},
    "temporal": {"burst_detected": "boolean", "rapid_in_out_detected": "boolean", "rapid_in_out_ratio": "double", "n_1h": "long", "temporal_concentration": "double"},
    "graph": {"has_cycle": "boolean", "shared_device_count": "long", "shared_ip_count": "long", "fan_in_ratio": "double", "fan_out_ratio": "double", "neighbourhood_density": "double"},
    "tabular_ml": {f"tabular_ml_{k}": t for k, t in (("probability", "double"), ("score", "int"), ("version", "string"), ("available", "boolean"))},
    "graph_ml": {f"graph_ml_{k}": t for k, t in (("probability", "double"), ("score", "int"), ("version", "string"), ("available", "boolean"))},
}


def signals(df: DataFrame) -> DataFrame:
    """Add ``signals``: modality to struct(value, is_available, status, summary).

    Columns of a modality that ``df`` lacks, or that are null, make it unavailable.
    """
    absent = {c: F.lit(None).cast(t) for cols in INPUTS.values() for c, t in cols.items() if c not in df.columns}
    made = {"rules": rules_signal(), "temporal": temporal_signal(), "graph": graph_signal(),
            "tabular_ml": model_signal("tabular_ml"), "graph_ml": model_signal("graph_ml")}
    full = df.withColumns(absent) if absent else df
    pairs = [x for m in MODALITIES for x in (F.lit(m), made[m])]
    return full.withColumn("signals", F.create_map(*pairs)).drop(*absent)


def normalized_weights(weights: Mapping[str, float] = WEIGHTS) -> dict[str, float]:
    """Weights that sum to one; bad values are refused before any job starts."""
    if set(weights) != set(MODALITIES):
        raise ValueError(f"weights needed for {MODALITIES}")
    for name, w in weights.items():
        if not isinstance(w, (int, float)) or not math.isfinite(w) or w < 0:
            raise ValueError(f"weight of {name} must be a finite number of at least 0, got {w!r}")
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must not all be zero")
    return {m: weights[m] / total for m in MODALITIES}


def check_thresholds(limits: Sequence[float]) -> tuple[float, float, float]:
    low, medium, high = limits
    if not all(math.isfinite(x) and 0 < x < 100 for x in limits) or not low < medium < high:
        raise ValueError(f"thresholds must increase strictly inside (0, 100), got {limits}")
    return low, medium, high


def tier(score: Column, limits: Sequence[float] = THRESHOLDS) -> Column:
    low, medium, high = check_thresholds(limits)
    s = clamp(score, 0.0, 100.0)
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(bad | (s < low), "LOW").when(s < medium, "MEDIUM").when(s < high, "HIGH").otherwise("CRITICAL")


def fuse(
    df: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    policy: str = "renormalize_available",
    thresholds: Sequence[float] = THRESHOLDS,
) -> DataFrame:
    """Score, tier and contribution of each modality, from the ``signals`` map. No shuffle."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    w = normalized_weights(weights)
    sig = {m: F.element_at("signals", m) for m in MODALITIES}
    on = {m: sig[m]["is_available"] for m in MODALITIES}
    names = F.array(*[F.lit(m) for m in MODALITIES])
    pool = sum((F.when(on[m], F.lit(w[m])).otherwise(0.0) for m in MODALITIES), F.lit(0.0))
    if policy == "renormalize_available":
        df = df.withColumn("_pool", pool)
        weight = {m: F.when(on[m] & (F.col("_pool") > 0), w[m] / F.col("_pool")).otherwise(F.lit(0.0)) for m in MODALITIES}
    else:
        df = df.withColumn("_pool", F.lit(1.0))
        weight = {m: F.lit(w[m]) for m in MODALITIES}
    absent = BASELINE if policy == "penalty_baseline" else 0.0
    note = "Neutral Baseline 0.20" if policy == "penalty_baseline" else "Zero Contribution"

    def contribution(m: str) -> Column:
        value = F.when(on[m], sig[m]["value"]).otherwise(F.lit(absent))
        part = weight[m] * value
        status = F.when(on[m], _text("Evaluated (", sig[m]["summary"], ")")).otherwise(_text("Unavailable (", sig[m]["status"], f") -> {note}"))
        text = _text(f"{m.upper()}: normalized=", _fixed(value, 4), ", effective_weight=", _fixed(weight[m], 4), f" (configured={w[m]:.4f}) -> contribution=",
                     _fixed(part, 4), ". Status: ", status)
        return F.struct(value.alias("normalized_value"), F.lit(w[m]).alias("configured_weight"), weight[m].alias("effective_weight"),
                        part.alias("contribution"), F.round(part, 6).alias("weighted_score"), on[m].alias("is_available"), text.alias("explanation"))

    out = df.withColumn("contributions", F.create_map(*[x for m in MODALITIES for x in (F.lit(m), contribution(m))])).drop("_pool")
    total = sum((F.element_at("contributions", m)["contribution"] for m in MODALITIES), F.lit(0.0))
    out = out.withColumn("_risk", clamp(total))
    return out.select(
        *[c for c in out.columns if c != "_risk"],
        F.round(F.col("_risk") * 100.0, 2).alias("composite_risk_score"),
        F.round("_risk", 4).alias("normalized_risk"),
        tier(F.round(F.col("_risk") * 100.0, 2), thresholds).alias("risk_level"),
        F.filter(names, lambda m: F.element_at("signals", m)["is_available"]).alias("available_modalities"),
        F.filter(names, lambda m: ~F.element_at("signals", m)["is_available"]).alias("unavailable_modalities"),
        F.lit(policy).alias("missing_signal_policy"),
    )
