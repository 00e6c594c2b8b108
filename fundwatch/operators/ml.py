"""Training, scoring, metrics and simple scores on the tabular features."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import clamp
from ..functions.timeline import MONEY_SCALE, money_units
from .features import FEATURES, feature_vector
from .selection import kth_smallest

# Features, weights and bias of the linear risk score.
LINEAR_WEIGHTS = [25.0, 30.0, 20.0, 15.0, 10.0, 10.0, 12.0, 8.0]
LINEAR_BIAS = 5.0


def balanced_weights(df: DataFrame, label: str = "label", positive: float | None = None) -> DataFrame:
    """``weight``: classes balanced, or ``positive`` for the positive class (neg/pos by default in boosting)."""
    pos, n = df.agg(F.sum(label), F.count(F.lit(1))).first()
    pos = pos or 0.0
    if positive is None:
        up, down = (n / (2 * pos) if pos else 1.0), (n / (2 * (n - pos)) if n > pos else 1.0)
    else:
        up, down = positive, 1.0
    return df.withColumn("weight", F.when(F.col(label) == 1, float(up)).otherwise(float(down)))


def _vector(df: DataFrame, columns: list[str]) -> DataFrame:
    return df if "features" in df.columns else feature_vector(df, columns)


def fit_rf_regressor(df: DataFrame, columns: list[str] = FEATURES, label: str = "label", trees: int = 100, depth: int = 15, seed: int = 42):
    return RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(_vector(df, columns))


def fit_rf_classifier(df: DataFrame, columns: list[str] = FEATURES, label: str = "label", trees: int = 100, depth: int = 15, seed: int = 42):
    data = balanced_weights(_vector(df, columns), label)
    return RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(data)


def fit_gbt(df: DataFrame, kind: str, columns: list[str] = FEATURES, label: str = "label", rounds: int = 50, depth: int = 5, step: float = 0.1, seed: int = 42):
    """Boosted trees; the classifier weighs positives by neg/pos."""
    data = _vector(df, columns)
    if kind == "regressor":
        return GBTRegressor(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed).fit(data)
    pos, n = data.agg(F.sum(label), F.count(F.lit(1))).first()
    data = balanced_weights(data, label, positive=float((n - pos) / pos) if pos else 1.0)
    return GBTClassifier(labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed).fit(data)


def grid_search(df: DataFrame, estimator, grid: dict[str, list], metric: str, folds: int = 3, label: str = "label", columns: list[str] = FEATURES, parallelism: int = 4):
    """Cross-validated grid over parameter names, by ``r2`` or ``f1``."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(estimator, name), values)
    judge = RegressionEvaluator(labelCol=label, metricName=metric) if metric in ("r2", "rmse", "mae") else MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=judge, numFolds=folds, parallelism=parallelism, seed=42)
    return cv.fit(_vector(df, columns))


def linear_inputs(df: DataFrame) -> list[Column]:
    """The eight scaled and capped inputs of the small models."""
    c = F.col
    return [c("amount") / 50000.0, c("user_risk_score") / 100.0, c("device_risk_score") / 100.0, c("network_risk_score") / 100.0, c("is_vpn_or_proxy"),
            c("is_rooted_or_emulator"), F.least(F.lit(1.0), c("velocity_l6h") / 20.0), F.least(F.lit(2.0), c("amount_deviation_ratio"))]


def with_linear_inputs(df: DataFrame) -> DataFrame:
    return df.withColumns({f"x{i}": x for i, x in enumerate(linear_inputs(df))})


def fit_logistic(df: DataFrame, label: str = "label", iterations: int = 300):
    data = feature_vector(with_linear_inputs(df), [f"x{i}" for i in range(8)])
    return LogisticRegression(labelCol=label, maxIter=iterations).fit(data)


def linear_risk(df: DataFrame, weights: list[float] = LINEAR_WEIGHTS, bias: float = LINEAR_BIAS) -> DataFrame:
    total = sum((x * w for x, w in zip(linear_inputs(df), weights)), F.lit(0.0)) + bias
    return df.withColumn("linear_risk", clamp(total, 0.0, 100.0))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", probability: str | None = None) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 and positive rate in one pass; 0 where undefined.

    With ``probability`` also the areas under the ROC and precision-recall curves.
    """
    y, p = F.col(label) == 1, F.col(prediction) == 1
    c = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"), F.count(F.lit(1)).alias("n"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = c.withColumns({"accuracy": ratio(tp + F.col("tn"), F.col("n")), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "positive_rate": ratio(tp + fn, F.col("n"))})
    out = out.withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
    if probability is not None:
        scored = df.select(F.col(label).cast("double").alias("label"), F.col(probability).alias("rawPrediction"))
        two = scored.agg(F.count_distinct("label")).first()[0] > 1
        for metric, name in (("areaUnderROC", "roc_auc"), ("areaUnderPR", "pr_auc")):
            out = out.withColumn(name, F.lit(float(BinaryClassificationEvaluator(metricName=metric).evaluate(scored)) if two else 0.0))
    return out


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """MAE, RMSE and R², from sums: one pass."""
    y, e = F.col(label).cast("double"), F.col(label).cast("double") - F.col(prediction)
    sst = F.var_pop(y) * F.count(F.lit(1))
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.coalesce(1 - F.sum(e * e) / F.nullif(sst, F.lit(0.0)), F.lit(0.0)).alias("r2"))


def heuristic_score(tx: DataFrame) -> DataFrame:
    """Score without a model, marked as not available for fusion."""
    score = F.when(F.col("amount") > 50000, F.least(F.lit(99), F.floor(F.col("amount") / 500))).otherwise(F.floor(F.col("amount") / 2000)).cast("int")
    return tx.withColumns({"ml_score": score, "ml_is_fraud": score >= 70, "ml_version": F.lit("heuristic_fallback"), "ml_available": F.lit(False)})


def predict(model, df: DataFrame, version: str, columns: list[str] = FEATURES, threshold: float = 0.5, prefix: str = "tabular_ml") -> DataFrame:
    """Batch scoring: probability (4 places), score 0–100, flag, version and availability."""
    scored = model.transform(_vector(df, columns))
    if "probability" in scored.columns:
        p = vector_to_array("probability")[1]
    else:
        p = clamp(F.col("prediction") / 100.0)
    p = F.round(p, 4)
    return scored.withColumns({
        f"{prefix}_probability": p, f"{prefix}_score": clamp(F.bround(p * 100), 0.0, 100.0).cast("int"), f"{prefix}_is_fraud": p >= threshold,
        f"{prefix}_version": F.lit(version), f"{prefix}_available": F.lit(True)}).drop("features", "rawPrediction", "probability", "prediction")


def amount_anomaly(tx: DataFrame, contamination: float = 0.05) -> DataFrame:
    """Flag the top ``contamination`` of amounts per channel, with a robust z-score (median and MAD).

    Cut, median and MAD are exact order statistics of money units; a place between two rows
    takes the lower. Transfers without a channel are a group of their own, those without an
    amount have a null score and flag.
    """
    place = lambda p: F.greatest(F.lit(1), F.ceil(F.col("n") * p - 1e-9))
    same = lambda limits: limits.select(F.struct("channel").alias("_g"), *[c for c in limits.columns if c != "channel"])
    units = money_units("amount")
    cuts = same(kth_smallest(tx, ["channel"], units, {"_cut": place(1 - contamination), "_median": place(0.5)}))
    grouped = tx.withColumn("_g", F.struct("channel")).join(cuts, "_g", "left")
    spread = same(kth_smallest(grouped, ["channel"], F.abs(units - F.col("_median")), {"_mad": place(0.5)}))
    scale = float(MONEY_SCALE)
    z = (F.col("amount") - F.col("_median") / scale) / F.nullif(1.4826 * F.col("_mad") / scale, F.lit(0.0))
    z = F.when(F.col("amount").isNotNull(), F.coalesce(z, F.lit(0.0)))
    return grouped.join(spread, "_g", "left").withColumns({"robust_z": z, "is_anomaly": units > F.col("_cut")}).drop("_g", "_cut", "_median", "_mad")


def importances(spark, model, columns: list[str] = FEATURES, k: int = 20) -> DataFrame:
    rows = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(k)


def compare(metrics: DataFrame, by: str) -> DataFrame:
    """The best row of a metrics table (columns ``model`` and ``by``)."""
    return metrics.agg(F.max_by("model", F.struct(by, "model")).alias("best_model"), F.max(by).alias(by))


def blend(df: DataFrame, rules: str = "rule_score", ml: str = "ml_score", wr: float = 0.6, wm: float = 0.4) -> DataFrame:
    """60 % rules and 40 % model, rounded half to even, within 0 to 99."""
    return df.withColumn("risk_score", F.least(F.lit(99), F.greatest(F.lit(0), F.bround(F.col(rules) * wr + F.col(ml) * wm).cast("int"))))
