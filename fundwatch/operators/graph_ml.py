"""Node features, labels, snapshots and GraphSAGE message passing as joins and aggregates.

Node state is a long table: one row per node with an array column. A layer joins edges
to the source states, averages them per target with partial aggregation (so a hub is
combined before the shuffle), and applies the weights, which are constants of fixed size,
as column arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import node_id, finite
from ..functions.session import cut
from .features import cut_points
from .graph import TRANSFER
from .union_counts import counted_in_unions

DIM = 16


def snapshot_until(tx: DataFrame, cutoff) -> DataFrame:
    return tx.filter(F.col("ts") <= (F.lit(cutoff).cast("timestamp") if not isinstance(cutoff, Column) else cutoff))


def node_labels(tx: DataFrame) -> DataFrame:
    """1 for senders of any fraud, 0 for other accounts that send or receive."""
    ends = tx.select(F.inline(F.array(
        F.struct(node_id("sender_account", "account").alias("node"), F.col("is_fraud").cast("double").alias("label")),
        F.struct(node_id("receiver_account", "account").alias("node"), F.lit(0.0).alias("label")))))
    return ends.groupBy("node").agg(F.max("label").alias("label"))


def label_nodes(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels on all nodes; −1 where unknown (devices and IPs)."""
    return nodes.join(labels, "node", "left").fillna({"label": -1.0})


def chronological_cutoffs(tx: DataFrame, train: float = 0.70, validation: float = 0.15) -> list[int]:
    """Instants (µs) of the last row of each cumulative part, found from counts."""
    us = F.unix_micros("ts")
    per = tx.groupBy(us.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    total, last = tx.agg(F.count(F.lit(1)), F.max(us)).first()
    first = max(1, int(total * train + 1e-9))
    second = max(first + 1, int(total * (train + validation) + 1e-9))
    shares = [(n + 0.5) / total for n in (first, min(second, total))]
    return [c[0] for c in cut_points(per, "s", "n", shares)] + [last]


def chronological_snapshots(tx: DataFrame, train: float = 0.70, validation: float = 0.15) -> dict[str, DataFrame]:
    """Three cumulative snapshots; a later one contains the earlier ones."""
    names = ("train", "validation", "test")
    return {n: tx.filter(F.unix_micros("ts") <= c) for n, c in zip(names, chronological_cutoffs(tx, train, validation))}


def edge_features(edges: DataFrame) -> DataFrame:
    amount = finite("amount")
    flag = lambda *r: F.when(F.col("relationship").isin(*r), 1.0).otherwise(0.0)
    log = F.when(amount > 0, F.round(F.log10(amount + 1.0), 4)).otherwise(0.0)
    return edges.select("src", "dst", "key", F.array(log, flag(TRANSFER), flag("USES_DEVICE", "USED_DEVICE"), flag("USES_IP", "USED_IP")).alias("attributes"))


def node_features(edges: DataFrame, attributes: DataFrame | None = None, temporal: DataFrame | None = None, graph: DataFrame | None = None) -> DataFrame:
    """Sixteen features per node, ``(node, type, features)``.

    Degrees count all edge types; the fan ratios divide transfer counterparties by them.
    ``attributes`` (node, account_age_days, velocity_l6h), ``temporal`` and ``graph``
    records are optional. Parallel edges are combined per neighbour before the shuffle by
    node, so a hub arrives as one row per neighbour.
    """
    rel = F.col("relationship")
    kind = F.when(rel == TRANSFER, "transfer").when(rel.endswith("DEVICE"), "device").otherwise("ip")
    links = edges.groupBy("src", "dst", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(finite("amount")).alias("amount"))
    ends = links.select(F.inline(F.array(
        F.struct(F.col("src").alias("node"), F.lit("out").alias("way"), "kind", "n", "amount"),
        F.struct(F.col("dst").alias("node"), F.lit("in").alias("way"), "kind", "n", "amount"))))
    inward, transfer = F.col("way") == "in", F.col("kind") == "transfer"
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("double")
    agg = ends.groupBy("node").agg(
        total(inward, "n").alias("d_in"), total(~inward, "n").alias("d_out"), F.count_if(inward & transfer).cast("double").alias("u_in"),
        F.count_if(~inward & transfer).cast("double").alias("u_out"), total(inward & transfer, "amount").alias("v_in"), total(~inward & transfer, "amount").alias("v_out"),
        total(~inward & (F.col("kind") == "device"), "n").alias("devices"), total(~inward & (F.col("kind") == "ip"), "n").alias("ips"))
    agg = agg.withColumn("type", F.substring_index("node", ":", 1))
    extra = {"account_age_days": 180.0, "velocity_l6h": 1.0, "t_burst": 0.0, "t_1h": 0.0, "g_device": 0.0, "g_ip": 0.0, "g_density": 0.0}
    if attributes is not None:
        agg = agg.join(attributes.select("node", "account_age_days", "velocity_l6h"), "node", "left")
    if temporal is not None:
        agg = agg.join(temporal.select(node_id("account", "account").alias("node"), F.col("burst_detected").cast("double").alias("t_burst"), F.col("n_1h").cast("double").alias("t_1h")), "node", "left")
    if graph is not None:
        agg = agg.join(graph.select(node_id("account", "account").alias("node"), F.col("shared_device_count").cast("double").alias("g_device"),
                                    F.col("shared_ip_count").cast("double").alias("g_ip"), F.col("neighbourhood_density").alias("g_density")), "node", "left")
    agg = agg.withColumns({k: finite(F.col(k), d) if k in agg.columns else F.lit(d) for k, d in extra.items()})
    log = lambda c: F.when(F.col(c) > 0, F.round(F.log10(F.col(c) + 1.0), 4)).otherwise(0.0)
    ratio = lambda a, b: F.round(F.col(a) / F.greatest(F.lit(1.0), F.col(b)), 4)
    account = F.array(
        F.col("d_in"), F.col("d_out"), F.col("d_in") + F.col("d_out"), F.col("u_in"), F.col("u_out"), log("v_in"), log("v_out"), ratio("u_in", "d_in"), ratio("u_out", "d_out"),
        F.col("account_age_days"), F.col("velocity_l6h"), F.col("t_burst"), F.col("t_1h"), F.greatest("devices", "g_device"), F.greatest("ips", "g_ip"), F.round("g_density", 4))
    entity = lambda at: F.array(F.col("d_in"), *[F.lit(1.0 if i == at else 0.0) for i in range(1, DIM)])
    vector = F.when(F.col("type") == "device", entity(13)).when(F.col("type") == "ip", entity(14)).otherwise(account)
    return agg.select("node", "type", vector.alias("features"))


def node_index(nodes: DataFrame) -> DataFrame:
    """Dense index in lexicographic order, for exporting index-based data only; joins use the id.

    Rows are range-partitioned and written with their partition; a row's index is its place in
    the partition plus the rows of the partitions before (a small table of counts).
    """
    placed = cut(nodes.select("node").distinct().repartitionByRange("node").select("node", F.spark_partition_id().alias("part")))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("node")) - 1
    return placed.withColumn("place", place).join(F.broadcast(before), "part").select("node", (F.col("before") + F.col("place")).alias("index"))


def _means(h: DataFrame, edges: DataFrame, dim: int) -> DataFrame:
    """Mean source state per target. Parallel edges weigh by their number, combined beforehand."""
    weighted = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_w"))
    moved = weighted.join(h.select(F.col("node").alias("src"), "h"), "src")
    sums = moved.groupBy("dst").agg(F.sum("_w").alias("_n"), *[F.sum(F.get("h", F.lit(i)) * F.col("_w")).alias(f"_{i}") for i in range(dim)])
    return sums.select(F.col("dst").alias("node"), F.array(*[F.col(f"_{i}") / F.col("_n") for i in range(dim)]).alias("mean"))


def _linear(x: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """``x W + b`` for a weight matrix given as rows (inputs) of columns (outputs)."""
    outputs = []
    for j, b in enumerate(bias):
        column = F.array(*[F.lit(float(row[j])) for row in weights])
        dot = F.aggregate(F.zip_with(x, column, lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v)
        outputs.append(dot + float(b))
    return F.array(*outputs)


def _unit(x: Column) -> Column:
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(x, lambda v: v / F.greatest(norm, F.lit(1e-12)))


def sage_layer(h: DataFrame, edges: DataFrame, weights, bias, aggregator: str = "mean", normalize: bool = True) -> DataFrame:
    """One layer over **incoming** edges: concat(self, mean) or (self + mean) / 2, linear, ReLU, unit length."""
    dim = len(weights) if aggregator == "gcn" else len(weights) // 2
    zero = F.array(*[F.lit(0.0)] * dim)
    joined = h.join(_means(h, edges, dim), "node", "left").withColumn("mean", F.coalesce("mean", zero))
    x = F.zip_with("h", "mean", lambda a, b: (a + b) / 2) if aggregator == "gcn" else F.concat("h", "mean")
    out = F.transform(_linear(F.col("_x"), weights, bias), lambda v: F.greatest(v, F.lit(0.0)))
    df = joined.select("node", x.alias("_x")).select("node", out.alias("_y"))
    return df.select("node", (_unit(F.col("_y")) if normalize else F.col("_y")).alias("h"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct transfer neighbours in both directions, and every node itself."""
    t = edges.filter(F.col("relationship") == TRANSFER).select("src", "dst")
    both = t.union(t.select("dst", "src"))
    return both.union(both.select("src", F.col("src"))).distinct()


def undirected_features(edges: DataFrame, risk: DataFrame | None = None) -> DataFrame:
    """``[risk / 100, 1, degree / largest degree, ln(1 + degree)]`` per account."""
    deg = undirected(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("degree"))
    top = deg.agg(F.max("degree")).first()[0]
    deg = deg.withColumn("risk", F.lit(0.0)) if risk is None else deg.join(risk, "node", "left").fillna({"risk": 0.0})
    return deg.select("node", F.array(F.col("risk") / 100.0, F.lit(1.0), F.col("degree") / F.lit(max(top or 1.0, 1.0)), F.log1p("degree")).alias("h"))


def sage_undirected(h: DataFrame, edges: DataFrame, weights, bias) -> DataFrame:
    """The federated variant: neighbours in both directions and the node itself, no normalisation."""
    return sage_layer(h, undirected(edges), weights, bias, normalize=False)


def embeddings(features: DataFrame, edges: DataFrame, layers: Sequence[tuple], places: int | None = 6) -> DataFrame:
    """Run ``layers`` of (weights, bias) over the node features; states are written between layers."""
    h = features.select("node", F.col("features").alias("h")) if "features" in features.columns else features
    edges = cut(edges.select("src", "dst"))
    for weights, bias in layers:
        h = cut(sage_layer(h, edges, weights, bias))
    return h if places is None else h.select("node", F.transform("h", lambda v: F.round(v, places)).alias("h"))


def score_head(h: DataFrame, weights: Sequence[float], bias: float, threshold: float = 0.5) -> DataFrame:
    logit = F.get(_linear(F.col("h"), [[w] for w in weights], [bias]), F.lit(0))
    p = 1.0 / (1.0 + F.exp(-logit))
    return h.withColumn("probability", p).withColumns({"risk": F.bround(F.col("probability") * 100).cast("int"), "is_fraud": F.col("probability") >= threshold})


def event_subgraph(edges: DataFrame, tx: DataFrame) -> DataFrame:
    """Per transfer: the edges among both parties and their direct neighbours, and the transfer's own edge."""
    parties = tx.select(F.col("transaction_id").alias("event_id"), F.explode(F.array(node_id("sender_account", "account"), node_id("receiver_account", "account"))).alias("node")).distinct()
    ends = edges.select("src", "dst").distinct()
    step = ends.union(ends.select("dst", "src")).toDF("node", "next").distinct()
    inside = cut(parties.unionByName(parties.join(step, "node").select("event_id", F.col("next").alias("node"))).distinct())
    induced = inside.withColumnRenamed("node", "src").join(edges.select("src", "dst", "key"), "src").join(inside.withColumnRenamed("node", "dst"), ["event_id", "dst"], "left_semi")
    own = tx.select(F.col("transaction_id").alias("event_id"), node_id("receiver_account", "account").alias("dst"), node_id("sender_account", "account").alias("src"), F.col("transaction_id").alias("key"))
    return induced.select("event_id", "src", "dst", "key").unionByName(own.select("event_id", "src", "dst", "key")).distinct()


def event_subgraph_counts(edges: DataFrame, tx: DataFrame) -> DataFrame:
    """event_id, edges: the size of each transfer's event subgraph, without listing it.

    Transfers between the same two accounts have the same subgraph, so it is counted once for each
    distinct (sender, receiver), inside tasks (``union_counts``), and joined back.
    """
    events = tx.select(F.col("transaction_id").alias("event_id"), node_id("sender_account", "account").alias("u"), node_id("receiver_account", "account").alias("v"))
    collapsed = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counted_in_unions(collapsed, events.select("u", "v").distinct()).filter("n > 0"))
    return events.join(counts, ["u", "v"]).select("event_id", F.col("n").alias("edges"))


def fit_head(h: DataFrame, labels: DataFrame, iterations: int = 100):
    """Logistic head on frozen embeddings, with classes balanced by weight."""
    from .ml import balanced_weights

    data = h.join(labels.filter("label >= 0"), "node").select(array_to_vector("h").alias("features"), "label")
    return LogisticRegression(maxIter=iterations, weightCol="weight").fit(balanced_weights(data))


def bce_accuracy(df: DataFrame, label: str = "label", probability: str = "probability", threshold: float = 0.5) -> DataFrame:
    eps = 1e-7
    p, y = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), F.col(probability))), F.col(label)
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    return df.agg(F.avg(loss).alias("loss"), F.avg(((F.col(probability) > threshold).cast("double") == y).cast("double")).alias("accuracy"))


def with_availability(accounts: DataFrame, predictions: DataFrame, version: str = "graphsage") -> DataFrame:
    """Predictions for all accounts; an account without one gets probability 0 and is marked unavailable."""
    out = accounts.join(predictions.select("account", F.col("probability").alias("graph_ml_probability")), "account", "left")
    known = F.col("graph_ml_probability").isNotNull()
    return out.withColumns({
        "graph_ml_available": known, "graph_ml_status": F.when(known, "available").otherwise("model_unavailable"), "graph_ml_version": F.when(known, version).otherwise(f"{version}_fallback"),
        "graph_ml_probability": F.coalesce("graph_ml_probability", F.lit(0.0)), "graph_ml_score": F.coalesce(F.bround(F.col("graph_ml_probability") * 100), F.lit(0)).cast("int")})
