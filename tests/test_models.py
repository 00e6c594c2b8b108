import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundwatch.operators import crossbank as X
from fundwatch.operators import features as T
from fundwatch.operators import graph_ml as N
from fundwatch.operators import ml as M
from fundwatch.operators.selection import kth_smallest
from fundwatch.sources.ingest import build_graph


def test_feature_order_and_values(make):
    assert len(T.FEATURES) == 57 == len(set(T.FEATURES))
    meta = {"account_age_days": "120", "velocity_l6h": "5", "is_vpn_or_proxy": "1", "churn_rate": "NaN"}
    tx = make([("T", 0, "A", "B", 10000, {"channel": "NEFT", "sender_bank": "State Bank of India", "receiver_bank": " state bank of INDIA ", "device_id": "D", "ip_address": "I", "metadata": meta})])
    r = T.build_features(tx).first()
    assert r["log_amount"] == pytest.approx(4.0, abs=1e-4) and (r["channel_neft"], r["is_interbank"], r["day_of_week"]) == (1.0, 0.0, 2.0)
    assert (r["account_age_days"], r["velocity_l6h"], r["is_vpn_or_proxy"], r["churn_rate"], r["graph_in_degree"]) == (120.0, 5.0, 1.0, 0.01, 0.0)


@pytest.mark.parametrize("n", [1, 2, 7, 20])
def test_chronological_split_is_exact(make, n):
    # Several rows share a second.
    tx = make([(f"T{i:02d}", (i * 7 % n) // 3, "A", "B", 1) for i in range(n)])
    got = {r["transaction_id"]: r["split"] for r in T.split_chronological(tx).collect()}
    order = [r["transaction_id"] for r in tx.orderBy("ts", "transaction_id").collect()]
    a, b = int(n * 0.7 + 1e-9), int(n * 0.85 + 1e-9)
    assert [got[t] for t in order] == ["train"] * a + ["validation"] * (b - a) + ["test"] * (n - b)


def test_cut_points_over_a_wide_range(spark):
    counts = spark.createDataFrame([(k * 99991, 1 + k % 3) for k in range(500)], "k long, n long")
    flat = [k * 99991 for k in range(500) for _ in range(1 + k % 3)]
    for share, got in zip((0.1, 0.5, 0.99), T.cut_points(counts, "k", "n", [0.1, 0.5, 0.99])):
        want = int(len(flat) * share + 1e-9)
        assert got[0] == flat[want - 1] and 1 <= got[1] <= 3


def test_random_split_is_stable(make):
    tx = make([(f"T{i}", i, "A", "B", 1) for i in range(300)])
    a = {r["transaction_id"] for r in T.split_random(tx).filter("split = 'train'").collect()}
    assert a == {r["transaction_id"] for r in T.split_random(tx.repartition(7)).filter("split = 'train'").collect()} and 200 < len(a) < 280


def test_kth_smallest_equals_sorting(spark):
    """Hot and tiny groups, negative and wide keys, repeats, a null group, null keys and places outside the group."""
    rng = random.Random(5)
    rows = [("hot", rng.choice([rng.randint(-(2**40), 2**40), rng.randint(0, 9)])) for _ in range(3000)]
    rows += [("same", 7)] * 500 + [(None, i) for i in range(10)] + [("one", -3), ("hot", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, k long")
    n = F.col("n")
    got = {r["g"]: tuple(r)[1:] for r in kth_smallest(df, ["g"], F.col("k"), {"first": F.lit(1), "median": F.ceil(n / 2), "last": n, "beyond": n + 1, "none": F.lit(0)}).collect()}
    want = {}
    for g in {g for g, k in rows if k is not None}:
        ks = sorted(k for h, k in rows if h == g and k is not None)
        want[g] = (ks[0], ks[-(-len(ks) // 2) - 1], ks[-1], None, None)
    assert got == want
    assert kth_smallest(df.filter("false"), ["g"], F.col("k"), {"first": F.lit(1)}).collect() == []


def test_stratified_split_has_exact_sizes(spark):
    rows = [(f"T{i}", "a" if i % 3 else None) for i in range(300)] + [("X", "tiny")] + [("T1", "a")] * 3
    out = T.split_random(spark.createDataFrame(rows, "transaction_id string, s string"), strata="s")
    sizes = {(r["s"], r["split"]): r["count"] for r in out.groupBy("s", "split").count().collect()}
    assert sizes[(None, "train")] == 80 and sizes[("tiny", "test")] == 1
    assert 162 <= sizes[("a", "train")] <= 165 and sum(sizes.values()) == len(rows)  # floor(0.8 * 203), and copies of the last key
    assert out.filter("transaction_id = 'T1'").select("split").distinct().count() == 1


def test_amount_anomaly_is_exact(spark):
    rows = [(f"T{i}", "UPI" if i % 2 else None, float(i)) for i in range(1, 201)] + [("N", "UPI", None)]
    got = {r["transaction_id"]: r for r in M.amount_anomaly(spark.createDataFrame(rows, "transaction_id string, channel string, amount double")).collect()}
    assert sorted(t for t, r in got.items() if r["is_anomaly"]) == sorted(f"T{i}" for i in range(191, 201))
    assert len(got) == 201 and got["N"]["robust_z"] is None and got["T99"]["robust_z"] == 0.0


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0)], "label double, prediction double")
    r = M.classification_metrics(df).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_blend_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0, 0), (5, 5), (200, 99)], "rule_score int, ml_score int")
    assert [r["risk_score"] for r in M.blend(df).orderBy("rule_score").collect()] == [0, 5, 99]


def test_models_learn(make):
    rows = [(f"T{i}", i * 60, f"S{i % 5}", "B", 90000 + i if i % 4 == 0 else 10 + i) for i in range(80)]
    tx = make(rows).withColumn("is_fraud", (F.col("amount") > 50000).cast("int"))
    d = T.dataset(T.build_features(tx))
    model = M.fit_rf_classifier(d, trees=5, depth=3)
    p = M.predict(model, d, "rf")
    assert p.filter(F.col("tabular_ml_is_fraud") != (F.col("label") == 1)).count() == 0
    assert M.fit_gbt(d, "classifier", rounds=2, depth=2).getNumTrees == 2


def snapshot_transfers(make):
    rows = [(f"T{i}", i * 86400, f"A{i + 1}", f"A{(i + 1) % 5 + 1}", a, {"metadata": None}) for i, a in enumerate((1000, 900, 50000, 49000, 100))]
    return make(rows).withColumn("is_fraud", F.col("transaction_id").isin("T2", "T3").cast("int"))


def test_snapshot_has_no_future(make):
    tx = N.snapshot_until(snapshot_transfers(make), "2026-09-17 23:59:59")
    _, edges = build_graph(tx)
    assert edges.count() == 2 and {r["node"] for r in N.node_features(edges).collect()} == {"account:A1", "account:A2", "account:A3"}


def test_labels(make):
    assert {r["node"]: r["label"] for r in N.node_labels(snapshot_transfers(make)).collect()} == {f"account:A{i}": float(i in (3, 4)) for i in range(1, 6)}


@pytest.mark.parametrize("aggregator", ["mean", "gcn"])
def test_sage_layer_matches_numpy(spark, make, aggregator):
    rng = np.random.default_rng(1)
    pairs = [("A", "B"), ("A", "B"), ("B", "C"), ("C", "A"), ("D", "A")]
    _, edges = build_graph(make([(f"T{i}", i, a, b, 1) for i, (a, b) in enumerate(pairs)]))
    names = "ABCD"
    x = rng.normal(size=(4, 3))
    w, b = rng.normal(size=(3 if aggregator == "gcn" else 6, 2)), rng.normal(size=2)
    h = spark.createDataFrame([(f"account:{n}", [float(v) for v in x[i]]) for i, n in enumerate(names)], "node string, h array<double>")
    got = {r["node"][-1]: r["h"] for r in N.sage_layer(h, edges, w.tolist(), b.tolist(), aggregator).collect()}
    for i, n in enumerate(names):
        into = [x[names.index(a)] for a, c in pairs if c == n]
        mean = np.mean(into, axis=0) if into else np.zeros(3)
        y = np.maximum(((x[i] + mean) / 2 if aggregator == "gcn" else np.concatenate([x[i], mean])) @ w + b, 0)
        assert np.allclose(got[n], y / max(np.linalg.norm(y), 1e-12))


def test_fed_avg_of_equal_weights(spark):
    rows = [("R", b, "W", i, 0, v, n, 0.5) for b, n in (("A", 50), ("B", 75)) for i, v in enumerate((0.25, -1.0))]
    w = spark.createDataFrame(rows, "round_id string, bank_id string, layer string, i int, j int, value double, n_samples long, loss double")
    assert {r["i"]: r["value"] for r in X.fed_avg(w).collect()} == pytest.approx({0: 0.25, 1: -1.0})
    assert {r["i"]: r["value"] for r in X.fed_avg(w.withColumn("n_samples", F.lit(0).cast("long"))).collect()} == {0: 0.0, 1: 0.0}
    s = X.round_stats(w).first()
    assert (s["participants"], s["total_samples"], s["aggregated_loss"]) == (2, 125, 0.5)
    norms = X.clip(w).groupBy("bank_id").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1.0) for r in norms)
    a, b = (sorted(map(str, X.add_noise(w.repartition(k), 1.0, 1e-5, seed=3).collect())) for k in (1, 3))
    assert a == b


def test_noise_scale():
    assert X.noise_scale(1.0, 1e-5) == pytest.approx(4.8448, abs=1e-3)
    with pytest.raises(ValueError):
        X.noise_scale(0, 1e-5)


def test_cross_bank_severity_and_pattern(spark):
    rows = [("h", "B1", 1, "r1", 80.0, "first"), ("h", "B1", 2, "r2", 10.0, "again"), ("h", "B2", 3, "r3", 90.0, "second"), ("x", "B1", 1, "r4", 99.0, "alone")]
    a = X.cross_bank_alerts(spark.createDataFrame(rows, "account_hash string, bank_id string, ts long, report_id string, risk_score double, pattern_type string")).collect()
    assert len(a) == 1 and (a[0]["contributing_banks"], a[0]["aggregate_risk"], a[0]["severity"], a[0]["pattern_type"]) == (2, 85.0, "HIGH", "second")


def test_event_subgraphs_are_counted_as_listed(spark, make):
    import random

    from fundwatch.operators import graph_ml as N
    from fundwatch.sources.ingest import build_graph

    rng = random.Random(6)
    tx = make([(f"T{i:02d}", i, f"A{rng.randrange(14)}", f"A{rng.randrange(14)}", 10, {"device_id": f"D{rng.randrange(9)}", "ip_address": f"P{rng.randrange(9)}"}) for i in range(40)])
    _, edges = build_graph(tx)
    listed = {r["event_id"]: r["count"] for r in N.event_subgraph(edges, tx).groupBy("event_id").count().collect()}
    assert {r["event_id"]: r["edges"] for r in N.event_subgraph_counts(edges, tx).collect()} == listed and len(listed) == 40


@pytest.mark.parametrize("span,chunk,arrays", [(1 << 15, 4096, 100_000), (16, 7, 50)])
def test_pairs_inside_sets_are_counted_on_bits(spark, monkeypatch, span, chunk, arrays):
    """Against a plain count: weights, self-pairs, several blocks, ranges and arrays, nodes in no set."""
    import random

    from fundwatch.operators import bit_counts as B

    for name, value in (("RANGE", span), ("CHUNK", chunk), ("PAIRS", arrays), ("TASKS", 2), ("LEAST", 1)):
        monkeypatch.setattr(B, name, value)
    rng = random.Random(3)
    sets = [{f"n{rng.randrange(60)}" for _ in range(rng.randrange(30))} for _ in range(300)]
    weights = {(f"n{rng.randrange(70)}", f"n{rng.randrange(70)}"): rng.choice([1, 1, 1, 2, 5, 1000]) for _ in range(900)}
    bits = {}
    for i, own in enumerate(sets):
        for node in own:
            bits[node, i // 64] = bits.get((node, i // 64), 0) | 1 << i % 64
    inside = spark.createDataFrame([(n, w, b - (1 << 64 if b >> 63 else 0)) for (n, w), b in bits.items()], "node string, word int, bits bigint")
    pairs = spark.createDataFrame([(a, b, n) for (a, b), n in weights.items()], "src string, dst string, n bigint")
    got = {64 * r["word"] + r["bit"]: r["n"] for r in B.counted_inside(pairs, inside).collect()}
    assert got == {i: k for i, own in enumerate(sets) if (k := sum(n for (a, b), n in weights.items() if a in own and b in own))}
    assert B.counted_inside(pairs, inside.filter("false")).count() == 0


@pytest.mark.parametrize("span,held", [(1 << 17, 4_000_000), (16, 50)])
def test_edges_in_joined_neighbourhoods(spark, monkeypatch, span, held):
    """A hub, loops and parallel edges against a plain count; one cell and one chunk, and many; no row for each pair and edge, or pair and node, is made."""
    import random

    from fundwatch.operators import union_counts as U

    monkeypatch.setattr(U, "RANGE", span)
    monkeypatch.setattr(U, "HELD", held)
    r = random.Random(3)
    links = {(f"N{r.randrange(40)}", f"N{r.randrange(40)}"): r.randrange(1, 4) for _ in range(110)} | {(f"N{i}", "HUB"): 1 for i in range(30)} | {("HUB", "N1"): 2, ("N2", "N2"): 5}
    near = {}
    for a, b in links:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    asked = sorted(links) + [("N1", "ALONE")]
    both = lambda u, v: near.get(u, {u}) | near.get(v, {v})
    want = {(u, v): sum(n for (a, b), n in links.items() if {a, b} <= both(u, v)) for u, v in asked}
    edges = spark.createDataFrame([(a, b, n) for (a, b), n in links.items()], "src string, dst string, n bigint")
    pairs = spark.createDataFrame(asked, "u string, v string")
    got = {(x["u"], x["v"]): x["n"] for x in U.counted_in_unions(edges, pairs).collect()}
    assert got == want
    assert U.counted_in_unions(edges, pairs.filter("false")).count() == 0
