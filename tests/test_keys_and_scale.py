"""Whole keys, optional report limits, thresholds from tables, and lookups that Spark can split."""

from pyspark.sql import functions as F

from fundwatch.functions import session
from fundwatch.functions.columns import parse_ts
from fundwatch.operators import crossbank, evidence, features, graph, graph_ml, rules, search
from fundwatch.sources.ingest import build_graph, export_graph


def test_ids_with_a_common_prefix_stay_apart(spark):
    ids = ["a" * 40 + "1", "a" * 40 + "2"]
    df = spark.createDataFrame([(x,) for x in ids], "t string").select(evidence.case_id(F.col("t")).alias("c"))
    got = {r.c for r in df.collect()}
    assert got == {f"CASE-{x}" for x in ids}
    assert df.select(evidence.case_label("c").alias("l")).distinct().count() == 1


def test_devices_are_nodes_of_their_own(make):
    rows = [(f"T{i}", i, "A", "B", 5, {"device_id": f"D{i}", "ip_address": "1.2.3.4"}) for i in range(50)]
    tx = make(rows).withColumns({"sender_name": F.lit("x"), "receiver_name": F.lit("y"), "risk_score": F.lit(1.0), "is_fraud": F.lit(0), "fraud_type": F.lit("None"),
                                 "device_risk_score": F.lit(1.0), "network_risk_score": F.lit(1.0), "is_rooted_or_emulator": F.lit(1), "is_vpn_or_proxy": F.lit(0)})
    nodes, edges = export_graph(tx)
    assert {r.id for r in nodes.filter("type = 'device'").collect()} == {f"dev-D{i}" for i in range(50)}
    assert edges.filter("relationship = 'SHARED_DEVICE'").select("target").distinct().count() == 50


def test_acknowledgement_is_by_whole_hash(spark):
    alerts = spark.createDataFrame([("f" * 16 + "1", "ALT-FED-F"), ("f" * 16 + "2", "ALT-FED-F")], "account_hash string, alert_id string")
    got = crossbank.acknowledged(alerts, alerts.filter(F.col("account_hash").endswith("1")))
    assert {r.account_hash[-1]: r.is_acknowledged for r in got.collect()} == {"1": True, "2": False}


def test_complaint_key_is_the_whole_digest(spark):
    fields = [f.split()[0] for f in search.COMPLAINT_SCHEMA.split(", ")]
    row = spark.createDataFrame([tuple("x" for _ in fields)], ", ".join(f"{f} string" for f in fields))
    got = search.build_complaints(row).first()
    assert len(got.report_key) == 64 and got.report_number == "CMP-" + got.report_key[:12].upper()


def test_money_paths_without_a_limit(spark, make):
    rows = [(f"T{i:02}", i, "A", f"B{i}", 5) for i in range(40)]
    edges = build_graph(make(rows))[1]
    start = spark.createDataFrame([("A",)], "account string")
    assert graph.money_paths(edges, start, 2).count() == 40 and graph.money_paths(edges, start, 2, limit=25).count() == 25


def test_thresholds_of_the_rules_table(spark):
    table = spark.createDataFrame([("R001", 7.0), ("R012", 9.0), ("R014", 1.0), ("R002", None), ("X", 3.0)], "rule_code string, threshold_value double")
    assert rules.rule_overrides(table) == {"R001": {"threshold": 7.0}, "R012": {"amount": 9.0}}


def test_graph_join_wants_every_column(spark, make):
    tx, record = make([("T1", 0, "A", "B", 5)]), spark.createDataFrame([("A", 3)], "account string, in_degree int")
    lacking = tuple(s for s in features.GRAPH.values() if s != "in_degree")
    try:
        features.join_graph(tx, record)
        raise AssertionError("a missing column passed")
    except ValueError as e:
        assert "out_degree" in str(e)
    assert features.join_graph(tx, record, absent=lacking).first()["graph_in_degree"] == 3.0


def test_node_index_is_dense_and_ordered(spark):
    names = sorted(f"n{i}" for i in range(300))
    nodes = spark.createDataFrame([(n,) for n in names], "node string").repartition(7)
    assert [(r["node"], r["index"]) for r in graph_ml.node_index(nodes).orderBy("index").collect()] == [(n, i) for i, n in enumerate(names)]


def test_lookup_of_a_hot_key_is_split(spark):
    """The final plan shows a split join; rows without a key keep their place in the result."""
    hot = spark.range(200_000).select("id", F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), F.repeat(F.lit("x"), 40).alias("pad"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        counts = session.cut(hot.filter("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n")))
        joined = session.lookup(session.cut(hot), counts, "k")
        rows = joined.groupBy(F.col("n").isNull().alias("none")).agg(F.count(F.lit(1)).alias("c")).collect()
        split = joined.select("id", "n")
        split.collect()
        assert {r.none: r.c for r in rows} == {True: 20_000, False: 180_000}
        assert "skew=true" in split._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_release_removes_written_tables(spark):
    table = session.cut(spark.range(3))
    assert table.count() == 3 and session.release(spark) >= 1
    path = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_timestamp_shapes(spark):
    shapes = {"2024-03-01T10:20": "2024-03-01 10:20:00", "2024-03-01 10:20": "2024-03-01 10:20:00", "2024-03-01T10:20:30.123456789": "2024-03-01 10:20:30.123456", "2024-03-01T10:20:30+0530": "2024-03-01 04:50:30",
              "20240301T102030": "2024-03-01 10:20:30", "20240301T102030+0100": "2024-03-01 09:20:30", "20240301": "2024-03-01 00:00:00", "2024-03-01": "2024-03-01 00:00:00", "2024-03-01T10:20:30.5+05:30": None, "2024-03-01T10:20:30Z": "2024-03-01 10:20:30",
              "2024/03/01 10:20:30": "2024-03-01 10:20:30", "2024-13-01": None, "x": None, "": None}
    df = spark.createDataFrame([(k,) for k in shapes], "t string").select("t", parse_ts("t").cast("string").alias("at"))
    got = {r.t: r["at"] for r in df.collect()}
    del shapes["2024-03-01T10:20:30.5+05:30"]
    assert {k: got[k] for k in shapes} == shapes
