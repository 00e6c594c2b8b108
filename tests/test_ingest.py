import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from fundwatch.functions import columns as C
from fundwatch.operators import search as S
from fundwatch.sources import ingest as I
from fundwatch.sources.readers import append_batch, committed_batches, read_scored, read_table, read_transfers_csv, write_scored


def test_canonicalize_aliases_defaults_metadata(spark):
    raw = spark.createDataFrame(
        [("", "T1", "2025-07-01 10:40:36", "A", "", "B", "44532.52", "", "x"), ("T2", "", "2025-07-01T10:40:36+05:30", "", "C", "D", "bad", "NEFT", None)],
        "transaction_id string, txn_id string, timestamp string, account_number string, sender_account_id string, receiver_account string, amount string, trans_type string, shade string")
    got = {r["transaction_id"]: r for r in I.canonicalize(raw).withColumn("at", C.ts_text("ts")).collect()}
    assert got["T1"]["sender_account"] == "A" and got["T2"]["sender_account"] == "C"
    assert got["T1"]["channel"] == "UPI" and got["T2"]["channel"] == "NEFT" and got["T1"]["currency"] == "INR"
    assert got["T1"]["at"].startswith("2025-07-01 10:40:36") and got["T2"]["at"].startswith("2025-07-01 05:10:36")
    assert got["T1"]["amount"] == 44532.52 and got["T2"]["amount"] is None
    assert got["T1"]["metadata"] == {"shade": "x"} and got["T2"]["metadata"] == {}


def test_validate_reasons(make, rows):
    tx = make([("T1", 0, "A", "B", 5), ("", 0, "A", "B", 5), ("T3", 0, "", "B", 5), ("T4", 0, "A", "B", 0), ("T5", 0, "A", "B", 5, {"latitude": 91.0})])
    ok, bad = I.validate(tx)
    assert [r["transaction_id"] for r in ok.collect()] == ["T1"]
    assert sorted(r["reason"] for r in bad.collect()) == ["amount_not_positive", "bad_latitude", "missing_sender", "missing_transaction_id"]


def test_dedup_keeps_first(make):
    tx = make([("DUP", 0, "A", "B", 1000), ("DUP", 5, "A", "B", 9999), ("U", 9, "A", "B", 2000)])
    assert sorted(r["amount"] for r in I.dedup_first(tx).collect()) == [1000.0, 2000.0]


def test_graph_ingest_is_idempotent(make, rows):
    tx = make([("T1", 0, "A", "B", 10, {"device_id": "D", "ip_address": "1.1.1.1", "sender_bank": "X"}), ("T1", 0, "A", "B", 10, {"device_id": "D"}), ("T2", 5, "A", "C", 1, {"sender_bank": "Y"})])
    nodes, edges = I.build_graph(tx)
    n = {r["id"]: r for r in nodes.collect()}
    assert set(n) == {"account:A", "account:B", "account:C", "device:D", "ip:1.1.1.1"}
    assert n["account:A"]["bank_name"] == "Y" and n["account:B"]["bank_name"] == "HDFC Bank"
    assert sorted((r["relationship"], r["key"]) for r in edges.collect()) == [
        ("TRANSFERRED_FUNDS", "T1"), ("TRANSFERRED_FUNDS", "T2"), ("USES_DEVICE", "link:account:A->device:D"), ("USES_IP", "ip_link:account:A->ip:1.1.1.1")]


def test_hashes(spark):
    df = spark.createDataFrame([("SB00009199",), ("ZZ1",), ("9 ",)], "a string")
    got = df.select("a", C.hmac_sha256("a", "k").alias("h"), C.map_bank("a").alias("b")).collect()
    for r in got:
        assert r["h"] == hmac.new(b"k", r["a"].encode(), hashlib.sha256).hexdigest()
        want = C.BANK_BY_PREFIX.get(r["a"].strip()[:2]) or C.BANK_BY_HASH[int(hashlib.md5(r["a"].strip().encode()).hexdigest(), 16) % 10]
        assert r["b"] == want


def test_masks(spark):
    r = spark.createDataFrame([("123456789012", "9", 50000.0)], "a string, b string, c double").select(C.mask_account("a"), C.mask_account("b"), C.format_inr("c")).first()
    assert tuple(r) == ("XXXX9012", "9", "₹50,000.00")


def test_round_trips(spark, make, tmp_path):
    tx = make([("T1", 0, "A", "B", 10), ("T2", 90000, "A", "B", 20)])
    write_scored(tx.select("transaction_id", "ts", "amount"), str(tmp_path / "s"))
    write_scored(tx.select("transaction_id", "ts", "amount"), str(tmp_path / "s"))
    assert read_scored(spark, str(tmp_path / "s")).count() == 4
    tx.select("transaction_id", "amount").write.option("header", True).csv(str(tmp_path / "c"))
    assert read_transfers_csv(spark, str(tmp_path / "c"), "transaction_id string, amount double").count() == 2
    spark.createDataFrame([("1", "R004", True)], "id string, rule_code string, is_active boolean").write.parquet(str(tmp_path / "rules"))
    assert read_table(spark, str(tmp_path), "rules").select("rule_code").first()[0] == "R004"


def test_batches_are_appended_once(spark, make, tmp_path):
    path, schema = str(tmp_path / "scored"), "transaction_id string, ts timestamp, amount double, dt date, batch string"
    tx = make([("T1", 0, "A", "B", 10), ("T2", 90000, "A", "B", 20)]).select("transaction_id", "ts", "amount")
    assert append_batch(tx, path, "run-0") and not append_batch(tx, path, "run-0")
    # A driver that dies before the commit: all of its rows are there, the marker is not.
    assert append_batch(tx, path, "run-1")
    (tmp_path / "scored" / "batch=run-1" / "_SUCCESS").unlink()
    assert committed_batches(spark, path) == ["run-0"]
    assert read_scored(spark, path).count() == 2
    # The repeat has one day less; the day of the first attempt does not come back.
    assert append_batch(tx.filter("transaction_id = 'T1'"), path, "run-1")
    assert sorted((r["batch"], r["transaction_id"]) for r in read_scored(spark, path).collect()) == [("run-0", "T1"), ("run-0", "T2"), ("run-1", "T1")]
    # An empty batch is committed and adds nothing.
    assert append_batch(tx.filter("false"), path, "run-2") and read_scored(spark, path, schema).count() == 3
    assert committed_batches(spark, path) == ["run-0", "run-1", "run-2"]
    with pytest.raises(ValueError):
        append_batch(tx, path, "a/b")


def test_complaints_tolerate_bad_json(spark):
    df = spark.createDataFrame([("VICTIM_COMPLAINT", '{"victim_email": "a@b.c", "amount_lost": 5.5}'), ("VICTIM_COMPLAINT", "{oops"), ("OTHER", "{}")], "report_type string, summary_text string")
    got = S.expand_complaints(df).select("victim_email", "amount_lost").collect()
    assert sorted(map(tuple, got), key=str) == [("a@b.c", 5.5), (None, None)]
    assert S.complaints_by_email(df, "a@b.c").count() == 1


def test_graph_view_drops_dangling_edges(spark):
    nodes = spark.createDataFrame([("a", 95, False, "account"), ("b", 80, False, "account"), ("c", 10, True, "account")], "id string, risk_score int, is_mule boolean, type string")
    edges = spark.createDataFrame([("a", "b", 5.0), ("a", "c", 9.0)], "source string, target string, amount double")
    n, e = S.graph_view(nodes, edges, risk="CRITICAL")
    assert sorted(r["id"] for r in n.collect()) == ["a", "c"] and e.count() == 1
    assert S.top_nodes(nodes, edges, 2)[1].count() == 1
    assert S.page_meta(nodes, 2, 2).select(F.col("pages"), "has_next", "has_prev").first()[:] == (2, False, True)
