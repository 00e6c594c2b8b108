"""Several micro-batches must add up to the batch answer."""

from pyspark.sql import functions as F

from fundwatch.operators import temporal as P
from fundwatch.streaming import jobs as K


def as_files(df, path, n):
    for i in range(n):
        df.filter(F.pmod(F.col("us") / 60_000_000, F.lit(10)).cast("int") % n == i).drop("us").coalesce(1).write.mode("append").parquet(str(path))


def source(spark, make, tmp_path):
    rows = [(f"T{i:03d}", i * 61, f"S{i % 3}", f"S{(i + 1) % 4}", 100 + i) for i in range(60)]
    tx = make(rows + rows[:5]).drop("metadata")
    once = make(rows)
    as_files(tx.withColumn("us", F.unix_micros("ts")), tmp_path / "in", 3)
    return once, K.read_stream(spark, str(tmp_path / "in"), tx.schema, files_per_batch=1)


def test_pass_through_over_micro_batches(spark, make, tmp_path):
    once, stream = source(spark, make, tmp_path)
    out = K.pass_through_stream(stream, delay="3 hours")
    K.run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["incoming_id"], r["outgoing_id"]) for r in spark.read.parquet(str(tmp_path / "out/*")).collect()}
    assert got == {(r["incoming_id"], r["outgoing_id"]) for r in P.pass_through(once).collect()}


def test_pass_through_of_a_zero_inflow(spark, make, tmp_path):
    tx = make([("1", 0, "A", "M", 0), ("2", 60, "M", "B", 5)]).drop("metadata")
    tx.write.parquet(str(tmp_path / "in"))
    stream = K.pass_through_stream(K.read_stream(spark, str(tmp_path / "in"), tx.schema))
    K.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r["pass_through_ratio"] for r in spark.read.parquet(str(tmp_path / "out/*")).collect()] == [float("inf")]


def test_trailing_windows_equal_the_batch_job(spark, make, tmp_path):
    """Three files whose times interleave: later files bring legs that earlier windows must count."""
    once, stream = source(spark, make, tmp_path)
    out = K.trailing_stream(stream, seconds=600, bucket_seconds=1000, delay="3 hours")
    K.run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    got = K.current(spark, str(tmp_path / "out"), out.schema, ["account", "transaction_id"]).collect()
    want = P.rolling(P.legs(once), {"w": 600}).collect()
    assert {(r["account"], r["transaction_id"], r["n"], r["amount"]) for r in got} == {(r["account"], r["transaction_id"], r["n_w"], r["amount_w"]) for r in want}
    assert spark.read.parquet(str(tmp_path / "out/*")).count() > len(got)  # some were given again


def test_accounts_share_trailing_states(spark, make, tmp_path):
    """All accounts in one share: one key a bucket, and the legs of each account stay apart."""
    once, stream = source(spark, make, tmp_path)
    out = K.trailing_stream(stream, seconds=600, bucket_seconds=1000, delay="3 hours", shares=1)
    K.run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    got = K.current(spark, str(tmp_path / "out"), out.schema, ["account", "transaction_id"]).collect()
    want = P.rolling(P.legs(once), {"w": 600}).collect()
    assert {(r["account"], r["transaction_id"], r["n"], r["amount"]) for r in got} == {(r["account"], r["transaction_id"], r["n_w"], r["amount_w"]) for r in want}


def test_trailing_state_expires(spark, make, tmp_path):
    """A leg later than the watermark changes nothing; nulls and self-transfers have a defined result."""
    for i, rows in enumerate(([("A", 0, "S", "R", 5), ("B", 0, "S", "S", 7), ("N", 1, "S", None, 2)], [("C", 40_000, "S", "R", 1)], [("D", 80_000, "S", "R", 1)], [("L", 2, "S", "R", 9)])):
        make(rows).drop("metadata").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    stream = K.read_stream(spark, str(tmp_path / "in/*"), make([]).drop("metadata").schema, files_per_batch=1)
    out = K.trailing_stream(stream, seconds=600, delay="10 minutes")
    K.run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    got = {(r["account"], r["transaction_id"]): (r["n"], r["amount"]) for r in K.current(spark, str(tmp_path / "out"), out.schema, ["account", "transaction_id"]).collect()}
    assert got == {("S", "A"): (2, 12.0), ("R", "A"): (1, 5.0), ("S", "B"): (2, 12.0), ("S", "N"): (3, 14.0), ("S", "C"): (1, 1.0), ("R", "C"): (1, 1.0), ("S", "D"): (1, 1.0), ("R", "D"): (1, 1.0)}


def test_scoring_drops_repeats(spark, make, tmp_path):
    once, stream = source(spark, make, tmp_path)
    profile = once.groupBy("sender_account").agg(F.lit(12).alias("fan_out"))
    seen = str(tmp_path / "scored")
    q = K.score_stream(stream, profile, lambda b, i: b.select("transaction_id", "rule_score").write.mode("overwrite").parquet(f"{seen}/b={i}"), str(tmp_path / "cp"), delay="3 hours", active=["R003"])
    q.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{seen}/*").collect()
    assert len(got) == once.count() and {r["rule_score"] for r in got} == {30}


def test_cross_bank_state(spark, tmp_path):
    rows = [("h", b, i, f"r{i}", 60.0 + 10 * i, "P") for i, b in enumerate(("B1", "B1", "B2", "B3"))]
    df = spark.createDataFrame(rows, "account_hash string, bank_id string, ts long, report_id string, risk_score double, pattern_type string")
    for i in range(4):
        df.filter(F.col("ts") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = K.read_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    K.run_available(K.cross_bank_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    got = [(r["contributing_banks"], r["aggregate_risk"]) for r in spark.read.parquet(str(tmp_path / "out/*")).orderBy("contributing_banks").collect()]
    assert [g[0] for g in got] == [2, 3] and got[1][1] > 70
