"""Hot-key fragments must give the same results as one fragment per key, and both the brute-force answer."""

import random

from pyspark.sql import functions as F

from fundwatch.functions import timeline as L

RNG = random.Random(5)
# One key holds most rows; times collide on purpose.
ROWS = [(("hot" if RNG.random() < 0.7 else f"k{RNG.randint(0, 4)}"), RNG.randint(0, 400) * 1_000_000, f"id{i:04d}", RNG.randint(1, 50), f"m{RNG.randint(0, 6)}") for i in range(500)]


def frame(spark):
    return spark.createDataFrame(ROWS, "key string, us long, id string, amount int, member string").repartition(5)


def both(spark, fn, order="id"):
    df = frame(spark)
    hot = L.find_hot(df, ["key"], "us", hot_rows=100, fragment_rows=40)
    assert [r["key"] for r in hot.collect()] == ["hot"]
    results = []
    for h in (hot, None, "auto"):
        out = fn(df, h)
        cols = sorted(out.columns)
        results.append(sorted((tuple(r[c] for c in cols) for r in out.collect()), key=str))
    assert results[0] == results[1] == results[2]
    return [dict(zip(cols, r)) for r in results[0]]


def test_trailing(spark):
    got = both(spark, lambda d, h: L.trailing(d, ["key"], "us", {"n": F.lit(1), "s": F.col("amount").cast("long")}, {"a": 10, "b": 60}, order="id", open_windows={"c": 10}, hot=h))
    assert len(got) == len(ROWS)
    for r in got:
        mine = [(t, i, a) for k, t, i, a, _ in ROWS if k == r["key"]]
        for w, low in (("a", r["us"] - 10_000_000), ("b", r["us"] - 60_000_000), ("c", r["us"] - 10_000_000 + 1)):
            inside = [a for t, _, a in mine if low <= t <= r["us"]]
            assert (r[f"n_{w}"], r[f"s_{w}"]) == (len(inside), sum(inside))
        earlier = [t for t, i, _ in mine if (t, i) < (r["us"], r["id"])]
        assert r["prev_t"] == (max(earlier) if earlier else None)


def test_neighbours(spark):
    got = both(spark, lambda d, h: L.neighbours(d, ["key"], "us", "id", ["us", "amount"], hot=h))
    for r in got:
        mine = sorted((t, i, a) for k, t, i, a, _ in ROWS if k == r["key"])
        at = [(t, i) for t, i, _ in mine].index((r["us"], r["id"]))
        before, after = (mine[at - 1] if at else None), (mine[at + 1] if at + 1 < len(mine) else None)
        assert (r["prev_us"], r["prev_amount"]) == ((before[0], before[2]) if before else (None, None))
        assert (r["next_us"], r["next_amount"]) == ((after[0], after[2]) if after else (None, None))


def test_trailing_distinct(spark):
    got = both(spark, lambda d, h: L.trailing_distinct(d, ["key"], "member", "us", "id", 20, "d", hot=h))
    for r in got:
        window = [(i, m) for k, t, i, _, m in ROWS if k == r["key"] and r["us"] - 20_000_000 <= t <= r["us"]]
        assert r["d"] == len({m for _, m in window})
        assert r["d_before"] == len({m for i, m in window if i != r["id"]})


def test_trailing_distinct_ignores_null_members(spark):
    df = spark.createDataFrame([("k", 1, "a", None), ("k", 2, "b", "m"), ("k", 3, "c", None)], "key string, us long, id string, member string")
    got = {r["id"]: r["d"] for r in L.trailing_distinct(df, ["key"], "member", "us", "id", 10, "d").collect()}
    assert got == {"a": 0, "b": 1, "c": 1}


def test_next_match(spark):
    def run(d, h):
        found = F.when(F.col("amount") % 3 == 0, F.struct("us", "id"))
        return L.next_match(d, ["key"], "us", "id", F.col("amount") % 2 == 0, found, hot=h)

    def flat(d, h):
        return run(d, h).select("key", "us", "id", F.col("_match.id").alias("match"))

    for r in both(spark, flat):
        later = sorted((t, i) for k, t, i, a, _ in ROWS if k == r["key"] and a % 3 == 0 and t >= r["us"])
        assert r["match"] == (later[0][1] if later else None)


def test_running(spark):
    measures = {"n": ("sum", F.lit(1)), "least": ("min", F.when(F.col("amount") > 20, F.col("amount"))), "top": ("max", F.struct("amount", "id"))}
    got = both(spark, lambda d, h: L.running(d, ["key"], "us", measures, hot=h))
    assert len(got) == len(ROWS)
    for r in got:
        mine = [(a, i) for k, t, i, a, _ in ROWS if k == r["key"] and t <= r["us"]]
        assert (r["n"], r["least"], tuple(r["top"])) == (len(mine), min((a for a, _ in mine if a > 20), default=None), max(mine))


def test_previous_rows_that_count(spark):
    """Rows that do not count as earlier ones still get a previous time of their own."""
    got = both(spark, lambda d, h: L.trailing(d.withColumn("real", F.col("amount") > 25), ["key"], "us", {"n": F.lit(1)}, {"a": 10}, order="id", counted="real", hot=h))
    for r in got:
        earlier = [t for k, t, i, a, _ in ROWS if k == r["key"] and a > 25 and (t, i) < (r["us"], r["id"])]
        assert r["prev_t"] == (max(earlier) if earlier else None)
