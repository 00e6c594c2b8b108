import pytest
from pyspark.sql import functions as F

from fundwatch.operators.context import rule_context
from fundwatch.operators.rules import RULES, evaluate_rules, registry


def last(make, rows, active, **kw):
    tx = make(rows)
    out = evaluate_rules(rule_context(tx, active=active, **kw), active=active)
    return out.filter(F.col("transaction_id") == rows[-1][0]).first()


def codes(r):
    return [m["rule_code"] for m in r["matches"]]


def test_high_velocity(make):
    r = last(make, [(f"t{i}", 120 * i, "A", f"R{i}", 10) for i in range(26)], ["R001"])
    assert codes(r) == ["R001"] and (r["rule_score"], r["highest_severity"]) == (25, "HIGH")
    assert r["matches"][0]["narrative"] == "High velocity detected: 25 transactions executed in the past hour."


def test_fan_in_and_out(make):
    assert last(make, [(f"t{i}", i, f"S{i}", "C", 10) for i in range(13)], ["R002"])["rule_score"] == 30
    assert last(make, [(f"t{i}", i, "D", f"R{i}", 10) for i in range(16)], ["R003"])["rule_score"] == 30


def test_mule_chain(make):
    r = last(make, [("in", 0, "V", "A", 50000), ("out", 300, "A", "X", 48000)], ["R004"])
    assert (r["rule_score"], r["highest_severity"]) == (40, "CRITICAL") and "₹48,000.00" in r["matches"][0]["narrative"]


def test_isolated_transfer_is_no_chain(make):
    assert codes(last(make, [("one", 0, "A", "B", 50000)], ["R004"])) == []


@pytest.mark.parametrize("amount, hit", [(48000, True), (49999, True), (47999.99, False), (50000, False)])
def test_smurfing(make, amount, hit):
    assert bool(codes(last(make, [("t", 0, "A", "B", amount)], ["R005"]))) is hit


def test_shared_entities(make):
    rows = [(f"t{i}", i, f"S{i}", "B", 1, {"device_id": "D", "ip_address": "I", "beneficiary_id": "N"}) for i in range(6)]
    assert codes(last(make, rows, ["R006", "R010", "R013"])) == ["R006", "R010", "R013"]
    assert codes(last(make, rows[:3], ["R006", "R010", "R013"])) == []


def test_dormant_new_account_travel_night(make):
    day = 86400
    assert codes(last(make, [("a", -91 * day, "A", "B", 1), ("b", 0, "A", "B", 1)], ["R007"])) == ["R007"]
    rows = [(f"t{i}", i, "A", f"R{i}", 1, {"metadata": {"account_age_days": "3"}}) for i in range(17)]
    assert codes(last(make, rows, ["R008"])) == ["R008"]
    place = lambda lat: {"latitude": lat, "longitude": 70.0}
    assert codes(last(make, [("a", 0, "A", "B", 1, place(8.0)), ("b", 3600, "A", "B", 1, place(13.0))], ["R011"])) == ["R011"]
    assert codes(last(make, [("n", -11 * 3600, "A", "B", 50000)], ["R012"])) == ["R012"]


def test_cross_channel_and_circular(make):
    rows = [("a", 0, "A", "B", 1, {"channel": "NEFT"}), ("b", 10, "A", "B", 1, {"channel": "IMPS"}), ("c", 20, "A", "B", 1)]
    assert codes(last(make, rows, ["R009"])) == ["R009"]
    assert codes(last(make, [("s", 0, "A", "A", 1)], ["R014"])) == ["R014"]


def test_all_rules_on_plain_transfer(make):
    r = last(make, [("t", 0, "A", "B", 100)], None)
    assert (codes(r), r["rule_score"], r["highest_severity"]) == ([], 0, "LOW")


def test_registry_order(spark):
    assert [r["rule_code"] for r in registry(spark).orderBy("position").collect()] == list(RULES) == [f"R{i:03d}" for i in range(1, 15)]
