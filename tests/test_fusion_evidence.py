import pytest
from pyspark.sql import functions as F

from fundwatch.operators import evidence as E
from fundwatch.operators import fusion as U
from fundwatch.plans.case import case_pipeline, open_cases
from fundwatch.plans.flagship import score_forwarders


def one(spark, **values):
    kinds = {c: t for cols in U.INPUTS.values() for c, t in cols.items()}
    return spark.range(1).select(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in values.items()])


RULES80 = dict(rule_score=80, highest_severity="LOW", rule_count=3)


@pytest.mark.parametrize("policy, score", [("renormalize_available", 80.0), ("zero_contribution", 20.0), ("penalty_baseline", 35.0)])
def test_missing_signal_policies(spark, policy, score):
    r = U.fuse(U.signals(one(spark, **RULES80)), policy=policy).first()
    assert r["composite_risk_score"] == pytest.approx(score) and r["available_modalities"] == ["rules"]
    if policy == "renormalize_available":
        assert r["contributions"]["rules"]["effective_weight"] == 1.0 and r["risk_level"] == "HIGH"


@pytest.mark.parametrize("severity, value", [("CRITICAL", 0.85), ("HIGH", 0.65), ("MEDIUM", 0.4), ("LOW", 0.1)])
def test_severity_floor(spark, severity, value):
    assert U.signals(one(spark, rule_score=10, highest_severity=severity, rule_count=1)).first()["signals"]["rules"]["value"] == value


def test_formulas(spark):
    t = dict(burst_detected=True, rapid_in_out_detected=True, rapid_in_out_ratio=1.4, n_1h=5, temporal_concentration=0.5)
    g = dict(has_cycle=True, shared_device_count=2, shared_ip_count=1, fan_in_ratio=0.2, fan_out_ratio=0.8, neighbourhood_density=0.1)
    m = dict(tabular_ml_probability=0.7, tabular_ml_score=70, tabular_ml_version="v", tabular_ml_available=False)
    s = U.signals(one(spark, **t, **g, **m)).first()["signals"]
    assert s["temporal"]["value"] == pytest.approx(0.85) and s["graph"]["value"] == pytest.approx(0.6717)
    assert (s["tabular_ml"]["status"], s["graph_ml"]["status"]) == ("model_unavailable", "missing")


def test_nothing_available(spark):
    r = U.fuse(U.signals(spark.range(1))).first()
    assert (r["composite_risk_score"], r["risk_level"], len(r["unavailable_modalities"])) == (0.0, "LOW", 5)


@pytest.mark.parametrize("score, tier", [(29.99, "LOW"), (30.0, "MEDIUM"), (64.99, "MEDIUM"), (65.0, "HIGH"), (85.0, "CRITICAL"), (float("nan"), "LOW"), (float("inf"), "LOW")])
def test_tiers(spark, score, tier):
    assert spark.range(1).select(U.tier(F.lit(score))).first()[0] == tier


@pytest.mark.parametrize("bad", [dict(U.WEIGHTS, rules=-1), dict(U.WEIGHTS, rules=float("nan")), dict.fromkeys(U.WEIGHTS, 0), {"rules": 1}])
def test_bad_weights(bad):
    with pytest.raises(ValueError):
        U.normalized_weights(bad)


def test_bad_thresholds():
    with pytest.raises(ValueError):
        U.check_thresholds((30, 30, 85))


def items(spark, rows):
    schema = ("case_id string, position int, evidence_id string, category string, title string, description string, severity string, source string, source_reference string, "
              "transaction_ids array<string>, account_ids array<string>, device_ids array<string>, ip_addresses array<string>, timestamps array<string>, metrics map<string,double>")
    return spark.createDataFrame([("C", p, i, "RULE_VIOLATION", t, "d", s, src, ref, tx, acc, [], [], [], m) for p, i, t, s, src, ref, tx, acc, m in rows], schema)


def test_dedup_merges(spark):
    df = items(spark, [(0, "E1", "low", "LOW", "RULE", "RULE:R1", ["T2"], ["B", "A"], {"a": 1.0, "b": 1.0}), (1, "E2", "high", "HIGH", "RULE", "RULE:R1", ["T1"], ["A", "B"], {"b": 2.0}),
                       (2, "E3", "same", "HIGH", "RULE", "RULE:R1", ["T1"], ["A", "B"], {}), (3, "E4", "other", "LOW", "RULE", "RULE:R2", ["T9", "T1"], ["A"], {})])
    got = {r["evidence_id"]: r for r in E.dedup_evidence(df).collect()}
    assert set(got) == {"E1", "E4"}
    e = got["E1"]
    assert (e["title"], e["severity"], e["transaction_ids"], e["account_ids"], e["metrics"]) == ("high", "HIGH", ["T1", "T2"], ["A", "B"], {"a": 1.0, "b": 2.0})
    assert got["E4"]["transaction_ids"] == ["T9", "T1"]


def test_findings_without_copies_are_not_shuffled(spark):
    """Only copies are grouped: the wide rows of single findings stay where they are."""
    single = items(spark, [(i, f"E{i}", "t", "LOW", "RULE", f"RULE:R{i}", ["T1"], ["A"], {"a": 1.0}) for i in range(3)])
    done = E.dedup_evidence(single)
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["evidence_id"] for r in done.collect()) == ["E0", "E1", "E2"]


def test_actions_of_cases_given_twice_or_not_at_all(spark):
    ranked = E.rank_evidence(items(spark, [(0, "R1", "Forensic Rule", "LOW", "RULE", "RULE:R005", [], ["A"], {}), (1, "R2", "Forensic Rule", "LOW", "RULE", "RULE:R006", [], ["A"], {})]))
    for given, idle in (([], 0), (["EMPTY", "EMPTY"], 2)):
        got = [(r["case_id"], r["action_id"], r["evidence_ids"]) for r in E.actions(ranked, spark.createDataFrame([(c,) for c in given], "case_id string")).collect()]
        assert sorted(got) == [("C", "ACT-RUL-001", ["R1", "R2"])] + [("EMPTY", "ACT-GEN-001", [])] * idle


def test_rank_order(spark):
    df = items(spark, [(0, "Z", "t", "HIGH", "GRAPH", "g", [], ["A"], {"cycle_count": 9.0}), (1, "Y", "t", "HIGH", "RULE", "r", [], ["A"], {"score_contribution": 10.0}),
                       (2, "X", "t", "HIGH", "RULE", "q", [], ["A"], {"score_contribution": 30.0}), (3, "W", "t", "CRITICAL", "TRANSACTION", "t", [], ["A"], {}),
                       (4, "A", "t", "HIGH", "RULE", "p", [], ["A"], {"score_contribution": 10.0})])
    assert [r["evidence_id"] for r in E.rank_evidence(df).orderBy("rank").collect()] == ["W", "X", "A", "Y", "Z"]


def test_rule_action_depends_on_rank(spark):
    df = items(spark, [(0, "R1", "Forensic Rule", "CRITICAL", "RULE", "RULE:R005", [], ["A"], {}), (1, "P", "Rapid Pass-Through", "HIGH", "TEMPORAL", "TEMPORAL:x", [], ["A"], {}),
                       (2, "R2", "Forensic Rule", "LOW", "RULE", "RULE:R006", [], ["A"], {})])
    acts = {r["action_id"]: r["evidence_ids"] for r in E.actions(E.rank_evidence(df), spark.createDataFrame([("C",), ("EMPTY",)], "case_id string")).filter("case_id = 'C'").collect()}
    assert acts["ACT-RUL-001"] == ["R1"] and acts["ACT-TEM-001"] == ["P"]


def test_empty_case(spark):
    cases = spark.createDataFrame([("EMPTY", "S", "T")], "case_id string, subject_id string, transaction_id string")
    none = E.rank_evidence(items(spark, [(0, "R1", "t", "LOW", "RULE", "r", [], ["A"], {})]).filter("false"))
    assert E.actions(none, cases).first()["action_id"] == "ACT-GEN-001"
    assert E.questions(none, cases).first()["questions"][0].startswith("Are additional transaction logs")
    p = E.themes(E.packages(none, E.coverage(cases))).first()
    assert "No suspicious forensic evidence" in p["evidence_summary"] and "No supporting forensic evidence" in p["narrative"]


def test_mule_chain_case(spark, make):
    rows = [("T1", 0, "V1", "M", 450000), ("T2", 90, "M", "X", 445000), ("T3", 600, "V2", "M", 480000), ("T4", 675, "M", "X", 475000), ("T5", 700, "X", "V1", 1000)]
    tx = make(rows)
    r = case_pipeline(tx, open_cases(tx, 475000).filter("transaction_id = 'T4'"))
    case = r.cases.first()
    assert case["case_id"] == "CASE-T4" and case["rapid_in_out_delay"] == 90.0 and case["has_cycle"]
    refs = [e["source_reference"] for e in r.evidence.orderBy("rank").collect()]
    assert refs[0].startswith("RULE:") and {"TEMPORAL:rapid_in_out", "GRAPH:circular_routing", "TRANSACTION:large_amount", "RISK_FUSION:v1.0"} <= set(refs)
    p = r.packages.first()
    assert p["total_evidence"] == len(refs) and "TABULAR_ML (MISSING)" in p["evidence_summary"] and p["narrative"].startswith("Case analysis for subject 'M'")
    assert r.actions.orderBy("position").first()["action_id"] == "ACT-CYC-001"
    assert any("circular transaction flow" in q for q in r.questions.first()["questions"])
    assert len(r.limitations.first()["limitations"]) == 3 + 2 + 2


def test_forwarders_meet_all_rules(make, rows):
    """A forwards 95 % within a minute (R004, 40) and lies on a ring (R014, 40)."""
    tx = make([("T1", 0, "X", "A", 1000), ("T2", 60, "A", "B", 950), ("T3", 4000, "B", "X", 10)])
    got = rows(score_forwarders(tx))
    assert [(r["account"], r["rule_score"], r["highest_severity"]) for r in got] == [("A", 80, "CRITICAL")]


def test_driver_weights_are_rounded_as_in_the_sql(spark):
    """All values of four places, against DuckDB: it differs from decimal rounding at 0.145, 0.285, 0.565 and 0.575."""
    import duckdb
    from pyspark.sql import functions as F

    from fundwatch.operators import evidence as E

    part = F.create_map(F.lit("temporal"), F.struct((F.col("id") / 10000).alias("weighted_score")))
    cases = spark.range(1, 10001).select("id", part.alias("contributions"), F.lit("LOW").alias("risk_level"), F.lit(0.0).alias("composite_risk_score"))
    got = {r["id"]: r["risk_summary"].split("(")[-1][:4] for r in E.risk_drivers(cases).collect()}
    assert got == dict(duckdb.sql("SELECT i, printf('%.2f', round(i / 10000::DOUBLE, 2)) FROM range(1, 10001) t(i)").fetchall())


def test_findings_of_cases_with_an_id_of_their_own_are_not_shuffled(spark, make):
    """Ranked inside the row they are what grouping their rows gives; cases that share an id still meet."""
    from fundwatch.operators.rules import RULES, result
    from fundwatch.plans.case import open_cases

    tx = make([("T1", 0, "A", "B", 600_000.0), ("T2", 1, "B", "A", 48_500.0), ("T3", 2, "C", "A", 10.0), ("T4", 3, "C", "B", 250_000.0), ("T5", 4, "D", "D", 250_000.0)])
    hits = {"R001": F.col("amount") > 40_000, "R004": F.col("sender_account") == "C", "R014": F.col("sender_account") == "B"}
    match = lambda code: F.when(hits[code], F.struct(*[F.lit(v).alias(n) for n, v in zip(("rule_code", "rule_name", "pattern_name", "score", "severity"), (code, *RULES[code][1:5]))], F.lit("passed in a burst").alias("narrative")))
    twice = F.when(F.col("transaction_id") == "T5", match("R001"))
    cases = open_cases(tx, 0.0).withColumn("matches", F.array_compact(F.array(*[match(c) for c in hits], twice))).withColumn("rule_score", F.lit(1))
    cases = E.coverage(cases.withColumns({"unavailable_modalities": F.array().cast("array<string>")}))
    shared = cases.withColumn("case_id", F.when(F.col("sender_account") == "C", "CASE-C").otherwise(F.col("case_id")))
    show = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    for given, alone in ((cases.filter("transaction_id <> 'T5'"), 4), (shared, 2)):
        plain = E.rank_evidence(E.dedup_evidence(E.collect_evidence(given)))
        ranked = E.ranked_cases(given)
        assert ranked.alone.count() == alone and (ranked.found is None) == (alone == 4)
        assert show(ranked.rows().select(plain.columns)) == show(plain)
        for made in (E.packages, E.actions, E.questions):
            a, b = made(ranked), made(plain, given)
            assert show(a.select(b.columns)) == show(b)
    plan = E.packages(E.ranked_cases(cases.filter("transaction_id <> 'T5'")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_case_packages_name_cycles_to_five_hops(spark, make, monkeypatch):
    """A ring of five: all its accounts are named, as the flag and the count go to five hops."""
    from fundwatch.catalog import evidence as C

    tx = make([(f"T{i}", 3000 * i, f"A{i}", f"A{(i + 1) % 5}", 1000) for i in range(5)])
    monkeypatch.setattr(C, "transfers", lambda spark, sf: tx)
    monkeypatch.setattr(C, "accounts", lambda spark, sf: None)
    text = {r["case_id"]: r["evidence_summary"] for r in C.e22_packages(spark, "").collect()}
    assert "accounts: A0 -> A1 -> A2 -> A3 -> A4." in text["CASE-T2"]


def test_packages_hold_their_actions_without_a_shuffle(spark, make):
    """The actions of a package are found in its row; cases that share an id are grouped, with the same result."""
    from fundwatch.operators.rules import RULES

    tx = make([("T1", 0, "A", "B", 600_000.0), ("T2", 1, "B", "A", 48_500.0), ("T3", 2, "C", "A", 10.0), ("T4", 3, "C", "B", 250_000.0)])
    hits = {"R001": F.col("amount") > 40_000, "R014": F.col("sender_account") == "B"}
    match = lambda code: F.when(hits[code], F.struct(*[F.lit(v).alias(n) for n, v in zip(("rule_code", "rule_name", "pattern_name", "score", "severity"), (code, *RULES[code][1:5]))], F.lit("burst").alias("narrative")))
    cases = E.coverage(open_cases(tx, 0.0).withColumns({"matches": F.array_compact(F.array(*[match(c) for c in hits])), "rule_score": F.lit(1)}))
    shared = cases.withColumn("case_id", F.when(F.col("sender_account") == "C", "CASE-C").otherwise(F.col("case_id")))
    for given in (cases, shared):
        ranked = E.ranked_cases(given)
        want = {}
        for r in E.actions(ranked).collect():
            want.setdefault(r["case_id"], set()).add(r["action_id"])
        got = E.packages_with_actions(ranked)
        assert {r["case_id"]: r["action_ids"] for r in got.collect()} == {k: sorted(v) for k, v in want.items()}
        if given is cases:
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_case_scores_make_no_lists_of_evidence(spark, make, monkeypatch):
    from fundwatch.catalog import evidence as C

    class Called(Exception):
        pass

    def features(tx, cases, accounts, **given):
        raise Called(cases.columns, given)

    monkeypatch.setattr(C, "transfers", lambda spark, sf: make([("T1", 0, "A", "B", 1.0)]))
    monkeypatch.setattr(C, "accounts", lambda spark, sf: None)
    monkeypatch.setattr(C, "case_features", features)
    with pytest.raises(Called) as caught:
        C.e22(spark, "")
    assert caught.value.args[1] == {"hops": 2, "max_depth": 5, "lists": False} and "metadata" not in caught.value.args[0]
