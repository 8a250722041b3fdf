"""Gating, robustness, abstention and fallback on small inputs with known values."""

from __future__ import annotations

import pytest
from helpers import predictions, scored
from pyspark.sql import functions as F

from gatewright.functions import scores as S
from gatewright.operators import gate as G
from gatewright.operators import robust as R


def test_gate(spark):
    cases = scored(spark, [("1", {"a": 0.9, "b": 0.1}, None), ("2", {"a": 0.6, "b": 0.4}, None), ("3", {"a": 0.88, "b": 0.12}, None), ("4", {"a": 1.0}, None), ("5", {"a": 0.9, "b": 0.3}, None)])
    out = {r["case_id"]: r for r in G.decide(cases, G.ThresholdPolicy(0.8, 0.8)).collect()}
    assert [(out[k]["action"], out[k]["reason_code"], out[k]["decision"]) for k in "12345"] == [
        ("EXECUTE", "CONFIDENT", "a"),
        ("FALLBACK", "LOW_CONFIDENCE", None),
        ("FALLBACK", "LOW_MARGIN", None),
        ("EXECUTE", "CONFIDENT", "a"),
        ("REJECT", "INVALID_SUM", None),
    ]
    entries = {r.case_id: r for r in G.ledger(G.decide(cases, G.ThresholdPolicy(0.8, 0.8))).collect()}
    assert len(entries) == 5 and entries["1"].evidence.margin == pytest.approx(0.8) and entries["2"].evidence is None and entries["2"].confidence is None and entries["1"].selected_candidate == "a"
    with pytest.raises(Exception, match="invalid case"):
        G.require_valid(cases).collect()
    with pytest.raises(ValueError):
        G.ThresholdPolicy(2.0)


def test_gate_fails_closed(spark):
    """Distributions that are null, empty, or have null, NaN or negative parts are refused."""
    kind = "case_id string, candidates array<string>, scores array<struct<candidate:string,probability:double>>"
    whole = [("a", 0.9), ("b", 0.1)]
    rows = [("none", ["a", "b"], None), ("empty", [], []), ("null", ["a", "b"], [("a", 1.0), ("b", None)]), ("nan", ["a", "b"], [("a", float("nan")), ("b", 0.1)]), ("below", ["a", "b"], [("a", 1.5), ("b", -0.5)]), ("unlisted", None, whole), ("entry", ["a", "b"], [("a", 1.0), None]), ("name", ["a", "b"], [("a", 1.0), (None, 0.0)]), ("good", ["a", "b"], whole)]
    df = spark.createDataFrame(rows, kind)
    out = {r.case_id: r for r in G.decide(df).collect()}
    assert {i for i, r in out.items() if r.action != "REJECT"} == {"good"} and all(r.decision is None and r.reason_code.startswith("INVALID_") for i, r in out.items() if i != "good")
    for i, *_ in rows[:-1]:
        with pytest.raises(Exception, match="invalid case"):
            G.require_valid(df.where(F.col("case_id") == i)).collect()
    asked = spark.createDataFrame([(None, ["a"]), ("t", None), ("t", ["a", "a"]), ("t", ["a"])], "d string, c array<string>")
    assert [len(r.v) > 0 for r in asked.select(S.request_violations("d", "c").alias("v")).collect()] == [True, True, True, False]


def first_wins(df):
    """A scorer that gives 0.9 to what is listed first."""
    return df.withColumn("scores", F.transform("candidates", lambda c, i: F.struct(c.alias("candidate"), F.when(i == 0, 0.9).otherwise(0.1).alias("probability"))))


def test_permutation(spark):
    cases = scored(spark, [("1", {"a": 0.5, "b": 0.5}, "a"), ("2", {"b": 0.5, "a": 0.5}, "b")]).select("case_id", "candidates", "gold")
    row = R.permutation_report(R.permutation_cases(cases, first_wins)).first()
    assert (row["baseline_accuracy"], row["comparison_count"], row["flip_rate"], row["perturbed_accuracy"]) == (1.0, 2, 1.0, 0.0)
    alone = scored(spark, [("1", {"a": 1.0}, "a")]).select("case_id", "candidates", "gold")
    row = R.permutation_report(R.permutation_cases(alone, first_wins)).first()
    assert (row["comparison_count"], row["flip_rate"], row["perturbed_accuracy"]) == (0, 0.0, 1.0)


def test_variants(spark):
    df = spark.createDataFrame([("1", list("abc")), ("2", list("ab")), ("3", ["a"])], "case_id string, candidates array<string>")
    rows = {(r["case_id"], r["variant"]): "".join(r["candidates"]) for r in R.permutation_variants(df).collect()}
    assert rows == {("1", "reverse"): "cba", ("1", "rotate_left_1"): "bca", ("2", "reverse"): "ba"}


def case(i, p, abstain, gold="a", **more):
    return (i, {"a": p, "b": 1 - p}, gold, {"expected_abstain": abstain} | more)


def test_abstention(spark):
    cases = scored(spark, [case("1", 0.9, False), case("2", 0.6, False), case("3", 0.95, True), case("4", 0.55, True)])
    r = R.abstention_report(R.abstention_cases(cases, 0.8)).first()
    assert (r["false_accept_rate"], r["false_reject_rate"], r["covered_accuracy"], r["coverage"], r["unsafe_rate"]) == (0.5, 0.5, 1.0, 0.5, 0.25)
    only = scored(spark, [case("1", 0.55, True, None)])
    row = R.abstention_cases(only, 0.8).first()
    r = R.abstention_report(R.abstention_cases(only, 0.8)).first()
    assert row["correct_when_covered"] is None and r["false_accept_rate"] == 0 and r["false_reject_rate"] is None
    for gold in ("z", None):
        with pytest.raises(Exception, match="gold label"):
            R.abstention_cases(scored(spark, [case("1", 0.9, False, gold)]), 0.5).collect()


def test_groups(spark):
    rows = [case("1", 0.95, True, None, coverage="covered", ambiguity="underspecified"), case("2", 0.6, True, None, coverage="covered", ambiguity="underspecified"), case("3", 0.9, True, None, coverage="missing_candidate"), case("4", 0.6, True, None, coverage="unsupported")]
    out = {(r["group_key"], r["group_value"]): r["false_accept_rate"] for r in R.abstention_groups(R.abstention_cases(scored(spark, rows), 0.8)).collect()}
    assert (out["abstention_reason", "underspecified"], out["abstention_reason", "missing_candidate"], out["abstention_reason", "unsupported"]) == (0.5, 1.0, 0.0)
    assert out["automation_risk", "unknown"] == 0.5
    with pytest.raises(Exception, match="expected to abstain"):
        R.abstention_groups(R.abstention_cases(scored(spark, [case("1", 0.9, False)]), 0.8)).collect()


def test_transfer(spark):
    r = R.threshold_transfer(predictions(spark, [(0.9, True), (0.7, False)]), predictions(spark, [(0.85, True), (0.9, False)]), 0.8).first()
    assert (r["source_coverage"], r["source_risk"], r["target_coverage"], r["target_risk"]) == (0.5, 0.0, 1.0, 0.5)
    assert (r["delta_coverage"], r["delta_risk"], r["delta_false_automation_rate"]) == (0.5, 0.5, 0.5)


def test_fallback(spark):
    fast = scored(spark, [("1", {"a": 0.95, "b": 0.05}, "a"), ("2", {"a": 0.55, "b": 0.45}, "b")])
    second = lambda df: df.withColumn("scores", F.transform("candidates", lambda c: F.struct(c.alias("candidate"), F.when(c == F.col("gold"), 1.0).otherwise(0.0).alias("probability"))))
    cases = R.fallback_cases(fast, second, 0.8)
    r = R.fallback_report(fast, cases).first()
    assert (cases.first()["case_id"], r["fallback_count"], r["fallback_rate"], r["fallback_accuracy"]) == ("2", 1, 0.5, 1.0)
    r = R.fallback_report(fast, R.fallback_cases(fast, second, 0.1)).first()
    assert (r["fallback_count"], r["fallback_rate"], r["fallback_accuracy"], r["p50_latency_ms"]) == (0, 0.0, None, None)
    for broken in (lambda df: df.withColumn("scores", F.slice("scores", 1, 1)), lambda df: df.withColumn("scores", F.lit(None).cast("array<struct<candidate:string,probability:double>>"))):
        with pytest.raises(Exception, match="second scorer"):
            R.fallback_cases(fast, broken, 0.8).collect()
    with pytest.raises(ValueError):
        R.require_distinct(fast.union(fast))


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.9, 0.1]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    near, far = [r["c"] for r in df.select(S.cosine("a", "b").alias("c")).collect()]
    assert near == pytest.approx(0.9 / (0.82**0.5)) and far == -1
