"""Metrics on small inputs with known values."""

from __future__ import annotations

import math

import pytest
from helpers import predictions, scored

from gatewright.functions import scores as S
from gatewright.operators import calibrate as C
from gatewright.operators import metrics as M


def one(df):
    return df.first().asDict()


def test_risk_coverage(spark):
    rows = {r["threshold"]: r for r in M.risk_coverage(predictions(spark, [(0.95, True), (0.90, False), (0.60, True)]), [0.5, 0.9, 0.96]).collect()}
    assert [rows[t]["coverage"] for t in (0.5, 0.9, 0.96)] == pytest.approx([1, 2 / 3, 0])
    assert [rows[t]["fallback_rate"] for t in (0.5, 0.9, 0.96)] == pytest.approx([0, 1 / 3, 1])
    assert rows[0.9]["false_automation_rate"] == pytest.approx(1 / 3)
    assert rows[0.96]["risk"] == 0


def test_risk_coverage_keeps_the_order_of_thresholds(spark):
    rows = M.risk_coverage(predictions(spark, [(0.5, True)]), [0.9, 0.1, 0.5]).orderBy("ordinal").collect()
    assert [(r["threshold"], r["accepted"]) for r in rows] == [(0.9, 0), (0.1, 1), (0.5, 1)]


def test_operating_point(spark):
    results = predictions(spark, [(0.99, True), (0.91, True), (0.82, False), (0.70, True)])
    p = one(M.operating_point(M.risk_coverage(results, [0.7, 0.8, 0.9, 0.95]), 0.0))
    assert (p["threshold"], p["coverage"], p["risk"], p["fallback_rate"]) == (0.9, 0.5, 0.0, 0.5)
    assert M.operating_point(M.risk_coverage(predictions(spark, [(0.99, False)]), [0.9]), 0.0).count() == 0


def test_perfect_calibration(spark):
    results = predictions(spark, [(1.0, True), (0.0, False)])
    assert results.agg(M.brier().alias("x")).first()["x"] == 0
    assert M.ece(results).first()["ece"] == 0


def test_bins_at_edges(spark):
    values = [0.8999999999999999, 1.0, 0.1, 0.0, 0.3, 0.30000000000000004]
    rows = spark.createDataFrame([(v,) for v in values], "confidence double").select(S.bin_of("confidence").alias("b")).collect()
    assert [r["b"] for r in rows] == [8, 9, 1, 0, 3, 3]


def test_macro_f1(spark):
    rows = [(str(i), p, g, 1.0, p == g, 1.0) for i, (g, p) in enumerate(zip("aabb", "abbb"))]
    results = spark.createDataFrame(rows, "case_id string, predicted string, gold string, confidence double, correct boolean, gold_probability double")
    assert M.macro_f1(results).first()["macro_f1"] == pytest.approx((2 / 3 + 4 / 5) / 2)


def test_multiclass_nll(spark):
    results = spark.createDataFrame([(0.8,), (0.5,)], "gold_probability double")
    assert results.agg(M.multiclass_nll().alias("x")).first()["x"] == pytest.approx(0.458145, abs=1e-6)


#: Confidence and whether the top candidate was right, of a published run of four cases: Brier 0.1852, ECE 0.4285.
PUBLISHED = [(0.5158, True), (0.4479, False), (0.5984, True), (0.3803, False)]


def test_published_run(spark):
    results = predictions(spark, PUBLISHED)
    assert results.agg(M.brier().alias("x")).first()["x"] == pytest.approx(0.185244, abs=1e-6)
    assert M.ece(results).first()["ece"] == pytest.approx(0.4285, abs=1e-4)


def test_benchmark_guards(spark):
    good = scored(spark, [("1", {"a": 0.6, "b": 0.4}, "a", {"latency_ms": 2.0})])
    out = M.run_benchmark(good, risk_budget=0.5)
    assert out["summary"].first()["accuracy"] == 1 and out["summary"].first()["mean_tokens"] is None
    assert out["operating_point"].count() == 1
    with pytest.raises(ValueError):
        M.run_benchmark(good, min_coverage=0.5)
    with pytest.raises(ValueError):
        M.run_benchmark(good.limit(0))
    for bad in ([("1", {"a": 0.6, "b": 0.4}, None)], [("1", {"a": 0.6, "b": 0.4}, "c")], [("1", {"a": 0.6, "b": 0.6}, "a")]):
        with pytest.raises(ValueError):
            M.run_benchmark(scored(spark, bad))


def test_ties_go_to_the_first_listed(spark):
    row = M.case_results(scored(spark, [("1", {"b": 0.4, "a": 0.4, "c": 0.2}, "b")])).first()
    assert (row["predicted"], row["correct"]) == ("b", True)


def test_temperature_scaling(spark):
    row = scored(spark, [("1", {"a": 0.8, "b": 0.2}, "a")]).select(S.temperature_scaled("scores", 2.0).alias("s")).first()["s"]
    assert [x["probability"] for x in row] == pytest.approx([2 / 3, 1 / 3])
    with pytest.raises(ValueError):
        S.temperature_scaled("scores", 0.0)


def test_fit_temperature(spark):
    cases = scored(spark, [("1", {"a": 0.99, "b": 0.01}, "b"), ("2", {"a": 0.9, "b": 0.1}, "a")])
    fit = one(C.fit_temperature(cases, 0.1, 20.0, 100))
    assert fit["temperature"] > 1 and fit["nll_after"] < fit["nll_before"]
    expected = min(((math.fsum(-math.log(math.exp(math.log(g) / t) / sum(math.exp(math.log(p) / t) for p in ps)) for g, ps in ((0.01, (0.99, 0.01)), (0.9, (0.9, 0.1)))) / 2, t) for t in C.grid(0.1, 20.0, 100)))
    assert fit["temperature"] == pytest.approx(expected[1]) and fit["nll_after"] == pytest.approx(expected[0])


def test_grid():
    g = C.grid()
    assert len(g) == 200 and g[0] == pytest.approx(0.05) and g[-1] == pytest.approx(10) and any(abs(t - 1.9709) < 1e-4 for t in g) and any(abs(t - 5.0045) < 1e-4 for t in g)


def test_calibration_needs_gold(spark):
    with pytest.raises(ValueError):
        C.check_examples(scored(spark, [("1", {"a": 1.0}, "b")]))


def test_structured_choice(spark):
    df = spark.createDataFrame([("d", 0.0, list("abcd")), ("a", 0.7, list("abc")), ("a", 0.2, ["a"]), ("x", 0.5, list("ab")), ("a", 2.0, list("ab"))], "c string, p double, l array<string>")
    rows = [r["s"] for r in df.select(S.structured_choice("c", "p", "l").alias("s")).collect()]
    first = [x["probability"] for x in rows[0]]
    assert first[3] > max(first[:3]) and sum(first) == pytest.approx(1)
    assert [x["probability"] for x in rows[1]] == pytest.approx([0.7, 0.15, 0.15])
    assert [x["probability"] for x in rows[2]] == [1.0]
    assert rows[3] is None and rows[4] is None


def test_parse_choice(spark):
    texts = ['prefix {"candidate":"read_logs","confidence":0.8} suffix', '{"candidate":"read_logs"}', '{"candidate":"other"}', '{"candidate":"read_logs","confidence":2}', "none", None, '{"candidate":', '{"candidate":"read_logs","confidence":null}', '{"candidate":"read_logs","confidence":"high"}']
    df = spark.createDataFrame([(t, ["read_logs", "b"]) for t in texts], "t string, l array<string>")
    rows = [r["c"] for r in df.select(S.parse_choice("t", "l").alias("c")).collect()]
    assert tuple(rows[0]) == ("read_logs", 0.8) and tuple(rows[1]) == ("read_logs", 1.0) and rows[2:] == [None] * 7
    said = spark.createDataFrame([('{"candidate":"b","confidence":"0.5"}', ["b"]), ('{"candidate":"b","confidence":true}', ["b"])], "t string, l array<string>")
    assert [r["c"]["confidence"] for r in said.select(S.parse_choice("t", "l").alias("c")).collect()] == [0.5, 1.0]


def test_softmax_and_prior(spark):
    df = spark.createDataFrame([(list("abc"), [-0.2, -0.5, -2.0], [-0.1, -2.0, -1.0])], "l array<string>, task array<double>, prior array<double>")
    for alpha, top in ((1.0, "b"), (0.0, "a")):
        s = df.select(S.top1(S.candidate_softmax("l", S.prior_corrected("task", "prior", alpha))).alias("t")).first()["t"]
        assert s["candidate"] == top
    with pytest.raises(ValueError):
        S.prior_corrected("task", "prior", -1.0)
