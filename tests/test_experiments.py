"""Experiments, scorers, suites, validators, seals, sources and the service."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

import pandas as pd
import pytest
from helpers import scored
from pyspark.sql import functions as F

from gatewright import cli
from gatewright.functions import scores as S
from gatewright.functions.canonical import canonical_json, digest, json_digest, same_value
from gatewright.operators import experiments as X
from gatewright.operators import gate as G
from gatewright.operators import metrics as M
from gatewright.operators import scoring, seal
from gatewright.operators import suites as U
from gatewright.operators import validate as V
from gatewright.service import build_server, decide_one
from gatewright.sources import cases as K
from gatewright.sources import embeddings as E
from gatewright.sources import tools as T


def confident(df):
    """0.99 for the gold label, or for the first candidate where there is none."""
    best = F.when(F.array_contains("candidates", F.col("gold")), F.col("gold")).otherwise(F.element_at("candidates", 1))
    rest = F.lit(0.01) / F.greatest(F.size("candidates") - 1, F.lit(1))
    return df.withColumn("scores", F.transform("candidates", lambda c: F.struct(c.alias("candidate"), F.when(c == best, 0.99).otherwise(rest).alias("probability"))))


def cases(spark, n, start=0, **more):
    rows = [(f"c{start + i}", {"a": 0.5, "b": 0.5}, "ab"[i % 2], more) for i in range(n)]
    return scored(spark, rows).drop("scores")


def test_calibrated_experiment(spark):
    out = X.calibrated_experiment(cases(spark, 4), cases(spark, 4, 10), confident)
    rows = {r["variant"]: r for r in out["reports"].collect()}
    assert set(rows) == {"raw", "calibrated"} and rows["raw"]["accuracy"] == 1 and out["fit"].nll_after <= out["fit"].nll_before + 1e-9


def test_quality_experiment(spark, tmp_path):
    left = cases(spark, 4, 20, expected_abstain=True, coverage="unsupported", ambiguity="clear", automation_risk="low")
    out = X.quality_experiment(cases(spark, 4), cases(spark, 4, 10), left, confident, risk_budget=0.0, thresholds=[0.5])
    assert (out["threshold"].value, out["threshold"].selection) == (0.5, "calibration_risk_budget")
    assert out["test"].first()["accuracy"] == 1 and out["abstention"].first()["false_accept_rate"] == 1
    X.write_report(out, str(tmp_path / "r.json"), {"run": 1})
    assert json.loads((tmp_path / "r.json").read_text())["metadata"] == {"run": 1}
    for sets in ((cases(spark, 4), cases(spark, 4, 10), left.unionByName(cases(spark, 1, 90, expected_abstain=False))), (cases(spark, 4), cases(spark, 4, 10).limit(0), left)):
        with pytest.raises(ValueError):
            X.quality_experiment(*sets, confident)
    X.release()
    assert not X._kept


def test_median_where_no_point_fits(spark):
    wrong = scored(spark, [("1", {"a": 0.9, "b": 0.1}, "b"), ("2", {"a": 0.7, "b": 0.3}, "b")])
    t = X.choose_threshold(M.case_results(wrong), 0.0)
    assert (t.value, t.selection) == (pytest.approx(0.8), seal.MEDIAN)


@pytest.fixture(scope="module")
def inventory(spark):
    return spark.createDataFrame([(f"s::t{i:02}", f"reads thing {i}", "s") for i in range(12)], "name string, description string, server string")


def asked(spark, n=3):
    return spark.createDataFrame([(f"c{i}", f"s::t{i:02}", f"read thing {i}") for i in range(n)], "case_id string, gold string, query string")


def test_suites(spark, inventory):
    covered = U.suite(asked(spark), inventory, [10, 5, 5], "random", 1).collect()
    assert covered == U.suite(asked(spark), inventory.repartition(7), [5, 10], "random", 1).collect()
    by = {(r.parent_case_id, r.candidate_count): r for r in covered}
    assert all(r.gold in r.candidates and len(r.candidates) == r.candidate_count for r in covered)
    assert all(set(by[c, 5].candidates) <= set(by[c, 10].candidates) for c in ("c0", "c1", "c2"))
    missing = U.suite(asked(spark), inventory, [5, 10], "lexical", 1, missing=True).collect()
    assert all(r.gold not in r.candidates and len(r.candidates) == r.candidate_count and r.expected_abstain for r in missing)
    assert {r.case_id for r in missing} >= {"c0::missing::k5::lexical"} and by["c0", 5].case_id == "c0::k5::random"
    for sizes in ([1], [], [50]):
        with pytest.raises(ValueError):
            U.suite(asked(spark), inventory, sizes)


def test_large_inventories_rank_the_same(spark, inventory, monkeypatch):
    near = {s: U.distractors(asked(spark), inventory, 6, s).orderBy("case_id").select("case_id", "ranked").collect() for s in ("random", "lexical")}
    monkeypatch.setattr(U, "BLOCK_ROWS", 3)
    for s, want in near.items():
        assert U.distractors(asked(spark), inventory, 6, s).orderBy("case_id").select("case_id", "ranked").collect() == want


def test_gold_must_be_a_tool(spark, inventory):
    for strategy in ("random", "lexical"):
        with pytest.raises(ValueError, match="gold label"):
            U.suite(asked(spark).withColumn("gold", F.lit("s::none")), inventory, [5], strategy)
    with pytest.raises(ValueError, match="gold label"):
        U.suite(asked(spark).withColumn("gold", F.lit(None).cast("string")), inventory, [5])


def test_rankers(spark, inventory):
    """A ranker of one's own orders the other tools; it must give each of them once."""
    pairs = lambda c, t: c.crossJoin(t.select("name")).where("name <> gold").groupBy("case_id")

    def backwards(c, t):
        return pairs(c, t).agg(F.reverse(F.array_sort(F.collect_list("name"))).alias("ranked"))

    out = U.suite(asked(spark), inventory, [3], backwards).collect()
    assert {r.case_id for r in out} == {f"c{i}::k3::backwards" for i in range(3)} and all({"s::t11", "s::t10", r.gold} == set(r.candidates) for r in out)
    for bad in (lambda c, t: pairs(c, t.limit(5)).agg(F.collect_list("name").alias("ranked")), lambda c, t: backwards(c, t).limit(2), lambda c, t: backwards(c, t).withColumn("ranked", F.transform("ranked", lambda x: F.lit("s::t09")))):
        with pytest.raises(ValueError, match="ranker"):
            U.suite(asked(spark), inventory, [3], bad, label="bad")


def test_lexical_neighbors_either_way(spark, monkeypatch):
    queries = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["c"]), (4, None), (5, ["z"])], "query_id long, words array<string>")
    items = spark.createDataFrame([(7, ["a"]), (2, ["a", "b"]), (3, ["b", "a"]), (4, []), (9, ["c", "a"])], "item_id long, words array<string>")
    run = lambda: sorted((r.query_id, r["rank"], r.item_id, round(r.similarity, 9)) for r in U.lexical_neighbors(queries, items, 3).collect())
    near = run()
    assert near[:3] == [(1, 1, 2, 1.0), (1, 2, 3, 1.0), (1, 3, 7, 0.5)] and [r[2] for r in near if r[0] == 2] == [2, 3, 4] and [r[2:] for r in near if r[0] == 3] == [(9, 0.5), (2, 0.0), (3, 0.0)]
    monkeypatch.setattr(U, "INDEX_WORDS", 1)
    assert run() == near


def test_lexical_and_semantic_order(spark):
    tools = spark.createDataFrame([("metrics.latency", "API latency metrics", "m", [0.9, 0.1]), ("logs.search", "search logs", "l", [0.4, 0.6]), ("deploy.run", "run a deployment", "d", [-1.0, 0.0]), ("gold", "nothing", "g", [1.0, 0.0])], "name string, description string, server string, vector array<double>")
    one = spark.createDataFrame([("c", "gold", "check API latency metrics for checkout")], "case_id string, gold string, query string")
    assert U.distractors(one, tools.drop("vector"), 3, "lexical").first().ranked[0] == "metrics.latency"
    assert U.distractors(one, tools, 3, "semantic").first().ranked == ["metrics.latency", "logs.search", "deploy.run"]


def test_stress_experiment(spark, inventory):
    base = asked(spark, 4).select("case_id", F.array(F.lit("a"), "gold").alias("candidates"), "gold")
    suites = [U.suite(asked(spark, 4), inventory, [5, 10], "random", 1, missing) for missing in (False, True)]
    out = X.stress_experiment(base, base, *suites, confident, risk_budget=0.0, min_coverage=0.5, permutation_cases=2)
    assert out["threshold"].selection == "calibration_risk_budget"
    assert {r["k"]: r["accuracy"] for r in out["covered"].collect()} == {5: 1.0, 10: 1.0}
    assert {r["k"]: r["false_accept_rate"] for r in out["abstention"].collect()} == {5: 1.0, 10: 1.0}
    assert {r["k"]: r["comparison_count"] for r in out["permutation"].collect()} == {5: 4, 10: 4}
    assert {r["k"]: (r["source_coverage"], r["delta_coverage"]) for r in out["transfer"].collect()} == {5: (1.0, 0.0), 10: (1.0, 0.0)}
    with pytest.raises(ValueError):
        X.stress_experiment(base, base, suites[0], suites[1].where("candidate_count = 5"), confident)


def test_requests_are_scored_once(spark):
    seen = spark.sparkContext.accumulator(0)

    class Model:
        def __call__(self, b: pd.DataFrame) -> pd.DataFrame:
            seen.add(len(b))
            return pd.DataFrame({"scores": [[{"candidate": c, "probability": 1 / len(x)} for c in x] for x in b["candidates"]], "latency_ms": 1.0, "tokens": 2, "parse_valid": True})

    rows = [(str(i), "t", ["a", "b"], '{"x": 1, "y": 2}' if i % 2 else '{"y":2,"x":1}') for i in range(6)] + [("6", "t", ["b", "a"], '{"x":1,"y":2}')]
    df = spark.createDataFrame(rows, "case_id string, decision_type string, candidates array<string>, context string")
    out = scoring.cached(scoring.batch_scorer(Model, ["candidates"]))(df).collect()
    assert len(out) == 7 and seen.value == 2 and {r.tokens for r in out} == {2}


def test_scorers(spark):
    df = spark.createDataFrame([("1", ["a", "b"], "{}")], "case_id string, candidates array<string>, text string")
    assert scoring.structured_scorer()(df).first().parse_valid is False
    with pytest.raises(Exception, match="does not parse"):
        scoring.structured_scorer(strict=True)(df).collect()
    table = spark.createDataFrame([("1", "a", 0.3), ("1", "b", 0.7)], "case_id string, candidate string, probability double")
    assert [s.probability for s in scoring.lookup_scorer(table)(df).first().scores] == [0.3, 0.7]
    with pytest.raises(Exception, match="no score"):
        scoring.lookup_scorer(table.where("candidate = 'a'"))(df).collect()


def test_prompts(spark):
    df = spark.createDataFrame([("route", ["x", "y"], {"b": "2", "a": "1"}), ("route", ["x"], {}), ("route", ["x"], None)], "t string, c array<string>, m map<string,string>")
    rows = df.select(scoring.default_prompt("t", "c", "m").alias("d"), scoring.compact_prompt("t", "m").alias("c"), scoring.neutral_prompt("t").alias("n"), scoring.structured_prompt("t", "c", "m").alias("s")).collect()
    assert rows[0].d == "Decision type: route\nCandidates: x, y\nContext:\na: 1\nb: 2\nChoose exactly one candidate:\n" and rows[0].c == "Decision type: route\nContext:\na: 1\nb: 2\nBest matching candidate: "
    assert rows[1].d == rows[2].d == "Decision type: route\nCandidates: x\nChoose exactly one candidate:\n" and rows[0].n == "Decision type: route\nContext:\ntask_evidence: unavailable\nBest matching candidate: "
    assert rows[0].s.endswith('Context:\na: 1\nb: 2\nFormat: {"candidate":"<allowed>","confidence":0.0}\n') and "\nAllowed candidates: x, y\n" in rows[0].s


def test_models_behind_scorers(spark):
    """Fake models: candidates in batches, values by length, generated text that parses or not."""
    sizes = []
    model = scoring.CandidateLogprobs(lambda prompt, part: sizes.append(len(part)) or [-float(len(c)) for c in part], str.split, 2)
    values, tokens = model.of("a prompt", ["x y", "x y z", "q", "q q", "r"])
    assert sizes == [2, 2, 1] and values == [-1.5, -5 / 3, -1, -1.5, -1] and tokens == 2 * 5 + 9
    assert scoring.CandidateLogprobs(lambda p, c: [1.0] * len(c)).of("p", ["a"]) == ([1.0], None)
    for bad in (lambda: scoring.CandidateLogprobs(len, candidate_batch_size=0), lambda: model.of("p", []), lambda: model.of("p", [" "]), lambda: scoring.CandidateLogprobs(lambda p, c: [1.0]).of("p", ["a", "b"])):
        with pytest.raises(ValueError):
            bad()
    df = spark.createDataFrame([("1", ["a", "bb"], "p"), ("2", ["bb", "a"], "q")], "case_id string, candidates array<string>, prompt string")
    out = scoring.batch_scorer(lambda: scoring.CandidateLogprobs(lambda prompt, part: [-float(len(c)) for c in part]), ["prompt", "candidates"])(df).collect()
    assert all(max(r.scores, key=lambda s: s.probability).candidate == "a" and sum(s.probability for s in r.scores) == pytest.approx(1) for r in out)
    texts = {"p": ('so {"candidate": "a", "confidence": "0.75"}', 9), "q": ("none", 4)}
    rows = {r.case_id: r for r in scoring.batch_scorer(lambda: scoring.GeneratedChoice(texts.__getitem__), ["prompt", "candidates"])(df).collect()}
    assert rows["1"].parse_valid and rows["1"].scores[0].probability == 0.75 and not rows["2"].parse_valid and rows["2"].scores[0].probability == 0.5 and rows["2"].tokens == 4


def test_calibrators(spark):
    df = cases(spark, 2)
    same, flat = (scoring.calibrated(confident, c)(df).select("scores").collect() for c in (scoring.identity(), 10.0))
    assert same == confident(df).select("scores").collect() and max(s.probability for s in flat[0].scores) < 0.7


def test_priors(spark):
    task = spark.createDataFrame([("1", ["a", "b"], [-1.0, -2.0])], "case_id string, candidates array<string>, logits array<double>")
    prior = spark.createDataFrame([("a", -0.5), ("b", -3.0)], "candidate string, neutral double")
    scores = scoring.with_priors(task, prior).first().scores
    assert [s.candidate for s in scores] == ["a", "b"] and scores[1].probability > scores[0].probability
    with pytest.raises(Exception, match="no prior for b"):
        scoring.with_priors(task, prior.where("candidate = 'a'")).collect()
    with pytest.raises(ValueError):
        scoring.with_priors(task, prior, -1.0)


def test_demonstration_rules(spark):
    rows = [("1", ["read_logs", "x"], '{"intent": "Error in LOG"}'), ("2", ["x", "y"], '{"intent": "cpu"}'), ("3", ["read_metrics"], '{"intent": "cpu"}'), ("4", ["read_logs", "x"], '{"q": "error"}')]
    df = spark.createDataFrame(rows, "case_id string, candidates array<string>, context string")
    got = {r.case_id: [s.probability for s in r.scores] for r in scoring.rule_scorer("context")(df).collect()}
    assert got == {"1": [0.9, 0.1], "2": [0.5, 0.5], "3": [1.0], "4": [0.5, 0.5]}
    from gatewright.service import intent_score

    for i, c, x in rows:
        assert list(intent_score({"candidates": c, "context": json.loads(x)}).values()) == got[i]


# --- contracts and seals ---------------------------------------------------------------------


def test_canonical(spark):
    value = {"b": [1e-7, 123456789.0, True, None], "a": "é"}
    assert canonical_json(value) == '{"a":"é","b":[1e-07,123456789.0,true,null]}'
    with pytest.raises(ValueError):
        canonical_json(float("nan"))
    row = spark.createDataFrame([('{"b": [1e-7, 123456789.0, true, null], "a": "é"}', '{"a":"é","b":[1e-7,123456789.0,true,null]}')], "x string, y string").select(json_digest("x").alias("d"), (same_value("x") == same_value("y")).alias("same")).first()
    assert row.d == digest(value) and row.same


METRICS = {"accuracy": 0.5, "macro_f1": 0.4, "nll": 1.0, "brier": 0.2, "ece": 0.1, "mean_latency_ms": 5.0, "p50_latency_ms": 4.0, "p95_latency_ms": 9.0, seal.TOKENS: None}
DATA = {"sha256": digest("test"), "case_count": 2, "case_ids": ["1", "2"]}


def artifact(**more):
    return seal.build_artifact(**({"adapter": "x", "decision_type": "t", "dataset": DATA, "metrics": METRICS} | more))


@pytest.mark.parametrize(
    ("path", "value"),
    [
        (("metrics", "accuracy"), 1.5), (("metrics", "p50_latency_ms"), 99.0), (("metrics", "nll"), -1.0), (("metrics", "accuracy"), True), (("metrics", seal.TOKENS), -1), (("dataset", "case_ids"), ["1", "1"]), (("dataset", "sha256"), "abc"),
        (("dataset", "case_count"), 3), (("schema_version",), "v0"), (("adapter",), ""), (("model_ref",), ""), (("calibration_sha256",), "x"), (("fallback_evaluation", "measured"), None), (("operating_point",), {"threshold": 0.5}),
    ],
)
def test_changed_artifacts(path, value):
    a = artifact()
    seal.verify_artifact(a)
    assert a["artifact_id"] == "decision-eval:" + a["content_digest"]
    b = json.loads(json.dumps(a))
    at = b
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = value
    again = seal._named({k: v for k, v in b.items() if k not in ("artifact_id", "content_digest")}, "artifact_id", "decision-eval")
    for changed in (b, again):
        assert seal.problem_in(changed) and not seal.is_sound(changed)
    assert seal.problem_in([]) and seal.problem_in({})


def test_artifact_parts():
    point = {"threshold": 0.8, "coverage": 0.5, "risk": 0.2, "false_automation_rate": 0.1, "fallback_rate": 0.5, "risk_budget": 0.3}
    artifact(operating_point=point)
    for k, v in (("risk", 0.4), ("coverage", 0.0), ("false_automation_rate", 0.3), ("fallback_rate", 0.4)):
        with pytest.raises(ValueError):
            artifact(operating_point=point | {k: v})
    cal = {"sha256": digest("cal"), "case_count": 1, "case_ids": ["9"]}
    assert artifact(calibration=cal)["calibration_sha256"] == cal["sha256"]
    for change in ({"case_ids": ["1"]}, {"sha256": "x"}, {"case_count": 2}, {"case_ids": []}):
        with pytest.raises(ValueError):
            artifact(calibration=cal | change)
    for more in ({"calibration": cal, "calibration_sha256": digest("z")}, {"report_case_ids": ["2", "1"]}, {"model_ref": ""}):
        with pytest.raises(ValueError):
            artifact(**more)


CASE = {"case_id": "1", "gold": "a", "fast_confidence": 0.5, "fast_predicted": "b", "fallback_predicted": "a", "correct": True, "latency_ms": 3.0, "tokens_processed": 4, "parse_valid": True}
FALLBACK = {
    "measured": True, "adapter": "second", "threshold": 0.8, "eligible_case_count": 2, "fallback_case_count": 1, "fallback_rate": 0.5, "accuracy": 1.0, "p50_latency_ms": 3.0, "p95_latency_ms": 3.0, "mean_tokens_processed": 4.0,
    "parse_valid_rate": 1.0, "cases": [CASE],
}


@pytest.mark.parametrize(
    "change",
    [
        {"adapter": ""}, {"threshold": 1.5}, {"threshold": 0.4}, {"eligible_case_count": 3}, {"eligible_case_count": True}, {"fallback_case_count": 2}, {"fallback_rate": 0.6}, {"accuracy": 0.0}, {"accuracy": None}, {"p95_latency_ms": 4.0}, {"p50_latency_ms": None},
        {"mean_tokens_processed": None}, {"mean_tokens_processed": 5.0}, {"parse_valid_rate": 0.5}, {"cases": None}, {"measured": "yes"}, {"cases": [CASE, CASE], "fallback_case_count": 2, "fallback_rate": 1.0},
        *({"cases": [CASE | c]} for c in ({"case_id": "7"}, {"fast_confidence": 0.9}, {"fast_confidence": None}, {"fast_predicted": ""}, {"gold": None}, {"correct": None}, {"latency_ms": -1}, {"tokens_processed": 1.5}, {"parse_valid": "x"})),
    ],
)
def test_fallback_rules(change):
    artifact(fallback=FALLBACK)
    artifact(fallback=FALLBACK | {"parse_valid_rate": None})
    with pytest.raises(ValueError):
        artifact(fallback=FALLBACK | change)


def test_fallback_without_cases():
    none = FALLBACK | {"fallback_case_count": 0, "fallback_rate": 0.0, "cases": [], "parse_valid_rate": None} | dict.fromkeys(("accuracy", "p50_latency_ms", "p95_latency_ms", "mean_tokens_processed"))
    artifact(fallback=none)
    for k in ("accuracy", "p50_latency_ms", "mean_tokens_processed"):
        with pytest.raises(ValueError):
            artifact(fallback=none | {k: 1.0})


def test_contract_matrix():
    m = seal.contract_matrix([artifact(adapter="b"), artifact(adapter="a", fallback=FALLBACK)])
    assert [r["adapter"] for r in m["rows"]] == ["b", "a"] and m["rows"][0]["operating_threshold"] is None and m["rows"][1]["fallback_adapter"] == "second" and m["dataset"] == DATA
    for bad in ([], [artifact(), artifact(dataset=DATA | {"sha256": digest("other")})], [artifact(), artifact(decision_type="u")], [artifact() | {"adapter": "y"}]):
        with pytest.raises(ValueError):
            seal.contract_matrix(bad)


PROFILE = {"adapter": "x", "model_ref": "m", "decision_type": "t", "calibration": {"sha256": digest("c"), "case_count": 1, "case_ids": ["9"]}, "temperature": 2.0, "execute_threshold": 0.6, "margin_threshold": 0.1, "risk_budget": 0.2, "selection": seal.BUDGET}


def test_profile(spark):
    p = seal.build_profile(**PROFILE)
    assert p["profile_id"] == "calibration-profile:" + p["content_digest"]
    seal.build_profile(**(PROFILE | {"selection": seal.MEDIAN}))  # a budget may be named that no threshold met
    df = scored(spark, [("1", {"a": 0.8, "b": 0.2}, None)]).withColumn("decision_type", F.lit("t"))
    decide = lambda rows, **kw: seal.decide_with_profile(rows, p, **({"adapter": "x", "model_ref": "m", "decision_type": "t"} | kw))
    row = decide(df).first()
    assert row.action == "EXECUTE" and row.confidence == pytest.approx(2 / 3)
    for kw in ({"adapter": "y"}, {"model_ref": "n"}, {"decision_type": "u"}, {"inventory_sha256": digest("i")}):
        with pytest.raises(ValueError):
            decide(df, **kw)
    with pytest.raises(ValueError):
        seal.decide_with_profile(df, seal.build_profile(**(PROFILE | {"selection": seal.MEDIAN})), adapter="x", model_ref="m", decision_type="t")
    for rows, why in ((df.withColumn("case_id", F.lit("9")), "calibration"), (df.withColumn("decision_type", F.lit("u")), "decision type"), (df.withColumn("scores", F.slice("scores", 1, 1)), "invalid case")):
        with pytest.raises(Exception, match=why):
            decide(rows).collect()
    for change in ({"temperature": -1.0}, {"risk_budget": None}, {"execute_threshold": 2.0}, {"adapter": ""}, {"inventory_sha256": "x"}, {"selection": "none"}, {"calibration": PROFILE["calibration"] | {"case_count": 2}}, {"calibration": {"sha256": digest("c")}}):
        with pytest.raises(ValueError):
            seal.build_profile(**(PROFILE | change))
    for changed in (p | {"temperature": 3.0}, p | {"more": 1}, {k: v for k, v in p.items() if k != "method"}, p | {"profile_id": "x"}):
        with pytest.raises(ValueError):
            seal.verify_profile(changed)


def test_typed_outputs(spark):
    assert V.decision_output("choice", "a", 0.5, ["a"])["schema_version"] == V.OUTPUT_VERSION and V.decision_output("score", None, None)["abstain"]
    for bad in (("choice", "a", 0.5), ("choice", "b", 0.5, ["a"]), ("boolean", 1, 0.5), ("score", 1.5, 0.5), ("score", 0.5, None), ("boolean", None, 0.5), ("other", None, None)):
        with pytest.raises(ValueError):
            V.decision_output(*bad)
    rows = [("null", None, "choice", '"b"', 5.0), ("void", False, "choice", "null", 0.5), ("ok", False, "choice", '"a"', 0.5), ("kind", True, None, None, None)]
    df = spark.createDataFrame(rows, "case_id string, abstain boolean, kind string, value string, confidence double").withColumns({"value": F.parse_json("value"), "candidates": F.array(F.lit("a")), "schema_version": F.lit("decision-output/v0")})
    found = {(r.case_id, r.rule) for r in V.decision_output_violations(df).collect()}
    assert found == {("null", "abstain"), ("null", "confidence"), ("null", "choice"), ("void", "value_missing"), ("kind", "kind")} | {(i, "schema_version") for i, *_ in rows}


def test_require_none(spark):
    V.require_none(spark.range(0))
    with pytest.raises(ValueError):
        V.require_none(spark.range(3))


# --- sources ---------------------------------------------------------------------------------


def test_case_lines(spark, tmp_path):
    lines = ['{"case_id": "1", "decision_type": "t", "candidates": ["a"], "gold_candidate": null, "context": {"k": 1.5, "ü": "é"}}', "", '{"case_id": "2", "decision_type": "t", "candidates": ["a", "b"], "gold_candidate": "b", "metadata": {"split": "test"}}']
    (tmp_path / "c.jsonl").write_text("\n".join(lines), encoding="utf-8")
    rows = K.read_cases(spark, str(tmp_path / "c.jsonl"))
    assert [(r.case_id, r.gold) for r in rows.orderBy("ordinal").collect()] == [("1", None), ("2", "b")]
    K.write_cases(rows, str(tmp_path / "out"))
    again = K.read_cases(spark, str(tmp_path / "out")).drop("ordinal")
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.withColumns({"context": F.to_json(F.parse_json("context"))}).drop("ordinal").collect()))
    for bad in ("{", '{"case_id": "1"}', '{"case_id": "1", "decision_type": "t", "candidates": ["a"], "gold_candidate": 5}'):
        (tmp_path / "bad.jsonl").write_text(bad)
        with pytest.raises(Exception, match="invalid case line"):
            K.read_cases(spark, str(tmp_path / "bad.jsonl")).collect()


CODE = '''
label = "computed"

@hub.tool(description="Weighs   the\\n parcel", name="weigh_parcel")
@hub.tool(name="scale")
async def weigh(): pass

@hub.tool(name=label)
def stamp():
    """Stamps
    it."""

@hub.tool
def bare(): pass

@tool(name="plain")
def unattached(): pass

_register_tool("Courier", stamp)
_register_tool(label, stamp)
self._register_tool("Hidden", stamp)
hub.tool(name="dispatch")(stamp)
hub.tool(name="track", description="Follows  it")(stamp)
hub.tool()(stamp)
'''


def test_tool_tree(spark, tmp_path):
    src = tmp_path / "src"
    (src / "post" / "tests").mkdir(parents=True)
    (src / "post" / "deep").mkdir()
    (src / "post" / "a.py").write_text(CODE)
    (src / "post" / "b.py").write_text(CODE + "\n(")
    (src / "post" / "c.py").write_text('@x.tool()\ndef stamp(): "again"\n')
    (src / "post" / "deep" / "d.py").write_text('@x.tool()\ndef seal_it(): "Seals."\n')
    (src / "post" / "e.py").write_bytes(b'@x.tool()\ndef latin(): "\xff"\n')
    (src / "post" / "tests" / "t.py").write_text("@x.tool()\ndef hidden(): pass\n")
    (src / "top.py").write_text("@x.tool()\ndef top(): pass\n")
    (tmp_path / "other.py").write_text("@x.tool()\ndef other(): pass\n")
    found = {r.name: r.description for r in T.extract_tools(T.python_tree(spark, str(tmp_path))).collect()}
    assert found == {"post::weigh_parcel": "Weighs the parcel", "post::scale": "", "post::stamp": "Stamps it.", "post::Courier": "", "post::dispatch": "", "post::track": "Follows it", "post::seal_it": "Seals."}
    made = T.tree_inventory(spark, str(tmp_path), "inv", "o/r", "f" * 40)
    assert made["source"] == {"kind": "github-source-tree", "repository": "o/r", "revision": "f" * 40, "extraction": "python-ast-mcp-tool-v1"}
    assert {t["name"]: t["metadata"] for t in made["tools"]}["post::seal_it"] == {"upstream_tool_name": "seal_it", "source_path": "src/post/deep/d.py"}


def test_inventory(spark, tmp_path):
    path = str(tmp_path / "i.json")
    made = T.make_inventory("inv", [{"name": "b", "server": "s"}, {"name": "a", "server": "s", "description": "d"}])
    T.write_inventory(made, path)
    assert sorted(r.name for r in T.load_inventory(spark, path).collect()) == ["a", "b"]
    # what may be left out is as if it were there
    bare = {"inventory_id": "inv", "tools": [{"name": "b", "server": "s"}, {"name": "a", "server": "s", "description": "d"}], "sha256": made["sha256"]}
    assert T.read_inventory(json.dumps(bare)) == made
    for change in ({"inventory_id": "other"}, {"schema_version": "v0"}, {"tools": []}):
        with pytest.raises(ValueError):
            T.read_inventory(json.dumps(made | change))
    for bad in ([], [{"name": "a", "server": "s"}] * 2, [{"name": "a", "server": ""}]):
        with pytest.raises(ValueError):
            T.make_inventory("inv", bad)


def test_embedding_snapshot(spark, tmp_path):
    path = str(tmp_path / "e.json")
    E.write_snapshot(E.snapshot("e", "inv", "0" * 64, {"a": [1.0, 0.0], "b": [0.5, 0.5]}), path)
    tools = spark.createDataFrame([("a",), ("b",)], "name string")
    assert E.load_snapshot(spark, path, tools, "0" * 64).count() == 2
    with pytest.raises(ValueError):
        E.load_snapshot(spark, path, tools.limit(1))
    made = E.snapshot("e", "inv", "0" * 64, {"b": [0.5, 0.5], "a": [1.0, 0.0]}, {"id": "m"})
    assert made["dimension"] == 2 and [v["tool"] for v in made["vectors"]] == ["a", "b"] and E.read_snapshot(json.dumps(made)) == made
    for change in ({"dimension": 3}, {"embedding_id": "x"}, {"schema_version": "v0"}, {"sha256": "0"}):
        with pytest.raises(ValueError):
            E.read_snapshot(json.dumps(made | change))
    for vectors in ({"a": [1.0], "b": [0.5, 0.5]}, {"a": [0.0]}, {"a": [float("nan")]}, {"a": []}, {}, {"": [1.0]}):
        with pytest.raises(ValueError):
            E.snapshot("e", "inv", "0" * 64, vectors)


def test_model_snapshot(tmp_path):
    revision = "a" * 40
    root = tmp_path / "snapshots" / revision
    root.mkdir(parents=True)
    (root / "config.json").write_text("{}")
    with pytest.raises(ValueError):
        T.freeze_snapshot(str(root), "org/model", revision)
    blob = tmp_path / "blob"
    blob.write_bytes(b"123")
    (root / "w.safetensors").symlink_to(blob)  # a link within the cache
    folder, s = T.fetch_snapshot("org/model", revision, lambda repo_id, revision: str(root))
    assert s["model_ref"] == f"org/model@{revision}" and [f["path"] for f in s["files"]] == ["config.json", "w.safetensors"]
    T.verify_snapshot(folder, s)
    blob.write_bytes(b"124")
    for bad in (lambda: T.verify_snapshot(folder, s), lambda: T.freeze_snapshot(str(root), "org/model", "main"), lambda: T.freeze_snapshot(str(root), "model", revision), lambda: T.freeze_snapshot(str(root), "org/model", "b" * 40), lambda: T.freeze_snapshot(str(tmp_path), "org/model", revision)):
        with pytest.raises(ValueError):
            bad()


# --- service and command line ----------------------------------------------------------------


def test_service():
    request = {"decision_type": "route", "candidates": ["read_logs", "read_metrics"], "context": {"q": "cpu is high"}}
    score = lambda r: {"read_metrics": 0.9, "read_logs": 0.1}
    a, b = decide_one(request, score), decide_one(request, score)
    assert a["action"] == "EXECUTE" and a["decision_id"] == b["decision_id"] and a["decision_id"].startswith("decision-sha256:")
    assert a["decision"] == {"candidate": "read_metrics", "confidence": 0.9, "evidence": {"runner_up_probability": 0.1, "margin": 0.8}} and [s["candidate"] for s in a["scores"]] == ["read_metrics", "read_logs"]
    said = {**request, "action": "EXECUTE", "reason_code": "CONFIDENT", "scores": a["scores"], "decision": a["decision"]}
    assert a["decision_id"] == digest(said, "decision-sha256:") and a["ledger"]["selected_candidate"] == "read_metrics" and a["ledger"]["candidate_set"] == request["candidates"]
    low = decide_one(request, lambda r: {"read_metrics": 0.5, "read_logs": 0.5}, G.ThresholdPolicy(), lambda r: {"said": 1})
    assert low["decision"] is None and low["fallback"] == {"said": 1} and low["ledger"]["evidence"] == {} and low["ledger"]["confidence"] is None
    for bad in ({"read_metrics": 0.9, "read_logs": 0.3}, {"read_metrics": float("nan"), "read_logs": 0.3}, {"read_metrics": 1.0}):
        with pytest.raises(ValueError):
            decide_one(request, lambda r, bad=bad: bad)


def test_service_and_spark_give_one_id(spark):
    request = {"decision_type": "route", "candidates": ["a", "b"], "context": {"k": 1.5, "é": None}}
    df = scored(spark, [("1", {"a": 0.125, "b": 0.875}, None)]).withColumns({"decision_type": F.lit("route"), "context": F.lit(json.dumps(request["context"]))})
    for policy in (G.ThresholdPolicy(0.8, 0.5), G.ThresholdPolicy(0.9, 0.5)):
        row = G.decision_id(G.decide(df, policy)).first()
        assert row.decision_id == decide_one(request, lambda r: {"a": 0.125, "b": 0.875}, policy)["decision_id"]


def test_http():
    server = build_server("127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    post = lambda body: urllib.request.urlopen(urllib.request.Request(f"{base}/decision", body.encode(), method="POST"))
    try:
        assert json.load(urllib.request.urlopen(f"{base}/health")) == {"status": "ok"}
        assert json.load(post(json.dumps({"decision_type": "t", "candidates": ["human_review", "execute", "fallback"]})))["decision"]["candidate"] == "execute"
        for bad in ("{", "{}", '{"decision_type": "t", "candidates": []}', '{"decision_type": "t", "candidates": ["execute", "x"]}'):
            with pytest.raises(urllib.error.HTTPError) as e:
                post(bad)
            assert e.value.code == 400
    finally:
        server.shutdown()


def test_cli(spark, tmp_path, capsys):
    rows = [{"case_id": str(i), "decision_type": "t", "candidates": ["read_metrics", "read_logs"], "gold_candidate": "read_logs", "context": {"intent": f"error {i}"}} for i in range(3)]
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    assert cli.main(["benchmark", str(path)]) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["accuracy"] == 1
    assert cli.main(["validate", str(path), str(path)]) == 0
    assert json.loads(capsys.readouterr().out) == {"valid": False, "case_ids": 3, "contexts": 3, "repeated": 3}
    assert cli.main(["corpus", str(path), "--split", "test"]) == 0
    assert json.loads(capsys.readouterr().out)["valid"] is False
    (tmp_path / "a.json").write_text(json.dumps(artifact()))
    assert cli.main(["verify", str(tmp_path / "a.json")]) == 0
    assert list(json.loads(capsys.readouterr().out).values()) == [None]


def test_linear_softmax(spark):
    """A hundred candidates cost about ten times what ten do, not a thousand times."""
    import time

    times = {}
    for k in (10, 100):
        df = spark.range(2000).select(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.struct(i.cast("string").alias("candidate"), (1.0 / (i + F.col("id"))).alias("probability"))).alias("scores"))
        out = df.select(S.temperature_scaled("scores", 2.0).alias("s"))
        out.agg(F.sum(F.size("s"))).collect()
        began = time.perf_counter()
        row = out.agg(F.sum(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["probability"]))).first()
        times[k] = time.perf_counter() - began
        assert row[0] == pytest.approx(2000)
    assert times[100] < 3


def test_top_similar_either_way(spark, monkeypatch):
    queries = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["c"])], "query_id int, q array<string>")
    items = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["b", "a"]), (4, [])], "item_id int, i array<string>")
    run = lambda: sorted(map(tuple, U.top_similar(queries, items, 2, lambda q, t: S.jaccard(q["q"], t["i"])).select("query_id", "item_id", "similarity", "rank").collect()))
    near = run()
    assert near[:2] == [(1, 2, 1.0, 1), (1, 3, 1.0, 2)]
    monkeypatch.setattr(U, "BLOCK_ROWS", 1)
    assert run() == near
