"""Corpus checks, released traces and combined replays."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from test_experiments import asked, cases, confident

from gatewright.functions.canonical import digest
from gatewright.operators import corpora as P
from gatewright.operators import experiments as X
from gatewright.operators import gate as G
from gatewright.operators import metrics as M
from gatewright.operators import replay, seal
from gatewright.operators import suites as U
from gatewright.operators import validate as V
from gatewright.sources import cases as K

SPLITS = "case_id string, split string, decision_type string, context string, candidates array<string>, gold string, coverage string"


def split(spark, rows):
    return spark.createDataFrame([(i, s, (k or ["t"])[0], c, ["a", "b"], "a", "covered") for i, s, c, *k in rows], SPLITS)


def test_pair(spark):
    tools = spark.createDataFrame([("a",), ("b",)], "name string")
    left = split(spark, [("1", "calibration", '{"q": 1, "r": 2}'), ("2", "calibration", '{"q":2}')])
    assert P.pair_report(left, split(spark, [("3", "test", '{"q":3}')]), tools) == {"calibration_count": 2, "test_count": 1}
    bad = split(spark, [("1", "test", '{"r":2,"q":1}'), ("4", "dev", "{}"), ("5", "test", '{"z":1}'), ("5", "test", '{"z":2}')])
    rules = {(r.rule, r.value) for r in P.pair_violations(left, bad, tools.limit(1)).collect()}
    assert {r for r, _ in rules} == {"test_split", "shared_id", "shared_context", "repeated_id", "not_in_inventory"}
    with pytest.raises(ValueError):
        P.pair_report(left, bad)
    # the same context of another decision type is no leak; a side without cases is refused
    assert P.pair_violations(left, split(spark, [("3", "test", '{"q":2}', "other")])).count() == 0
    for sides in ((left, left.limit(0)), (left.limit(0), left)):
        with pytest.raises(ValueError):
            P.pair_report(*sides)


TRACE = {
    "source_type": "incident_record", "transformation": "semantic_rewrite", "label_source": "human_adjudication", "source_artifact_sha256": digest("a"), "source_record_sha256": digest("r"), "source_group_sha256": digest("g"),
    "reviewer_count": 1, "benchmark_release_approved": True, "sanitization": dict.fromkeys(V.SANITIZATION, True),
}


def test_trace(spark):
    case = {"decision_type": "t", "context": {"b": 1.5, "a": "é"}, "candidates": ["x", "y"], "gold_candidate": None, "metadata": {"ambiguity": "clear"}}
    trace = P.build_trace_provenance(case, **TRACE)
    rows = [
        ("ok", "t", '{"a": "é", "b": 1.5}', ["x", "y"], None, "clear", trace), ("changed", "t", "{}", ["x", "y"], None, "clear", trace), ("open", "t", '{"a":"é","b":1.5}', ["x", "y"], None, "multi_valid", trace),
        ("kinds", "t", '{"a":"é","b":1.5}', ["x", "y"], None, "clear", trace | {"source_type": "log", "transformation": None, "label_source": "review", "identifier_pseudonymization": "hashed"}),
        ("none", "t", "{}", ["x", "y"], None, "clear", None),
    ]
    kinds = {"reviewer_count": "bigint", "benchmark_release_approved": "boolean", "sanitization": "struct<" + ",".join(f"{k}:boolean" for k in V.SANITIZATION) + ">"}
    kind = "struct<" + ",".join(f"{k}:{kinds.get(k, 'string')}" for k in trace) + ">"
    df = spark.createDataFrame(rows, f"case_id string, decision_type string, context string, candidates array<string>, gold string, ambiguity string, trace {kind}")
    found = {}
    for r in V.trace_violations(df).collect():
        found.setdefault(r.case_id, set()).add(r.rule)
    assert len(found.pop("none")) > 10
    assert found == {"open": {"reviewers"}, "changed": {"released_fingerprint"}, "kinds": {"source_type", "transformation", "label_source", "pseudonymization"}}
    assert {r.case_id for r in P.with_release_check(df).collect()} == {"changed", "none"}
    assert {(r.category, r.value, r.n) for r in V.trace_summary(df.where("case_id in ('ok', 'kinds')")).collect()} >= {("source_type", "log", 1), ("transformation", None, 1), ("source_groups", None, 1)}
    for change in ({"reviewer_count": 0}, {"reviewer_count": True}, {"source_group_sha256": "g"}, {"identifier_pseudonymization": "salted_hash"}, {"source_type": "log"}, {"benchmark_release_approved": None}, {"sanitization": {}}):
        with pytest.raises(ValueError):
            P.build_trace_provenance(case, **(TRACE | change))
    with pytest.raises(ValueError):
        P.build_trace_provenance(case | {"metadata": {"ambiguity": "multi_valid"}}, **TRACE)


def test_replay(spark):
    tools = spark.createDataFrame([(f"s::t{i:02}", "", "s") for i in range(12)], "name string, description string, server string")
    base = asked(spark, 4).select("case_id", F.array(F.lit("a"), "gold").alias("candidates"), "gold")
    stress = {"calibration": base, "base_test": base, "covered": U.suite(asked(spark, 4), tools, [5, 10]), "missing": U.suite(asked(spark, 4), tools, [5, 10], missing=True)}
    left = cases(spark, 2, 20, expected_abstain=True, coverage="unsupported", ambiguity="clear", automation_risk="low")
    quality = {"calibration": cases(spark, 4), "test": cases(spark, 4, 10), "abstention": left}
    frames = replay.run({"one": confident, "two": confident}, stress, quality)
    replay.verify(frames, ["one", "two"], [5, 10], closed=4, abstention=2)
    with pytest.raises(ValueError):
        replay.verify(frames, ["one"], [5, 10])
    with pytest.raises(ValueError):
        replay.verify(frames, ["one", "two"], [5, 10], closed=5)


def test_replay_profile(spark, tmp_path):
    lines = [{"case_id": f"c{i}", "decision_type": "t", "context": {"q": i}, "candidates": ["a", "b"], "gold_candidate": "ab"[i % 2], "metadata": {"split": "calibration"}} for i in range(4)]
    path = tmp_path / "calibration.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)))
    calibration = K.annotated(K.read_cases(spark, str(path)))
    test = calibration.withColumns({"case_id": F.concat("case_id", F.lit("t")), "split": F.lit("test"), "context": F.lit('{"q":9}')})
    results = M.case_results(confident(calibration))
    fit, t = X.Fit(1.5, 1.0, 0.9), X.choose_threshold(results, 0.5)
    assert t.selection == seal.BUDGET
    made = {"adapter": "x", "source_adapter": "x+calibrated", "model_ref": "m", "calibration_path": str(path), "calibration": calibration, "test": test, "results": results, "fit": fit, "threshold": t, "risk_budget": 0.5}
    p = replay.profile(**made)
    seal.verify_profile(p)
    assert p["calibration"]["case_ids"] == ["c0", "c1", "c2", "c3"] and p["risk_budget"] == 0.5 and p["adapter"] == "x"
    wrong = F.when(F.col("case_id") == "c0", "b").otherwise(F.col("gold"))
    for change in (
        {"source_adapter": "x"}, {"source_risk_budget": 0.4}, {"threshold": X.Threshold(0.1, seal.BUDGET)}, {"threshold": X.Threshold(t.value, seal.MEDIAN)}, {"results": results.limit(3)}, {"results": results.withColumn("gold", wrong)},
        {"calibration": calibration.withColumn("gold", wrong)}, {"test": calibration}, {"test": test.withColumn("decision_type", F.lit("u"))},
    ):
        with pytest.raises(ValueError):
            replay.profile(**(made | change))


def test_bundle_and_observation(spark):
    files = spark.createDataFrame([("b", 1, "y"), ("a", 2, "x")], "path string, bytes long, sha256 string")
    assert [f["path"] for f in replay.bundle(files)["files"]] == ["a", "b"]
    scored = confident(cases(spark, 4))
    df, seen = replay.observed(G.decide(scored))
    df.collect()
    assert seen.get["rows"] == 4 and seen.get["execute"] == 4


def test_corpora(spark):
    rows = spark.createDataFrame([("1", "test", None, True), ("2", "dev", "a", False)], "case_id string, split string, gold string, expected_abstain boolean")
    assert {(r.case_id, r.rule) for r in P.calibration_only_violations(rows).collect()} == {("1", "gold"), ("1", "expected_abstain")}
    assert [r.case_id for r in V.split_labels(rows, "test").collect()] == ["2"]


def test_streams(spark, tmp_path):
    from gatewright.streaming.decisions import decide_stream, windowed_counts

    rows = [(str(i % 3), ["a", "b"], [("a", 0.95), ("b", 0.05)], f"2024-01-0{1 + i // 3} 00:00:00") for i in range(6)]
    df = spark.createDataFrame(rows, "case_id string, candidates array<string>, scores array<struct<candidate:string,probability:double>>, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = decide_stream(stream).writeStream.format("memory").queryName("decided").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("decided").count() == 3  # each id once
    q = windowed_counts(G.decide(stream)).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(str(r.start)[:10], r.n) for r in spark.table("windows").collect()} == {("2024-01-01", 3), ("2024-01-02", 3)}
