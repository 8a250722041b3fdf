"""Small builders of scored cases."""

from __future__ import annotations

CASES = "case_id string, candidates array<string>, scores array<struct<candidate:string,probability:double>>, gold string, latency_ms double, tokens long, expected_abstain boolean, coverage string, ambiguity string, automation_risk string"


def scored(spark, rows):
    """rows: (case_id, {candidate: probability}, gold, other columns as keywords)."""
    out = []
    for case_id, probabilities, gold, *more in rows:
        extra = more[0] if more else {}
        names = list(probabilities)
        get = extra.get
        out.append((case_id, names, [(c, float(p)) for c, p in probabilities.items()], gold, get("latency_ms"), get("tokens"), get("expected_abstain"), get("coverage"), get("ambiguity"), get("automation_risk")))
    return spark.createDataFrame(out, CASES)


def predictions(spark, rows):
    """Case results from (confidence, correct) pairs."""
    return spark.createDataFrame([(str(i), "a" if ok else "b", "a", float(c), ok, float(c)) for i, (c, ok) in enumerate(rows)], "case_id string, predicted string, gold string, confidence double, correct boolean, gold_probability double")
