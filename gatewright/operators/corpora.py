"""Checks of whole corpora: calibration against test, released traces, test-only sets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import digest, json_digest, same_value
from . import validate as V


def _named(rule: str, df: DataFrame, value: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(value).cast("string").alias("value"))


def pair_violations(calibration: DataFrame, test: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """(rule, value) of what is wrong with a calibration and a test set (case_id, split, decision_type, context, candidates, gold, coverage).

    Wrong split labels, repeated and shared ids, contexts that both have for one decision type
    (whatever their spelling), and with an inventory what is not in it.
    """
    parts = [
        _named("calibration_split", V.split_labels(calibration, "calibration"), "case_id"),
        _named("test_split", V.split_labels(test, "test"), "case_id"),
        _named("repeated_id", V.repeated_ids(calibration).unionByName(V.repeated_ids(test)), "case_id"),
        _named("shared_id", V.overlap(calibration, test, "case_id"), "case_id"),
        _named("shared_context", V.overlap(*[d.select("decision_type", same_value("context").alias("context")) for d in (calibration, test)], "decision_type", "context"), "context"),
    ]
    if tools is not None:
        both = calibration.unionByName(test, allowMissingColumns=True)
        parts.append(_named("not_in_inventory", V.dangling_references(both, tools), "name"))
    return reduce(DataFrame.unionByName, parts)


def pair_report(calibration: DataFrame, test: DataFrame, tools: DataFrame | None = None) -> dict:
    """Counts of a sound pair; raises for any violation and for a side without cases."""
    counts = {"calibration_count": calibration.count(), "test_count": test.count()}
    if not all(counts.values()):
        raise ValueError("calibration and test need cases")
    V.require_none(pair_violations(calibration, test, tools), "calibration and test")
    return counts


def trace_fingerprint(decision_type: str = "decision_type", context: str = "context", candidates: str = "candidates", gold: str = "gold") -> Column:
    """The digest of what a released case says, whatever the spelling of its context (JSON text)."""
    parts = F.struct(F.col(decision_type).alias("decision_type"), F.parse_json(context).alias("context"), F.col(candidates).alias("candidates"), F.col(gold).alias("gold_candidate"))
    return json_digest(F.to_json(parts, {"ignoreNullFields": "false"}))


def with_release_check(cases: DataFrame) -> DataFrame:
    """(case_id, rule): cases whose released digest is not that of what they say."""
    return cases.where(~F.coalesce(F.col("trace.released_case_sha256") == trace_fingerprint(), F.lit(False))).select("case_id", F.lit("released_fingerprint").alias("rule"))


def build_trace_provenance(
    case: dict, *, source_type: str, transformation: str, label_source: str, source_artifact_sha256: str, source_record_sha256: str, source_group_sha256: str, reviewer_count: int,
    benchmark_release_approved: bool, sanitization: dict[str, bool], identifier_pseudonymization: str = V.PSEUDONYMIZATION,
) -> dict:
    """The provenance of a released case; refuses what ``validate.trace_violations`` would refuse."""
    ambiguous = (case.get("metadata") or {}).get("ambiguity") in ("underspecified", "multi_valid")
    digests = {"source_artifact_sha256": source_artifact_sha256, "source_record_sha256": source_record_sha256, "source_group_sha256": source_group_sha256}
    sound = (
        source_type in V.SOURCE_TYPES and transformation in V.TRANSFORMATIONS and label_source in V.LABEL_SOURCES and identifier_pseudonymization == V.PSEUDONYMIZATION
        and all(isinstance(d, str) and re.fullmatch(V.DIGEST, d) for d in digests.values()) and type(reviewer_count) is int and reviewer_count >= (2 if ambiguous else 1)
        and benchmark_release_approved is True and all(sanitization.get(k) is True for k in V.SANITIZATION)
    )
    if not sound:
        raise ValueError("the provenance breaks its contract")
    said = {k: case.get(k) for k in ("decision_type", "context", "candidates", "gold_candidate")}
    return {
        "version": V.TRACE_VERSION, "source_type": source_type, "transformation": transformation, "label_source": label_source, **digests, "identifier_pseudonymization": identifier_pseudonymization,
        "released_case_sha256": digest(said), "reviewer_count": reviewer_count, "benchmark_release_approved": True, "sanitization": dict(sanitization),
    }


def test_only_violations(cases: DataFrame) -> DataFrame:
    """(case_id, rule) of an abstention corpus: every case is a test case and annotated soundly."""
    return V.split_labels(cases, "test").unionByName(V.annotation_violations(cases))


def calibration_only_violations(cases: DataFrame) -> DataFrame:
    """(case_id, rule): a case to calibrate on has a gold label and is not to be left alone."""
    rules = [("gold", F.col("gold").isNull()), ("expected_abstain", F.coalesce("expected_abstain", F.lit(False)))]
    return V._rows(cases, rules, "case_id")
