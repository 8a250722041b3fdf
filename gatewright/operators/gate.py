"""Gating decisions on confidence and margin, and the ledger of what was decided."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.canonical import json_digest


@dataclass(frozen=True)
class ThresholdPolicy:
    execute_threshold: float = 0.85
    margin_threshold: float = 0.20

    def __post_init__(self):
        if not (0 <= self.execute_threshold <= 1 and 0 <= self.margin_threshold <= 1):
            raise ValueError("thresholds lie in [0, 1]")


def decide(scored: DataFrame, policy: ThresholdPolicy = ThresholdPolicy()) -> DataFrame:
    """Adds decision, confidence, runner_up, margin, reason_code and action; confidence is tested first.

    A row with an invalid distribution gets the action ``REJECT`` and the rule it breaks as reason, so
    a stream goes on; ``require_valid`` raises instead. Map-only, hence the same for batches and streams.
    """
    bad = S.violations("candidates", "scores", lengths=False)
    best = scored.withColumn("_top", S.top1("scores")).withColumn("_bad", bad)
    best = best.withColumn("confidence", F.col("_top.probability")).withColumn("runner_up", S.runner_up("scores")).withColumn("margin", F.col("confidence") - F.col("runner_up"))
    reason = (
        F.when(F.size("_bad") > 0, F.concat(F.lit("INVALID_"), F.upper(F.element_at("_bad", 1))))
        .when(F.col("confidence") < policy.execute_threshold, F.lit("LOW_CONFIDENCE"))
        .when(F.col("margin") < policy.margin_threshold, F.lit("LOW_MARGIN"))
        .otherwise(F.lit("CONFIDENT"))
    )
    action = F.when(F.col("reason_code") == "CONFIDENT", F.lit("EXECUTE")).when(F.startswith("reason_code", F.lit("INVALID_")), F.lit("REJECT")).otherwise(F.lit("FALLBACK"))
    out = best.withColumn("reason_code", reason).withColumn("action", action)
    return out.withColumn("decision", F.when(F.col("action") == "EXECUTE", F.col("_top.candidate"))).drop("_top", "_bad")


def require_valid(scored: DataFrame, *, lengths: bool = True) -> DataFrame:
    """The same rows; the first row with an invalid request or distribution fails the job."""
    wrong = F.concat(S.violations("candidates", "scores", lengths=lengths), S.request_violations("decision_type", "candidates") if "decision_type" in scored.columns else F.array().cast("array<string>"))
    return scored.where(F.when(F.size(wrong) == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid case: "), F.array_join(wrong, ",")))))


def decision_id(decided: DataFrame) -> DataFrame:
    """Adds ``decision_id``, the same for the same request (decision_type, candidates, context as JSON text) and result."""
    ranked = F.transform(S._ranked(F.col("scores")), lambda x: F.struct(x["candidate"].alias("candidate"), x["probability"].alias("probability")))
    evidence = F.struct(F.col("runner_up").alias("runner_up_probability"), "margin")
    made = F.when(F.col("action") == "EXECUTE", F.struct(F.col("decision").alias("candidate"), "confidence", evidence.alias("evidence")))
    parts = F.struct("decision_type", "candidates", F.parse_json("context").alias("context"), "action", "reason_code", ranked.alias("scores"), made.alias("decision"))
    return decided.withColumn("decision_id", json_digest(F.to_json(parts, {"ignoreNullFields": "false"}), "decision-sha256:"))


def ledger(decided: DataFrame) -> DataFrame:
    """One append-only entry for each decision, with its time, scores by rank and the evidence of what was executed."""
    kept = [c for c in ("case_id", "decision_id", "decision_type") if c in decided.columns]
    ranked = F.transform(S._ranked(F.col("scores")), lambda x: F.struct(x["candidate"].alias("candidate"), x["probability"].alias("probability")))
    run = F.col("action") == "EXECUTE"
    return decided.select(
        F.current_timestamp().alias("timestamp"), *kept, F.col("candidates").alias("candidate_set"), ranked.alias("scores"), "action", "reason_code", F.col("decision").alias("selected_candidate"),
        F.when(run, F.col("confidence")).alias("confidence"), F.when(run, F.struct(F.col("runner_up").alias("runner_up_probability"), "margin")).alias("evidence"),
    )
