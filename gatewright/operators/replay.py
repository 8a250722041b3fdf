"""Combined replays: several arms through the stress and the quality protocol, and their profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.canonical import same_value, sealed
from ..sources import cases as K
from . import corpora as P
from . import experiments as X
from . import seal
from .scoring import Scorer

SIZES = (5, 10, 20, 50, 100)


def run(arms: dict[str, Scorer], stress: dict[str, DataFrame], quality: dict[str, DataFrame], **options) -> dict:
    """``X.stress_experiment`` and ``X.quality_experiment`` of each arm; frames get the arm as a column.

    stress: calibration, base_test, covered, missing. quality: calibration, test, abstention.
    """
    found = {arm: {"stress": X.stress_experiment(**stress, score=score, **options), "quality": X.quality_experiment(**quality, score=score, **options)} for arm, score in arms.items()}
    frames = {}
    for protocol in ("stress", "quality"):
        for key in next(iter(found.values()))[protocol]:
            parts = {arm: r[protocol][key] for arm, r in found.items()}
            first = next(iter(parts.values()))
            frames[f"{protocol}_{key}"] = reduce(DataFrame.unionByName, [df.withColumn("arm", F.lit(arm)) for arm, df in parts.items()]) if isinstance(first, DataFrame) else parts
    return frames


def profile(
    *, adapter: str, source_adapter: str, model_ref: str, calibration_path: str, calibration: DataFrame, test: DataFrame, results: DataFrame, fit: X.Fit, threshold: X.Threshold, risk_budget: float,
    source_risk_budget: float | None = None, min_coverage: float = 0.25, thresholds: Sequence[float] = X.GRID, inventory_sha256: str | None = None,
) -> dict:
    """A sealed profile of one arm, from cases (case_id, split, decision_type, context, candidates, gold) and calibrated ``results`` of the calibration cases.

    Refuses: a pair that leaks; cases that are not those of the file; results of other cases or gold
    labels; several decision types; an adapter whose calibrated form is another; another budget; a
    threshold that is not the operating point (or, without one, the median confidence).
    """
    spark = calibration.sparkSession
    P.pair_report(calibration, test)
    said = lambda d: d.select("case_id", "decision_type", same_value("context").alias("context"), "candidates", "gold")
    filed = said(K.read_cases(spark, calibration_path))
    if filed.exceptAll(said(calibration)).limit(1).count() or said(calibration).exceptAll(filed).limit(1).count():
        raise ValueError("the calibration file has other cases")
    named = lambda d: d.select(F.col("case_id").cast("string"), "gold")
    if named(results).exceptAll(named(calibration)).limit(1).count() or named(calibration).exceptAll(named(results)).limit(1).count():
        raise ValueError("the results are of other cases or gold labels")
    kinds = [r[0] for r in calibration.select("decision_type").union(test.select("decision_type")).distinct().limit(2).collect()]
    if len(kinds) != 1:
        raise ValueError("a profile is of one decision type")
    if source_adapter != f"{adapter}+calibrated" or source_risk_budget not in (None, risk_budget):
        raise ValueError("the results are of another adapter or budget")
    chosen = X.choose_threshold(results, risk_budget, min_coverage, thresholds)
    if chosen != threshold:
        raise ValueError(f"the calibration cases give {chosen}")
    # the ids are part of the document; they are those of one small file, in its order
    ids = [r["case_id"] for r in K.read_cases(spark, calibration_path).select("ordinal", "case_id").orderBy("ordinal").collect()]
    sha = K.file_digests(spark, calibration_path).first()["sha256"]
    return seal.build_profile(
        adapter=adapter, model_ref=model_ref, decision_type=kinds[0], calibration={"sha256": sha, "case_count": len(ids), "case_ids": ids}, temperature=fit.temperature,
        execute_threshold=threshold.value, risk_budget=risk_budget, selection=threshold.selection, inventory_sha256=inventory_sha256,
    )


def verify(frames: dict, arms: Sequence[str], sizes: Sequence[int] = SIZES, closed: int | None = None, abstention: int | None = None) -> None:
    """Every arm has every size once and, where asked, the numbers of closed and abstention cases."""
    found = {(r["arm"], r["k"]) for r in frames["stress_covered"].select("arm", "k").collect()}
    if found != {(a, k) for a in arms for k in sizes}:
        raise ValueError(f"arms and sizes are {sorted(found)}")
    for key, n in (("quality_test", closed), ("quality_abstention", abstention)):
        if n is not None and {r["n"] for r in frames[key].select("n").collect()} != {n}:
            raise ValueError(f"{key} has other numbers of cases")


def bundle(files: DataFrame) -> dict:
    """A sealed manifest of (path, bytes, sha256) rows."""
    return sealed({"schema_version": "decision-gpu-replay-bundle/v1", "files": [r.asDict() for r in files.orderBy("path").collect()]})


def observed(df: DataFrame, name: str = "decisions") -> tuple[DataFrame, Observation]:
    """The same rows, and counts that are known when an action on them has ended, at no extra pass."""
    o = Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows")]
    if "action" in df.columns:
        metrics += [F.count_if(F.col("action") == a).alias(a.lower()) for a in ("EXECUTE", "FALLBACK", "REJECT")]
    return df.observe(o, *metrics), o
