"""Experiments: fit on calibration cases, freeze a threshold, report on test cases.

Each runs in two phases. The first collects two numbers, the temperature and the threshold;
the second embeds them as literals in lazy plans. Cases are scored once for each split and
kept, so raw, calibrated and per-size reports share one pass of the scorer.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import calibrate as C
from . import metrics as M
from . import robust as R
from .scoring import Scorer, calibrated
from .seal import BUDGET, MEDIAN
from .suites import by_candidate_count

GRID = tuple(k / 20 for k in range(21))


@dataclass(frozen=True)
class Fit:
    temperature: float
    nll_before: float
    nll_after: float


@dataclass(frozen=True)
class Threshold:
    value: float
    selection: str  # seal.BUDGET or seal.MEDIAN


_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist scored cases; lost blocks are computed again. ``release`` lets all of them go."""
    _kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _kept[-1]


def release() -> None:
    """Unpersist what experiments kept, once their reports are written."""
    while _kept:
        _kept.pop().unpersist()


def fit(scored: DataFrame, steps: int = C.STEPS) -> Fit:
    C.check_examples(scored)
    return Fit(**C.fit_temperature(scored, steps=steps).first().asDict())


def choose_threshold(results: DataFrame, risk_budget: float = 0.5, min_coverage: float = 0.25, thresholds: Sequence[float] = GRID) -> Threshold:
    """The operating point within the budget, else the median confidence."""
    if not (0 <= risk_budget <= 1 and 0 <= min_coverage <= 1):
        raise ValueError("budget and coverage lie in [0, 1]")
    point = M.operating_point(M.risk_coverage(results, thresholds), risk_budget, min_coverage).first()
    if point:
        return Threshold(point["threshold"], BUDGET)
    return Threshold(results.agg(F.median("confidence").alias("m")).first()["m"], MEDIAN)


def calibrated_experiment(calibration: DataFrame, test: DataFrame, score: Scorer) -> dict:
    """The fit on calibration cases, and raw and calibrated reports of the test cases."""
    source, target = keep(score(calibration)), keep(score(test))
    f = fit(source)
    raw = M.case_results(target).withColumn("variant", F.lit("raw"))
    scaled = M.case_results(C.calibrated(target, f.temperature)).withColumn("variant", F.lit("calibrated"))
    return {"fit": f, "reports": M.benchmark_report(raw.unionByName(scaled), by=["variant"])}


def stress_experiment(calibration: DataFrame, base_test: DataFrame, covered: DataFrame, missing: DataFrame, score: Scorer, risk_budget: float = 0.5, min_coverage: float = 0.25, permutation_cases: int = 10) -> dict:
    """Reports by number of candidates at a threshold that calibration alone chose.

    ``covered`` and ``missing`` are suites with the same sizes; all sizes are one grouped job.
    """
    source = keep(score(calibration))
    f = fit(source)
    scaled = calibrated(score, f.temperature)
    source_results = keep(M.case_results(C.calibrated(source, f.temperature)))
    threshold = choose_threshold(source_results, risk_budget, min_coverage)
    sizes = [sorted(r[0] for r in d.select(by_candidate_count()).distinct().collect()) for d in (covered, missing)]
    if sizes[0] != sizes[1]:
        raise ValueError(f"the suites have different sizes: {sizes[0]} and {sizes[1]}")
    k = by_candidate_count().cast("int")
    c, m = (keep(scaled(d.withColumn("k", k))) for d in (covered, missing))
    results = M.case_results(c, "k")
    at = M.risk_coverage(results, [threshold.value], by=["k"])
    both = c.withColumn("expected_abstain", F.lit(False)).unionByName(m.withColumn("expected_abstain", F.lit(True)), allowMissingColumns=True)
    # the first cases of each size, by id; the window keeps no more of each in the map tasks
    first = Window.partitionBy("k").orderBy("case_id")
    few = covered.withColumn("k", k).withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= permutation_cases).drop("_rn")
    return {
        "fit": f,
        "threshold": threshold,
        "source": M.benchmark_report(source_results),
        "base_test": M.benchmark_report(M.case_results(scaled(base_test))),
        "covered": M.benchmark_report(results, by=["k"]),
        "at_threshold": at,
        "abstention": R.abstention_report(R.abstention_cases(both, threshold.value), by=["k"]),
        "transfer": R.threshold_transfer(source_results, results, threshold.value, by=["k"]),
        "permutation": R.permutation_report(R.permutation_cases(few, scaled, "k"), by=["k"]),
    }


def quality_experiment(calibration: DataFrame, test: DataFrame, abstention: DataFrame, score: Scorer, risk_budget: float = 0.5, min_coverage: float = 0.25, thresholds: Sequence[float] = GRID) -> dict:
    """Everything that decides comes from calibration; then closed test, transfer, order, abstention and its groups.

    Refuses empty sets and an abstention set with cases that are not to be left alone.
    """
    counts = [d.limit(1).count() for d in (calibration, test, abstention)]
    if not all(counts) or abstention.where(~F.coalesce("expected_abstain", F.lit(False))).limit(1).count():
        raise ValueError("every set needs cases, and the abstention set only such as are to be left alone")
    source = keep(score(calibration))
    f = fit(source)
    scaled = calibrated(score, f.temperature)
    source_results = keep(M.case_results(C.calibrated(source, f.temperature)))
    threshold = choose_threshold(source_results, risk_budget, min_coverage, thresholds)
    target = keep(M.case_results(scaled(test)))
    left = keep(R.abstention_cases(scaled(abstention), threshold.value))
    return {
        "fit": f,
        "threshold": threshold,
        "source": M.benchmark_report(source_results),
        "test": M.benchmark_report(target),
        "at_threshold": M.risk_coverage(target, [threshold.value]),
        "transfer": R.threshold_transfer(source_results, target, threshold.value),
        "permutation": R.permutation_report(R.permutation_cases(test, scaled)),
        "abstention": R.abstention_report(left),
        "groups": R.abstention_groups(left),
    }


def matrix(reports: DataFrame, points: DataFrame) -> DataFrame:
    """Reports by arm with their operating points, NULL where there is none, in the order of the arms."""
    return reports.join(points, "arm", "left").orderBy("arm")


def write_report(experiment: dict, path: str, metadata: dict | None = None) -> None:
    """The experiment as one JSON document; its frames have a few rows each."""

    def plain(x):
        if isinstance(x, DataFrame):
            return [json.loads(r) for r in x.toJSON().collect()]
        return x.__dict__ if isinstance(x, Fit | Threshold) else x

    Path(path).write_text(json.dumps({"metadata": metadata or {}} | {k: plain(v) for k, v in experiment.items()}, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
