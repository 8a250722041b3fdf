"""Metrics over case results: accuracy, calibration, selective risk, latency.

Input is a *scored* DataFrame (case_id, candidates, scores, gold and, where known,
latency_ms, tokens) or the *case results* that ``case_results`` makes of it. All metrics
are partial and final hash aggregates over narrow rows; curves are histograms of at most
as many rows as there are thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S

DEFAULT_THRESHOLDS = (0.5, 0.7, 0.8, 0.9, 0.95)


def case_results(scored: DataFrame, *extra: str) -> DataFrame:
    """predicted, gold, confidence, correct and gold_probability of each case; the first listed wins ties."""
    carried = [c for c in ("case_id", "latency_ms", "tokens", *extra) if c in scored.columns]
    best = scored.withColumn("_top", S.top1("scores"))
    return best.select(
        *carried,
        F.col("_top.candidate").alias("predicted"),
        "gold",
        F.col("_top.probability").alias("confidence"),
        F.coalesce(F.col("_top.candidate") == F.col("gold"), F.lit(False)).alias("correct"),
        S.probability_of("scores", "gold").alias("gold_probability"),
    )


def _hit() -> Column:
    return F.col("correct").cast("double")


def accuracy() -> Column:
    return F.avg(_hit())


def brier() -> Column:
    return F.avg(F.pow(F.col("confidence") - _hit(), F.lit(2.0)))


def binary_nll() -> Column:
    p = F.greatest(F.least("confidence", F.lit(1.0 - S.FLOOR)), F.lit(S.FLOOR))
    return F.avg(-(_hit() * F.log(p) + (1.0 - _hit()) * F.log(1.0 - p)))


def multiclass_nll() -> Column:
    return F.avg(-F.log(F.least(F.greatest("gold_probability", F.lit(S.FLOOR)), F.lit(1.0))))


def ece_bins(results: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """n, accuracy and mean confidence of each bin that has rows."""
    return results.groupBy(*by, S.bin_of("confidence", bins).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), accuracy().alias("accuracy"), F.avg("confidence").alias("confidence"))


def ece(results: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error: the bins' gaps weighted by their rows."""
    per = ece_bins(results, bins, by)
    return per.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def f1_per_label(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, predicted and gold counts and F1 of each label that is gold or predicted; undefined ratios are 0."""
    labels = results.select(*by, F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("x"), "correct")
    per = labels.groupBy(*by, F.col("x.label").alias("label")).agg(F.sum(F.col("x.g") * F.col("correct").cast("int")).alias("tp"), F.sum("x.g").alias("gold_n"), F.sum("x.p").alias("predicted_n"))
    return per.where("label is not null").withColumn("f1", F.coalesce(F.try_divide(F.lit(2.0) * F.col("tp"), F.col("gold_n") + F.col("predicted_n")), F.lit(0.0)))


def macro_f1(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return f1_per_label(results, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def percentile(column: str, q: float) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(column, F.lit(q))


def risk_coverage(results: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """coverage, risk, false_automation_rate and fallback_rate at each threshold.

    Rows are counted once by how many thresholds they reach; the counts of a threshold are the
    suffix sums, joined back to the list of thresholds, so one without rows of its own stays.
    """
    order = sorted(set(float(t) for t in thresholds))
    rank = {t: i + 1 for i, t in enumerate(order)}
    reached = reduce(lambda a, b: a + b, [(F.col("confidence") >= t).cast("int") for t in order], F.lit(0))
    counts = results.groupBy(*by, reached.alias("_reached")).agg(F.count(F.lit(1)).alias("_n"), F.sum(1 - F.col("correct").cast("int")).alias("_wrong"))
    listed = F.array(*[F.struct(F.lit(i).cast("long").alias("ordinal"), F.lit(float(t)).alias("threshold"), F.lit(rank[float(t)]).alias("rank")) for i, t in enumerate(thresholds)])
    per = counts.select(*by, "_reached", "_n", "_wrong", F.explode(listed).alias("t"))
    inside = F.col("_reached") >= F.col("t.rank")
    sums = per.groupBy(*by, F.col("t.ordinal").alias("ordinal"), F.col("t.threshold").alias("threshold")).agg(
        F.sum("_n").alias("n"), F.sum(F.when(inside, F.col("_n")).otherwise(0)).alias("accepted"), F.sum(F.when(inside, F.col("_wrong")).otherwise(0)).alias("errors")
    )
    coverage = F.col("accepted") / F.col("n")
    return sums.select(
        *by, "ordinal", "threshold", "n", "accepted", "errors",
        coverage.alias("coverage"),
        F.coalesce(F.try_divide(F.col("errors").cast("double"), F.col("accepted")), F.lit(0.0)).alias("risk"),
        (F.col("errors") / F.col("n")).alias("false_automation_rate"),
        ((F.col("n") - F.col("accepted")) / F.col("n")).alias("fallback_rate"),
    )


def operating_point(curve: DataFrame, risk_budget: float, min_coverage: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Of the points within the budget, that with most coverage, then least risk, then the highest threshold; no row if there is none."""
    fit = curve.where((F.col("coverage") > 0) & (F.col("coverage") >= min_coverage) & (F.col("risk") <= risk_budget))
    key = F.struct(F.col("coverage"), -F.col("risk"), F.col("threshold"))
    columns = [c for c in curve.columns if c not in by]
    if not by:
        return fit.orderBy(F.desc("coverage"), F.asc("risk"), F.desc("threshold")).limit(1)
    return fit.groupBy(*by).agg(F.max_by(F.struct(*columns), key).alias("best")).select(*by, "best.*")


def benchmark_report(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (for each group): n, accuracy, macro-F1, NLL, Brier, ECE, latencies and tokens.

    Latencies and tokens are NULL where none is known.
    """
    for c, kind in (("latency_ms", "double"), ("tokens", "long")):
        if c not in results.columns:
            results = results.withColumn(c, F.lit(None).cast(kind))
    one = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), accuracy().alias("accuracy"), multiclass_nll().alias("nll"), brier().alias("brier"),
        F.avg("latency_ms").alias("mean_latency_ms"), percentile("latency_ms", 0.5).alias("p50_latency_ms"), percentile("latency_ms", 0.95).alias("p95_latency_ms"), F.avg("tokens").alias("mean_tokens"),
    )
    if by:
        return one.join(ece(results, by=by), list(by)).join(macro_f1(results, by), list(by))
    return one.crossJoin(F.broadcast(ece(results))).crossJoin(F.broadcast(macro_f1(results)))  # one row each


def run_benchmark(scored: DataFrame, thresholds: Sequence[float] = DEFAULT_THRESHOLDS, risk_budget: float | None = None, min_coverage: float | None = None) -> dict[str, DataFrame]:
    """The report of a closed-set benchmark: summary, curve, cases and, with a budget, the operating point.

    Refuses a minimum coverage without a budget, no cases, cases without gold label or with one that
    is not a candidate, and invalid distributions.
    """
    if min_coverage is not None and risk_budget is None:
        raise ValueError("a minimum coverage needs a risk budget")
    check = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("gold").isNull()).alias("no_gold"),
        F.count_if(F.col("gold").isNotNull() & ~F.array_contains("candidates", F.col("gold"))).alias("foreign_gold"),
        F.count_if(F.size(S.violations("candidates", "scores")) > 0).alias("invalid"),
    ).first()
    if not check["n"]:
        raise ValueError("a benchmark needs cases")
    for k in ("no_gold", "foreign_gold", "invalid"):
        if check[k]:
            raise ValueError(f"{check[k]} cases: {k}")
    results = case_results(scored)
    curve = risk_coverage(results, thresholds)
    out = {"summary": benchmark_report(results), "coverage": curve, "cases": results}
    if risk_budget is not None:
        out["operating_point"] = operating_point(curve, risk_budget, min_coverage or 0.0)
    return out
