"""Robustness of decisions: candidate order, abstention, threshold transfer, fallback."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from . import metrics as M


def permutation_variants(cases: DataFrame) -> DataFrame:
    """One row for each other order of a case's candidates: variant and candidates; narrow, no shuffle."""
    return cases.withColumn("_v", F.explode(S.reversed_and_rotated("candidates"))).withColumn("variant", F.col("_v.name")).withColumn("candidates", F.col("_v.candidates")).drop("_v")


def permutation_cases(cases: DataFrame, score: Callable[[DataFrame], DataFrame], *extra: str) -> DataFrame:
    """(case_id, variant, baseline, perturbed, ..) of each comparison; the baseline row has no variant.

    The orders of a case stay in its row until they are scored, so no join by case is needed.
    """
    orders = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("candidates").alias("candidates"))), S.reversed_and_rotated("candidates"))
    spread = cases.withColumn("_v", F.explode(orders)).withColumn("variant", F.col("_v.name")).withColumn("candidates", F.col("_v.candidates")).drop("_v")
    return M.case_results(score(spread), "variant", *extra)


def permutation_report(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """baseline_accuracy, comparison_count, flips, flip_rate, perturbed_accuracy.

    Without comparisons the flip rate is 0 and the perturbed accuracy is the baseline's.
    """
    base = F.max(F.when(F.col("variant").isNull(), F.col("predicted")))
    per = results.groupBy(*by, "case_id").agg(
        base.alias("base"),
        F.max(F.when(F.col("variant").isNull(), F.col("correct").cast("int"))).alias("base_ok"),
        F.collect_list(F.when(F.col("variant").isNotNull(), F.struct("predicted", "correct"))).alias("others"),  # two at most
    )
    sums = per.groupBy(*by).agg(
        F.avg("base_ok").alias("baseline_accuracy"),
        F.sum(F.size("others")).alias("comparison_count"),
        F.sum(F.size(F.filter("others", lambda o: o["predicted"] != F.col("base")))).alias("flips"),
        F.sum(F.size(F.filter("others", lambda o: o["correct"]))).alias("right"),
    )
    return sums.select(
        *by, "baseline_accuracy", "comparison_count", "flips",
        F.coalesce(F.try_divide(F.col("flips").cast("double"), F.col("comparison_count")), F.lit(0.0)).alias("flip_rate"),
        F.coalesce(F.try_divide(F.col("right").cast("double"), F.col("comparison_count")), F.col("baseline_accuracy")).alias("perturbed_accuracy"),
    )


def abstention_cases(scored: DataFrame, threshold: float) -> DataFrame:
    """accepted, expected_abstain and, for covered cases with a gold label, whether the top candidate is right.

    A case that is not to be left alone must list its gold label; the job fails otherwise.
    """
    keep = [c for c in ("coverage", "ambiguity", "automation_risk", "k") if c in scored.columns]
    abstain = F.coalesce(F.col("expected_abstain"), F.lit(False))
    known = abstain | F.coalesce(F.array_contains("candidates", F.col("gold")), F.lit(False))
    checked = scored.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.lit("a covered case does not list its gold label"))))
    results = M.case_results(checked.withColumn("expected_abstain", abstain), "expected_abstain", *keep)
    return results.select("case_id", *keep, "expected_abstain", (F.col("confidence") >= threshold).alias("accepted"), F.when(~F.col("expected_abstain") & F.col("gold").isNotNull(), F.col("correct")).alias("correct_when_covered"))


def abstention_report(cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """False accepts and rejects, accuracy where covered, coverage, unsafe share; rates are NULL without a denominator."""
    ok, off = F.col("accepted"), F.col("expected_abstain")
    sums = cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(off).alias("abstain_n"), F.count_if(~off).alias("covered_n"),
        F.count_if(ok & off).alias("fa"), F.count_if(~ok & ~off).alias("fr"), F.count_if(ok).alias("accepted_n"),
        F.count_if(F.col("correct_when_covered")).alias("right"), F.count_if(F.col("correct_when_covered").isNotNull()).alias("judged"),
        F.count_if(ok & ~off & ~F.coalesce("correct_when_covered", F.lit(False))).alias("wrong"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return sums.select(
        *by, "n", "abstain_n", "covered_n", ratio("fa", "abstain_n").alias("false_accept_rate"), ratio("fr", "covered_n").alias("false_reject_rate"),
        ratio("right", "judged").alias("covered_accuracy"), ratio("accepted_n", "n").alias("coverage"), ((F.col("fa") + F.col("wrong")) / F.col("n")).alias("unsafe_rate"),
    )


def abstention_reason() -> Column:
    """Why a case should be left alone, by precedence."""
    return (
        F.when(F.col("coverage") == "missing_candidate", F.lit("missing_candidate"))
        .when(F.col("coverage") == "unsupported", F.lit("unsupported"))
        .when(F.col("ambiguity") == "underspecified", F.lit("underspecified"))
        .when(F.col("ambiguity") == "multi_valid", F.lit("multi_valid"))
        .otherwise(F.lit("other"))
    )


GROUP_KEYS = ("abstention_reason", "coverage", "ambiguity", "automation_risk")


def abstention_groups(cases: DataFrame) -> DataFrame:
    """Count, accepted and false-accept rate by (key, value), all keys in one pass; missing values are ``unknown``.

    All cases must be expected to abstain; the job fails otherwise.
    """
    only = cases.where(F.when(F.col("expected_abstain"), F.lit(True)).otherwise(F.raise_error(F.lit("a case is not expected to abstain"))))
    named = only.withColumn("abstention_reason", abstention_reason())
    pairs = F.array(*[F.struct(F.lit(k).alias("group_key"), F.coalesce(F.col(k), F.lit("unknown")).alias("group_value")) for k in GROUP_KEYS])
    return named.select("accepted", F.explode(pairs).alias("g")).groupBy("g.group_key", "g.group_value").agg(F.count(F.lit(1)).alias("case_count"), F.count_if("accepted").alias("accepted_count"), (F.count_if("accepted") / F.count(F.lit(1))).alias("false_accept_rate"))


def threshold_transfer(source: DataFrame, target: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Coverage, risk, false automation and calibration error of both results at one threshold, and target less source.

    With ``by``, the target is split into groups, of which each is compared with the whole source.
    """

    def one(results: DataFrame, tag: str, keys: Sequence[str]) -> DataFrame:
        at = M.risk_coverage(results, [threshold], by=keys).select(*keys, "coverage", "risk", "false_automation_rate")
        error = M.ece(results, by=keys)
        both = at.join(error, list(keys)) if keys else at.crossJoin(F.broadcast(error))  # one row each
        return both.select(*keys, *[F.col(c).alias(f"{tag}_{c}") for c in names])

    names = ("coverage", "risk", "false_automation_rate", "ece")
    joined = one(target, "target", by).crossJoin(F.broadcast(one(source, "source", ())))  # one row
    return joined.select(*by, F.lit(float(threshold)).alias("threshold"), *[f"{tag}_{n}" for tag in ("source", "target") for n in names], *[(F.col(f"target_{n}") - F.col(f"source_{n}")).alias(f"delta_{n}") for n in names])


def fallback_cases(fast: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """Results of a second scorer for the cases in which the first is below the threshold.

    Rows are filtered before they are scored, so the second scorer sees only those. ``fast`` is
    scored; ``score`` replaces scores and may set latency_ms, tokens and parse_valid. An invalid
    distribution of either scorer fails the job; ``require_distinct`` refuses repeated ids.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies in [0, 1]")
    sound = lambda df, which: df.where(F.when(F.size(S.violations("candidates", "scores")) == 0, F.lit(True)).otherwise(F.raise_error(F.lit(f"the {which} scorer gave no distribution")).cast("boolean")))
    low = sound(fast, "first").withColumn("_top", S.top1("scores")).where(F.col("_top.probability") < threshold)
    low = low.withColumns({"fast_predicted": F.col("_top.candidate"), "fast_confidence": F.col("_top.probability")}).drop("_top", "latency_ms", "tokens")
    second = sound(score(low), "second")
    if "parse_valid" not in second.columns:
        second = second.withColumn("parse_valid", F.lit(None).cast("boolean"))
    results = M.case_results(second, "fast_predicted", "fast_confidence", "parse_valid")
    return results.select("case_id", "gold", "fast_predicted", "fast_confidence", F.col("predicted").alias("fallback_predicted"), F.col("correct").alias("fallback_correct"), *[c for c in ("latency_ms", "tokens") if c in results.columns], "parse_valid")


def require_distinct(cases: DataFrame, what: str = "cases") -> DataFrame:
    """The same rows; raises if an id is there twice."""
    if cases.groupBy("case_id").count().where("count > 1").limit(1).count():
        raise ValueError(f"{what} repeat an id")
    return cases


def fallback_report(fast: DataFrame, cases: DataFrame) -> DataFrame:
    """Rate over all cases; accuracy, latencies, tokens and parse rate over the cases that fell back, NULL if none did."""
    for c, kind in (("latency_ms", "double"), ("tokens", "long")):
        if c not in cases.columns:
            cases = cases.withColumn(c, F.lit(None).cast(kind))
    sums = cases.agg(
        F.count(F.lit(1)).alias("fallback_count"), F.avg(F.col("fallback_correct").cast("double")).alias("fallback_accuracy"), M.percentile("latency_ms", 0.5).alias("p50_latency_ms"),
        M.percentile("latency_ms", 0.95).alias("p95_latency_ms"), F.avg("tokens").alias("mean_tokens"), F.avg(F.col("parse_valid").cast("double")).alias("parse_valid_rate"),
    )
    total = fast.agg(F.count(F.lit(1)).alias("n"))
    both = sums.crossJoin(F.broadcast(total))
    return both.select("n", "fallback_count", F.coalesce(F.try_divide(F.col("fallback_count").cast("double"), F.col("n")), F.lit(0.0)).alias("fallback_rate"), "fallback_accuracy", "p50_latency_ms", "p95_latency_ms", "mean_tokens", "parse_valid_rate")
