"""Sealed evaluation artifacts, calibration profiles and their comparison.

Artifacts are small JSON documents made of one-row reports, so they are built and verified
on the driver; many of them in a column are verified by ``problem_of``. Field names and
rules are those of the published versions.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.canonical import digest
from . import metrics as M

# fixed values of the contracts
ARTIFACT = "decision-eval/v1"
PROFILE = "calibration-profile/v1"
MATRIX = "decision-contract-matrix/v1"
CANDIDATE_SET = "candidate-set/v1"
METHOD = "temperature_scaling"
BUDGET, MEDIAN = "calibration_risk_budget", "calibration_median_confidence_fallback"
_DIGEST = re.compile(r"sha256:[0-9a-f]{64}\Z")
SHARES = ("accuracy", "macro_f1", "brier", "ece")
AMOUNTS = ("nll", "mean_latency_ms", "p50_latency_ms", "p95_latency_ms")
TOKENS = "mean_tokens_processed_per_decision"
POINT = ("threshold", "coverage", "risk", "false_automation_rate", "fallback_rate", "risk_budget")


class ContractError(ValueError):
    """A document that breaks its contract."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ContractError(what)


def _number(x: object, low: float = -math.inf, high: float = math.inf) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x) and low <= x <= high


def _count(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= 0


def _name(x: object) -> bool:
    return isinstance(x, str) and x != ""


def _sha(x: object) -> bool:
    return isinstance(x, str) and _DIGEST.match(x) is not None


def _close(a: object, b: float, near: float = 1e-9) -> bool:
    return _number(a) and math.isclose(a, b, rel_tol=1e-9, abs_tol=near)


def interpolated(values: Sequence[float], q: float) -> float:
    """The percentile with linear interpolation, as ``metrics.percentile`` has it."""
    ordered = sorted(values)
    at = q * (len(ordered) - 1)
    low = math.floor(at)
    high = math.ceil(at)
    return ordered[low] if low == high else ordered[low] * (high - at) + ordered[high] * (at - low)


def check_metrics(m: dict) -> None:
    """Ranges of a report's metrics; tokens may be null, the median latency is not above the 95th percentile."""
    for k in SHARES:
        _need(_number(m.get(k), 0, 1), f"{k} must lie in [0, 1]")
    for k in AMOUNTS:
        _need(_number(m.get(k), 0), f"{k} must not be negative")
    _need(m.get(TOKENS) is None or _number(m[TOKENS], 0), f"{TOKENS} must be null or not negative")
    _need(m["p50_latency_ms"] <= m["p95_latency_ms"], "the median latency is above the 95th percentile")


def check_operating_point(p: dict | None) -> None:
    if p is None:
        return
    _need(isinstance(p, dict), "an operating point is an object")
    for k in POINT:
        _need(_number(p.get(k), 0, 1), f"{k} must lie in [0, 1]")
    _need(p["coverage"] > 0, "an operating point covers something")
    _need(_close(p["coverage"] + p["fallback_rate"], 1), "coverage and fallback rate must add up to 1")
    _need(_close(p["false_automation_rate"], p["risk"] * p["coverage"]), "false automation is risk times coverage")
    _need(p["risk"] <= p["risk_budget"] + 1e-12, "the risk is above its budget")


def _check_fallback_case(c: object, threshold: float, ids: set[str]) -> None:
    _need(isinstance(c, dict) and _name(c.get("case_id")) and c["case_id"] in ids, "a fallback case is one of the dataset")
    _need(_number(c.get("fast_confidence"), 0, 1) and c["fast_confidence"] < threshold, "a fallback case was below the threshold")
    _need(all(_name(c.get(k)) for k in ("fast_predicted", "fallback_predicted", "gold")), "a fallback case names its predictions and gold label")
    _need(isinstance(c.get("correct"), bool), "a fallback case says whether it is correct")
    _need(_number(c.get("latency_ms"), 0), "a fallback case has a latency")
    _need(c.get("tokens_processed") is None or _count(c["tokens_processed"]), "tokens are counted")
    _need(c.get("parse_valid") is None or isinstance(c["parse_valid"], bool), "parse_valid is true, false or null")


def check_fallback(f: dict, case_ids: Sequence[str]) -> None:
    """A fallback that was measured: its aggregates must be those of its cases, and null if there are none."""
    _need(isinstance(f.get("measured"), bool), "the fallback says whether it was measured")
    if not f["measured"]:
        return
    cases, n = f.get("cases"), f.get("fallback_case_count")
    _need(_name(f.get("adapter")), "the fallback names its adapter")
    _need(_number(f.get("threshold"), 0, 1), "the fallback's threshold lies in [0, 1]")
    _need(_count(f.get("eligible_case_count")) and f["eligible_case_count"] == len(case_ids), "all cases are eligible")
    _need(_count(n) and n <= len(case_ids) and isinstance(cases, list) and len(cases) == n, "the fallback's cases are counted")
    _need(_close(f.get("fallback_rate"), n / len(case_ids) if case_ids else 0.0), "the fallback rate is that of the counts")
    for c in cases:
        _check_fallback_case(c, f["threshold"], set(case_ids))
    _need(len({c["case_id"] for c in cases}) == n, "a fallback case is listed twice")
    of = lambda k: [c[k] for c in cases if c.get(k) is not None]
    want = {}
    if n:
        want = {"accuracy": sum(of("correct")) / n, "p50_latency_ms": interpolated(of("latency_ms"), 0.5), "p95_latency_ms": interpolated(of("latency_ms"), 0.95)}
        if tokens := of("tokens_processed"):
            want["mean_tokens_processed"] = sum(tokens) / len(tokens)
    for k in ("accuracy", "p50_latency_ms", "p95_latency_ms", "mean_tokens_processed"):
        if k in want:
            _need(_close(f.get(k), want[k], 1e-6 if k.endswith("_ms") else 1e-9), f"the fallback's {k} is not that of its cases")
        else:
            _need(f.get(k) is None, f"the fallback's {k} must be null")
    if f.get("parse_valid_rate") is not None:
        parsed = of("parse_valid")
        _need(bool(parsed) and _number(f["parse_valid_rate"], 0, 1) and _close(f["parse_valid_rate"], sum(parsed) / len(parsed)), "the parse rate is not that of the cases")


def _check_split(d: object, what: str) -> None:
    _need(isinstance(d, dict) and _sha(d.get("sha256")), f"{what} needs a digest")
    ids = d.get("case_ids")
    _need(isinstance(ids, list) and bool(ids) and all(map(_name, ids)) and len(set(ids)) == len(ids), f"{what} needs distinct case ids")
    _need(_count(d.get("case_count")) and d["case_count"] == len(ids), f"{what}'s cases are counted")


def _check_artifact_body(a: dict) -> None:
    _need(_name(a.get("decision_type")) and _name(a.get("adapter")), "adapter and decision type are needed")
    _need(a.get("model_ref") is None or _name(a["model_ref"]), "the model reference is null or a name")
    _need(a.get("calibration_sha256") is None or _sha(a["calibration_sha256"]), "the calibration digest is null or a digest")
    _check_split(a.get("dataset"), "the dataset")
    _need(isinstance(a.get("metrics"), dict) and isinstance(a.get("fallback_evaluation"), dict), "metrics and fallback are objects")
    check_metrics(a["metrics"])
    if a.get("calibration") is not None:
        _check_split(a["calibration"], "the calibration")
        _need(a["calibration"]["sha256"] == a.get("calibration_sha256"), "there are two calibration digests")
        _need(not set(a["calibration"]["case_ids"]) & set(a["dataset"]["case_ids"]), "calibration and test share cases")
    check_operating_point(a.get("operating_point"))
    check_fallback(a["fallback_evaluation"], a["dataset"]["case_ids"])


def _named(body: dict, field: str, kind: str) -> dict:
    """The document with its digest and the name that follows from it."""
    content = digest(body)
    return body | {field: f"{kind}:{content}", "content_digest": content}


def _check_name(a: dict, field: str, kind: str) -> None:
    content = digest({k: v for k, v in a.items() if k not in (field, "content_digest")})
    _need(a.get("content_digest") == content, "the content digest does not match")
    _need(a.get(field) == f"{kind}:{content}", f"the {field} does not match")


def build_artifact(
    *, adapter: str, decision_type: str, dataset: dict, metrics: dict, model_ref: str | None = None, calibration: dict | None = None, calibration_sha256: str | None = None, operating_point: dict | None = None,
    fallback: dict | None = None, report_case_ids: Sequence[str] | None = None,
) -> dict:
    """A sealed artifact. dataset and calibration: sha256, case_count, case_ids; they must not share cases.

    ``report_case_ids``, if known, are the cases in the order in which they were evaluated.
    """
    split = lambda d: {"sha256": d["sha256"], "case_count": d.get("case_count", len(d["case_ids"])), "case_ids": list(d["case_ids"])}
    data, used = split(dataset), split(calibration) if calibration is not None else None
    _need(not report_case_ids or list(report_case_ids) == data["case_ids"], "the report is of other cases")
    body = {
        "schema_version": ARTIFACT, "decision_type": decision_type, "adapter": adapter, "model_ref": model_ref, "dataset": data, "calibration_sha256": calibration_sha256 if used is None or calibration_sha256 else used["sha256"],
        "metrics": {k: metrics.get(k) for k in (*SHARES, *AMOUNTS, TOKENS)}, "operating_point": operating_point, "fallback_evaluation": {"measured": False} | dict(fallback or {}),
    }
    if used is not None:
        body["calibration"] = used
    _check_artifact_body(body)
    return _named(body, "artifact_id", "decision-eval")


def verify_artifact(a: dict) -> None:
    """The seal and all semantics; a document that was changed and sealed again must still make sense."""
    _need(isinstance(a, dict) and a.get("schema_version") == ARTIFACT, "unknown artifact version")
    _check_name(a, "artifact_id", "decision-eval")
    _check_artifact_body(a)


def is_sound(a: dict) -> bool:
    return problem_in(a) is None


def problem_in(a: dict) -> str | None:
    """What is wrong with an artifact, None if nothing."""
    try:
        verify_artifact(a)
    except (ValueError, KeyError, TypeError, AttributeError, OverflowError) as e:
        return str(e)[:200] or type(e).__name__
    return None


PROFILE_FIELDS = frozenset(
    "schema_version profile_id content_digest adapter model_ref decision_type candidate_schema_version inventory_sha256 calibration method temperature execute_threshold margin_threshold risk_budget threshold_selection".split()
)


def build_profile(
    *, adapter: str, model_ref: str, decision_type: str, calibration: dict, temperature: float, execute_threshold: float, margin_threshold: float = 0.0, risk_budget: float | None = None, selection: str = MEDIAN, inventory_sha256: str | None = None
) -> dict:
    """A sealed profile of fitted settings and the calibration cases that they come from."""
    body = {
        "schema_version": PROFILE, "adapter": adapter, "model_ref": model_ref, "decision_type": decision_type, "candidate_schema_version": CANDIDATE_SET, "inventory_sha256": inventory_sha256, "calibration": dict(calibration),
        "method": METHOD, "temperature": temperature, "execute_threshold": execute_threshold, "margin_threshold": margin_threshold, "risk_budget": risk_budget, "threshold_selection": selection,
    }
    out = _named(body, "profile_id", "calibration-profile")
    verify_profile(out)
    return out


def verify_profile(p: dict) -> None:
    """The profile's fields, their ranges and its seal; no proof of a good fit."""
    _need(isinstance(p, dict) and set(p) == PROFILE_FIELDS, "the profile's fields are not those of its version")
    _need((p["schema_version"], p["candidate_schema_version"], p["method"]) == (PROFILE, CANDIDATE_SET, METHOD), "unknown profile version or method")
    _need(all(_name(p[k]) for k in ("adapter", "model_ref", "decision_type")), "adapter, model and decision type are needed")
    _need(p["inventory_sha256"] is None or _sha(p["inventory_sha256"]), "the inventory digest is null or a digest")
    _need(isinstance(p["calibration"], dict) and set(p["calibration"]) == {"sha256", "case_count", "case_ids"}, "the calibration has other fields")
    _check_split(p["calibration"], "the calibration")
    _need(_number(p["temperature"]) and p["temperature"] > 0, "the temperature must be positive")
    _need(all(_number(p[k], 0, 1) for k in ("execute_threshold", "margin_threshold")), "thresholds lie in [0, 1]")
    _need(p["risk_budget"] is None or _number(p["risk_budget"], 0, 1), "the budget is null or lies in [0, 1]")
    _need(p["threshold_selection"] in (BUDGET, MEDIAN), "unknown threshold selection")
    _need(p["threshold_selection"] != BUDGET or p["risk_budget"] is not None, "a selection by budget has one")
    _check_name(p, "profile_id", "calibration-profile")


def decide_with_profile(scored: DataFrame, profile: dict, *, adapter: str, model_ref: str, decision_type: str, inventory_sha256: str | None = None) -> DataFrame:
    """Calibrate and gate with a verified profile of the same adapter, model, inventory and decision type.

    Only a threshold that a risk budget selected may execute. Rows of another decision type, of
    calibration cases or with an invalid distribution fail the job; the calibration ids are a table
    that rows are joined with.
    """
    from ..functions import scores as S
    from . import gate as G

    verify_profile(profile)
    same = {"adapter": adapter, "model_ref": model_ref, "decision_type": decision_type, "inventory_sha256": inventory_sha256}
    for k, v in same.items():
        _need(profile[k] == v, f"the profile is of another {k}")
    _need(profile["threshold_selection"] == BUDGET, "only a risk budget may automate")
    used = scored.sparkSession.createDataFrame([(i, True) for i in profile["calibration"]["case_ids"]], "_used_id string, _used boolean")
    joined = scored.join(used, scored["case_id"].cast("string") == used["_used_id"], "left")
    fail = lambda bad, what: F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(what)).cast("boolean")).otherwise(F.lit(True))
    fresh = joined.where(fail(F.col("_used").isNotNull(), "a case was used for calibration")).drop("_used", "_used_id")
    if "decision_type" in scored.columns:
        fresh = fresh.where(fail(F.col("decision_type") != decision_type, "a case is of another decision type"))
    calibrated = G.require_valid(fresh).withColumn("scores", S.temperature_scaled("scores", profile["temperature"]))
    return G.decide(calibrated, G.ThresholdPolicy(profile["execute_threshold"], profile["margin_threshold"]))


def contract_matrix(artifacts: Sequence[dict]) -> dict:
    """One row for each artifact, in order; all must be sound, of one decision type and of the same cases."""
    _need(bool(artifacts), "a matrix needs artifacts")
    wrong = [str(i) for i, a in enumerate(artifacts) if not is_sound(a)]
    _need(not wrong, "unsound artifacts: " + ",".join(wrong))
    first = artifacts[0]
    same = lambda a: (a["schema_version"], a["decision_type"], a["dataset"]["sha256"], a["dataset"]["case_ids"])
    _need(all(same(a) == same(first) for a in artifacts), "artifacts differ in decision type or cases")
    return {"schema_version": MATRIX, "decision_eval_schema_version": ARTIFACT, "decision_type": first["decision_type"], "dataset": dict(first["dataset"]), "rows": [_matrix_row(a) for a in artifacts]}


def _matrix_row(a: dict) -> dict:
    point, fall = a.get("operating_point") or {}, a["fallback_evaluation"]
    row = {k: a.get(k) for k in ("artifact_id", "content_digest", "adapter", "model_ref", "calibration_sha256")} | {"calibration_case_count": (a.get("calibration") or {}).get("case_count")}
    row |= {k: a["metrics"][k] for k in (*SHARES, "nll", "p50_latency_ms", "p95_latency_ms", TOKENS)} | {"operating_threshold": point.get("threshold")}
    row |= {k: point.get(k) for k in POINT[1:]} | {"fallback_measured": fall["measured"]}
    return row | {f"fallback_{k}": fall.get(k) for k in ("adapter", "accuracy", "p50_latency_ms", "p95_latency_ms", "mean_tokens_processed")}


@F.pandas_udf(StringType())
def problem_of(texts: pd.Series) -> pd.Series:
    """For each artifact's JSON, NULL if it is sound, else what is wrong; null text is wrong."""

    def one(text: str | None) -> str | None:
        try:
            return problem_in(json.loads(text))
        except (ValueError, TypeError):
            return "no JSON document"

    return texts.map(one)


def report_of(results: DataFrame, by: str | None = None) -> dict:
    """The metrics of case results under the artifact's names; with ``by``, a dictionary of them."""
    names = {**{k: k for k in (*SHARES, *AMOUNTS)}, "mean_tokens": TOKENS}
    rows = M.benchmark_report(results, by=[by] if by else ()).collect()
    made = [{new: r[old] for old, new in names.items()} for r in rows]
    return {r[by]: m for r, m in zip(rows, made)} if by else made[0]


def variants(artifact: dict) -> Iterator[tuple[str, dict]]:
    """The artifact, changed ones, and changed ones that were sealed again."""
    yield "sound", artifact
    changes = {"accuracy": ("metrics", "accuracy", 2.0), "ids": ("dataset", "case_ids", artifact["dataset"]["case_ids"][:-1]), "measured": ("fallback_evaluation", "measured", None)}
    for name, (part, field, value) in changes.items():
        changed = {k: v for k, v in artifact.items() if k not in ("artifact_id", "content_digest")} | {part: artifact[part] | {field: value}}
        yield f"changed {name}", artifact | changed
        yield f"resealed {name}", _named(changed, "artifact_id", "decision-eval")
    yield "other name", artifact | {"artifact_id": "decision-eval:" + digest("x")}
