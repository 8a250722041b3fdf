"""Contracts of datasets as violation rows: (case_id, rule) for every rule that a case breaks.

A validator is lazy and lists everything; ``require_none`` makes it fail closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the contracts
COVERAGE = ("covered", "missing_candidate", "unsupported")
AMBIGUITY = ("clear", "near_neighbor", "underspecified", "multi_valid")
RISK = ("low", "medium", "high")
EFFECT = ("read_only", "sensitive_read", "write_capable", "unknown")
ANNOTATION_VERSION = "mcp-routing-label/v1"
TRACE_VERSION = "trace-backed-routing/v1"
SOURCE_TYPES = ("production_trace", "incident_record", "user_study", "support_case")
TRANSFORMATIONS = ("verbatim_sanitized", "semantic_rewrite")
LABEL_SOURCES = ("observed_tool_selection", "human_adjudication", "upstream_contract_relabel")
SANITIZATION = ("pii_removed", "secrets_removed", "customer_identifiers_removed", "free_text_reviewed")
PSEUDONYMIZATION = "salted_sha256"
OUTPUT_VERSION = "decision-output/v1"
DIGEST = "^sha256:[0-9a-f]{64}$"


def require_none(violations: DataFrame, what: str = "dataset") -> None:
    """Raise with the first few violations, if there are any."""
    rows = violations.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def _rows(df: DataFrame, rules: list[tuple[str, Column]], *keys: str) -> DataFrame:
    broken = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(broken).alias("rule"))


def annotation_violations(cases: DataFrame, require_source_grounding: bool = False) -> DataFrame:
    """Broken rules of the routing annotation, one row each.

    Columns: case_id, candidates, gold, annotation_version, coverage, ambiguity, automation_risk,
    operation_effect, expected_abstain, label_rationale, gold_rationale, label_basis,
    plausible_candidates and evidence_refs (repository, revision, path).
    """
    c = F.col
    rationale = F.length(F.trim(F.coalesce("label_rationale", "gold_rationale", F.lit(""))))
    covered, missing, unsupported = (c("coverage") == x for x in COVERAGE)
    ambiguous = c("ambiguity").isin("underspecified", "multi_valid")
    abstain = F.coalesce("expected_abstain", F.lit(False))
    listed = F.coalesce(F.array_contains("candidates", c("gold")), F.lit(False))
    p = c("plausible_candidates")
    plausible = F.coalesce((F.size(p) >= 2) & (F.size(F.array_except(p, "candidates")) == 0) & (F.size(F.array_distinct(p)) == F.size(p)), F.lit(False))
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    refs = F.coalesce((F.size("evidence_refs") > 0) & ~F.exists("evidence_refs", lambda r: blank(r["repository"]) | blank(r["revision"]) | blank(r["path"])), F.lit(False))
    allowed = lambda name, values: (name, ~F.coalesce(c(name).isin(*values), F.lit(False)))
    open_case = covered & abstain & ambiguous
    rules = [
        ("annotation_version", ~F.coalesce(c("annotation_version") == ANNOTATION_VERSION, F.lit(False))),
        allowed("coverage", COVERAGE), allowed("ambiguity", AMBIGUITY), allowed("automation_risk", RISK), allowed("operation_effect", EFFECT),
        ("expected_abstain", c("expected_abstain").isNull()),
        ("rationale", rationale < 20),
        ("label_basis", blank(c("label_basis"))),
        ("open_gold", open_case & c("gold").isNotNull()),
        ("open_plausible", open_case & ~plausible),
        ("covered_gold", covered & ~open_case & ~listed),
        ("missing_gold", missing & (c("gold").isNull() | listed)),
        ("missing_abstain", missing & ~abstain),
        ("unsupported_gold", unsupported & c("gold").isNotNull()),
        ("unsupported_abstain", unsupported & ~abstain),
        ("ambiguous_abstain", ambiguous & ~abstain),
        ("high_risk_effect", (c("automation_risk") == "high") & (c("operation_effect") != "write_capable")),
        ("write_low_risk", (c("operation_effect") == "write_capable") & (c("automation_risk") == "low")),
    ]
    if require_source_grounding:
        rules += [("grounded_basis", c("label_basis") != "upstream_tool_contract"), ("evidence_refs", ~refs)]
    return _rows(cases, rules, "case_id")


def category_counts(cases: DataFrame, *columns: str) -> DataFrame:
    """(category, value, n) of several columns in one aggregation."""
    pairs = F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).cast("string").alias("value")) for k in columns])
    return cases.select(F.explode(pairs).alias("x")).groupBy("x.category", "x.value").agg(F.count(F.lit(1)).alias("n"))


def split_labels(cases: DataFrame, expected: str) -> DataFrame:
    """Cases whose declared split is another one."""
    return _rows(cases, [("split", ~F.coalesce(F.col("split") == expected, F.lit(False)))], "case_id")


def repeated_ids(cases: DataFrame) -> DataFrame:
    return cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def overlap(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """Distinct values that both sides have."""
    return left.select(*columns).intersect(right.select(*columns))


def dangling_references(cases: DataFrame, tools: DataFrame) -> DataFrame:
    """(case_id, role, name) of candidates and gold labels that the inventory does not have.

    A missing gold label is an error too, unless the case is covered or unsupported.
    """
    refs = cases.select("case_id", F.explode(F.concat(F.transform("candidates", lambda x: F.struct(F.lit("candidate").alias("role"), x.alias("name"))), F.array(F.struct(F.lit("gold").alias("role"), F.col("gold").alias("name"))))).alias("r"), "coverage")
    flat = refs.select("case_id", "r.role", "r.name", "coverage")
    absent = flat.where("name is not null").join(tools.select("name").distinct(), "name", "left_anti").select("case_id", "role", "name")
    no_gold = flat.where((F.col("role") == "gold") & F.col("name").isNull() & ~F.coalesce(F.col("coverage").isin("unsupported", "covered"), F.lit(False))).select("case_id", "role", "name")
    return absent.unionByName(no_gold)


def trace_violations(cases: DataFrame) -> DataFrame:
    """Broken rules of the trace provenance, a struct ``trace``; what is null breaks its rule.

    Where the cases have decision_type, context (JSON text), candidates and gold, the released
    digest must be that of what they say.
    """
    t = lambda x: F.col(f"trace.{x}")
    missing = lambda ok: ~F.coalesce(ok, F.lit(False))
    allowed = {"source_type": SOURCE_TYPES, "transformation": TRANSFORMATIONS, "label_source": LABEL_SOURCES}
    rules = [
        ("version", missing(t("version") == TRACE_VERSION)),
        *((k, missing(t(k).isin(*v))) for k, v in allowed.items()),
        *((k, missing(t(k).rlike(DIGEST))) for k in ("source_artifact_sha256", "source_record_sha256", "source_group_sha256", "released_case_sha256")),
        ("pseudonymization", missing(t("identifier_pseudonymization") == PSEUDONYMIZATION)),
        *((f"sanitization_{k}", missing(F.col(f"trace.sanitization.{k}"))) for k in SANITIZATION),
        ("approval", missing(t("benchmark_release_approved"))),
        ("reviewers", missing(t("reviewer_count") >= F.when(F.col("ambiguity").isin("underspecified", "multi_valid"), 2).otherwise(1))),
    ]
    if {"decision_type", "context", "candidates", "gold"} <= set(cases.columns):
        from .corpora import trace_fingerprint

        rules.append(("released_fingerprint", t("released_case_sha256").rlike(DIGEST) & missing(t("released_case_sha256") == trace_fingerprint())))
    return _rows(cases, rules, "case_id")


def trace_summary(cases: DataFrame) -> DataFrame:
    """(category, value, n): cases by source type, transformation and label source, and the number of source groups."""
    named = cases.select(*[F.col(f"trace.{k}").alias(k) for k in ("source_type", "transformation", "label_source")])
    groups = cases.agg(F.countDistinct("trace.source_group_sha256").alias("n")).select(F.lit("source_groups").alias("category"), F.lit(None).cast("string").alias("value"), "n")
    return category_counts(named, *named.columns).unionByName(groups)


def trace_isolation(calibration: DataFrame, test: DataFrame) -> DataFrame:
    """(kind, value) of groups, records and released cases that both splits have."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in (("group", "group_id"), ("record", "record_id"), ("fingerprint", "fingerprint"))])
    sides = [d.select(F.explode(kinds).alias("x")).select("x.kind", "x.value").where("value is not null") for d in (calibration, test)]
    return sides[0].intersect(sides[1])


def embedding_violations(vectors: DataFrame) -> DataFrame:
    """(name, rule): wrong or different dimension, values that are not finite, zero norm, repeated names.

    Vectors that differ from the most frequent dimension (the smaller of equals) are the wrong ones.
    """
    sized = vectors.select("name", "vector", F.size("vector").alias("dim"))
    usual = sized.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).select(F.col("dim").alias("usual"))
    repeated = vectors.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", F.lit("repeated_name").alias("rule"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rules = [("dimension", F.coalesce(F.col("dim") <= 0, F.lit(True)) | (F.col("dim") != F.col("usual"))), ("not_finite", ~finite), ("zero_norm", F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) == 0)]
    return _rows(sized.crossJoin(F.broadcast(usual)), rules, "name").unionByName(repeated)


def embedding_coverage(vectors: DataFrame, tools: DataFrame) -> DataFrame:
    """(name, rule): tools without a vector, vectors without a tool."""
    v, t = vectors.select("name").distinct(), tools.select("name").distinct()
    return t.join(v, "name", "left_anti").select("name", F.lit("missing").alias("rule")).unionByName(v.join(t, "name", "left_anti").select("name", F.lit("extra").alias("rule")))


def decision_output_violations(outputs: DataFrame) -> DataFrame:
    """Broken rules of typed outputs: kind, candidates, abstain, value (VARIANT), confidence and, where there, schema_version.

    A value is null exactly if the output abstains; choices are listed and not empty, booleans are
    strict, scores lie in [0, 1]. An output that does not say whether it abstains is wrong, and its
    value and confidence are judged as if it did not.
    """
    value = F.col("value")
    kind_of = F.schema_of_variant(value)
    text, number, flag = (F.try_variant_get(value, "$", k) for k in ("string", "double", "boolean"))
    none = F.coalesce(value.isNull() | (kind_of == "VOID"), F.lit(True))
    abstain = F.coalesce(F.col("abstain"), F.lit(False))
    given = ~abstain & ~none
    listed = F.coalesce(F.array_contains("candidates", text), F.col("candidates").isNull(), F.lit(False))
    rules = [
        ("kind", ~F.coalesce(F.col("kind").isin("choice", "boolean", "score"), F.lit(False))),
        ("abstain", F.col("abstain").isNull()),
        ("abstain_value", abstain & ~none),
        ("abstain_confidence", abstain & F.col("confidence").isNotNull()),
        ("value_missing", ~abstain & none),
        ("confidence", ~abstain & ~F.coalesce(F.col("confidence").between(0.0, 1.0) & ~F.isnan("confidence"), F.lit(False))),
        ("choice", given & (F.col("kind") == "choice") & ~F.coalesce((kind_of == "STRING") & (text != "") & listed, F.lit(False))),
        ("boolean", given & (F.col("kind") == "boolean") & ~F.coalesce((kind_of == "BOOLEAN") & flag.isNotNull(), F.lit(False))),
        ("score", given & (F.col("kind") == "score") & ~F.coalesce(~kind_of.isin("STRING", "BOOLEAN") & number.between(0.0, 1.0), F.lit(False))),
    ]
    if "schema_version" in outputs.columns:
        rules.append(("schema_version", ~F.coalesce(F.col("schema_version") == OUTPUT_VERSION, F.lit(False))))
    return _rows(outputs, rules, "case_id")


def decision_output(kind: str, value: object, confidence: float | None, candidates: list[str] | None = None) -> dict:
    """A typed output; refuses what the contract refuses, and choices without the candidates that they come from."""
    chance = lambda x: type(x) in (int, float) and 0 <= x <= 1
    fits = {"choice": lambda: isinstance(value, str) and value != "" and candidates is not None and value in candidates, "boolean": lambda: type(value) is bool, "score": lambda: chance(value)}
    if kind not in fits or not (confidence is None if value is None else fits[kind]() and chance(confidence)):
        raise ValueError("no typed decision output")
    return {"schema_version": OUTPUT_VERSION, "kind": kind, "value": value, "abstain": value is None, "confidence": confidence}
