"""Cases as JSON lines: a fail-closed scan with line order, and the sink."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "case_id STRING, decision_type STRING, context STRING, candidates ARRAY<STRING>, gold_candidate STRING, metadata STRING, _bad STRING"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, case_id, decision_type, context and metadata (JSON text), candidates, gold.

    Blank lines are skipped. ``ordinal`` increases with the position in the files. A line that is
    no JSON object, lacks a required field or has a gold label that is no string fails the job
    with the line's content.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ordinal"), F.col("value").alias("line")).where(F.trim("line") != "")
    row = F.from_json("line", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    loose = F.try_parse_json("line")
    gold_kind = F.schema_of_variant(F.try_variant_get(loose, "$.gold_candidate", "variant"))
    parsed = lines.select("ordinal", "line", row.alias("r"), gold_kind.alias("gold_kind"))
    good = F.col("r._bad").isNull() & F.col("r.case_id").isNotNull() & F.col("r.decision_type").isNotNull() & F.col("r.candidates").isNotNull() & F.coalesce(F.col("gold_kind").isin("STRING", "VOID"), F.lit(True))
    checked = parsed.where(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid case line: "), F.substring("line", 1, 200)))))
    return checked.select("ordinal", F.col("r.case_id").alias("case_id"), F.col("r.decision_type").alias("decision_type"), F.coalesce("r.context", F.lit("{}")).alias("context"), F.col("r.candidates").alias("candidates"), F.col("r.gold_candidate").alias("gold"), F.coalesce("r.metadata", F.lit("{}")).alias("metadata"))


ANNOTATION = (
    "split STRING, annotation_version STRING, coverage STRING, ambiguity STRING, automation_risk STRING, operation_effect STRING, expected_abstain BOOLEAN, label_rationale STRING, gold_rationale STRING, label_basis STRING, "
    "plausible_candidates ARRAY<STRING>, evidence_refs ARRAY<STRUCT<repository: STRING, revision: STRING, path: STRING>>"
)


def annotated(cases: DataFrame) -> DataFrame:
    """Cases with the fields of their annotation as columns; what is missing or of another type is null."""
    return cases.withColumn("_a", F.from_json("metadata", ANNOTATION)).select(*cases.columns, "_a.*")


def case_line(row) -> str:
    """The line of a case: fixed key order, UTF-8 unescaped."""
    return json.dumps(
        {"case_id": row["case_id"], "decision_type": row["decision_type"], "context": json.loads(row["context"]), "candidates": list(row["candidates"]), "gold_candidate": row["gold"], "metadata": json.loads(row["metadata"])},
        ensure_ascii=False,
    )


def write_cases(cases: DataFrame, path: str) -> None:
    """Write cases in line order as a folder of JSON-lines files, in parallel."""
    @F.pandas_udf("string")
    def line(case_id: pd.Series, decision_type: pd.Series, context: pd.Series, candidates: pd.Series, gold: pd.Series, metadata: pd.Series) -> pd.Series:
        names = ("case_id", "decision_type", "context", "candidates", "gold", "metadata")
        return pd.Series([case_line(dict(zip(names, x))) for x in zip(case_id, decision_type, context, candidates, gold, metadata)])

    line_column = line("case_id", "decision_type", "context", "candidates", "gold", "metadata").alias("value")
    cases.orderBy("ordinal").select(line_column).write.text(path)


def fingerprint(cases: DataFrame, block: int = 1 << 16) -> DataFrame:
    """case_count and the digest of the ordered ids of a dataset (ordinal, case_id).

    Ids are digested by blocks of ordinals, and then the blocks' digests in order, so no row holds
    more than a block or one digest for each block.
    """
    ordered = lambda key, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), "\n"), 256)
    parts = cases.withColumn("_block", F.expr(f"ordinal div {int(block)}")).groupBy("_block").agg(F.count(F.lit(1)).alias("n"), ordered("ordinal", "case_id").alias("_digest"))
    return parts.agg(F.sum("n").alias("case_count"), ordered("_block", "_digest").alias("ids_sha256"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"))
