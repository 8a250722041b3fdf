"""Deterministic workloads of scored cases over the test tables, in Spark and in SQL.

Weights are integers, so probabilities are the same doubles in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _weighted(candidates: tuple[str, ...], key: str, other: str, gold: str, a: int = 7, b: int = 13, bonus: int = 60, first: int = 0) -> tuple:
    listed = F.array(*map(F.lit, candidates))
    weight = lambda c, k: (F.lit(1) + F.pmod(F.col(key) * a + k * b + F.col(other), F.lit(101)) + F.when((c == F.col(gold)) & (F.col(key) % 3 != 0), bonus).otherwise(0) + F.when(k == 0, first).otherwise(0)).cast("double")
    return listed, F.transform(listed, weight)


def events(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    """Cases of event types; ``second``: another scorer's weights."""
    e = table(spark, sf_dir, "events")
    listed, w = _weighted(EVENT_TYPES, "event_id", "user_id", "event_type", *((11, 17, 90) if second else ()))
    return e.select(F.col("event_id").alias("case_id"), "user_id", listed.alias("candidates"), S.distribution(listed, S.normalised(w)).alias("scores"), F.col("event_type").alias("gold"), F.col("value").alias("latency_ms"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 50).alias("tokens"), "ts", "props")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    listed, w = _weighted(PRIORITIES, "o_orderkey", "o_custkey", "o_orderpriority")
    return o.select(F.col("o_orderkey").alias("case_id"), "o_custkey", listed.alias("candidates"), S.distribution(listed, S.normalised(w)).alias("scores"), F.col("o_orderpriority").alias("gold"), F.col("o_totalprice").alias("latency_ms"), (F.col("o_custkey") % 200).alias("tokens"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of return flags; lines have no key of their own, which scoring in the row does not need."""
    x = table(spark, sf_dir, "lineitem")
    listed, w = _weighted(("A", "N", "R"), "l_orderkey", "l_partkey", "l_returnflag")
    return x.select(F.col("l_orderkey").alias("case_id"), listed.alias("candidates"), S.distribution(listed, S.normalised(w)).alias("scores"), F.col("l_returnflag").alias("gold"))


def abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality decisions on labelled documents; toxic ones are to be left alone."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    listed = F.array(F.lit("0"), F.lit("1"))
    w = F.array((1 + F.col("n_chars") % 97).cast("double"), (1 + F.col("n_chars") * 7 % 89).cast("double"))
    return d.select(
        F.col("doc_id").alias("case_id"), listed.alias("candidates"), S.distribution(listed, S.normalised(w)).alias("scores"), F.col("quality").cast("string").alias("gold"), (F.col("toxic") == 1).alias("expected_abstain"),
        F.when(F.col("lang") == "fr", "missing_candidate").when(F.col("lang") == "de", "unsupported").otherwise("covered").alias("coverage"),
        F.element_at(F.array(*map(F.lit, ("underspecified", "multi_valid", "near_neighbor", "clear"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("ambiguity"),
        F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), (F.col("n_chars") % 3 + 1).cast("int")).alias("automation_risk"),
    )


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text that may hold a JSON choice; every fifth has no braces, every fifth an unknown candidate."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1)
    name = F.when(F.col("event_id") % 5 == 1, F.lit("nothing")).otherwise(F.col("event_type"))
    body = F.concat(F.lit('I choose {"candidate": "'), name, F.lit('", "confidence": '), (k.cast("double") / 100.0).cast("string"), F.lit("} because"))
    return e.select(F.col("event_id").alias("case_id"), F.array(*map(F.lit, EVENT_TYPES)).alias("candidates"), F.when(F.col("event_id") % 5 == 0, F.lit("no choice")).otherwise(body).alias("text"), F.col("event_type").alias("gold"))


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as tools."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat_ws("::", F.lit("part"), F.col("p_partkey").cast("string")).alias("name"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("description"), F.col("p_brand").alias("server"), "p_partkey")


def dealt(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """Rows of a small file that are much work each, in tasks for all cores."""
    return df.repartition(4 * spark.sparkContext.defaultParallelism, key)


def tool_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries of the suites: parts whose key is divisible by 50, against all tools."""
    t = dealt(spark, tools(spark, sf_dir).where("p_partkey % 50 = 0"), "p_partkey")
    return t.select(F.concat(F.lit("case"), F.col("p_partkey")).alias("case_id"), F.col("name").alias("gold"), F.col("description").alias("query"))


def suppliers(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    """A small closed set: suppliers by the remainder of their nation; ``second``: another scorer's weights."""
    x = table(spark, sf_dir, "supplier").withColumn("gold", (F.col("s_nationkey") % 3).cast("string"))
    listed, w = _weighted(("0", "1", "2"), "s_suppkey", "s_nationkey", "gold", *((11, 17, 90) if second else ()))
    return x.select(F.col("s_suppkey").cast("string").alias("case_id"), listed.alias("candidates"), S.distribution(listed, S.normalised(w)).alias("scores"), "gold", (F.col("s_suppkey") % 100).cast("double").alias("latency_ms"))


def turns(spark: SparkSession, sf_dir: str, side: int, clean: bool = True) -> DataFrame:
    """Turns as trace cases of one split; the clean split is by conversation, the leaky one by turn."""
    c = table(spark, sf_dir, "conversations")
    return c.where((F.col("conv_id") if clean else F.col("turn")) % 2 == side).select(F.concat_ws(":", "conv_id", "turn").alias("case_id"), F.col("conv_id").alias("group_id"), F.concat_ws(":", "conv_id", "turn").alias("record_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"), "role", "text")


# --- the same in SQL -------------------------------------------------------------------------

EVT = """
k AS (SELECT * FROM (VALUES (0,'click'),(1,'error'),(2,'purchase'),(3,'signup'),(4,'view')) AS t(pos, cand)),
evt_w AS (
  SELECT event_id AS case_id, user_id, event_type AS gold, value AS latency_ms, CASE WHEN event_id % 4 <> 0 THEN event_id % 50 END AS tokens, pos, cand,
    CAST(1 + (event_id * 7 + pos * 13 + user_id) % 101 + CASE WHEN cand = event_type AND event_id % 3 <> 0 THEN 60 ELSE 0 END AS DOUBLE) AS w,
    CAST(1 + (event_id * 11 + pos * 17 + user_id) % 101 + CASE WHEN cand = event_type AND event_id % 3 <> 0 THEN 90 ELSE 0 END AS DOUBLE) AS w2
  FROM events, k
),
evt AS (SELECT *, w / sum(w) OVER (PARTITION BY case_id) AS p, w2 / sum(w2) OVER (PARTITION BY case_id) AS p2 FROM evt_w),
evt_r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY p DESC, pos) AS rn, row_number() OVER (PARTITION BY case_id ORDER BY p2 DESC, pos) AS rn2 FROM evt),
evt_top AS (
  SELECT case_id, max(gold) AS gold, max(latency_ms) AS latency_ms, max(tokens) AS tokens,
    max(CASE WHEN rn = 1 THEN cand END) AS predicted, max(CASE WHEN rn = 1 THEN p END) AS confidence, max(CASE WHEN rn = 2 THEN p END) AS runner_up,
    max(CASE WHEN rn2 = 1 THEN cand END) AS predicted2, max(CASE WHEN rn2 = 1 THEN p2 END) AS confidence2, max(CASE WHEN cand = gold THEN p END) AS gold_probability
  FROM evt_r GROUP BY case_id
),
res AS (SELECT *, predicted = gold AS correct FROM evt_top)
"""

ORD = """
k AS (SELECT * FROM (VALUES (0,'1-URGENT'),(1,'2-HIGH'),(2,'3-MEDIUM'),(3,'4-NOT SPECIFIED'),(4,'5-LOW')) AS t(pos, cand)),
ord_w AS (
  SELECT o_orderkey AS case_id, o_orderpriority AS gold, o_totalprice AS latency_ms, o_custkey % 200 AS tokens, pos, cand,
    CAST(1 + (o_orderkey * 7 + pos * 13 + o_custkey) % 101 + CASE WHEN cand = o_orderpriority AND o_orderkey % 3 <> 0 THEN 60 ELSE 0 END AS DOUBLE) AS w
  FROM orders, k
),
ord AS (SELECT *, w / sum(w) OVER (PARTITION BY case_id) AS p FROM ord_w),
ord_r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY p DESC, pos) AS rn FROM ord),
res AS (
  SELECT *, predicted = gold AS correct FROM (
    SELECT case_id, max(gold) AS gold, max(latency_ms) AS latency_ms, max(tokens) AS tokens, max(CASE WHEN rn = 1 THEN cand END) AS predicted, max(CASE WHEN rn = 1 THEN p END) AS confidence, max(CASE WHEN cand = gold THEN p END) AS gold_probability
    FROM ord_r GROUP BY case_id)
)
"""

ABS = """
abs_all AS (
  SELECT d.doc_id AS case_id, CAST(l.quality AS VARCHAR) AS gold, l.toxic = 1 AS expected_abstain,
    CASE WHEN d.lang = 'fr' THEN 'missing_candidate' WHEN d.lang = 'de' THEN 'unsupported' ELSE 'covered' END AS coverage,
    CASE d.doc_id % 4 WHEN 0 THEN 'underspecified' WHEN 1 THEN 'multi_valid' WHEN 2 THEN 'near_neighbor' ELSE 'clear' END AS ambiguity,
    CASE d.n_chars % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS automation_risk,
    CAST(1 + d.n_chars % 97 AS DOUBLE) AS w0, CAST(1 + d.n_chars * 7 % 89 AS DOUBLE) AS w1
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
abs_cases AS (
  SELECT *, greatest(w0, w1) / (w0 + w1) >= 0.6::DOUBLE AS accepted, CASE WHEN NOT expected_abstain THEN (CASE WHEN w0 >= w1 THEN '0' ELSE '1' END) = gold END AS correct_when_covered FROM abs_all
)
"""

TOOLS = """
tool AS (SELECT 'part::' || p_partkey AS name, p_name || ' ' || p_type || ' ' || p_brand AS description, p_brand AS server, p_partkey FROM part),
tcase AS (SELECT 'case' || p_partkey AS case_id, name AS gold, description AS query FROM tool WHERE p_partkey % 50 = 0)
"""

SUP = """
sup_w AS (
  SELECT s_suppkey AS case_id, CAST(s_nationkey % 3 AS VARCHAR) AS gold, pos, CAST(pos AS VARCHAR) AS cand, CAST(s_suppkey % 100 AS DOUBLE) AS latency_ms,
    CAST(1 + (s_suppkey * 7 + pos * 13 + s_nationkey) % 101 + CASE WHEN pos = s_nationkey % 3 AND s_suppkey % 3 <> 0 THEN 60 ELSE 0 END AS DOUBLE) AS w,
    CAST(1 + (s_suppkey * 11 + pos * 17 + s_nationkey) % 101 + CASE WHEN pos = s_nationkey % 3 AND s_suppkey % 3 <> 0 THEN 90 ELSE 0 END AS DOUBLE) AS w2
  FROM supplier, (SELECT * FROM (VALUES (0), (1), (2)) AS t(pos))
),
sup_p AS (SELECT 'A-weights' AS arm, case_id, gold, pos, cand, latency_ms, w / sum(w) OVER (PARTITION BY case_id) AS p FROM sup_w UNION ALL SELECT 'B-second', case_id, gold, pos, cand, latency_ms, w2 / sum(w2) OVER (PARTITION BY case_id) FROM sup_w),
sup_r AS (SELECT *, row_number() OVER (PARTITION BY arm, case_id ORDER BY p DESC, pos) AS rn FROM sup_p),
arms AS (SELECT arm, case_id, p AS confidence, cand = gold AS correct, latency_ms FROM sup_r WHERE rn = 1)
"""
