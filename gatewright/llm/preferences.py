"""Preference formatting of chosen and rejected conversations, in DataFrame operations only.

Method. Turns of both sides become narrow rows (pair, turn, two hashes of role and text) with
a flag for each side. A turn that only one side has is where the conversations part; the
smallest such turn of a pair ends the longest common prefix. Turns before it are rendered
once as the prompt, the others as the completion of their side, with the spans that count
for the loss (what assistants say, with the mark that ends a turn).

The prefix comes from two aggregations of narrow rows that combine map-side. Texts cross the
network once, in the aggregation that gathers them; where the pair parts travels with them as
a marker row, so no join moves texts. Rendering gathers at most ``chunk_turns`` turn numbers of
a pair in one row: the result always has one row for each such range of a pair's turn numbers
(chunk 0, 1, ...), so a conversation of any length is spread over rows and tasks.

Defined results: null texts and roles are empty; null turns come last; equal rows count
once; several texts at one turn are all kept, ordered by role and text; rows without a
conversation id form no pair; equal conversations have empty completions; a pair of which
one side is missing has an empty prompt; null turns are one turn number each, after all
others; very long texts are whole; extra columns are ignored, whatever their names; an empty
table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LAST = (1 << 63) - 1
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _turns(df: DataFrame, pair: str, chosen: int) -> DataFrame:
    return df.where(F.col(pair).isNotNull()).select(
        F.col(pair).alias("pair_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(chosen).alias("c"),
        F.lit(1 - chosen).alias("r"),
    )


def _rendered(turns: str) -> str:
    """SQL for a struct (text, mask, n) of an array of turns; the mask lists start:end in code points."""
    piece = f"concat('{OPEN}', t.role, '|>\\n', t.text, '<|end|>\\n')"
    head = "length(t.role) + 5"
    return (
        f"aggregate({turns}, named_struct('text', '', 'mask', '', 'n', 0), (a, t) -> named_struct("
        f"'text', concat(a.text, {piece}), "
        f"'mask', if(t.role = 'assistant', concat(a.mask, if(a.mask = '', '', ','), a.n + {head}, ':', a.n + length({piece}) - 1), a.mask), "
        f"'n', a.n + length({piece})))"
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", chunk_turns: int = 64) -> DataFrame:
    """Prompt and paired masked completions of each pair; both inputs have turn, role and text.

    Returns pair_id, chunk, prompt, chosen, chosen_mask, rejected, rejected_mask and the
    numbers of turns in each; masks are ``start:end`` spans of the completion that count.
    """
    rows = _turns(chosen, pair, 1).unionAll(_turns(rejected, pair, 0))
    chunk = F.expr(f"(turn - pmod(turn, {int(chunk_turns)}L)) div {int(chunk_turns)}")
    keys = rows.select("pair_id", "turn", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), F.length("text"), "text", "role").alias("h2"), "c", "r")
    # of a pair's chunks, which turns only one side has; sides that have the same are none
    sided = keys.groupBy("pair_id", "turn", "h1", "h2").agg(F.max("c").alias("c"), F.max("r").alias("r"))
    split = sided.where("c <> r").groupBy("pair_id").agg(F.min("turn").alias("split"))
    marks = keys.select("pair_id", chunk.alias("chunk")).distinct().join(split.withColumnRenamed("pair_id", "_pair"), F.col("pair_id") == F.col("_pair"))
    none = F.lit(None)
    wide = rows.select("pair_id", chunk.alias("chunk"), F.lit(None).cast("long").alias("split"), F.struct("turn", "role", "text").alias("t"), "c")
    marked = marks.select("pair_id", "chunk", "split", none.cast(wide.schema["t"].dataType).alias("t"), F.lit(0).alias("c"))
    parts = wide.unionAll(marked).groupBy("pair_id", "chunk").agg(
        F.max("split").alias("split"), F.array_sort(F.collect_set(F.when(F.col("c") == 1, F.col("t")))).alias("mine"), F.array_sort(F.collect_set(F.when(F.col("c") == 0, F.col("t")))).alias("other")
    )
    # before the split both sides are the same; without a split they are all the same
    split_at = F.coalesce("split", F.lit(LAST))
    whole = F.col("split").isNull()
    shares = parts.select(
        "pair_id", "chunk",
        F.filter("mine", lambda t: whole | (t["turn"] < split_at)).alias("p"),
        F.filter("mine", lambda t: ~whole & (t["turn"] >= split_at)).alias("y"),
        F.filter("other", lambda t: ~whole & (t["turn"] >= split_at)).alias("n"),
    )
    shown = shares.select("pair_id", "chunk", *(F.expr(_rendered(x)).alias(f"_{x}") for x in "pyn"), *(F.size(x).cast("long").alias(f"k{x}") for x in "pyn"))
    return shown.select(
        "pair_id", "chunk", F.col("_p.text").alias("prompt"), F.col("_y.text").alias("chosen"), F.col("_y.mask").alias("chosen_mask"), F.col("_n.text").alias("rejected"), F.col("_n.mask").alias("rejected_mask"),
        F.col("kp").alias("prompt_turns"), F.col("ky").alias("chosen_turns"), F.col("kn").alias("rejected_turns"),
    )


def with_foreign_endings(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation as chosen, and as rejected the same with its final turn taken from its neighbour.

    The neighbour of conversation c is c XOR 1; where there is none, the rejected side just ends early.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("pair_id"), F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"), "role", "text")
    last = turns.groupBy("pair_id").agg(F.max("turn").alias("last"))
    # the last turn of each conversation and of its neighbour, in one narrow table
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("last").alias("other_last"))
    ends = last.join(other, "pair_id", "left")
    ended = turns.join(ends, "pair_id")
    moved = F.col("turn") == F.col("last")
    # the final turn goes to the neighbour, if there is one, as its last; others stay
    rejected = ended.where(~moved | F.col("other_last").isNotNull()).select(
        F.when(moved, F.col("pair_id").bitwiseXOR(F.lit(1))).otherwise(F.col("pair_id")).alias("pair_id"), F.when(moved, F.col("other_last")).otherwise(F.col("turn")).alias("turn"), "role", "text"
    )
    return turns, rejected


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(*with_foreign_endings(table(spark, sf_dir, "conversations")))


_PIECE = "'<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)"
ORACLE_SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id AS pair_id, coalesce(turn, {LAST}) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), last AS (SELECT pair_id, max(turn) AS last FROM t GROUP BY pair_id),
sides AS (
  SELECT pair_id, turn, role, text, 1 AS c, 0 AS r FROM t
  UNION ALL
  SELECT pair_id, turn, role, text, 0, 1 FROM t JOIN last USING (pair_id) WHERE turn < last
  UNION ALL
  SELECT n.pair_id, n.last, t.role, t.text, 0, 1
  FROM t JOIN last l ON t.pair_id = l.pair_id AND t.turn = l.last JOIN last n ON n.pair_id = xor(t.pair_id, 1)
), rows AS (
  SELECT pair_id, turn, role, text, max(c) AS c, max(r) AS r FROM sides GROUP BY pair_id, turn, role, text
), split AS (
  SELECT pair_id, min(turn) AS split FROM rows WHERE c <> r GROUP BY pair_id
), placed AS (
  SELECT rows.*, split.split IS NULL OR turn < split.split AS common, (turn - ((turn % 64) + 64) % 64) // 64 AS chunk, {_PIECE} AS piece
  FROM rows LEFT JOIN split USING (pair_id)
), parted AS (
  SELECT pair_id, chunk, turn, role, text, piece, 'p' AS part FROM placed WHERE common
  UNION ALL SELECT pair_id, chunk, turn, role, text, piece, 'y' FROM placed WHERE NOT common AND c = 1
  UNION ALL SELECT pair_id, chunk, turn, role, text, piece, 'n' FROM placed WHERE NOT common AND r = 1
), ended AS (
  SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY pair_id, chunk, part ORDER BY turn, role, text) AS BIGINT) AS e FROM parted
)
SELECT pair_id, chunk,
  coalesce(string_agg(piece, '' ORDER BY turn, role, text) FILTER (WHERE part = 'p'), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY turn, role, text) FILTER (WHERE part = 'y'), '') AS chosen,
  coalesce(string_agg((e - length(piece) + length(role) + 5) || ':' || (e - 1), ',' ORDER BY turn, role, text) FILTER (WHERE part = 'y' AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(piece, '' ORDER BY turn, role, text) FILTER (WHERE part = 'n'), '') AS rejected,
  coalesce(string_agg((e - length(piece) + length(role) + 5) || ':' || (e - 1), ',' ORDER BY turn, role, text) FILTER (WHERE part = 'n' AND role = 'assistant'), '') AS rejected_mask,
  count(*) FILTER (WHERE part = 'p') AS prompt_turns, count(*) FILTER (WHERE part = 'y') AS chosen_turns, count(*) FILTER (WHERE part = 'n') AS rejected_turns
FROM ended GROUP BY pair_id, chunk
"""
