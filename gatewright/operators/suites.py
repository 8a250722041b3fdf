"""Stress suites: cases with many candidates, drawn from an inventory of tools.

A case's distractors are its inventory in a deterministic order (hash, lexical or embedding
similarity, or that of a ranker) that does not depend on the number of candidates, so smaller
sets are prefixes of larger ones and one ranking serves all sizes. Cases are broadcast in
chunks of at most ``BLOCK_ROWS`` rows and about ``BLOCK_BYTES``; every task meets them with its
part of the inventory and only what may be among the first leaves it, to be merged by case.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from . import nearest as N

UNIT = chr(31)
BLOCK_ROWS = 20_000
BLOCK_BYTES = 32 << 20
#: Words of all items of an inverted index that is broadcast; beyond that, words are joined.
INDEX_WORDS = 4_000_000
STRATEGIES = ("random", "lexical", "semantic")


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(UNIT, *[p.cast("string") for p in parts]), 256)


def tool_text() -> Column:
    return F.concat_ws(" ", F.col("name"), F.coalesce("description", F.lit("")), F.col("server"))


def check_counts(counts: Sequence[int], missing: bool) -> list[int]:
    """Distinct sizes in order; a covered set has two candidates at least, a missing one has one."""
    out = sorted(set(counts))
    if not out or out[0] < (1 if missing else 2):
        raise ValueError("there are too few candidates in a set")
    return out


def _weight(df: DataFrame) -> Column:
    """About how many bytes a row has."""
    sizes = {"string": lambda c: F.octet_length(c), "array<string>": lambda c: F.octet_length(F.array_join(c, "____"))}
    return sum((F.coalesce(sizes.get(t, lambda c: F.size(c) * 8 if c_type.startswith("array") else F.lit(8))(F.col(n)), F.lit(0)) for n, t in df.dtypes for c_type in [t]), F.lit(16))


def chunks(df: DataFrame, key: str) -> list[DataFrame]:
    """The rows as a few tables, dealt by a hash of the key; none is above the bounds by much."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_weight(df)), F.lit(0))).first()
    k = max(1, -(-n // BLOCK_ROWS), -(-size // BLOCK_BYTES))
    return [df] if k == 1 else [df.where(F.pmod(F.xxhash64(key), F.lit(k)) == i) for i in range(k)]


def blocks(df: DataFrame, key: str) -> list[DataFrame]:
    """The same as one-row tables with a sorted array ``_tools``."""
    return [p.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("_tools")) for p in chunks(df, key)]


def dealt(df: DataFrame) -> DataFrame:
    """Rows that are much work each, in tasks for all cores."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def _by_hash(cases: DataFrame, tools: DataFrame, need: int, seed: int, n: int) -> DataFrame:
    """(_case, _gold, _best) by the hash of seed, case and name; n: distinct names.

    Every pair is hashed, in the tasks of the tools. Hashes are evenly spread, so only those below a
    bound that lets about ``need + 10 sqrt(need) + 40`` names of a case through are kept; a case with
    fewer than ``need`` (of 10 ** 19, one) fails the job.
    """
    share = (need + 10 * math.isqrt(need) + 40) / max(1, n)
    asked = cases.select(F.col("case_id").alias("_case"), F.col("gold").alias("_gold")).distinct().withColumn("_head", F.concat_ws(UNIT, F.lit(seed).cast("string"), F.col("_case").cast("string"), F.lit("distractor"), F.lit("")))
    key = F.sha2(F.concat("_head", "name"), 256)
    low = key < F.lit(f"{int(share * 2**64):016x}") if share < 1 else F.lit(True)
    held = dealt(tools.select("name"))
    near = [held.crossJoin(F.broadcast(c)).where(low & (F.col("name") != F.col("_gold"))).select("_case", "_gold", F.struct(key.alias("k"), "name").alias("x")) for c in chunks(asked, "_head")]
    return _merged(reduce(DataFrame.unionByName, near), need, "_case", "_gold")


def _merged(found: DataFrame, need: int, *by: str) -> DataFrame:
    """The first ``need`` of the structs ``x`` of each group, as ``_best``."""
    return found.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list("x")), 1, need).alias("_best"))


def _by_words(cases: DataFrame, tools: DataFrame, keep: int) -> DataFrame:
    """(_text, _best) by the similarity of words; cases of the same words are ranked once."""
    held = dealt(tools.select("name", "description", "server")).select("name", S.words_of(tool_text()).alias("words"))
    found = [N.by_words(c, held, keep) for c in chunks(cases.select(F.col("_text").alias("text")).distinct(), "text")]
    near = reduce(DataFrame.unionByName, found).select(F.col("text").alias("_text"), F.struct((-F.col("similarity")).alias("k"), "name").alias("x"))
    return _merged(near, keep, "_text")


def _by_vectors(cases: DataFrame, tools: DataFrame, keep: int) -> DataFrame:
    """(_gold, _best) by the cosine with the gold label's vector."""
    doubles = F.col("vector").cast("array<double>").alias("vector")
    asked = tools.join(cases.select(F.col("gold").alias("name")).distinct(), "name", "left_semi").select(F.col("name").alias("query"), doubles)
    items = dealt(tools.select(F.col("name").alias("item"), doubles))
    found = [N.by_vectors(c, items, keep) for c in chunks(asked, "query")]
    near = reduce(DataFrame.unionByName, found).select(F.col("query").alias("_gold"), F.struct((-F.col("similarity")).alias("k"), F.col("item").alias("name")).alias("x"))
    return _merged(near, keep, "_gold")


def _require_gold(cases: DataFrame, tools: DataFrame) -> None:
    if cases.join(tools.select(F.col("name").alias("gold")), "gold", "left_anti").limit(1).count() or cases.where("gold is null").limit(1).count():
        raise ValueError("a case's gold label is not in the inventory")


#: A ranker orders the other tools of each case: (cases, tools) -> (case_id, ranked), all of them.
Ranker = Callable[[DataFrame, DataFrame], DataFrame]


def distractors(cases: DataFrame, tools: DataFrame, need: int, strategy: str | Ranker = "random", seed: int = 0) -> DataFrame:
    """``cases`` (case_id, gold, query) with ``ranked``, the first ``need`` other tools in order.

    tools: name, description, server and, for the semantic strategy, vector. Refuses a gold label
    that the inventory does not have.
    """
    _require_gold(cases, tools)
    if callable(strategy):
        return cases.join(checked_ranking(strategy(cases, tools), cases, tools).select("case_id", F.slice("ranked", 1, need).alias("ranked")), "case_id")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    tools = tools.where("name is not null")
    n, copies = tools.groupBy("name").count().agg(F.count(F.lit(1)), F.coalesce(F.max("count"), F.lit(1))).first()
    if strategy == "random":
        best = _by_hash(cases, tools, need, seed, n)
        ranked = cases.join(best, F.col("case_id").eqNullSafe(F.col("_case")) & (F.col("gold") == F.col("_gold")), "left")
    elif strategy == "lexical":
        asked = cases.withColumn("_text", F.array_join(F.sort_array(F.coalesce(S.words_of("query"), F.array().cast("array<string>"))), " "))
        ranked = asked.join(_by_words(asked, tools, need + copies), "_text", "left")
    else:
        ranked = cases.join(_by_vectors(cases, tools, need + copies), F.col("gold") == F.col("_gold"), "left")
    others = F.slice(F.filter(F.transform("_best", lambda x: x["name"]), lambda x: x != F.col("gold")), 1, need)
    found = F.coalesce(others, F.array().cast("array<string>"))
    whole = F.when(F.size(found) < min(need, n - 1), F.raise_error(F.lit("a case has fewer distractors than there are tools")).cast("array<string>")).otherwise(found)
    return ranked.select(*cases.columns, whole.alias("ranked"))


def checked_ranking(ranking: DataFrame, cases: DataFrame, tools: DataFrame) -> DataFrame:
    """The ranking of each case; raises if one is missing, repeats a tool or lacks one."""
    n = tools.count() - 1
    listed = ranking.join(cases.select("case_id", "gold"), "case_id").select("case_id", F.explode("ranked").alias("name"), "gold")
    known = listed.join(tools.select("name").distinct(), "name", "left_semi").where("name <> gold").groupBy("case_id").agg(F.countDistinct("name").alias("n"))
    sound = ranking.join(known, "case_id", "left").where((F.col("n") == n) & (F.size("ranked") == n))
    if sound.select("case_id").distinct().count() != cases.count() or ranking.count() != cases.count():
        raise ValueError("a ranker gives every other tool of each case once")
    return ranking


def _require_capacity(tools: DataFrame, sizes: list[int], largest: int) -> None:
    capacity = tools.count() - 1
    if largest > capacity:
        raise ValueError(f"{sizes[-1]} candidates are asked for; the inventory has {capacity + 1}")


def suite(cases: DataFrame, tools: DataFrame, counts: Sequence[int], strategy: str | Ranker = "random", seed: int = 0, missing: bool = False, label: str | None = None) -> DataFrame:
    """For each case and size K: the gold label and K - 1 distractors, or K distractors if it is to be missing.

    Candidates are in an order that a hash of case, size and candidate fixes. Ids are
    ``{case}::k{K}::{strategy}`` (of a ranker, its name or ``label``) and ``{case}::missing::k{K}::{strategy}``.
    """
    sizes = check_counts(counts, missing)
    largest = sizes[-1] - (0 if missing else 1)
    _require_capacity(tools, sizes, largest)
    ranked = distractors(cases, tools, largest, strategy, seed)
    strategy = label or (strategy if isinstance(strategy, str) else strategy.__name__)
    spread = ranked.withColumn("candidate_count", F.explode(F.array(*map(F.lit, sizes))))
    chosen = F.slice(F.col("ranked"), F.lit(1), F.col("candidate_count") - F.lit(0 if missing else 1))
    if not missing:
        chosen = F.concat(F.array("gold"), chosen)
    tag = ("missing:" if missing else "covered:") + strategy
    keyed = F.transform(chosen, lambda c: F.struct(_hash(F.lit(seed), F.col("case_id"), F.col("candidate_count"), F.lit(tag), c).alias("k"), c.alias("c")))
    parts = ["_case", F.lit("missing"), F.concat(F.lit("k"), "candidate_count"), F.lit(strategy)]
    named = spread.withColumn("candidates", F.transform(F.array_sort(keyed), lambda x: x["c"])).withColumnRenamed("case_id", "_case")
    out = named.withColumn("case_id", F.concat_ws("::", *[F.col(p) if isinstance(p, str) else p for i, p in enumerate(parts) if missing or i != 1]))
    return out.select(
        "case_id", F.col("_case").alias("parent_case_id"), "candidate_count", "candidates", "gold", F.lit(strategy).alias("distractor_strategy"), F.lit(seed).alias("generation_seed"),
        F.lit("missing_candidate" if missing else "covered").alias("coverage"), F.lit(missing).alias("expected_abstain"), F.lit("missing_candidate" if missing else "candidate_count").alias("shift"),
    )


def set_sizes(cases: DataFrame, tools: DataFrame, counts: Sequence[int], missing: bool = False) -> DataFrame:
    """(parent_case_id, candidate_count, size) of the sets that ``suite`` makes; it refuses the same.

    However tools are ranked, a set of a sufficient inventory has as many candidates as are asked for.
    """
    sizes = check_counts(counts, missing)
    _require_capacity(tools, sizes, sizes[-1] - (0 if missing else 1))
    _require_gold(cases, tools)
    return cases.select(F.col("case_id").alias("parent_case_id"), F.explode(F.array(*map(F.lit, sizes))).alias("candidate_count")).withColumn("size", F.col("candidate_count"))


def top_similar(queries: DataFrame, items: DataFrame, k: int, similarity: Callable[[Column, Column], Column]) -> DataFrame:
    """The ``k`` best (query_id, item_id, similarity, rank) of each query; ties by item.

    ``similarity`` gets the structs of a query's and an item's columns. Items travel in blocks, each
    one broadcast row; every query keeps ``k`` of a block in its own row, and the blocks' are merged.
    """
    scored = S.bound(F.struct(*queries.columns), lambda q: F.transform("_tools", lambda t: F.struct(t["item_id"].alias("item_id"), similarity(q, t).alias("similarity"))))
    keyed = F.transform(scored, lambda t: F.struct((-F.round(t["similarity"], 9)).alias("k"), t["item_id"].alias("item_id"), t["similarity"].alias("similarity")))
    parts = [queries.crossJoin(F.broadcast(b)).select("query_id", F.slice(F.array_sort(keyed), 1, k).alias("best")) for b in blocks(items, "item_id")]  # one row each
    best = parts[0]
    if len(parts) > 1:
        best = reduce(DataFrame.unionByName, parts).groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("pos", "x")).select("query_id", "x.item_id", "x.similarity", (F.col("pos") + 1).alias("rank"))


def vector_neighbors(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The ``k`` items with the greatest cosine, rounded to nine places (query_id, item_id, similarity, rank); ties by item.

    queries: query_id, vector; items: item_id, vector.
    """
    held = dealt(items.select(F.col("item_id").alias("item"), "vector"))
    found = [N.by_vectors(c, held, k) for c in chunks(queries.select(F.col("query_id").alias("query"), "vector"), "query")]
    near = reduce(DataFrame.unionByName, found).select(F.col("query").alias("query_id"), F.struct((-F.round("similarity", 9)).alias("k"), F.col("item").alias("item_id"), "similarity").alias("x"))
    return _ranked(_merged(near, k, "query_id"))


def _ranked(best: DataFrame) -> DataFrame:
    return best.select("query_id", F.posexplode("_best").alias("pos", "x")).select("query_id", "x.item_id", "x.similarity", (F.col("pos") + 1).alias("rank"))


class WordIndex:
    """Items by their words: for each word the places of its items, items in order of their ids."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        rows = sorted(rows, key=lambda r: r[0])
        self.ids = np.array([i for i, _ in rows])
        self.sizes = np.array([len(w) for _, w in rows], np.int64)
        places: dict[str, list[int]] = {}
        for at, (_, words) in enumerate(rows):
            for w in words:
                places.setdefault(w, []).append(at)
        self.places = {w: np.array(p, np.int32) for w, p in places.items()}

    def best(self, words: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the ``k`` most similar items, of equal ones those with the smallest ids."""
        found = [p for w in words if (p := self.places.get(w)) is not None]
        same = np.bincount(np.concatenate(found), minlength=len(self.ids)) if found else np.zeros(len(self.ids), np.int64)
        similarity = same / np.maximum(1, len(words) + self.sizes - same)
        key = np.round(similarity, 9)
        k = min(k, len(key))
        least = np.partition(key, len(key) - k)[len(key) - k] if k else 0
        near = np.flatnonzero(key >= least)
        near = near[np.argsort(-key[near], kind="stable")[:k]]
        return self.ids[near], similarity[near]


def lexical_neighbors(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The ``k`` items with the most similar word sets (query_id, item_id, similarity, rank); ties by item.

    queries: query_id, words; items: item_id, words; both without repetitions. Items with at most
    ``INDEX_WORDS`` words in all (counted first) are one inverted index that is broadcast, and each
    query adds up the places of its words; beyond that, words meet in an equi-join.
    """
    total = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)) + F.count(F.lit(1))).first()[0]
    schema = f"query_id {dict(queries.dtypes)['query_id']}, item_id {dict(items.dtypes)['item_id']}, similarity double, rank int"
    if total > INDEX_WORDS:
        return _joined_neighbors(queries, items, k)
    index = queries.sparkSession.sparkContext.broadcast(WordIndex([(r["item_id"], r["words"]) for r in items.select("item_id", "words").collect()]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [index.value.best(list(w), k) for w in f["words"]]
            counts = [len(i) for i, _ in found]
            if sum(counts):
                yield pd.DataFrame({"query_id": np.repeat(f["query_id"].to_numpy(), counts), "item_id": np.concatenate([i for i, _ in found]), "similarity": np.concatenate([s for _, s in found]), "rank": np.concatenate([np.arange(1, c + 1) for c in counts])})

    return queries.select("query_id", F.coalesce("words", F.array().cast("array<string>")).alias("words")).mapInPandas(run, schema)


def _joined_neighbors(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The same by a join of words; items without a common word come from the ``k`` smallest ids."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    asked = queries.select("query_id", size("words").alias("nq"), F.explode_outer("words").alias("word"))
    held = items.select("item_id", size("words").alias("ni"), F.explode("words").alias("word"))
    same = asked.join(held, "word").groupBy("query_id", "item_id").agg(F.count(F.lit(1)).alias("same"), F.max("nq").alias("nq"), F.max("ni").alias("ni"))
    near = same.select("query_id", "item_id", (F.col("same") / (F.col("nq") + F.col("ni") - F.col("same"))).alias("similarity"))
    first = items.select("item_id").orderBy("item_id").limit(k)
    zero = queries.select("query_id").crossJoin(F.broadcast(first)).join(near, ["query_id", "item_id"], "left_anti").withColumn("similarity", F.lit(0.0))  # k rows
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "item_id")
    return near.unionByName(zero).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def by_candidate_count() -> Column:
    """The group of a case: the size its metadata states, else that of its candidates."""
    return F.coalesce(F.col("candidate_count"), F.size("candidates"))
