"""Rankings of inventories that are larger than what is kept for a case, by brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewright.operators import nearest as N
from gatewright.operators import suites as U
from gatewright.plans.catalog import QUERIES

UNIT = chr(31)


def sha(*parts):
    return hashlib.sha256(UNIT.join(map(str, parts)).encode()).hexdigest()


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def inventory(spark):
    """Tools of few words, most of them in many tools; every 100th is asked for."""
    words = ["steel", "tin", "green", "Blue", "small", "large", "nut"]
    rows = [(f"t::{i}", f"{words[i % 7]} {words[i * 3 % 5]} {'rare%d' % i if i % 10 == 0 else ''}", f"b{i % 3}") for i in range(3000)]
    return rows, spark.createDataFrame(rows, "name string, description string, server string")


def asked(spark, rows):
    return spark.createDataFrame([(f"c{i}", n, d) for i, (n, d, _) in enumerate(rows) if i % 100 == 0] + [("none", "t::7", None), ("nothing", "t::8", "?")], "case_id string, gold string, query string")


@pytest.mark.parametrize("need", [1, 19, 20])
def test_hashes_of_all_pairs(spark, inventory, need, monkeypatch):
    """The bound of the hashes loses nothing, in one chunk of cases and in several; no inventory is an array."""
    rows, tools = inventory
    cases = asked(spark, rows)
    want = {c.case_id: sorted((n for n, *_ in rows if n != c.gold), key=lambda n: sha(7, c.case_id, "distractor", n))[:need] for c in cases.collect()}
    out = U.distractors(cases, tools, need, "random", 7)
    assert {r.case_id: r.ranked for r in out.collect()} == want and "_tools" not in plan(out)
    monkeypatch.setattr(U, "BLOCK_ROWS", 10)
    assert {r.case_id: r.ranked for r in U.distractors(cases, tools, need, "random", 7).collect()} == want


@pytest.mark.parametrize("missing", [False, True])
def test_random_suites_of_all_pairs(spark, inventory, missing):
    """Sets of a large inventory, in the order of their own hash; no inventory is an array."""
    rows, tools = inventory
    cases, label = asked(spark, rows), ("missing:" if missing else "covered:") + "random"
    want = {}
    for c in cases.collect():
        ranked = sorted((n for n, *_ in rows if n != c.gold), key=lambda n: sha(7, c.case_id, "distractor", n))
        for k in (5, 20):
            chosen = ranked[: k if missing else k - 1] + ([] if missing else [c.gold])
            want[c.case_id, k] = sorted(chosen, key=lambda n: sha(7, c.case_id, k, label, n))
    out = U.suite(cases, tools, [5, 20], "random", 7, missing)
    assert {(r.parent_case_id, r.candidate_count): r.candidates for r in out.collect()} == want and "_tools" not in plan(out)


def test_sizes_need_no_ranking(spark, inventory, tmp_path):
    """Sizes of sets are those of the suite, its refusals too; counting them hashes nothing."""
    rows, tools = inventory
    cases = asked(spark, rows)
    for missing in (False, True):
        made = U.suite(cases, tools, [5, 10], "random", 7, missing).selectExpr("parent_case_id", "candidate_count", "size(candidates) AS size")
        sizes = U.set_sizes(cases, tools, [10, 5, 5], missing)
        assert sorted(map(tuple, sizes.collect())) == sorted(map(tuple, made.collect())) and sizes.dtypes == made.dtypes
    for bad in (lambda: U.set_sizes(cases, tools, [3001]), lambda: U.set_sizes(cases, tools, [1]), lambda: U.set_sizes(cases, tools.where("name <> 't::7'"), [5])):
        with pytest.raises(ValueError):
            bad()
    spark.createDataFrame([(i, f"n{i}", "b", "t") for i in range(60)], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    grouped = QUERIES["suite_group_by_k"](spark, str(tmp_path))
    assert sorted(map(tuple, grouped.collect())) == [(k, 2, 2 * k) for k in (5, 10, 20)] and "sha2" not in plan(grouped)


def words(text):
    return {w.lower() for w in re.findall("[A-Za-z0-9_]+", text or "")}


@pytest.mark.parametrize("missing", [False, True])
def test_similar_words_of_all_pairs(spark, inventory, missing, monkeypatch):
    """Tools of the same words are one kind, with ties to the first names; no inventory is an array."""
    rows, tools = inventory
    cases = asked(spark, rows)
    held = {n: words(f"{n} {d} {s}") for n, d, s in rows}
    near = lambda own, n: len(own & held[n]) / max(1, len(own | held[n]))
    order = {c.case_id: (c.gold, sorted((n for n in held if n != c.gold), key=lambda n: (-near(words(c.query), n), n))) for c in cases.collect()}
    want = {(c, k): {*ranked[: k if missing else k - 1], *([] if missing else [gold])} for c, (gold, ranked) in order.items() for k in (5, 20)}

    def found():
        return {(r.parent_case_id, r.candidate_count): set(r.candidates) for r in U.suite(cases, tools, [5, 20], "lexical", 7, missing).collect()}

    assert found() == want and "_tools" not in plan(U.distractors(cases, tools, 5, "lexical"))
    monkeypatch.setattr(U, "BLOCK_ROWS", 10)
    assert found() == want


def test_kinds_of_tools(spark):
    """A task hands on the first names of each kind, however many tools there are of it; few held ones do as well."""
    import pandas as pd

    class Known:
        value = {"a", "b"}

    frame = pd.DataFrame({"name": [f"t{i:04}" for i in range(2000)][::-1], "words": [["x%d" % i, "ab"[i % 2]] for i in range(2000)][::-1]})
    out = pd.concat(N._kinds(Known, 3)(iter([frame[:900], frame[900:]])))
    assert sorted(zip(out["kind"], out["name"])) == [("2 a", "t0000"), ("2 a", "t0002"), ("2 a", "t0004"), ("2 b", "t0001"), ("2 b", "t0003"), ("2 b", "t0005")]


# --- vectors ---------------------------------------------------------------------------------


def cosine(a, b):
    dot = lambda x, y: float(sum((p * q for p, q in zip(x, y)), 0.0))
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Vectors of which many are equal, one of them in every third row, and their folder."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8)).astype(np.float32)
    rows = [(i, base[0 if i % 3 == 0 else rng.integers(40)].tolist(), 0) for i in range(600)]
    folder = tmp_path_factory.mktemp("nearest")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return {i: v for i, v, _ in rows}, str(folder)


def test_neighbours_with_equal_vectors(spark, vectors, monkeypatch):
    v, folder = vectors
    want = {(a, r + 1, b) for a in v if a % 50 == 0 for r, b in enumerate(sorted(v, key=lambda b: (-round(cosine(v[a], v[b]), 9), b))[:5])}
    out = QUERIES["semantic_neighbors_topk"](spark, folder)
    assert {(r.query_id, r["rank"], r.item_id) for r in out.collect()} == want and "_tools" not in plan(out)
    monkeypatch.setattr(U, "BLOCK_ROWS", 5)
    assert {(r.query_id, r["rank"], r.item_id) for r in QUERIES["semantic_neighbors_topk"](spark, folder).collect()} == want


def test_semantic_suites_with_equal_vectors(spark, vectors):
    v, folder = vectors
    order = {a: sorted((b for b in v if b != a), key=lambda b: (-cosine(v[a], v[b]), f"v{b}")) for a in v if a % 50 == 0}
    ranking = QUERIES["suite_semantic_ranking"](spark, folder)
    assert {r.case_id: r.ranked for r in ranking.collect()} == {f"q{a}": ",".join(f"v{b}" for b in order[a][:5]) for a in order} and "_tools" not in plan(ranking)
    covered = QUERIES["suite_semantic_covered"](spark, folder)
    want = {f"q{a}::k{k}::semantic": {f"v{b}" for b in [a, *order[a][: k - 1]]} for a in order for k in (5, 10)}
    assert {r.case_id: set(r.candidates.split(",")) for r in covered.collect()} == want and "_tools" not in plan(covered)


def test_vectors_without_a_cosine(spark):
    """As in a sort of cosines: null comes first, what is no number last; a vector of zeros is refused."""
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 1.0]), (7, [0.0, 1.0]), (8, [2.0, 0.0])], "item_id int, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [3.0])], "query_id int, vector array<double>")
    near = lambda k: {q: [r.item_id for r in U.vector_neighbors(queries, items, k).where(F.col("query_id") == q).orderBy("rank").collect()] for q in (1, 2, 3)}
    assert near(8) == {1: [2, 3, 4, 1, 8, 6, 7, 5], 2: list(range(1, 9)), 3: [1, 2, 4, 5, 6, 7, 8, 3]}
    assert near(4) == {1: [2, 3, 4, 1], 2: [1, 2, 3, 4], 3: [1, 2, 4, 5]}
    with pytest.raises(Exception, match="length zero"):
        U.vector_neighbors(queries, items.unionByName(spark.createDataFrame([(9, [0.0, 0.0])], items.schema)), 3).collect()
    assert U.vector_neighbors(queries.limit(0), items, 3).count() == 0 and U.vector_neighbors(queries, items.limit(0), 3).count() == 0
