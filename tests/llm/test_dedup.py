"""Exact and near deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import thue_morse
from gatewright.llm import exact_dedup as E
from gatewright.llm import near_dedup as N


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            keep = min(known) if known else None
            out.append((i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("budget", [48 << 20, 3000])
def test_exact(spark, odd_docs, budget):
    found = E.mark_copies(odd_docs, budget=budget).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, found), key=repr) == brute_exact([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_exact_on_nothing(no_docs):
    assert E.mark_copies(no_docs).count() == 0 and E.drop_copies(no_docs).count() == 0


def test_drop_copies_keeps_columns(clashing):
    out = E.drop_copies(clashing)
    assert out.columns == clashing.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) and {r.kept for r in out.collect()} == {7}
    assert {r.doc_id for r in out.collect()} >= {1, 4, 9, 10, 11, 12}


def test_drop_copies_of_repeated_rows(spark):
    """Of rows with one id and text the same one stays however the table is dealt; names of results do not clash."""
    rows = [(1, "a  b", k) for k in range(9)] + [(2, "a b", 0), (3, "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").withColumnsRenamed({}).withColumns({n: F.lit(4) for n in ("_digest", "digest", "id", "ties", "least", "keep_id", "KEPT")})
    runs = [sorted(map(tuple, E.drop_copies(d).collect())) for d in (docs, docs.repartition(5), docs.orderBy(F.desc("row")))]
    assert runs[0] == runs[1] == runs[2] and [r[0] for r in runs[0]] == [1, 3] and E.drop_copies(docs).columns == docs.columns


def test_grace_spills(tmp_path):
    rng = random.Random(1)
    records = [(b"%d" % rng.randrange(300) * rng.randrange(1, 5), i) for i in range(5000)]
    want: dict = {}
    for c, i in records:
        least, n = want.get(c, (i, 0))
        want[c] = (min(least, i), n + 1)
    for same in (False, True):  # also with hashes that are all the same
        got = list(E.grace_groups(((7 if same else E.content_hash(c), c, i // 2, 1, 1) for c, i in records), budget=2000))
        assert len(got) == len(want) and {c: (a, n) for c, a, n, _ in got} == {c: (a // 2, n) for c, (a, n) in want.items()}
        first: dict = {}
        for c, i in records:
            first.setdefault(c, []).append(i // 2)
        assert {c: t for c, _, _, t in got} == {c: ids.count(min(ids)) for c, ids in first.items()}


def sets_of(text, words):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def brute_near(rows, words, percent):
    sets = {i: sets_of(t, words) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_odd(spark, odd_docs):
    found = N.near_copies(spark, odd_docs, 3, 85).collect()
    want = brute_near({(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None}, 3, 85)
    assert len(found) == odd_docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == want


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_chains(spark, words, percent):
    """A large family of copies with changes at random, where components are chains."""
    rng = random.Random(words)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(220):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"z{rng.randrange(900)}" for _ in range(rng.randrange(1, 80)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(rows, words, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_copies(spark, docs, words, percent).collect()} == want
    kept = {r.doc_id for r in N.drop_near_copies(spark, docs, words, percent).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_near_tells_words_apart(spark):
    """Texts of words that a polynomial hash confuses share no shingle and are not linked."""
    pairs = [thue_morse(n) for n in (1024, 2048, 4096, 8192)]
    rows = [(k, " ".join(p[k] for p in pairs)) for k in (0, 1)] + [(2, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.near_copies(spark, docs, 3, 85).collect()} == {0: 0, 1: 1, 2: 2}
    x, y = (t.encode() for _, t in rows[:2])
    assert not N.linked(x, y, 3, 85) and N.linked(x, x, 3, 85)


def test_linked_is_the_similarity_of_words():
    rng = random.Random(8)
    for _ in range(300):
        a = [f"w{rng.randrange(6)}" for _ in range(rng.randrange(0, 14))]
        b = list(a) if rng.random() < 0.7 else [f"w{rng.randrange(6)}" for _ in range(rng.randrange(0, 14))]
        for _ in range(rng.randrange(3)):
            if b:
                b[rng.randrange(len(b))] = f"w{rng.randrange(7)}"
        for words, percent in ((3, 85), (5, 50), (1, 40), (30, 80)):
            x, y = sets_of(" ".join(a), words), sets_of(" ".join(b), words)
            want = bool(x) and bool(y) and 100 * len(x & y) >= percent * len(x | y)
            assert N.linked(" ".join(a).encode(), " ".join(b).encode(), words, percent) == want


def test_near_with_repeated_ids(spark):
    """Rows that share an id are linked each by its own text; a component is named by the smallest id in it."""
    w = [f"w{i}" for i in range(100)]
    near = [*w[:-1], "other"]
    apart = [f"z{i}" for i in range(100)]
    rows = [(1, " ".join(w)), (7, " ".join(near)), (7, " ".join(apart)), (7, " ".join(near)), (9, " ".join([*apart[:-1], "q"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in N.near_copies(spark, docs, 3, 85).collect()) == [(1, 1), (7, 1), (7, 1), (7, 7), (9, 7)]
    assert sorted(r.text for r in N.drop_near_copies(spark, docs, 3, 85).collect()) == sorted([rows[0][1], rows[2][1]])


def test_common_shingles_bring_few_together(spark):
    """Sets that differ but for a passage that all share, with some near copies among them, meet in few pairs."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(400):
        own = [f"o{rng.randrange(10**9)}" for _ in range(15)]
        rows.append((2 * i, " ".join(passage + own)))
        if i % 20 == 0:
            rows.append((2 * i + 1, " ".join([*passage, *own[:-1], "x"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    steps = N.NearCopies(spark, docs, 3, 85)
    pairs = []
    crossing = steps._crossing
    steps._crossing = lambda play, sets: pairs.append(crossing(play, sets)) or pairs[0]
    found = {r.doc_id: r.component_id for r in steps.run().collect()}
    assert {i: c for i, c in found.items() if i != c} == {2 * i + 1: 2 * i for i in range(0, 400, 20)}
    assert pairs[0].count() < 4 * len(rows)


def test_near_on_nothing(spark, no_docs):
    assert N.near_copies(spark, no_docs).count() == 0
    assert N.drop_near_copies(spark, no_docs).count() == 0


def test_near_keeps_columns(spark, clashing):
    out = N.drop_near_copies(spark, clashing)
    assert out.columns == clashing.columns
    assert out.where("doc_id = 2").count() == 0 and out.where("doc_id is null").count() == 2


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7)], "a long, b long")
    found = {r.id: r.component for r in N.components(spark, links).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {200: 100, 300: 100}
    assert N.components(spark, links.where(F.lit(False))).count() == 0


def test_sketch_bound_is_loose_enough():
    import numpy as np

    bands, rows = N.banding(85)
    sketcher, rng = N.Sketcher(bands, rows), np.random.default_rng(0)
    for _ in range(50):
        common = rng.integers(0, 2**63, 850, dtype=np.uint64)
        sets = [np.unique(np.concatenate((common, rng.integers(0, 2**63, 75, dtype=np.uint64)))) for _ in range(2)]
        _, s = sketcher.keys(np.stack([sketcher.samples(x) for x in sets]))
        assert int(np.bitwise_count(s[0] ^ s[1]).sum()) <= N.sketch_bound(85, bands * rows)
