"""The items nearest to queries, exactly: by common words and by the cosine of vectors.

Queries are broadcast to Python tasks in chunks that the caller bounds; items stay where they
are. Items that no query can tell apart count once, with the first of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that a task holds before it hands them on, and kinds of items that it compares at once.
HELD = 200_000
KINDS = 20_000
#: Queries that are multiplied at once, and how far a product may be from the cosine as Spark adds it up,
#: with room for a rounding to nine places.
ROWS = 256
MARGIN = 4e-9


def _kinds(vocabulary, keep: int):
    """Tools by what queries see of them: how many words and which of the vocabulary; the first names of each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held, n = vocabulary.value, {}, 0

        def flush() -> pd.DataFrame:
            first = {k: sorted(v)[:keep] for k, v in held.items()}
            return pd.DataFrame({"kind": np.repeat(np.array(list(first), object), [len(v) for v in first.values()]), "name": [x for v in first.values() for x in v]})

        for f in frames:
            for name, words in zip(f["name"], f["words"]):
                kind = " ".join([str(len(words)), *sorted(known.intersection(words))])
                names = held.setdefault(kind, [])
                names.append(name)
                n += 1
                if len(names) > 4 * keep + 100:
                    n -= len(names) - keep
                    held[kind] = sorted(names)[:keep]
            if n > HELD:
                yield flush()
                held, n = {}, 0
        if held:
            yield flush()

    return run


class Kinds:
    """An inverted index of kinds ("size word word ..") and their names in order."""

    def __init__(self, kinds: list[str], names: list[list[str]], keep: int):
        order = sorted(range(len(kinds)), key=lambda i: names[i][0])
        self.names = np.array(sorted({x for v in names for x in v} | {""}), object)
        rank = {x: i for i, x in enumerate(self.names)}
        self.ranks = np.full((len(kinds), keep), len(rank), np.int64)
        self.sizes = np.empty(len(kinds), np.int64)
        places: dict[str, list[int]] = {}
        for at, i in enumerate(order):
            size, *words = kinds[i].split(" ")
            self.sizes[at] = int(size)
            self.ranks[at, : len(names[i])] = [rank[x] for x in names[i]]
            for w in words:
                places.setdefault(w, []).append(at)
        self.places = {w: np.array(p, np.int64) for w, p in places.items()}

    def best(self, words: list[str], keep: int) -> tuple[np.ndarray, np.ndarray]:
        """(similarities, names) of the ``keep`` most similar tools, of equal ones those with the first names."""
        same = np.zeros(len(self.sizes), np.int64)
        for w in words:
            if (p := self.places.get(w)) is not None:
                same[p] += 1
        near = same / np.maximum(1, len(words) + self.sizes - same)
        least = np.partition(near, len(near) - keep)[len(near) - keep] if len(near) > keep else -1.0
        at = np.concatenate([np.flatnonzero(near > least), np.flatnonzero(near == least)[:keep]])
        ranks, value = self.ranks[at].ravel(), np.repeat(near[at], self.ranks.shape[1])
        held = np.flatnonzero(ranks < len(self.names))
        held = held[np.lexsort((ranks[held], -value[held]))[:keep]]
        return value[held], self.names[ranks[held]]


def _compare(texts, keep: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds: list[str] = []
        names: list[list[str]] = []

        def flush() -> Iterator[pd.DataFrame]:
            index = Kinds(kinds, names, keep)
            for at in range(0, len(texts.value), 1000):
                some = texts.value[at : at + 1000]
                found = [index.best(t.split(), keep) for t in some]
                yield pd.DataFrame({"text": np.repeat(np.array(some, object), [len(v) for v, _ in found]), "similarity": np.concatenate([v for v, _ in found]), "name": np.concatenate([n for _, n in found])})

        for f in frames:
            kinds += f["kind"].tolist()
            names += [list(v) for v in f["names"]]
            if len(kinds) >= KINDS:
                yield from flush()
                kinds, names = [], []
        if kinds:
            yield from flush()

    return run


def by_words(texts: DataFrame, tools: DataFrame, keep: int) -> DataFrame:
    """(text, similarity, name): at least the first ``keep`` tools of each text by similarity of words, then name.

    texts: text (distinct words, a blank between them), few enough to be broadcast; tools: name, words
    (without repetitions). Tools with equally many words and the same ones of the texts are one kind.
    """
    context = texts.sparkSession.sparkContext
    rows = [r[0] for r in texts.select("text").collect()]
    found = tools.mapInPandas(_kinds(context.broadcast({w for t in rows for w in t.split()}), keep), "kind string, name string")
    kinds = found.groupBy("kind").agg(F.slice(F.array_sort(F.collect_list("name")), 1, keep).alias("names"))
    return kinds.mapInPandas(_compare(context.broadcast(rows), keep), "text string, similarity double, name string")


# --- vectors ---------------------------------------------------------------------------------


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added up in the order of ``scores.dot``, so the doubles are the same."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _vectors(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and rows of a list column by their dimension; null vectors and those with a null are under -1."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    starts, flat = column.offsets.to_numpy(), column.values
    sizes = np.diff(starts)
    holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    odd = column.is_null().to_numpy(zero_copy_only=False) | (holes[starts[1:]] > holes[starts[:-1]])
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    out = {-1: (np.flatnonzero(odd), np.empty((0, 0)))}
    for d in np.unique(sizes[~odd]):
        at = np.flatnonzero(~odd & (sizes == d))
        out[int(d)] = at, values[starts[at][:, None] + np.arange(d)]
    return out


def _norms(v: np.ndarray) -> np.ndarray:
    out = np.sqrt(_dot(v, v))
    if (out == 0).any():
        raise ZeroDivisionError("a vector of length zero has no cosine")
    return out


def _first(values: np.ndarray, ranks: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` smallest ranks of each distinct row."""
    order = np.argsort(ranks, kind="stable")
    rows = np.ascontiguousarray(values[order]).view(np.dtype((np.void, values.shape[1] * 8))).ravel() if values.shape[1] else np.zeros(len(order), np.int8)
    _, group = np.unique(rows, return_inverse=True)
    by = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[by], prepend=-1))
    within = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
    return np.sort(order[by[within < keep]])


class Best:
    """What may be among the ``keep`` best items of each query: those within the margin of the last."""

    def __init__(self, n: int, keep: int):
        self.keep = keep
        self.least = np.full(n, -np.inf)
        self.query = np.empty(0, np.int64)
        self.key = np.empty(0)
        self.item = np.empty(0, object)

    def add(self, query: np.ndarray, key: np.ndarray, item: np.ndarray) -> None:
        """key: the cosine; infinite if it is null, which comes first, and -inf if it is none, which comes last."""
        query, key, item = np.concatenate([self.query, query]), np.concatenate([self.key, key]), np.concatenate([self.item, item])
        ranks = np.unique(item, return_inverse=True)[1]
        order = np.lexsort((ranks, -key, query))
        query, key, item = query[order], key[order], item[order]
        place = np.arange(len(query))
        fresh = np.diff(query, prepend=-1) != 0
        position = place - np.maximum.accumulate(np.where(fresh, place, 0))
        tie = place - np.maximum.accumulate(np.where(fresh | np.append(True, key[1:] != key[:-1])[: len(key)], place, 0))
        last = position == self.keep - 1
        self.least[query[last]] = key[last]
        held = (key >= self.least[query] - MARGIN) & (tie < self.keep)
        self.query, self.key, self.item = query[held], key[held], item[held]


def _nearest(best: Best, asked: np.ndarray, q: np.ndarray, item: np.ndarray, v: np.ndarray) -> None:
    """Products pick what is near, sums in order give its cosine."""
    nq, nv = _norms(q), _norms(v)
    unit = (v / nv[:, None]).T
    found = []
    for a in range(0, len(q), ROWS):
        near = (q[a : a + ROWS] / nq[a : a + ROWS, None]) @ unit
        near[np.isnan(near)] = -np.inf
        least = best.least[asked[a : a + ROWS]]
        new = np.flatnonzero(least == -np.inf)
        if len(new) and len(item) > best.keep:
            least[new] = np.partition(near[new], len(item) - best.keep, axis=1)[:, len(item) - best.keep]
        i, j = np.nonzero(near >= (least - MARGIN)[:, None])
        cosine = _dot(q[a + i], v[j]) / (nq[a + i] * nv[j])
        found.append((asked[a + i], np.where(np.isnan(cosine), -np.inf, cosine), item[j]))
    best.add(*map(np.concatenate, zip(*found)))


def _cosines(queries, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets = queries.value
        best = Best(len(ids), keep)
        for batch in batches:
            if not len(batch):
                continue
            item, held = np.array(batch.column(0).to_pylist(), object), _vectors(batch.column(1))
            kind = batch.schema.field(0).type
            ranks = np.unique(item, return_inverse=True)[1]
            for d, (asked, q) in sets.items():
                at, v = held[d] if d >= 0 and d in held else (np.empty(0, np.int64), np.empty((0, max(d, 0))))
                other = np.setdiff1d(np.arange(len(item)), at)
                other = other[np.argsort(ranks[other], kind="stable")[:keep]]  # without a cosine
                if len(asked) and len(other):
                    best.add(np.repeat(asked, len(other)), np.full(len(asked) * len(other), np.inf), np.tile(item[other], len(asked)))
                if len(asked) and len(at):
                    some = _first(v, ranks[at], keep)
                    with np.errstate(all="ignore"):
                        _nearest(best, asked, q, item[at[some]], v[some])
        if len(best.query):
            cosine = pa.array(np.where(best.key == -np.inf, np.nan, best.key), mask=best.key == np.inf)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.query)), pa.array(best.item.tolist(), kind), cosine], names=["query", "item", "similarity"])

    return run


def by_vectors(queries: DataFrame, items: DataFrame, keep: int) -> DataFrame:
    """(query, item, similarity): at least the first ``keep`` items of each query by cosine (rounded to nine
    places or not), then item.

    queries: query, vector, few enough to be broadcast; items: item, vector; arrays of doubles. Where two
    vectors have no cosine (null ones, unlike dimensions) it is null and comes first, as in a sort; one
    that is no number comes last. Of equal vectors of a batch the first ``keep`` items count.
    """
    asked = queries.select("query", "vector").toArrow().combine_chunks()
    ids = pa.concat_arrays(asked.column("query").chunks) if len(asked) else pa.array([], asked.schema.field("query").type)
    sets = _vectors(asked.column("vector")) if len(asked) else {}
    schema = f"query {dict(queries.dtypes)['query']}, item {dict(items.dtypes)['item']}, similarity double"
    return items.select("item", "vector").mapInArrow(_cosines(queries.sparkSession.sparkContext.broadcast((ids, sets)), keep), schema)
