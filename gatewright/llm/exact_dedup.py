"""Exact deduplication by Grace hashing.

Method. Each task deals its records into an open-addressing table that compares
complete contents. When the distinct contents outgrow the table's budget, the
records that it does not hold go to spill files, one for each value of some bits
of their hash, and each file is worked on in the same way with other bits, until
it fits. What a task keeps is one record for each distinct content, with the
smallest id and the number of copies, so a content that makes up a third of all
rows crosses the shuffle once for each task and not once for each row. After an
exchange by hash, the same table merges these partial groups.

Spill files are private to one task attempt, live in Spark's own scratch folders
(``SPARK_LOCAL_DIRS``), as Spark's shuffle spills do, and are removed by the
attempt; a lost executor's tasks are simply run again from their input. Results
between stages move only through Spark exchanges.

Defined results: null text counts as empty; texts are equal when identical after
each run of blanks became one space; ids that are null are dropped last (a null
id never represents a group that has another); rows that repeat an id are all
returned and counted; very long texts are whole, alone in memory; extra columns are
ignored by ``op1`` and kept by ``drop_copies``, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, materialize, table, text_slices, trimmed

_NO_ID = (1 << 63) - 1


class ContentTable:
    """Open addressing with linear probing over complete contents."""

    def __init__(self, budget: int):
        self.budget, self.used = budget, 0
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.least: list[int] = []
        self.counts: list[int] = []
        self.ties: list[int] = []  # how many records have the smallest id

    def _grow(self) -> None:
        size = len(self.slots) * 2
        slots, mask = [-1] * size, size - 1
        for i, h in enumerate(self.hashes):
            at = h & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = i
        self.slots = slots

    def add(self, h: int, content: bytes, least: int, n: int, ties: int) -> bool:
        """Count the record; False if it is new and there is no room for it."""
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (i := slots[at]) >= 0:
            if self.hashes[i] == h and self.contents[i] == content:
                self.counts[i] += n
                if least < self.least[i]:
                    self.least[i], self.ties[i] = least, ties
                elif least == self.least[i]:
                    self.ties[i] += ties
                return True
            at = (at + 1) & mask
        if self.contents and self.used + len(content) + 120 > self.budget:
            return False
        slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.least.append(least)
        self.counts.append(n)
        self.ties.append(ties)
        self.used += len(content) + 120
        if 2 * len(self.contents) > len(slots):
            self._grow()
        return True


class SpillFiles:
    """The records that a table had no room for, dealt to files by bits of their hash."""

    def __init__(self, folder: str, level: int, fan: int):
        self.folder, self.level, self.fan = folder, level, fan
        self.files: dict[int, object] = {}

    def put(self, h: int, *record) -> None:
        k = (h >> (4 * (self.level % 15))) % self.fan
        if k not in self.files:
            self.files[k] = open(f"{self.folder}/{self.level}-{k}-{id(self)}", "wb")
        pickle.dump((h, *record), self.files[k], protocol=5)

    def buckets(self) -> Iterator[Iterator[tuple]]:
        for f in self.files.values():
            f.close()
        for f in self.files.values():
            yield _records(f.name)
            os.unlink(f.name)


def _records(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f, contextlib.suppress(EOFError):
        read = pickle.Unpickler(f)
        while True:
            yield read.load()
            read.memo = {}


def content_hash(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little")


def grace_groups(records: Iterable[tuple[int, bytes, int, int, int]], budget: int = 48 << 20, fan: int = 16, level: int = 0, folder: str | None = None) -> Iterator[tuple[bytes, int, int, int]]:
    """(content, smallest id, count, records with that id) of each distinct content of (hash, content, id, count, ties).

    Memory holds at most ``budget`` bytes of distinct contents (a single longer
    content is held alone). Each level takes at least one content off, so the
    recursion ends even if all hashes are the same.
    """
    own = folder is None
    if own:
        tops = (os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()).split(",")
        top = tops[os.getpid() % len(tops)]  # workers share all disks
        os.makedirs(top, exist_ok=True)
        folder = tempfile.mkdtemp(prefix="grace-", dir=top)
    try:
        held, spilled = ContentTable(budget), SpillFiles(folder, level, fan)
        for record in records:
            if not held.add(*record):
                spilled.put(*record)
        yield from zip(held.contents, held.least, held.counts, held.ties)
        del held
        for bucket in spilled.buckets():
            yield from grace_groups(bucket, budget, fan, level + 1, folder)
    finally:
        if own:
            shutil.rmtree(folder, ignore_errors=True)


_GROUPS = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("least", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ties", T.LongType())])


def _emit(groups: Iterator[tuple[bytes, int, int, int]]) -> Iterator[pa.RecordBatch]:
    rows: list = []
    size = 0
    for g in groups:
        rows.append(g)
        size += len(g[0])
        if size > (8 << 20) or len(rows) >= 5000:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list) -> pa.RecordBatch:
    content, *numbers = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(content, pa.binary()), *(pa.array(x, pa.int64()) for x in numbers)], names=["content", "least", "n", "ties"])


def _grouper(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in (part for batch in batches for part in text_slices(batch, 0)):
                for content, *numbers in zip(*(c.to_pylist() for c in b.columns)):
                    yield content_hash(content), content, *numbers

        yield from _emit(grace_groups(records(), budget))

    return trimmed(run)


def normalised(column: str = "text") -> F.Column:
    """The text as it is compared: null is empty, each run of blanks is one space."""
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), BLANKS, " ")


def copy_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", budget: int = 48 << 20) -> DataFrame:
    """Groups of two or more equal texts: text_sha256, keep_id, group_size and ties, the rows with that id.

    Texts are told apart by their contents; the digest only names the group. Two
    contents with one digest would be an error and not a silent merge.
    """
    records = docs.select(
        normalised(text_column).cast("binary").alias("content"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("least"),
        F.lit(1).cast("long").alias("n"),
        F.lit(1).cast("long").alias("ties"),
    )
    partial = records.mapInArrow(_grouper(budget), _GROUPS)
    whole = partial.repartition(F.xxhash64("content")).mapInArrow(_grouper(budget), _GROUPS)
    return whole.where(F.col("n") > 1).select(
        F.sha2("content", 256).alias("text_sha256"),
        F.when(F.col("least") != _NO_ID, F.col("least")).alias("keep_id"),
        F.col("n").alias("group_size"),
        "ties",
    )


def _marked(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (row, id, text_sha256) with those of their group: keep_id, group_size, ties, kept."""
    joined = rows.join(groups.withColumnRenamed("text_sha256", "digest"), F.col("text_sha256") == F.col("digest"), "left").drop("digest")
    joined = joined.withColumns({"keep_id": F.coalesce("keep_id", "id"), "group_size": F.coalesce("group_size", F.lit(1).cast("long")), "ties": F.coalesce("ties", F.lit(1).cast("long"))})
    return joined.withColumn("kept", F.col("keep_id").eqNullSafe(F.col("id")))


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """All columns of a row in one struct, so that names of results cannot clash with them."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_column].cast("long").alias("id"), F.sha2(normalised(text_column), 256).alias("text_sha256"))


def mark_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", budget: int = 48 << 20) -> DataFrame:
    """``docs`` and the columns text_sha256, keep_id, group_size and kept, which take the place of any of these names.

    The join with the groups is an equi-join by digest, of which Spark splits hot
    keys (only groups of two or more are on its other side).
    """
    marks = ("text_sha256", "keep_id", "group_size", "kept")
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in marks]
    return _marked(_rows(docs, id_column, text_column), copy_groups(docs, id_column, text_column, budget)).select(*own, *marks)


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", budget: int = 48 << 20) -> DataFrame:
    """``docs`` without the rows whose text another row with a smaller id has; all columns stay.

    Rows that repeat both id and text cannot be told apart by id; of these the one stays whose
    JSON form has the smallest hash. Such groups are known after the first pass, and only if
    there are any is there a second one.
    """
    groups = materialize(docs.sparkSession, copy_groups(docs, id_column, text_column, budget), "copies")
    rows = _rows(docs, id_column, text_column)
    out = _marked(rows, groups).where(F.col("kept") & (F.col("ties") == 1)).select("row")
    tied = groups.where("ties > 1")
    if tied.limit(1).count():
        repeated = _marked(rows, tied).where(F.col("kept") & (F.col("ties") > 1))
        out = out.unionByName(repeated.groupBy("text_sha256").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row"))
    return out.select("row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
