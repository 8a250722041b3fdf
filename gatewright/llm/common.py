"""What the training-data operators share: inputs, shared scratch tables, hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import os
import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whitespace of the contracts: space and 0x09 to 0x0D.
BLANKS = r"[\x20\x09-\x0D]+"

_live: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    Read from ``spark.checkpoint.dir``; a temporary folder is set only where the session has
    none and its master is this machine alone, as in tests. On a cluster without the setting
    this raises: a folder of one machine is not shared.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        at = "file://" + tempfile.mkdtemp(prefix="gatewright-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    # a path without scheme is one of the cluster's default file system
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/gatewright-{uuid.uuid4().hex}/{name}"
    if not _live:
        atexit.register(_sweep)
    _live.append((spark, path))
    return path


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage with data that outlives any executor.
    """
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` made and nothing reads any more."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for spark, path in _live:
        with contextlib.suppress(Exception):
            _delete(spark, os.path.dirname(path))


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores before it until no column has it (names are told apart without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of the id as decimal text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def crc_mod_py(doc_id: int | None, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


# --- words and their keys ------------------------------------------------------------------


class Numbers(dict):
    """Numbers of distinct byte strings in order of appearance; only equal bytes share a number."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; a bijection, so it adds no collisions."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Words are hashed by two polynomials modulo a prime, with random codes of the bytes and random bases.
_PRIME = np.uint64((1 << 31) - 1)
_random = np.random.default_rng(0x6A7E)
_CODES = _random.integers(1, int(_PRIME), (2, 256)).astype(np.uint64)
_BASES = _random.integers(1 << 20, int(_PRIME), 2).tolist()
_powers = [np.ones(1, np.uint32), np.ones(1, np.uint32)]


def _powers_of(k: int, n: int) -> np.ndarray:
    """The powers 0..n-1 (at least) of a base modulo the prime; those of very long words are not kept."""
    out = _powers[k]
    while len(out) < n:
        step = np.uint64(pow(_BASES[k], len(out), int(_PRIME)))
        out = np.concatenate((out, (out.astype(np.uint64) * step % _PRIME).astype(np.uint32)))
    if len(out) <= 1 << 16:
        _powers[k] = out
    return out


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-blank bytes in ``buf``."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _IS_BLANK[buf], [True]))))
    return edge[::2], edge[1::2]


def word_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of two unsigned 64-bit keys for each of the words that ``word_spans`` found.

    The first comes from two polynomials over all bytes, modulo a prime, so that no form of
    words makes them collide as it does modulo a power of two. The second comes from the first
    and last eight bytes and the length; it alone tells words of up to 16 bytes apart.
    """
    out = np.empty((len(starts), 2), np.uint64)
    for a in range(0, len(starts), 8192):  # pieces that stay in the processor's caches
        _keys_of(buf, starts[a : a + 8192], ends[a : a + 8192], out[a : a + 8192])
    return out


def _keys_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, out: np.ndarray) -> None:
    origin = starts[0]
    buf, starts, ends = buf[origin : ends[-1]], starts - origin, ends - origin
    lengths = ends - starts
    inside = np.flatnonzero(~_IS_BLANK[buf])
    place = inside - np.repeat(starts, lengths)
    data = buf[inside]
    heads = np.cumsum(lengths) - lengths
    longest = int(lengths.max())
    sums = []
    for k in (0, 1):
        x = _CODES[k][data] * _powers_of(k, longest)[place]
        sums.append(np.add.reduceat((x & _PRIME) + (x >> np.uint64(31)), heads) % _PRIME)
    size = lengths.astype(np.uint64)
    edges = [np.zeros(len(starts), np.uint64) for _ in range(2)]
    for j in range(min(8, longest)):
        has = lengths > j
        every = has.all()
        at = slice(None) if every else np.flatnonzero(has)
        for x, place_ in zip(edges, (starts + j, ends - 1 - j)):
            x[at] |= buf[place_[at]].astype(np.uint64) << np.uint64(8 * j)
    out[:, 0] = mix64((sums[0] | sums[1] << np.uint64(32)) + size * np.uint64(0x9E3779B97F4A7C15))
    out[:, 1] = mix64(edges[0] + mix64(edges[1] + size))


def text_slices(batch, column: int = 1, limit: int = 1 << 20):
    """Slices of an Arrow batch of about ``limit`` bytes of text; a longer text is alone."""
    sizes = [(x.as_buffer().size if x.is_valid else 0) for x in batch.column(column)]
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held + n > limit and i > at:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(batch):
        yield batch.slice(at)


_tidy = False


def _tidy_memory() -> None:
    """Once in a worker: large blocks go straight back to the system when they are freed."""
    global _tidy
    if not _tidy:
        with contextlib.suppress(Exception):  # another C library does without
            ctypes.CDLL("libc.so.6").mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD, which also ends its growth
        pa.set_memory_pool(pa.system_memory_pool())
        _tidy = True


def trimmed(run):
    """The same map function; memory that it frees goes back to the system.

    Python workers are reused by later tasks, and would otherwise hold what their largest task needed.
    """

    @functools.wraps(run)
    def with_trim(batches):
        _tidy_memory()
        try:
            yield from run(batches)
        finally:
            with contextlib.suppress(Exception):
                pa.default_memory_pool().release_unused()
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return with_trim
