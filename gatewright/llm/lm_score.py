"""Language-model scores by logistic mixing of hashed-context bit predictors.

Method. A text is scored as its tokens joined by single spaces and ended by a line feed,
byte by byte and each byte as eight binary decisions. Three predictors (the last three
bytes, the last five, the current word so far) look the decision up under their hashed
context; their log-odds are combined by weights gated by the position of the bit, squashed,
and the weights are refined by the gradient of the coding loss after every block of a text
(from its first bytes on, blocks of 16 up to 512 bytes), so each text tunes the mixture to
itself. The coding losses add up to the text's total bits.

Counts of all training texts make the predictors: tasks count bytes under hashed contexts
in tables whose size is in proportion to the training bytes, of which the non-zero blocks are
summed in a tree of two exchanges and turned to log-odds there, which go to files of the shared
folder. Workers map these files, so one copy in the page cache serves all workers of a machine and
none of it is memory of their own; neither the driver nor a broadcast holds a table. A task counts
in an array while tables have their least size, and in sorted runs of bounded length beyond.

The weights that every text starts with are learnt from every training text, by deleted estimation:
a second pass looks each decision up as the counts would be without its own occurrence and counts
decisions by the (quantised) log-odds of the three predictors; the weights are those of least loss
over these counts (Newton's method, the loss is convex). Other occurrences in the same text stay
in. The rate of refinement is a constant. Without training texts, ``WEIGHTS`` stay.

Token counts for the base score are aggregated by key, 64 bits (see ``common.word_keys``). At most
``hot_tokens`` of the most frequent tokens are broadcast; the other tokens of each text meet their
counts in an equi-join.

Texts are worked on in lock step: the blocks of many texts of like length, one block of each at a
time, are one numpy array. Scores are written once to the shared folder before the token join.

Defined results: null text counts as empty (the end token alone); without training rows all
counts are 0 and base scores use N = V = 0; repeated rows are scored each, and equal texts have
equal scores up to rounding; null ids count as the id of empty text when rows are split; very
long texts are whole, alone in a pass; extra columns are ignored, whatever their names; an
empty table gives no row.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import mmap
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, drop_folder, materialize, mix64, new_folder, table, text_slices, trimmed, word_keys, word_spans
from .warc import file_system

#: Least slots of the context tables (three and five bytes, and the word so far); a slot has 16 cells, one for each half byte.
SLOTS = (1 << 17, 1 << 19, 1 << 19)
#: Training bytes for each slot of the largest table; with more bytes than that, all tables grow.
SLOT_BYTES = 1024
BLOCK = 1 << 16
#: Blocks in one file of a table.
PART = 16
#: Tables of so many cells at most are counted in an array, larger ones in sorted runs of about so many cells.
DENSE_CELLS, RUN_CELLS = 1 << 25, 1 << 21
END_KEY = int(mix64(np.array([0xE0D], np.uint64)).view(np.int64)[0])
#: Block lengths by position in the text: (from, length).
BLOCKS = ((0, 16), (64, 32), (256, 64), (1024, 128), (4096, 256), (16384, 512))
#: Bytes of text of which cells are looked up at once (in the processor's caches), that are scored in lock step, and that are sorted by length before.
PIECE, PASS, SORTED = 64 << 10, 512 << 10, 4 << 20
#: Weights of the predictors where no text is there to learn them, the rate of their refinement, and rates that are sensible.
WEIGHTS = (0.4, 0.5, 0.25)
RATE = 0.004
RATES = (0.001, 0.002, 0.004, 0.008)
#: Log-odds of the mixture are kept within these bounds on both sides.
BOUND = 10
#: What is added to both counts of a decision.
PRIOR = 0.2


def slots_of(training_bytes: int) -> tuple[int, ...]:
    """Slots of the tables for a training corpus, in proportion to its bytes, rounded up to a power of two."""
    needed = -(-training_bytes // (SLOT_BYTES * max(SLOTS)))
    return tuple(k << max(0, needed - 1).bit_length() for k in SLOTS)


#: A-Z in lower case, and all blanks as spaces.
_PLAIN = bytes(32 if 9 <= x <= 13 else x + 32 if 65 <= x <= 90 else x for x in range(256))


def canonical(text: bytes) -> bytes:
    out = text.translate(_PLAIN)
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out.strip(b" ")


def canonical_texts(column: pa.Array) -> list[bytes]:
    """The canonical texts of a column of strings."""
    return [canonical(t or b"") for t in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def token_keys(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and keys of the words in a buffer of canonical texts, between which are line feeds.

    Up to 16 bytes the first and the last eight and the length tell words apart; longer words have the keys of ``word_keys``.
    """
    edge = np.flatnonzero(np.diff(np.concatenate(([True], (buf == 32) | (buf == 10), [True]))))
    starts, ends = edge[::2], edge[1::2]
    lengths = ends - starts
    padded = np.concatenate((np.zeros(8, np.uint8), buf, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(buf) + 9, "<u8", padded, strides=(1,))
    first = np.take(eight, starts + 8) & _FIRST[np.minimum(lengths, 8)]
    last = np.take(eight, ends) >> (np.uint64(8) * np.maximum(8 - lengths, 0).astype(np.uint64))
    keys = mix64(first + mix64(last + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    long = np.flatnonzero(lengths > 16)
    if len(long):
        apart = bytearray(b"\n".join(buf[a:b].tobytes() for a, b in zip(starts[long].tolist(), ends[long].tolist())))
        pairs = word_keys(np.frombuffer(apart, np.uint8), *word_spans(np.frombuffer(apart, np.uint8)))
        keys[long] = pairs[:, 0] ^ pairs[:, 1]
    return starts, keys.view(np.int64)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical texts in one buffer, each after five line feeds and ended by one (with which a text's contexts begin); starts and scored lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = 5 + np.concatenate(([0], np.cumsum(lengths[:-1] + 5))) if len(texts) else np.zeros(0, np.int64)
    return np.frombuffer(b"\n" * 5 + (b"\n" * 5).join(texts) + b"\n", np.uint8), starts, lengths + 1


def slices(texts: list[bytes], limit: int) -> Iterator[list[bytes]]:
    """Consecutive texts of about ``limit`` bytes together; a longer text is alone."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held + len(t) > limit and i > first:
            yield texts[first:i]
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield texts[first:]


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The base's powers 0..n-1 (at least) and their inverses, as wrapping 64-bit integers."""
    if len(_tables[0]) >= n:
        return _tables
    size = -(-n // 262144) * 262144
    made = []
    for base in (_BASE, _BASE_INV):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        made.append(np.multiply.accumulate(x))
    if size <= 1 << 22:  # those of a very long text are not kept
        _tables[:] = made
    return made


def word_hashes(buf: np.ndarray) -> np.ndarray:
    """For each position, a rolling polynomial over the bytes since the last blank before it."""
    powers, inverses = _powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    for i in range(0, len(buf), 16384):  # pieces that stay in the processor's caches
        n = min(16384, len(buf) - i)
        x = np.take(_CODE, buf[i : i + n].astype(np.intp))
        x *= powers[i : i + n]
        x[:1] += total[i]
        np.cumsum(x, out=total[i + 1 : i + n + 1])
    starts = np.flatnonzero((buf[:-1] == 32) | (buf[:-1] == 10)) + 1
    starts = np.concatenate(([0], starts))
    lengths = np.diff(np.append(starts, len(buf)))
    at_start = np.stack((total[starts], inverses[starts]), axis=1).view(np.complex128).ravel()  # pairs of integers as one item
    for_each = np.repeat(at_start, lengths).view(np.uint64).reshape(-1, 2)
    out = total[:-1]
    out -= for_each[:, 0]
    out *= for_each[:, 1]
    return out


#: What a byte makes of the first cell of its context's slot (by exclusive or), for the high and for the low half byte. The low half's slot
#: is one of the 15 beside, which the high half tells; low halves of 0x10 to 0x1F, which are rare, are in the context's own slot.
_HIGH = np.arange(256, dtype=np.uint64) >> np.uint64(4)
_LOW = (_HIGH ^ np.uint64(1)) << np.uint64(4) | np.arange(256, dtype=np.uint64) & np.uint64(15)
_HALVES = _HIGH | _LOW << np.uint64(32)


def context_pairs(buf: np.ndarray, slots: tuple[int, ...] = SLOTS) -> list[np.ndarray]:
    """For each predictor, a row for each position: the cells of its high and of its low half byte.

    A cell is a slot, that is a hash of the context (for the low half with the high half), and the
    half byte that is found in it. A text's first bytes have the line feeds before it as context.
    """
    words = word_hashes(buf)
    padded = np.concatenate((np.full(5, 10, np.uint8), buf, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(buf), "<u8", padded, strides=(1,))  # the five bytes before each position and three more
    wide = sum(slots) > 1 << 28  # such cells take more than 32 bits
    out = [np.empty(len(buf) << wide, np.uint64) for _ in slots]
    firsts = np.cumsum((0, *slots[:-1])).tolist()
    for i in range(0, len(buf), 16384):
        n = min(16384, len(buf) - i)
        five = eight[i : i + n] << np.uint64(24)
        three = five >> np.uint64(40)
        five *= np.uint64(0x9E3779B97F4A7C15)
        three *= np.uint64(0xD6E8FEB86659FD93)
        here = buf[i : i + n].astype(np.intp)
        halves = np.take(_HALVES, here)
        for cells, context, first, own in zip(out, (three, five, words[i : i + n]), firsts, slots):
            context >>= np.uint64(64 - (own.bit_length() - 1))
            context += np.uint64(first)
            if wide:
                context <<= np.uint64(4)
                cells[2 * i : 2 * (i + n) : 2] = context ^ _HIGH[here]
                cells[2 * i + 1 : 2 * (i + n) : 2] = context ^ _LOW[here]
            else:
                context *= np.uint64(16 << 32 | 16)
                np.bitwise_xor(context, halves, out=cells[i : i + n])
    return [(x if wide else x.view(np.uint32)).reshape(-1, 2) for x in out]


def context_cells(buf: np.ndarray, slots: tuple[int, ...] = SLOTS) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same as two arrays for each predictor."""
    return [(x[:, 0].astype(np.int64), x[:, 1].astype(np.int64)) for x in context_pairs(buf, slots)]


class Counter:
    """What a task gathers: bytes under contexts, and tokens."""

    def __init__(self, slots: tuple[int, ...] = SLOTS):
        self.slots = slots
        self.dense = sum(slots) * 16 <= DENSE_CELLS
        self.cells = np.zeros(sum(slots) * 16 if self.dense else 0, np.int32)
        self.waiting: list[np.ndarray] = []
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []  # sorted cells and their counts
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0
        self.words: list[np.ndarray] = []
        self.texts = 0

    def add(self, texts: list[bytes]) -> None:
        self.add_canonical([canonical(t) for t in texts])

    def add_canonical(self, texts: list[bytes]) -> None:
        if texts:
            self._count(texts)
        self.texts += len(texts)
        if sum(map(len, self.words)) > 500_000:
            self.gather()

    def _count(self, texts: list[bytes]) -> None:
        buf, starts, lengths = joined(texts)
        self.words.append(token_keys(buf)[1])
        outside = between(starts, lengths)
        for pairs in context_pairs(buf, self.slots):
            if self.dense:
                np.add.at(self.cells, pairs.ravel().astype(np.intp), np.int32(1))
                np.subtract.at(self.cells, pairs[outside].ravel().astype(np.intp), np.int32(1))
            else:
                self.waiting.append(np.delete(pairs, outside, axis=0).ravel())
                if sum(map(len, self.waiting)) >= RUN_CELLS:
                    self._sort()

    def _sort(self) -> None:
        """What waits becomes a run."""
        if self.waiting:
            x = np.concatenate(self.waiting)
            self.waiting = []
            x.sort()
            heads = np.append(0, np.flatnonzero(x[1:] != x[:-1]) + 1)
            self.runs.append((x[heads], np.diff(np.append(heads, len(x))).astype(np.int32)))

    def full(self) -> bool:
        """Whether the runs, merged where they are many, are too long to be kept."""
        if sum(len(x) for x, _ in self.runs) <= 3 * RUN_CELLS:
            return False
        self._merge()
        return len(self.runs[0][0]) > 2 * RUN_CELLS

    def _merge(self) -> None:
        self._sort()
        if len(self.runs) > 1:
            if self.runs[0][0].dtype == np.uint32 and sum(int(n.sum()) for _, n in self.runs) < 1 << 32:  # a cell and its count are one integer
                n = np.concatenate([x.astype(np.uint64) << np.uint64(32) | n.view(f"u{n.itemsize}") for x, n in self.runs])
                n.sort()
                x = (n >> np.uint64(32)).astype(np.uint32)
                n &= np.uint64(0xFFFFFFFF)
            else:
                x, n = (np.concatenate(c) for c in zip(*self.runs))
                order = np.argsort(x, kind="stable")
                x, n = x[order], n[order]
            self.runs = []
            heads = np.append(0, np.flatnonzero(x[1:] != x[:-1]) + 1)
            self.runs = [(x[heads], np.add.reduceat(n, heads).astype(np.int64))]

    def gather(self) -> None:
        """Count the words that wait."""
        if self.texts:
            keys, counts = np.unique(np.concatenate(self.words), return_counts=True)
            self.keys += [keys, np.array([END_KEY])]
            self.counts += [counts, np.array([self.texts])]
            self.held += len(keys) + 1
        self.words, self.texts = [], 0

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        self.gather()
        keys, back = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate(self.counts)).astype(np.int64)
        self.keys, self.counts, self.held = [keys], [counts], len(keys)
        return keys, counts

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """The counts of each block that has some; those in runs are handed over and forgotten."""
        if not self.dense:
            self._merge()
            for x, n in self.runs:
                block = (x // BLOCK).astype(np.int64)
                heads = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
                for a, b in zip(heads, [*heads[1:], len(x)]):
                    yield int(block[a]), packed(x[a:b] % BLOCK, n[a:b])
            self.runs = []
            return
        for b in range(0, len(self.cells), BLOCK):
            part = self.cells[b : b + BLOCK]
            at = np.flatnonzero(part)
            if len(at):
                yield b // BLOCK, packed(at, part[at])


def between(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of ``joined`` that belong to no text and no end."""
    return np.concatenate((np.arange(5), ((starts + lengths)[:-1, None] + np.arange(4)).ravel()))


def packed(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Places and counts, the counts byte by byte of equal weight, which compresses well."""
    planes = np.zeros((8, len(counts)), np.uint8)
    for k in range((int(counts.max(initial=0)).bit_length() + 7) // 8):
        planes[k] = counts >> counts.dtype.type(8 * k) & counts.dtype.type(255)
    return at.astype("<u2").tobytes() + planes.tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 10
    planes = np.frombuffer(data, np.uint8, 8 * n, 2 * n).reshape(8, n)
    counts = planes[0].astype(np.int64)
    for k in range(1, 8):
        if planes[k].any():
            counts |= planes[k].astype(np.int64) << 8 * k
    return np.frombuffer(data, "<u2", n).astype(np.int64), counts


_STATS = "block int, salt int, key long, n long, data binary"


def _counter(slots: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        counter, salt = Counter(slots), TaskContext.get().partitionId() % 16

        def token_rows():
            keys, counts = counter.tokens()
            for a in range(0, len(keys), 200_000):
                k = keys[a : a + 200_000]
                yield _stats([None] * len(k), salt, k, counts[a : a + 200_000], [None] * len(k))
            counter.keys, counter.counts, counter.held = [], [], 0

        def block_rows():
            for block, data in counter.blocks():
                yield _stats([block], salt, np.zeros(1, np.int64), np.zeros(1, np.int64), [data])

        seen = False
        for b in batches:
            for part in text_slices(b, 0, PIECE):
                seen = True
                counter.add_canonical(canonical_texts(part.column(0)))
                if counter.full():
                    yield from block_rows()
                if counter.held > 1_000_000:
                    counter.tokens()
                    if counter.held > 700_000:
                        yield from token_rows()
        if seen:
            yield from token_rows()
            yield from block_rows()

    return trimmed(run)


def _stats(block, salt, key, n, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array([salt] * len(block), pa.int32()), pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["block", "salt", "key", "n", "data"])


def _summer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of consecutive rows of the same block."""
    now, total = None, None

    def row():
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([packed(at, total[at])], pa.binary())], names=["block", "data"])

    for b in batches:
        for block, data in zip(b.column(0).to_pylist(), b.column(1)):
            if block != now:
                if now is not None:
                    yield row()
                now, total = block, np.zeros(BLOCK, np.int64)
            at, counts = unpacked(data.as_py())
            total[at] += counts
    if now is not None:
        yield row()


def _writer(folder: str):
    """Writes each part's log-odds and deleted levels, once all counts of its blocks are summed; an attempt has names of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        now, total = None, None

        def row():
            name = f"{now:06d}-{uuid.uuid4().hex}"
            for kind, data in (("odds", paths(log_odds(total))), ("levels", deleted_levels(total))):
                with fs.open_output_stream(f"{path}/{name}.{kind}", compression=None) as out:
                    out.write(data.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([name])], names=["part", "name"])

        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1)):
                if block // PART != now:
                    if now is not None:
                        yield row()
                    now, total = block // PART, np.zeros(PART * BLOCK, np.int64)
                at, counts = unpacked(data.as_py())
                total[block % PART * BLOCK + at] += counts
        if now is not None:
            yield row()

    return trimmed(run)


class Tables:
    """The files of the tables, by part; parts that no text reached have none and are zero."""

    def __init__(self, folder: str, cells: int, names: dict[int, str]):
        self.folder, self.cells, self.names = folder, cells, names

    def _local(self, fs: pafs.FileSystem, path: str) -> str:
        """A path that can be mapped; files of a remote store are copied once for all workers of an executor."""
        if isinstance(fs, pafs.LocalFileSystem):
            return path
        copy = os.path.join(SparkFiles.getRootDirectory(), os.path.basename(path))
        if not os.path.exists(copy):
            own = f"{copy}.{uuid.uuid4().hex}"
            pafs.copy_files(path, own, source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
            os.replace(own, copy)
        return copy

    def mapped(self, kind: str) -> np.ndarray:
        """One read-only array over all files of the kind, side by side in the address space."""
        item = {"odds": np.uint32, "levels": np.uint16}[kind]
        size = PART * BLOCK * 2  # both have two bytes a cell
        whole = mmap.mmap(-1, -(-self.cells // (PART * BLOCK)) * size, mmap.MAP_PRIVATE | mmap.MAP_NORESERVE, mmap.PROT_READ)
        out = np.frombuffer(whole, item)
        libc = ctypes.CDLL(None, use_errno=True)
        libc.mmap.restype = ctypes.c_void_p
        libc.mmap.argtypes = [ctypes.c_void_p, ctypes.c_size_t, ctypes.c_int, ctypes.c_int, ctypes.c_int, ctypes.c_long]
        fs, path = file_system(self.folder)
        for part, name in self.names.items():
            with open(self._local(fs, f"{path}/{name}.{kind}"), "rb") as f:
                at = out.ctypes.data + part * size
                if os.fstat(f.fileno()).st_size != size or libc.mmap(at, size, mmap.PROT_READ, mmap.MAP_SHARED | 0x10, f.fileno(), 0) != at:  # MAP_FIXED
                    raise OSError(ctypes.get_errno(), f"{name}.{kind} can't be mapped")
        return out

    @property
    def value(self) -> np.ndarray:
        """The log-odds as ``log_odds`` gives them."""
        found = self.mapped("odds").view(np.int8).reshape(-1, 8, 4)
        out = np.zeros((len(found), 16), np.int8)
        for k in range(4):
            out[:, 1 << k : 2 << k] = found[:, :: 8 >> k, k]
        return out.ravel()[: self.cells]

    def drop(self, kind: str) -> None:
        fs, path = file_system(self.folder)
        for name in self.names.values():
            fs.delete_file(f"{path}/{name}.{kind}")


def log_odds(cells: np.ndarray) -> np.ndarray:
    """Of counts of half bytes under contexts, int8 log-odds (in sixteenths) of the 15 bit decisions of each slot."""
    out = np.zeros((len(cells) // 16, 16), np.int8)
    for a in range(0, len(out), 65536):
        c = cells.reshape(-1, 16)[a : a + 65536].astype(np.float32)
        for k in range(4):
            n = c.reshape(len(c), 1 << k, 2, 1 << (3 - k)).sum(3)
            odds = np.log((n[:, :, 1] + PRIOR) / (n[:, :, 0] + PRIOR)) * 16
            out[a : a + 65536, 1 << k : 2 << k] = np.clip(np.rint(odds), -127, 127)
    return out.ravel()


def paths(odds: np.ndarray) -> np.ndarray:
    """Of each slot, for the upper three bits of a half byte the log-odds of its four decisions, which a single look-up gives."""
    odds, j = odds.reshape(-1, 16), np.arange(8)
    out = np.empty((len(odds), 8, 4), np.int8)
    for k in range(4):
        out[:, :, k] = odds[:, 1 << k | j >> (3 - k)]
    return out.reshape(-1).view(np.uint32)


#: Log-odds by level, as four bits: 0 to 7, then -8 (not used) to -1.
LEVELS = np.array([*(q * q / 6 for q in range(8)), *(-q * q / 6 for q in range(8, 0, -1))])


def deleted_levels(cells: np.ndarray) -> np.ndarray:
    """For each half byte under a context, four levels: the log-odds of its decisions, towards them, as they are without one occurrence of it."""
    out = np.zeros((len(cells) // 16, 16), np.uint16)
    for a in range(0, len(out), 16384):
        c = cells.reshape(-1, 16)[a : a + 16384].astype(np.float32)
        for k in range(4):
            n = c.reshape(len(c), 2 << k, 8 >> k).sum(2)
            other = n.reshape(len(c), 1 << k, 2)[:, :, ::-1].reshape(n.shape)
            odds = np.log((np.maximum(n - 1, 0) + PRIOR) / (other + PRIOR))
            q = (np.sign(odds) * np.minimum(np.rint(np.sqrt(6 * np.abs(odds))), 7)).astype(np.int8)
            out[a : a + 16384] |= np.repeat((q & 15).astype(np.uint16) << np.uint16(4 * k), 8 >> k, axis=1)
    return out.ravel()


def level_counts(texts: list[bytes], levels: np.ndarray, slots: tuple[int, ...], into: np.ndarray) -> None:
    """Count the decisions of canonical texts by half byte and bit (rows) and the levels of the predictors (columns)."""
    buf, starts, lengths = joined(texts)
    outside = between(starts, lengths)
    found = [np.take(levels, pairs.ravel().astype(np.intp), mode="clip") for pairs in context_pairs(buf, slots)]
    bins = into.shape[1]
    half = np.tile(np.array([0, bins], np.uint16), len(buf))
    for k in range(4):
        joint = np.zeros(len(half), np.uint16)
        for x in found:
            joint <<= np.uint16(4)
            joint |= x >> np.uint16(4 * k) & np.uint16(15)
        joint |= half
        n = np.bincount(joint, minlength=2 * bins) - np.bincount(joint.reshape(-1, 2)[outside].ravel(), minlength=2 * bins)
        into[k::4] += n.reshape(2, bins)


def learnt_weights(counts: np.ndarray, steps: int = 20) -> np.ndarray:
    """For each half byte, predictor and bit, the weights of least loss over decisions that ``level_counts`` counted."""
    m = len(WEIGHTS)
    odds = LEVELS[np.arange(16**m)[:, None] >> 4 * np.arange(m)[::-1] & 15]
    out = np.empty((2, m, 4))
    for row, n in enumerate(counts):
        some = n > 0
        out[row // 4, :, row % 4] = least_loss(odds[some].astype(np.float32), np.array(WEIGHTS), steps, n[some].astype(np.float64))
    return out


def blocks(length: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the blocks of a text; later blocks are longer."""
    a = 0
    while a < length:
        size = max(n for at, n in BLOCKS if at <= a)
        yield a, size
        a += size


#: For each byte eight int8, all ones where a decision was a zero, as one item.
_ZEROS = np.where(np.arange(256)[:, None] >> np.arange(7, -1, -1) & 1, 0, -1).astype(np.int8).view(np.uint64).ravel()


class Mixer:
    """Scores many texts in lock step with frozen predictors and a mixture of its own for each text.

    tables: log-odds, or what ``paths`` makes of them.
    weights: for each half byte, predictor and bit, what a text starts with.
    """

    def __init__(self, tables: np.ndarray, slots: tuple[int, ...] = SLOTS, weights: np.ndarray | None = None, rate: float = RATE):
        self.slots, self.rate = slots, rate
        self.weights = np.tile(np.array(WEIGHTS, np.float32)[None, :, None], (2, 1, 4)) if weights is None else weights.astype(np.float32)
        self.table = tables if tables.dtype == np.uint32 else paths(tables)
        self.held = np.empty((len(slots), 2 * PASS), np.uint64)  # kept from pass to pass; a very long text takes more

    def odds(self, buf: np.ndarray, out: np.ndarray) -> None:
        """For each predictor (rows) and byte the log-odds (int8, in sixteenths, towards what was found) of its eight decisions, as one item."""
        zeros = np.take(_ZEROS, buf.astype(np.intp))
        for x, pairs in zip(out, context_pairs(buf, self.slots)):
            np.bitwise_xor(np.take(self.table, (pairs >> 1).ravel().astype(np.intp), mode="clip").view(np.uint64), zeros, out=x)
            x = x.view(np.int8)
            x -= zeros.view(np.int8)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Total bits of each canonical text and its end."""
        pieces = [joined(part) for part in slices(texts, PIECE)]
        firsts = np.cumsum([0, *(len(buf) for buf, _, _ in pieces)])
        odds = np.empty((len(self.slots), firsts[-1]), np.uint64) if firsts[-1] > self.held.shape[1] else self.held[:, : firsts[-1]]
        for (buf, _, _), a in zip(pieces, firsts):
            self.odds(buf, odds[:, a : a + len(buf)])
        starts = np.concatenate([np.zeros(0, np.int64), *(starts + a for (_, starts, _), a in zip(pieces, firsts))])
        lengths = np.concatenate([np.zeros(0, np.int64), *(lengths for _, _, lengths in pieces)])
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        n, m = len(starts), len(self.slots)
        # what a text's weights (times -1/16) become; decisions of both halves are one axis
        weights = np.repeat(self.weights.transpose(1, 0, 2).reshape(m, 1, 8) * np.float32(-1 / 16), n, axis=1).reshape(m, 8 * n)
        total = np.zeros(8 * n)
        share = np.float32(self.rate / 256)
        live = n
        for a, size in blocks(int(lengths[0]) if n else 0):
            while lengths[live - 1] <= a:
                live -= 1
            here = np.arange(a, a + size)[:, None]
            at = starts[:live] + here
            some_past = lengths[live - 1] < a + size  # in a text's last block, after which its weights are of no use
            if some_past:
                np.minimum(at, odds.shape[1] - 1, out=at)
            w = weights[:, : 8 * live]
            st = [np.take(x, at).view(np.int8).astype(np.float32) for x in odds]
            against = st[0] * w[0]
            for o in range(1, m):
                against += st[o] * w[o]
            np.minimum(against, np.float32(BOUND), out=against)
            np.maximum(against, np.float32(-BOUND), out=against)
            factor = np.exp(against, out=against)
            factor += np.float32(1)
            if some_past:
                factor.reshape(size, live, 8)[here >= lengths[:live]] = 1
            # factors are at most 22027, so that eight of them have a product
            total[: 8 * live] += np.log(np.multiply.reduce(factor.reshape(size // 8, 8, 8 * live), axis=1)).sum(0)
            miss = np.reciprocal(factor, out=factor)
            np.subtract(np.float32(1), miss, out=miss)
            for o in range(m):
                w[o] -= share * np.einsum("ij,ij->j", miss, st[o])
        out = np.empty(n)
        out[order] = total.reshape(n, 8).sum(1) / math.log(2)
        return out


def least_loss(odds: np.ndarray, start: np.ndarray, steps: int, times: np.ndarray | float = 1.0) -> np.ndarray:
    """Weights w that minimise the sum of log(1 + exp(-odds . w)), each row so many times, by Newton's method with a small ridge."""
    w = start.astype(np.float64)
    for _ in range(steps):
        miss = 1 / (1 + np.exp(np.clip(odds @ w.astype(np.float32), -30, 30)))
        slope = odds.T @ (times * miss) - 1e-3 * w
        curve = (odds * (times * miss * (1 - miss))[:, None]).T @ odds + 1e-3 * np.eye(len(w))
        w = np.clip(w + np.clip(np.linalg.solve(curve, slope), -0.5, 0.5), -2, 2)
    return w


def _learner(tables: Tables, slots):
    """The decisions of the task's texts, counted by their levels: a row for each count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        levels, counts = tables.mapped("levels"), np.zeros((8, 16 ** len(slots)), np.int64)
        for b in batches:
            for part in text_slices(b, 0, PIECE):
                level_counts(canonical_texts(part.column(0)), levels, slots, counts)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts.ravel()[at])], names=["bin", "n"])

    return trimmed(run)


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known_hot long, sum_hot double, n_bytes long, bits double, rare array<long>, times array<int>"


def _token_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens of each canonical text and how often each is there, text after text; where each text's begin."""
    firsts, keys = token_keys(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8))
    bounds = np.searchsorted(firsts, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
    found = [np.unique(np.append(keys[a:b], END_KEY), return_counts=True) for a, b in zip(bounds, bounds[1:])]
    own, times = (np.concatenate(x) for x in zip(*found))
    return own, times, np.cumsum([0, *(len(x) for x, _ in found[:-1])])


def _keep_memory() -> None:
    """Within a task freed memory is kept up to a bound: to give back and get again each piece's arrays takes longer than to fill them."""
    with contextlib.suppress(Exception):  # another C library does without
        ctypes.CDLL("libc.so.6").mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD


def _scorer(tables: Tables, hot_b, slots, weights, rate):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        mixer = Mixer(tables.mapped("odds"), slots, weights, rate)
        hot_keys, hot_counts = hot_b.value
        hot_logs = np.log10(hot_counts + 1.0)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for rows in text_slices(b, 2, SORTED):
                unsorted = canonical_texts(rows.column(2))
                order = np.argsort([len(t) for t in unsorted], kind="stable")
                done = 0
                for texts in slices([unsorted[i] for i in order], PASS):
                    here = pa.array(order[done : done + len(texts)])
                    done += len(texts)
                    own, times, heads = _token_counts(texts)
                    at = np.searchsorted(hot_keys, own)
                    at[at == len(hot_keys)] = 0
                    hot = hot_keys[at] == own if len(hot_keys) else np.zeros(len(own), bool)
                    logs = np.where(hot, hot_logs[at], 0.0) if len(hot_keys) else np.zeros(len(own))
                    offsets = pa.array(np.append(0, np.cumsum(np.add.reduceat(~hot, heads, dtype=np.int64))).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.arange(row, row + len(texts))), rows.column(0).take(here), rows.column(1).take(here), pa.array(np.add.reduceat(times, heads)), pa.array(np.add.reduceat(times * hot, heads)), pa.array(np.add.reduceat(logs * times, heads)),
                            pa.array([len(t) for t in texts], pa.int64()), pa.array(mixer.bits(texts)), pa.ListArray.from_arrays(offsets, pa.array(own[~hot])), pa.ListArray.from_arrays(offsets, pa.array(times[~hot].astype(np.int32))),
                        ],
                        names=["row", "doc_id", "held_out", "n_tokens", "known_hot", "sum_hot", "n_bytes", "bits", "rare", "times"],
                    )
                    row += len(texts)

    return trimmed(run)


class Model:
    """Token counts (a DataFrame key, n), the totals, the files of the tables and what the mixture starts with."""

    def __init__(self, spark: SparkSession, training: DataFrame, text_column: str = "text", hot_tokens: int = 1 << 19):
        texts = training.select(F.coalesce(F.col(text_column), F.lit("")).alias("text"))
        self.slots = slots_of(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
        stats = materialize(spark, texts.mapInArrow(_counter(self.slots), _STATS), "lm-stats")
        self.counts = materialize(spark, stats.where("block is null").groupBy("key").agg(F.sum("n").alias("n")), "lm-tokens")
        bins = self.counts.groupBy(F.floor(8 * F.log2("n")).alias("bin")).agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("n")).collect()
        self.train_tokens = sum(r["n"] for r in bins)
        self.vocabulary = sum(r["tokens"] for r in bins)
        least, held = 1 << 30, 0
        for r in sorted(bins, key=lambda r: -r["bin"]):
            held += r["tokens"]
            if held > hot_tokens:
                break
            least = r["bin"]
        hot = self.counts.where(F.floor(8 * F.log2("n")) >= least).toArrow()
        keys, n = hot.column("key").to_numpy(), hot.column("n").to_numpy()
        order = np.argsort(keys)
        self.hot = spark.sparkContext.broadcast((keys[order], n[order]))
        self.rare = self.counts.where(F.floor(8 * F.log2("n")) < least)
        summed = stats.where("block is not null").repartition("block", "salt").sortWithinPartitions("block").select("block", "data").mapInArrow(trimmed(_summer), "block int, data binary")
        folder = new_folder(spark, "lm-tables")
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        part = F.floor(F.col("block") / PART)
        names = summed.repartition(part).sortWithinPartitions("block").mapInArrow(_writer(folder), "part int, name string").collect()
        drop_folder(spark, stats)
        self.tables = Tables(folder, sum(self.slots) * 16, {r["part"]: r["name"] for r in names})
        self.weights, self.rate = None, RATE
        if names:
            counts = np.zeros((8, 16 ** len(self.slots)), np.int64)
            for r in texts.mapInArrow(_learner(self.tables, self.slots), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
                counts.flat[r["bin"]] = r["n"]
            self.weights = learnt_weights(counts)
        self.tables.drop("levels")

    def score(self, spark: SparkSession, docs: DataFrame, held_out: F.Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        rows = docs.select(docs[id_column].cast("long").alias("doc_id"), held_out.alias("held_out"), docs[text_column].alias("text"))
        scored = materialize(spark, rows.mapInArrow(_scorer(self.tables, self.hot, self.slots, self.weights, self.rate), _SCORED), "lm-scored")
        rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("row", F.col("t.rare").alias("key"), F.col("t.times").alias("times"))
        found = rare.join(self.rare, "key").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("known"))
        norm = math.log10(self.train_tokens + self.vocabulary + 1)
        joined_rows = scored.drop("rare", "times").join(found, "row", "left")
        return joined_rows.select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known_hot") + F.coalesce("known", F.lit(0))).alias("n_known"),
            F.lit(self.train_tokens).cast("long").alias("train_tokens"),
            (F.col("sum_hot") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
            (-F.col("bits") * F.lit(math.log10(2))).alias("score"),
            (F.col("bits") / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
        )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 7) == 2
    return Model(spark, docs.where(~held_out)).score(spark, docs, held_out)
