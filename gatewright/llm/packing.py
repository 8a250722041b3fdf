"""Packing documents into sequences by Karmarkar-Karp multiway differencing.

Method. Token counts are differenced: the two partial partitions with the largest
imbalance are merged so that the fullest windows of one meet the emptiest windows
of the other, until one partition into near-equal windows is left. If one of its
windows exceeds the capacity, the window count rises and differencing starts anew.

Documents are tokenised once. A task gathers pieces until they make a group of
about ``group_windows`` windows, packs it and goes on, so memory is bounded by the
group and not by the task's input, nothing crosses the network, and a lost task is
just run again. Documents longer than a window give full windows first; what is
left is cut into pieces of at most ``piece`` tokens, which keeps the imbalance that
differencing leaves far below a window.

Defined results: null text counts as empty; an empty document is the end token
alone; repeated ids and equal rows are packed as they come; of equal imbalances the
pieces that came first are merged first; very long texts are whole, cut into pieces;
extra columns are ignored, whatever their names; an empty table gives no sequence.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe import REMEMBER, text_encoder
from .common import table, text_slices, trimmed

CAPACITY = 4096
END_ID = 2

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def kk_partition(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` windows of near-equal sums."""
    if k <= 1:
        return [list(range(len(sizes)))]
    kids: list = []  # of merged nodes; nodes below len(sizes) are items
    n = len(sizes)
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:
            merged = a[: len(a) - over] + b[: len(b) - over]
            for (s, x), (t, y) in zip(a[len(a) - over :], reversed(b[len(b) - over :])):
                merged.append((s + t, n + len(kids)))
                kids.append((x, y))
        merged.sort(reverse=True)
        gap = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-gap, tick, merged))
        tick += 1
    windows = []
    for _, node in heap[0][2] if heap else []:
        stack, items = [node], []
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack.extend(kids[x - n])
        windows.append(sorted(items))
    return windows


def balanced_windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows, as few as fit; each size must be at most ``capacity``."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = kk_partition(sizes, k)
        excess = [s - capacity for w in windows if (s := sum(sizes[i] for i in w)) > capacity]
        if not excess:
            return [w for w in windows if w]
        k += max(1, sum(excess) // capacity)


def _packer(path: str, capacity: int, group_windows: int, piece: int, remember: int = REMEMBER):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, "word_end", remember)
        next_sequence = TaskContext.get().partitionId() << 32
        end = struct.pack("<I", END_ID)
        pieces: list[tuple] = []  # doc, start, length, crc, doc tokens
        held = 0
        rows: list[tuple] = []

        def place(windows):
            nonlocal next_sequence
            for window in windows:
                at = 0
                for p in window:
                    rows.append((*p, next_sequence, at))
                    at += p[2]
                next_sequence += 1

        def flush():
            nonlocal pieces, held
            place([[pieces[i] for i in w] for w in balanced_windows([p[2] for p in pieces], capacity)])
            pieces, held = [], 0

        def batch():
            nonlocal rows
            columns, rows = list(zip(*rows)), []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for b in batches:
            for rows_in in text_slices(b, 1, 2 << 20):
                part = rows_in.column(0).to_pylist()
                ids, offsets = encoder.encode([(x or "").encode() for x in rows_in.column(1).to_pylist()])
                flat = memoryview(ids.astype("<u4").tobytes())
                for i, doc_id in enumerate(part):
                    first, last = int(offsets[i]), int(offsets[i + 1])
                    n = last - first + 1
                    at = 0
                    while at < n:
                        length = capacity if n - at >= capacity else min(piece, n - at)
                        crc = zlib.crc32(flat[4 * (first + at) : 4 * min(first + at + length, last)])
                        p = (doc_id, at, length, zlib.crc32(end, crc) if at + length == n else crc, n)
                        at += length
                        if length == capacity:
                            place([[p]])
                        else:
                            pieces.append(p)
                            held += length
                    if held >= group_windows * capacity:
                        flush()
                if len(rows) > 20_000:
                    yield batch()
        flush()
        if rows:
            yield batch()

    return trimmed(run)


def pack(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, group_windows: int = 128, piece: int = 1024, remember: int = REMEMBER) -> DataFrame:
    """One row for each piece of each document, with its place in a sequence.

    remember: bytes of segments whose ids a worker keeps, see ``bpe.TextEncoder``.
    """
    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(_packer(tokenizer_path, capacity, group_windows, piece, remember), SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer(), remember=64 << 20)
