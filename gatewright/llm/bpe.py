"""Byte-pair encoding in batched numpy merge rounds, and decoding.

Method. The symbols of many words lie in one flat array. In a round, each word's
adjacent pair of lowest rank is found by binary search of pair keys in the sorted
keys of all merges and a segmented minimum; every occurrence of that pair in its
word is merged, and words without a mergeable pair leave the array. Only pairs
that touch a merged symbol are looked up again.

Texts are cut into segments, each a run of blanks and the following run of other
bytes, across which no token of these tokenizers reaches. Segments are told apart
by their bytes, encoded once for each batch of texts and remembered up to a bound,
so a text is a gather of the ids of its segments.

Defined results: null texts are empty and have no ids; repeated rows and ids are each
encoded; nothing is chosen among rows, so there are no ties; a very long text is worked
on alone, whole; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import Numbers, table, text_slices, trimmed

#: White space of Unicode; the part outside ASCII makes a blank no safe place to cut.
WIDE = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = r"\t-\r " + WIDE
#: Word patterns of the two tokenizers; {0} is where NUL, which parts joined segments, is left out.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^WHITE\p{L}\p{N}{0}]+|[WHITE]+(?![^WHITE{0}])|[WHITE]+".replace("WHITE", WHITE)
WORD_END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^WHITE\p{L}\p{N}{0}]+".replace("WHITE", WHITE)
_FAR = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others follow from U+0100 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    code = {b: b for b in own} | {b: 0x100 + i for i, b in enumerate(rest)}
    return [chr(code[b]) for b in range(256)]


class PairMerger:
    """The vocabulary of a tokenizer file and its merges as sorted pair keys."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        glyphs = byte_alphabet()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.inner = np.array([vocab[g] for g in glyphs], np.int32)
        self.final = np.array([vocab[g + suffix] for g in glyphs], np.int32)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] if not suffix else vocab[a.removesuffix(suffix) + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        back = {g: b for b, g in enumerate(glyphs)}
        self.bytes_of = {i: bytes(back[c] for c in (t.removesuffix(suffix) if suffix else t)) for t, i in vocab.items() if t not in self.specials}
        self.bytes_of |= {i: t.encode() for t, i in self.specials.items()}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _FAR)

    def encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the non-empty words ``buf[starts:ends]`` and the offset of each word in them."""
        n = len(starts)
        lengths = ends - starts
        out: list[np.ndarray] = []
        of: list[np.ndarray] = []
        word = np.repeat(np.arange(n, dtype=np.int32), lengths)
        take = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
        symbols = self.inner[buf[take]]
        if n:
            last = np.cumsum(lengths) - 1
            symbols[last] = self.final[buf[ends - 1]]
        same = np.zeros(len(word), bool)
        same[:-1] = word[:-1] == word[1:]
        rank = np.full(len(word), _FAR, np.int32)
        at = np.flatnonzero(same)
        rank[at] = self._rank(symbols[at], symbols[at + 1])
        while len(word):
            head = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, head)
            sizes = np.diff(np.append(head, len(word)))
            spread = np.repeat(least, sizes)
            done = spread == _FAR
            if done.any():
                out.append(symbols[done])
                of.append(word[done])
                if done.all():
                    break
                live = ~done
                symbols, word, rank, spread = symbols[live], word[live], rank[live], spread[live]
            hit = np.flatnonzero(rank == spread)
            # of overlapping occurrences, as in "aaa", every second one counts
            follows = np.concatenate(([False], (hit[1:] == hit[:-1] + 1)))
            if follows.any():
                run = np.flatnonzero(~follows)
                nth = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
                hit = hit[nth % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(len(word), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            hit = moved[hit]
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            touched = np.zeros(len(word) + 1, bool)  # the last is that of no symbol, before the first
            touched[hit] = touched[hit - 1] = True
            again = np.flatnonzero(touched[:-1])
            rank[again] = _FAR
            inside = again[again + 1 < len(word)]
            inside = inside[word[inside] == word[inside + 1]]
            rank[inside] = self._rank(symbols[inside], symbols[inside + 1])
        if not out:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        ids, word = np.concatenate(out), np.concatenate(of)
        order = np.argsort(word, kind="stable")
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(word, minlength=n), out=offsets[1:])
        return ids[order], offsets


#: Characters outside the long-settled letters, signs and punctuation.
UNSETTLED = r"[^\x01-\u012f\u0131-\u024f\u0391-\u03c9\u0400-\u04ff\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"


class Words:
    """How a tokenizer cuts segments into words, and what it does to a text before."""

    def __init__(self, merger: PairMerger, pattern: str, folded: bool, library=None):
        """library: a ``tokenizers.Tokenizer`` for segments with characters whose classes differ between Unicode versions."""
        self.merger, self.folded, self.library = merger, folded, library
        self.alone = regex.compile(pattern.replace("{0}", ""))
        self.joined = regex.compile("\x00|" + pattern.replace("{0}", r"\x00"))
        self.special = regex.compile("|".join([*map(regex.escape, merger.specials), r"\x00", *([UNSETTLED] if library else [])]))
        self.unsettled = regex.compile(UNSETTLED)

    def _fold(self, text: str) -> str:
        if not self.folded:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        return text.lower()

    def _parts(self, segment: str) -> list:
        """Words of a segment, and the ids of special tokens that it spells."""
        if self.library is not None and self.unsettled.search(segment):
            return self.library.encode(segment, add_special_tokens=False).ids
        parts: list = []
        for piece in regex.split("(" + "|".join(map(regex.escape, self.merger.specials)) + ")", segment):
            parts += [self.merger.specials[piece]] if piece in self.merger.specials else self.alone.findall(self._fold(piece))
        return parts

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the segments and each segment's offset in them."""
        n = len(segments)
        whole = "\x00".join(segments)
        odd: dict[int, list] = {}
        if whole.count("\x00") != n - 1 or self.special.search(whole.replace("\x00", "")):
            odd = {i: self._parts(s) for i, s in enumerate(segments) if self.special.search(s)}
            whole = "\x00".join("" if i in odd else s for i, s in enumerate(segments))
        index: dict[str, int] = {}
        flat = np.array([-1 if w == "\x00" else index.setdefault(w, len(index)) for w in self.joined.findall(self._fold(whole))], np.int64)
        ends = flat < 0
        use, of = flat[~ends], np.cumsum(ends)[~ends]
        singles: list[int] = []
        if odd:
            late = [(i, w) for i, parts in odd.items() for w in parts]
            for _, w in late:
                if isinstance(w, str):
                    index.setdefault(w, len(index))
            more = []
            for _, w in late:
                more.append(index[w] if isinstance(w, str) else len(index) + len(singles))
                if not isinstance(w, str):
                    singles.append(w)
            use, of = np.concatenate((use, np.array(more, np.int64))), np.concatenate((of, np.array([i for i, _ in late], np.int64)))
            by = np.argsort(of, kind="stable")
            use, of = use[by], of[by]
        coded = [w.encode() for w in index]
        lengths = np.array([len(w) for w in coded], np.int64)
        last = np.cumsum(lengths)
        ids, offsets = self.merger.encode(np.frombuffer(b"".join(coded), np.uint8), last - lengths, last)
        if singles:
            ids = np.concatenate((ids, np.array(singles, np.int32)))
            offsets = np.concatenate((offsets, offsets[-1] + 1 + np.arange(len(singles))))
        at = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(of, weights=np.diff(offsets)[use], minlength=n).astype(np.int64), out=at[1:])
        return gather(ids, offsets, use), at


#: A run of blanks and what follows up to the next, or blanks at the end of a text.
_SEGMENT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


class TextEncoder:
    """Ids of whole texts, by segments that are remembered with their bytes.

    Callers hand over a few MB of text at a time, which bounds the working memory;
    about ``remember`` bytes of segments bound the memory of what was encoded before.
    """

    def __init__(self, path: str, pattern: str, folded: bool, remember: int = 24 << 20, library=None):
        self.merger = PairMerger(path)
        self.words = Words(self.merger, pattern, folded, library)
        self.blanks = not folded  # whether blanks are part of the tokens
        self.remember = remember
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.held = Numbers(), 0
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _segments(self, text: bytes) -> list[bytes]:
        if not self.blanks:
            return text.split()
        if not text.isascii() and _ODD_BLANK.search(text):  # such blanks join what they touch
            return [text]
        return _SEGMENT.findall(text)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat int32 ids of the texts and each text's offset in them."""
        if self.held > self.remember:
            self._forget()
        segments: list[bytes] = []
        ends = [0]
        for t in texts:
            segments += self._segments(t)
            ends.append(len(segments))
        use = self.numbers.of(segments)
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if fresh:
            ids, offsets = self.words.encode([x.decode() for x in fresh])
            self.ids = np.concatenate((self.ids, ids))
            self.offsets = np.concatenate((self.offsets, self.offsets[-1] + offsets[1:]))
            self.held += sum(map(len, fresh)) + 200 * len(fresh)
        total = np.concatenate(([0], np.cumsum(np.diff(self.offsets)[use])))
        return gather(self.ids, self.offsets, use), total[np.array(ends)]


#: The UTF-8 forms of the white space outside ASCII.
_ODD_BLANK = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")

#: Bytes of segments that an encoder remembers.
REMEMBER = 24 << 20

_encoders: dict[tuple, TextEncoder] = {}


def text_encoder(path: str, kind: str, remember: int = REMEMBER) -> TextEncoder:
    """The encoder of a worker process. kind: ``byte_level`` (this module alone) or ``word_end``
    (with the library for characters whose classes differ between Unicode versions)."""
    if (path, kind, remember) not in _encoders:
        if kind == "byte_level":
            made = TextEncoder(path, BYTE_LEVEL, folded=False, remember=remember)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_padding()
            library.no_truncation()
            made = TextEncoder(path, WORD_END, folded=True, remember=remember, library=library)
        _encoders[path, kind, remember] = made
    return _encoders[path, kind, remember]


def passes(items: list, size, limit: int = 4 << 20):
    """Slices of ``items`` of about ``limit`` bytes each."""
    at, held = 0, 0
    for i, x in enumerate(items):
        held += size(x)
        if held >= limit:
            yield items[at : i + 1]
            at, held = i + 1, 0
    if at < len(items):
        yield items[at:]


def gather(flat: np.ndarray, offsets: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The concatenation of the slices ``flat[offsets[i]:offsets[i+1]]`` for i in ``use``."""
    counts = (offsets[1:] - offsets[:-1])[use]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(offsets[:-1][use], counts)]


# --- the operator ---------------------------------------------------------------------------

OP9_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def decode(ids: list[int], merger: PairMerger) -> str:
    """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
    table = merger.bytes_of
    return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def _coder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, "byte_level")
        for b in batches:
            for rows in text_slices(b, 1, 2 << 20):
                part = rows.column(0).to_pylist()
                flat, at = encoder.encode([(x or "").encode() for x in rows.column(1).to_pylist()])
                out = []
                for i, doc_id in enumerate(part):
                    ids = flat[at[i] : at[i + 1]].tolist()
                    listed = ",".join(map(str, ids)).encode()
                    out.append((doc_id, len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decode(ids, encoder.merger).encode()).hexdigest()))
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return trimmed(run)


def encode_table(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Digests of the ids of each text and of their decoded text; map-only, no shuffle.

    Null texts are empty (no ids). Repeated rows are each returned; extra columns are ignored.
    """
    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(_coder(tokenizer_path), OP9_SCHEMA)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
