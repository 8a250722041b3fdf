"""Language identification with a byte convolutional network.

Method. Bytes are embedded, convolved with filters of several widths, rectified,
max-pooled over a fixed-length window and classified by a softmax layer; all of it is
trained in numpy (Adam on cross-entropy) on windows of labelled texts. A whole text is
cut into overlapping windows, so that no filter loses a position, and its language is
the one with the largest mean window probability, weighted by the windows' bytes.

For prediction, embedding and filters are folded into tables over byte pairs: the
response of a filter of width w is the sum of w/2 table rows, which is the same
convolution with fewer operations.

Training reads a bounded sample: about ``per_language`` distinct texts for each label,
chosen by a hash of the text among the labelled rows, one window each, and raises if there
are more than ``most_labels`` labels. The network (a few thousand weights) is all that is
sent to the executors; prediction is map-only.

Defined results: a null text or one without a letter is ``und`` with score 0; of equal mean
probabilities the first label by name is taken; equal texts have equal results, so repeated
rows and ids do; very long texts are whole, in windows; rows without label teach nothing; a
text with several labels teaches each; with no labelled row at all every text is ``und``;
other columns are ignored by ``op2`` and kept by ``keep_known``, whatever their names; an
empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, text_slices, trimmed

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
_LETTER = regex.compile(r"\p{L}")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


class ByteCNN:
    """The network; parameters are float32 arrays in ``w``."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.w = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        self.w["embed"][0] = 0
        for k in WIDTHS:
            self.w[f"conv{k}"] = rng.normal(0, (k * EMBED) ** -0.5, (k, EMBED, FILTERS)).astype(np.float32)
            self.w[f"bias{k}"] = np.zeros(FILTERS, np.float32)
        hidden = len(WIDTHS) * FILTERS
        self.w["out"] = rng.normal(0, hidden**-0.5, (hidden, len(classes))).astype(np.float32)
        self.w["out_bias"] = np.zeros(len(classes), np.float32)

    def _forward(self, x: np.ndarray):
        e = self.w["embed"][x]
        pooled, places = [], []
        for k in WIDTHS:
            n = x.shape[1] - k + 1
            view = np.concatenate([e[:, j : j + n] for j in range(k)], axis=2)
            r = view @ self.w[f"conv{k}"].reshape(k * EMBED, FILTERS) + self.w[f"bias{k}"]
            at = r.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(r, at[:, None], 1)[:, 0], 0))
            places.append((at, view))
        h = np.concatenate(pooled, 1)
        z = h @ self.w["out"] + self.w["out_bias"]
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return h, p / p.sum(1, keepdims=True), places

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, p, places = self._forward(x)
        rows = np.arange(len(x))
        d = p
        d[rows, y] -= 1
        d /= len(x)
        g = {"out": h.T @ d, "out_bias": d.sum(0), "embed": np.zeros_like(self.w["embed"])}
        dh = (d @ self.w["out"].T) * (h > 0)
        for i, k in enumerate(WIDTHS):
            at, view = places[i]
            dr = dh[:, i * FILTERS : (i + 1) * FILTERS]
            seen = view[rows[:, None], at]  # example, filter, k * EMBED
            g[f"conv{k}"] = np.einsum("bf,bfe->ef", dr, seen).reshape(k, EMBED, FILTERS)
            g[f"bias{k}"] = dr.sum(0)
            back = np.einsum("bf,kef->bfke", dr, self.w[f"conv{k}"])
            for j in range(k):
                np.add.at(g["embed"], x[rows[:, None], at + j].ravel(), back[:, :, j].reshape(-1, EMBED))
        g["embed"][0] = 0
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteCNN:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                at = order[a : a + batch]
                step += 1
                lr = rate * (1 - epoch / epochs) + rate / 20
                for k, g in self._gradients(x[at], y[at]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.99 * v2[k] + 0.01 * g * g
                    self.w[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def tables(self) -> dict[tuple[int, int], np.ndarray]:
        """Filter responses of byte pairs, and of single bytes for the last of an odd width."""
        out = {}
        for k in WIDTHS:
            single = np.einsum("be,kef->kbf", self.w["embed"], self.w[f"conv{k}"])
            for j in range(0, k - 1, 2):
                out[k, j] = (single[j][:, None] + single[j + 1][None, :]).reshape(65536, FILTERS).astype(np.float32)
            if k % 2:
                out[k, k - 1] = single[k - 1].astype(np.float32)
        return out


def window_starts(n: int) -> list[int]:
    """Starts of the windows over a text of n bytes; neighbours share the bytes of the widest filter but one."""
    stride = LENGTH - max(WIDTHS) + 1
    return list(range(0, max(1, n - max(WIDTHS) + 1), stride))


class Predictor:
    def __init__(self, net: ByteCNN):
        self.net, self.t = net, net.tables()

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of the windows in the columns of ``x`` (bytes in rows)."""
        w, count = self.net.w, x.shape[1]
        pair = x[:-1].astype(np.int32) << 8 | x[1:]
        h = np.empty((count, len(WIDTHS) * FILTERS), np.float32)
        for i, k in enumerate(WIDTHS):
            n = x.shape[0] - k + 1
            total = None
            for j in range(0, k, 2):
                part = np.take(self.t[k, j], pair[j : j + n] if j + 1 < k else x[j : j + n], axis=0, mode="clip")
                total = part if total is None else np.add(total, part, out=total)
            best = total.reshape(n, count * FILTERS).max(0).reshape(count, FILTERS)
            h[:, i * FILTERS : (i + 1) * FILTERS] = np.maximum(best + w[f"bias{k}"], 0)
        z = h @ w["out"] + w["out_bias"]
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)

    def texts(self, texts: list[bytes], chunk: int = 128) -> np.ndarray:
        """Mean window probabilities of each text, weighted by the bytes in each window."""
        return self.judged(texts, 1.0, chunk)[0]

    def judged(self, texts: list[bytes], sure: float, chunk: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Mean window probabilities of each text, and the share of its windows (both weighted by bytes) with a class at or above ``sure``."""
        buf = np.frombuffer(b"".join(texts) + bytes(LENGTH), np.uint8)
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        starts, ends, of = [], [], []
        for i, t in enumerate(texts):
            s = window_starts(len(t))
            starts += [at[i] + a for a in s]
            ends += [at[i + 1]] * len(s)
            of += [i] * len(s)
        starts, ends, of = np.array(starts, np.int64), np.array(ends, np.int64), np.array(of)
        total = np.zeros((len(texts), len(self.net.classes)))
        weight, certain = np.zeros(len(texts)), np.zeros(len(texts))
        steps = np.arange(LENGTH)[:, None]
        for a in range(0, len(starts), chunk):
            s, e = starts[a : a + chunk], ends[a : a + chunk]
            here = s + steps
            x = np.where(here < e, buf[np.minimum(here, len(buf) - 1)], 0).astype(np.uint8)
            # no window is longer than what its text has; a few bytes are enough for the widest filter
            used = int(max(max(WIDTHS), min(LENGTH, (e - s).max())))
            size = np.minimum(e - s, LENGTH).astype(float) + 1e-9
            p = self.windows(x[:used])
            np.add.at(total, of[a : a + chunk], p * size[:, None])
            np.add.at(weight, of[a : a + chunk], size)
            np.add.at(certain, of[a : a + chunk], size * (p.max(1) >= sure))
        return total / weight[:, None], certain / weight


def _folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def training_sample(docs: DataFrame, per_language: int, text_column: str = "text", label_column: str = "lang", most_labels: int = 1000) -> tuple[list[str], list[bytes]]:
    """(labels, windows' texts) of a bounded sample: about ``per_language`` distinct texts for each label, by a hash of the text.

    However often a text or an id repeats, a text counts once for a label, so the sample's size is
    about ``per_language`` times the number of labels, which must not be above ``most_labels``.
    """
    named = docs.where(F.col(label_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(label_column).cast("string").alias("label"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("key"))
    scale = 1 << 20
    counts = named.select("label", "key").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(most_labels + 1).collect()
    if len(counts) > most_labels:
        raise ValueError(f"there are more than {most_labels} labels to learn")
    shares = {r["label"]: min(scale, -(-per_language * scale // r["n"])) for r in counts}
    if not shares:
        return [], []
    share = F.element_at(F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(v))]), F.col("label"))
    width = 2 * LENGTH
    place = F.lit(1) + F.pmod(F.xxhash64("key", F.lit(1)), F.greatest(F.lit(1).cast("long"), F.length("text").cast("long") - width))
    picked = named.where(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(scale)) < share).select("label", "key", F.substring("text", place.cast("int"), width).alias("text"))
    rows = picked.groupBy("label", "key").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["label"], r["key"]))
    return [r["label"] for r in rows], [_folded(r["text"]) for r in rows]


def train(labels: list[str], texts: list[bytes], seed: int = 3) -> ByteCNN | None:
    """The network for the labelled texts; each gives a full window and one shortened at random, as short texts are."""
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    classes = sorted(set(labels))
    x = np.zeros((2 * len(texts), LENGTH), np.uint8)
    for i, t in enumerate(texts):
        t = t[:LENGTH]
        x[i, : len(t)] = np.frombuffer(t, np.uint8)
        n = min(len(t), int(np.exp(rng.uniform(np.log(3), np.log(LENGTH)))))
        a = rng.integers(0, len(t) - n + 1)
        x[len(texts) + i, :n] = np.frombuffer(t[a : a + n], np.uint8)
    y = np.array([classes.index(k) for k in labels] * 2)
    return ByteCNN(classes).fit(x, y)


def _predictions(predictor: Predictor | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    out = [("und", 0.0)] * len(texts)
    spoken = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if predictor else []
    if spoken:
        for i, row in zip(spoken, predictor.texts([_folded(texts[i]) for i in spoken])):
            k = int(row.argmax())
            out[i] = (predictor.net.classes[k], float(min(1.0, row[k])))
    return out


def _labeller(net: ByteCNN | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(net) if net is not None else None
        for batch in batches:
            for b in text_slices(batch, 2, 2 << 20):
                lang, score = zip(*_predictions(predictor, b.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return trimmed(run)


def fit(docs: DataFrame, per_language: int = 1500, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> ByteCNN | None:
    """Learn from the labelled rows that are not held out (crc32 of the id modulo 4 is not 2)."""
    return train(*training_sample(docs.where(crc_mod(id_column, 4) != 2), per_language, text_column, label_column))


def predict(docs: DataFrame, net: ByteCNN | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text."""
    return docs.select(docs[id_column].cast("long").alias("doc_id"), (crc_mod(id_column, 4) == 2).alias("held_out"), docs[text_column].alias("text")).mapInArrow(_labeller(net), SCHEMA)


def sure_bound(classes: int, margin: float = 0.2) -> float:
    """The probability from which a window's class is sure: chance and a share ``margin`` of the way from there to certainty."""
    return 1 / classes + margin * (1 - 1 / classes)


def keep_known(docs: DataFrame, net: ByteCNN | None, margin: float = 0.2, share: float = 0.5, text_column: str = "text") -> DataFrame:
    """``docs`` without the rows whose text has no letter or no language that the network is sure of; map-only.

    A text stays if windows with at least ``share`` of its bytes have a class that is sure (see
    ``sure_bound``), so a text in several languages stays, whatever the number of labels. Without
    a trained network (no labelled row), or with a single label, only texts without a letter go.
    """
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(net) if net is not None and len(net.classes) > 1 else None
        for batch in batches:
            for b in text_slices(batch, at, 2 << 20):
                texts = b.column(at).to_pylist()
                keep = np.array([bool(t) and _LETTER.search(t) is not None for t in texts], bool)
                if predictor and keep.any():
                    spoken = np.flatnonzero(keep)
                    keep[spoken] = predictor.judged([_folded(texts[i]) for i in spoken], sure_bound(len(net.classes), margin))[1] >= share
                yield b.filter(pa.array(keep))

    return docs.mapInArrow(trimmed(run), docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
