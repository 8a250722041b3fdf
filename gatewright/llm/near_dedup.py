"""Near-duplicate detection with MinHash bands and odd sketches.

Method. A text's set is its distinct word shingles. From its MinHash samples come two
things: bands, equal bands being how candidates meet, and an odd sketch, a bitmap that
holds the parity of the samples hashed into each bit. The XOR of two sketches is the
sketch of the samples in which they differ, so its population count estimates a high
similarity precisely from a few words; it decides which candidates of a band are worth
the exact check, which then compares the words of all shingles of both texts.

Bands and rows are derived from the threshold so that a pair at the threshold is missed
with a probability of at most about 1e-6, and the sketch bound lies five standard
deviations below the threshold.

No bucket is expanded into all its pairs. Texts with equal sets are one class first.
Then, in each bucket, every member meets only the one with the smallest id (a star). Links that
hold are merged into components. A bucket whose members are in one component needs no
more. Sets of the other buckets meet by their rarest shingles (prefix and positional
filters, which are exact; the order comes from exact counts among these sets), members
outside the largest component of a shingle against the members of other components. A
shingle that very many sets share is thus the last to bring sets together. This loses no
link between components of sets that share a band. Components are found
by alternating large and small stars, whose joins and aggregations by key Spark can
split; nothing but a bitmap of at most 32 MB is collected.

Shingles are keyed by sums of word keys (two polynomials modulo a prime, and a second key
from the bytes themselves), classes by a digest of the keys of the whole set. Tables that later steps read several times are written once
to the shared folder, so a lost executor costs tasks and no results.

Defined results: null or wordless texts have an empty set, link with nothing and stay;
texts with fewer words than a shingle are one shingle of all their words; equal rows share
their result and are all returned; rows that repeat an id with other texts are documents of
their own that share a name: each is linked by its own text, and a component is named by
the smallest id in it; null ids stay unlinked; very long texts are whole, alone in memory;
extra columns are ignored by ``op5`` and kept by ``drop_near_copies``, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Numbers, drop_folder, materialize, mix64, table, text_slices, trimmed, word_keys, word_spans

SKETCH_WORDS = 8  # of 64 bits
SKETCH_BITS = 64 * SKETCH_WORDS
#: Bits of the bitmap of ids for each id, and its least and largest size.
FILTER_LOAD, FILTER_LEAST, FILTER_MOST = 16, 1 << 20, 1 << 28


def banding(percent: int, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): six or five rows a band, and enough bands for the miss probability at the threshold."""
    rows = 6 if percent >= 85 else 5
    return ceil(log(miss) / log(1 - (percent / 100) ** rows)), rows


def sketch_bound(percent: int, samples: int) -> int:
    """The largest XOR population count at which a pair may still reach the threshold.

    With a share 1 - J of differing samples, each differing one toggles two bits; five
    standard deviations are added for the number of samples and the bits they fall on.
    """
    j = percent / 100
    differ = samples * (1 - j) + 5 * (samples * j * (1 - j)) ** 0.5
    mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differ))
    return int(mean + 5 * (mean / 2) ** 0.5)


_STEPS = mix64(np.arange(1, 65, dtype=np.uint64))


def _summed(keys: np.ndarray, words: int) -> np.ndarray:
    """Keys of the runs of ``words`` words, from the keys of the words."""
    n = max(0, len(keys) - words + 1)
    full = np.zeros(n, np.uint64)
    for j in range(words):
        full += mix64(keys[j : j + n] + _STEPS[j])
    return mix64(full)


def shingle_sets(texts: list[bytes], words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each lower-case text, the sorted keys of its distinct shingles and a second key of each; empty without words."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, ends = word_spans(buf)
    flat = word_keys(buf, starts, ends)
    keys = [np.ascontiguousarray(flat[:, c]) for c in (0, 1)]
    full = [_summed(k, words) for k in keys]
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= words:
            part, first = np.unique(full[0][a : b - words + 1], return_index=True)
            out.append((part, full[1][a : b - words + 1][first]))
        elif b > a:
            out.append(tuple(mix64(_summed(k[a:b], b - a) + np.uint64(b - a)) for k in keys))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    return out


def set_id(keys: np.ndarray, second: np.ndarray) -> bytes:
    """A digest of a set."""
    return hashlib.blake2b(keys.tobytes() + second.sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(mix64(second), initial=np.uint64(0)).tobytes(), digest_size=16).digest()


def word_pair(left: bytes, right: bytes) -> list[np.ndarray]:
    """The words of two canonical texts as numbers that only equal words share."""
    numbers = Numbers()
    return [numbers.of(t.split(b" ")) if t else np.zeros(0, np.int64) for t in (left, right)]


def linked(left: bytes, right: bytes, words: int, percent: int) -> bool:
    """Whether the shingle sets of two canonical texts reach the similarity, by the words themselves."""
    a, b = word_pair(left, right)
    if min(len(a), len(b)) < words:
        return len(a) == len(b) > 0 and left == right
    both = np.concatenate((a, b))
    width = top = int(both.max()) + 1
    full = both
    for j in range(1, words):
        if width * top >= 1 << 62:  # numbers in order of size take the place of the shingles so far
            _, full = np.unique(full, return_inverse=True)
            width = len(full)
        full = full[:-1] * top + both[j:]
        width *= top
    x, y = np.unique(full[: len(a) - words + 1]), np.unique(full[len(a) :])
    merged = np.concatenate((x, y))
    merged.sort(kind="stable")
    same = int((merged[1:] == merged[:-1]).sum())
    return 100 * same >= percent * (len(merged) - same)


class Sketcher:
    """MinHash samples of a set, its band keys and its odd sketch."""

    def __init__(self, bands: int, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        n = bands * rows
        self.mul = (rng.integers(0, 2**32, n, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
        self.add = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)[:, None]
        self.sample_salt = rng.integers(0, 2**63, n, dtype=np.uint64)
        self.band_salt = rng.integers(0, 2**63, bands, dtype=np.uint64)

    def samples(self, s: np.ndarray, block: int = 2048) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32)
        best = None
        for a in range(0, len(x), block):
            least = (x[None, a : a + block] * self.mul + self.add).min(1)
            best = least if best is None else np.minimum(best, least)
        return best

    def keys(self, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys and odd sketches of the samples of many sets, one set in each row."""
        mixed = mix64(samples.astype(np.uint64) + self.sample_salt[None])
        band = mix64(mixed.reshape(len(mixed), self.bands, self.rows).sum(2, dtype=np.uint64) + self.band_salt[None])
        bit = (mixed >> np.uint64(20)) % np.uint64(SKETCH_BITS)
        sketch = np.zeros((len(mixed), SKETCH_WORDS), np.uint64)
        rows = np.arange(len(mixed))
        for i in range(bit.shape[1]):
            sketch[rows, (bit[:, i] >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit[:, i] & np.uint64(63))
        return band, sketch


_SIGNED = "doc_id long, text_key long, n_shingles long, set_id binary, " + ", ".join(f"s{i} long" for i in range(SKETCH_WORDS)) + ", bands array<long>"


def _texts(column) -> list[bytes]:
    """Lower-case UTF-8 of each text; null is empty."""
    return [x.as_buffer().to_pybytes().lower() if x.is_valid else b"" for x in column]


def _signer(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(bands, rows)
        for b in batches:
            for part in text_slices(b, 2):
                sets = shingle_sets(_texts(part.column(2)), words)
                n = np.array([len(s) for s, _ in sets], np.int64)
                full = np.flatnonzero(n)
                band = np.zeros((len(sets), bands), np.uint64)
                sketch = np.zeros((len(sets), SKETCH_WORDS), np.uint64)
                if len(full):
                    band[full], sketch[full] = sketcher.keys(np.stack([sketcher.samples(sets[i][0]) for i in full]))
                offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[full].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n), pa.array([set_id(*s) for s in sets], pa.binary()), *(pa.array(np.ascontiguousarray(sketch[:, i]).view(np.int64)) for i in range(SKETCH_WORDS)), lists],
                    names=["doc_id", "text_key", "n_shingles", "set_id", *(f"s{i}" for i in range(SKETCH_WORDS)), "bands"],
                )

    return trimmed(run)


def _setter(words: int, bitmap: np.ndarray):
    """(set_id, canonical text) of the rows of (place, text) whose place is set in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column(0).to_numpy()
            wanted = np.flatnonzero(bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            for part in text_slices(b.take(pa.array(wanted))) if len(wanted) else ():
                texts = _texts(part.column(1))
                yield pa.RecordBatch.from_arrays([pa.array([set_id(*s) for s in shingle_sets(texts, words)], pa.binary()), pa.array([b" ".join(t.split()) for t in texts], pa.binary())], names=["set_id", "words"])

    return trimmed(run)


def _spreader(words: int):
    """(id, n, shingle) of the shingles of (id, canonical text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in text_slices(b, 1):
                sets = [s for s, _ in shingle_sets(_texts(part.column(1)), words)]
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), n)), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "n", "shingle"])

    return trimmed(run)


def _confirmer(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [i for i, (x, y) in enumerate(zip(b.column(2), b.column(3))) if linked(x.as_py(), y.as_py(), words, percent)]
            if held:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(held)), b.column(1).take(pa.array(held))], names=["a", "b"])

    return trimmed(run)


def components(spark: SparkSession, links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of all ids in ``links`` (a, b): the smallest id that each reaches.

    Large star and small star in turn, until no link changes; each is one aggregation
    and one join by key.
    """
    edges = materialize(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    step = 0
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours of u are linked to the least of u and its neighbours
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        step += 1
        new = materialize(spark, small, f"{name}-{step}")
        state = new.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        drop_folder(spark, edges)
        edges = new
        if state == seen or state[0] == 0:
            break
        seen = state
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def text_key(column) -> F.Column:
    return F.xxhash64(F.coalesce(column, F.lit("")))


class NearCopies:
    """The steps of one run over ``docs``."""

    def __init__(self, spark: SparkSession, docs: DataFrame, words: int, percent: int, id_column: str = "doc_id", text_column: str = "text"):
        self.spark, self.words, self.percent = spark, words, percent
        self.texts = docs.select(docs[id_column].cast("long").alias("doc_id"), text_key(docs[text_column]).alias("text_key"), docs[text_column].alias("text"))
        bands, rows = banding(percent)
        self.bound = sketch_bound(percent, bands * rows)
        self.signed = materialize(spark, self.texts.mapInArrow(_signer(words, bands, rows), _SIGNED), "signed")

    def _close(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those whose sketches and sizes allow the threshold."""
        left = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), *(F.col(f"s{i}").alias(f"l{i}") for i in range(SKETCH_WORDS)))
        right = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), *(F.col(f"s{i}").alias(f"r{i}") for i in range(SKETCH_WORDS)))
        differ = sum((F.bit_count(F.col(f"l{i}").bitwiseXOR(F.col(f"r{i}"))) for i in range(1, SKETCH_WORDS)), F.bit_count(F.col("l0").bitwiseXOR(F.col("r0"))))
        sizes = 100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")
        return pairs.join(left, "a").join(right, "b").where(sizes & (differ <= self.bound)).select("a", "b")

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """(id, canonical text) of the given classes (id, set_id, least).

        A bitmap of their smallest ids lets most other texts go before their sets are computed
        (its size follows their number up to ``FILTER_MOST`` bits); the join by set is exact.
        """
        bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (FILTER_LOAD * wanted.count()).bit_length()))
        place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
        marks = wanted.select(F.pmod(F.xxhash64("least"), F.lit(bits)).alias("p")).groupBy(F.expr("p div 32768").alias("part")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits")).collect()
        bitmap = np.zeros(bits // 8, np.uint8)
        for r in marks:
            bitmap[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
        found = self.texts.where(F.col("doc_id").isNotNull()).select(place.alias("place"), "text").mapInArrow(_setter(self.words, bitmap), "set_id binary, words binary")
        return found.join(wanted.select("set_id", "id"), "set_id").select("id", "words").dropDuplicates(["id"])

    def _confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those that reach the threshold on the words of their shingles."""
        left, right = sets.select(F.col("id").alias("a"), F.col("words").alias("wa")), sets.select(F.col("id").alias("b"), F.col("words").alias("wb"))
        return pairs.join(right, "b").join(left, "a").select("a", "b", "wa", "wb").mapInArrow(_confirmer(self.words, self.percent), "a long, b long")

    def _crossing(self, play: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs (a, b) of the sets in ``play`` (id, component) of different components that may reach the threshold.

        In any fixed order of all shingles, two sets that reach the threshold share one among the
        first n - ceil(t n) + 1 of each, and as many shingles as both have from the first shared one
        on must be enough for the threshold. The order is by how many sets in play have a shingle.
        Shingles of one set alone come first and bring nothing together; only others are joined.
        Sets whose sizes rule the threshold out are kept apart by classes of size in the join's key.
        """
        spread = materialize(self.spark, sets.join(play.select("id"), "id", "left_semi").select("id", "words").mapInArrow(_spreader(self.words), "id long, n long, shingle long"), "spread")
        counts = spread.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
        order = Window.partitionBy("id").orderBy("times", "shingle")
        # the sets' own shingles are the first n - (those shared) of the order
        ranked = spread.join(counts, "shingle").select("id", "n", F.col("shingle").alias("bucket"), F.row_number().over(order).alias("nth"), F.count(F.lit(1)).over(Window.partitionBy("id")).alias("common"))
        first = F.col("n") - F.ceil(F.col("n") * self.percent / F.lit(100)) + 1
        place = F.col("n") - F.col("common") + F.col("nth") - 1
        kind = F.floor(F.log(F.col("n").cast("double")) / F.lit(log(100 / self.percent) * (1 + 1e-9))).cast("int")
        rows = ranked.select("bucket", "id", "n", place.alias("place"), kind.alias("kind")).where(F.col("place") < first)
        placed = materialize(self.spark, rows.join(play, "id"), "prefixes")
        several = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
        rest = placed.join(several, "bucket", "left_semi")
        largest = rest.groupBy("bucket", "component").count().groupBy("bucket").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
        sided = rest.join(largest, "bucket")
        strays = sided.where("component <> main").select("bucket", "kind", F.col("id").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("place").alias("px"))
        near = F.explode(F.array(F.col("kind") - 1, F.col("kind"), F.col("kind") + 1))
        others = sided.select("bucket", near.alias("kind"), F.col("id").alias("y"), F.col("component").alias("cy"), (F.col("component") == F.col("main")).alias("in_main"), F.col("n").alias("ny"), F.col("place").alias("py"))
        enough = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) * (100 + self.percent) >= self.percent * (F.col("nx") + F.col("ny"))
        met = strays.join(others, ["bucket", "kind"]).where((F.col("cx") != F.col("cy")) & (F.col("in_main") | (F.col("x") < F.col("y"))) & enough)
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def run(self) -> DataFrame:
        """(doc_id, text_key, n_shingles, component_id) of every row."""
        spark = self.spark
        full = self.signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        carried = [F.first("n_shingles").alias("n"), *(F.first(f"s{i}").alias(f"s{i}") for i in range(SKETCH_WORDS)), F.first("bands").alias("bands")]
        # a class is numbered as it is written, so its number stays
        classes = materialize(spark, full.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"), *carried).withColumn("id", F.monotonically_increasing_id()), "classes")
        sketches = classes.select("id", "n", *(f"s{i}" for i in range(SKETCH_WORDS)))
        # the class with the smallest document id of a bucket is its hub: copies usually come after what they are copies of
        buckets = classes.select("id", "least", F.explode("bands").alias("bucket"))
        shared = buckets.groupBy("bucket").agg(F.min("least").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
        members = materialize(spark, buckets.join(shared.select("bucket", "hub"), "bucket"), "members")
        hubs = classes.select(F.col("least").alias("hub"), F.col("id").alias("a"))
        wanted = classes.select("id", "set_id", "least").join(members.select("id").distinct(), "id", "left_semi")
        sets = materialize(spark, self._sets(wanted), "sets")
        spokes = members.where("least <> hub").select("hub", "id").distinct().join(hubs, "hub").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
        stars = materialize(spark, self._close(spokes, sketches), "stars")
        links = materialize(spark, self._confirmed(stars, sets), "links")
        first = components(spark, links, "first")
        named = members.join(first, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
        mixed = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
        play = materialize(spark, named.join(mixed, "bucket", "left_semi").select("id", "component").distinct(), "play")
        late = self._close(self._crossing(play, sets), sketches).join(stars, ["a", "b"], "left_anti")
        more = self._confirmed(materialize(spark, late, "late"), sets)
        joined = more.join(play.withColumnsRenamed({"id": "a", "component": "ca"}), "a").join(play.withColumnsRenamed({"id": "b", "component": "cb"}), "b")
        bridges = materialize(spark, joined.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "bridges")
        final = components(spark, bridges, "final").select(F.col("id").alias("component"), F.col("component").alias("top"))
        topped = first.join(final, "component", "left").select("id", F.coalesce("top", "component").alias("top"))
        lone = final.select(F.col("component").alias("id"), "top").join(first, "id", "left_anti")
        # the smallest number of a component is in no row of its own
        topped = topped.unionByName(lone)
        tops = materialize(spark, topped.unionByName(topped.select(F.col("top").alias("id"), "top").distinct()), "tops")
        linked_classes = classes.select("id", "set_id", "least").join(tops, "id")
        least = linked_classes.groupBy("top").agg(F.min("least").alias("component_id"))
        several = classes.where("rows > 1").join(tops, "id", "left_anti")
        # written, so that the join with all rows has plain exchanges on both sides and hot sets are split
        of_set = linked_classes.join(least, "top").select(F.col("set_id").alias("_set"), "component_id").unionByName(several.select(F.col("set_id").alias("_set"), F.col("least").alias("component_id")))
        of_set = materialize(spark, of_set, "named")
        out = self.signed.select("doc_id", "text_key", "n_shingles", "set_id")
        placed = out.join(of_set, (F.col("set_id") == F.col("_set")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
        return placed.select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_copies(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return NearCopies(spark, docs, words, percent, id_column, text_column).run().drop("text_key")


def drop_near_copies(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; all columns stay.

    A row goes by its id and text, so of rows that share an id only those that are copies go.
    """
    found = NearCopies(spark, docs, words, percent, id_column, text_column).run()
    # written, so that its size is known and texts are shuffled only if the ids are too many to broadcast
    gone = materialize(spark, found.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("text_key").alias("b")).distinct(), "gone")
    return docs.join(gone, (docs[id_column].cast("long") == gone["a"]) & (text_key(docs[text_column]) == gone["b"]), "left_anti")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(spark, table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
