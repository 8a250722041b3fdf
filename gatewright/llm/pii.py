"""Personal data by base patterns and bootstrapped contextual extraction.

Method. The base patterns give seed entities, and long mixed tokens (keys, digests) are seeds
of secrets. Every seed and every other token or run of digit groups of a similar form (a
*candidate*) has lexical contexts: the word before it, the two words before it, the words
around it. Contexts and instances (distinct values) are the two sides of a graph that Spark
scores iteratively: a context is worth the share of its instances that are believed to be of
a kind, damped for small support; a candidate is worth its best context that is confident
enough. Rounds go on until no belief changes. Candidates that end above the confidence bound
become additional spans. Base spans always stay. Secrets are no kind of the base; they are
listed apart, and ``redact`` takes them out, too.

All texts are scanned once, map-only, in time linear in their length. The graph holds contexts
of identifier-like tokens only; it is aggregated map-side before each shuffle and written
once, so a context that very many rows share is a few rows in the exchange, and joins are
equi-joins that Spark splits where keys are hot. Nothing is collected but the state of a round.

Defined results: null text counts as empty (no spans, the digest of an empty list); very long
texts are whole, alone in memory; rows that repeat an id and a text share their result; a null
id stays null; of kinds with the same score the last by name is taken; extra columns are kept
by ``redact`` and ignored by ``op10``, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_folder, materialize, table, text_slices, trimmed, unused

KINDS = ("email", "ip", "card", "phone")
#: Kinds of contexts: those of the base and secrets, with rank 4.
ALL_KINDS = (*KINDS, "secret")
#: What a candidate must look like to be of a kind.
FORM_OF = {"email": "email", "ip": "ip", "card": "number", "phone": "number", "secret": "secret"}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match starts where a run of digits does, as a later digit of the run meets the same dot or none; so time is linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()<>[]{}"
_LOOSE_IP = re.compile(r"[0-9]++(?:\.[0-9]++){2,}\Z")
_LOOSE_NUMBER = re.compile(r"\+?[0-9().-]*\Z")
_LONG_GROUP = re.compile("[0-9]{4}")
#: What may lie between two groups of one number, beside the dots and dashes inside a token.
_GAP = re.compile(r"\)?\x20+(?:-\x20+)?\(?\Z")
#: Seeds of secrets: hexadecimal digits, or letters and digits of all three sorts, in one long token.
_SECRET = re.compile(r"(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])[A-Za-z0-9_/+-]{24,}={0,2})\Z")
_LETTER_AND_DIGIT = re.compile(r"(?=[^0-9]*[0-9])[^A-Za-z]*[A-Za-z]")
#: The least length of a candidate for a secret; it follows a sign that assigns and has a digit or quotes.
LEAST_SECRET = 6
_DIGITS = re.compile("[0-9]+")
#: Digits that make a number, and those of the longest card.
LEAST_DIGITS, MOST_DIGITS = 7, 19


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (2 * d - 9 * (d > 4)) if i % 2 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the base patterns, leftmost and non-overlapping for each kind, ordered."""
    found: list[tuple[int, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str, str | None]]:
    """(start, end, form, kind) of identifier-like tokens and runs of digit groups that no base span touches.

    A run is one number: groups joined by the separators of the base patterns, up to and with a group
    that has ``LEAST_DIGITS`` itself. A run of more than ``MOST_DIGITS`` is no number of a kind; its
    tokens are taken each, if they have no more than that. A kind is given for seeds of secrets.
    """
    out: list[tuple[int, int, str, str | None]] = []
    run: list[tuple[int, int, int]] = []  # start, end and digits of the groups so far

    def close() -> None:
        total = sum(n for _, _, n in run)
        parts = [(run[0][0], run[-1][1], total)] if run and total <= MOST_DIGITS else run
        for start, end, n in parts:
            if LEAST_DIGITS <= n <= MOST_DIGITS:
                inside = text[start:end]
                opened = start > 0 and text[start - 1] == "(" and inside.count(")") > inside.count("(")
                out.append((start - opened, end, "number", None))
        run.clear()

    taken = sorted((s, e) for s, _, e in spans)
    k = 0
    assigns = False  # whether the token before ends with a sign that assigns
    for m in _TOKEN.finditer(text):
        token = m[0]
        assigned, assigns = assigns, token[-1] in "=:"
        left = token.lstrip(_EDGE)
        core = left.rstrip(_EDGE)
        if not core:
            continue
        digits = sum(map(len, _DIGITS.findall(core))) if "@" not in core else 0
        seed = None
        if "@" in core and 3 <= len(core) <= 200:
            form = "email"
        elif digits and _LOOSE_NUMBER.match(core) and (not _LOOSE_IP.match(core) or digits >= LEAST_DIGITS and _LONG_GROUP.search(core)):
            form = "number"
        elif digits >= 3 and _LOOSE_IP.match(core):
            form = "ip"
        elif len(core) >= 24 and digits and _SECRET.match(core) and _LETTER_AND_DIGIT.match(core):
            form, seed = "secret", "secret"
        elif assigned and len(core) >= LEAST_SECRET and (digits or token[0] in "\"'"):
            form = "secret"
        else:
            continue
        start = m.start() + len(token) - len(left)
        end = start + len(core)
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if any(s < end and e > start for s, e in taken[k : k + 8]):
            continue
        if form != "number":
            out.append((start, end, form, seed))
            continue
        if run and (run[-1][2] >= LEAST_DIGITS or core[0] == "+" or not _GAP.match(text[run[-1][1] : start])):
            close()
        run.append((start, end, digits))
    close()
    return sorted(out, key=lambda c: c[:3])


_ANY = re.compile(r"[^\W_]|#")
#: What is longer is no word of a lexical pattern; ``#`` stands for it.
LONGEST_WORD = 256


def _before(text: str, start: int) -> list[str]:
    """The last two words before a place, whole; what touches the place counts, and marks alone are no word."""
    out: list[str] = []
    while start > 0 and len(out) < 2:
        while start > 0 and text[start - 1].isspace():
            start -= 1
        end, least = start, max(0, start - LONGEST_WORD)
        while start > least and not text[start - 1].isspace():
            start -= 1
        if start > 0 and start < end and not text[start - 1].isspace():
            return ["#", *out]
        if word := text[start:end].strip(_EDGE).lower():
            out.insert(0, word)
    return out


def _after(text: str, end: int) -> list[str]:
    """The first word after a place, whole; what touches the place counts, and marks alone are no word."""
    n = len(text)
    while end < n:
        while end < n and text[end].isspace():
            end += 1
        start, most = end, min(n, end + LONGEST_WORD)
        while end < most and not text[end].isspace():
            end += 1
        if end < n and not text[end].isspace():
            return ["#"]
        if word := text[start:end].strip(_EDGE).lower():
            return [word]
    return []


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: the word before, the two before, the words on both sides.

    Signs such as ``=`` mean nothing by themselves, so each pattern has a letter or digit before the span, or ``#``.
    """
    before, after = _before(text, start), _after(text, end)
    out = []
    if before and _ANY.search(before[-1]):
        out.append(f"1 {before[-1]}")
    if len(before) > 1 and _ANY.search(before[0] + before[1]):
        out.append(f"2 {before[0]} {before[1]}")
    if before and after and _ANY.search(before[-1]):
        out.append(f"3 {before[-1]} _ {after[0]}")
    return out


_SCAN = (
    "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "spans array<struct<start:int,rank:int,end:int>>, "
    "occurrences array<struct<start:int,end:int,form:string,kind:string,value:long,contexts:array<string>>>"
)
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
_OCC_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("form", pa.string()), ("kind", pa.string()), ("value", pa.int64()), ("contexts", pa.list_(pa.string()))]))
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[r]}:{s}:{e}" for s, r, e in spans)


def _scan_text(text: str) -> tuple[list[int], str, list[dict], list[dict]]:
    spans = base_spans(text)
    counts = [0, 0, 0, 0]
    occurrences = []
    for s, r, e in spans:
        counts[r] += 1
        occurrences.append({"start": s, "end": e, "form": FORM_OF[KINDS[r]], "kind": KINDS[r], "value": _value(text[s:e]), "contexts": contexts(text, s, e)})
    for s, e, form, seed in candidates(text, spans):
        occurrences.append({"start": s, "end": e, "form": form, "kind": seed, "value": _value(text[s:e]), "contexts": contexts(text, s, e)})
    return counts, hashlib.sha256(listed(spans).encode()).hexdigest(), [{"start": s, "rank": r, "end": e} for s, r, e in spans], [o for o in occurrences if o["contexts"] or o["kind"]]


def _value(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.lower().encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def may_have(column: pa.Array) -> np.ndarray:
    """Whether each text has a digit or an at sign; others have no span and no candidate."""
    out = np.zeros(len(column), bool)
    if not len(column):
        return out
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None:
        return out
    buf = np.frombuffer(data, np.uint8)
    for a in range(0, len(column), 500):
        b = min(a + 500, len(column))
        part = buf[offsets[a] : offsets[b]]
        hits = np.flatnonzero(((part - 48) < 10) | (part == 64)) + offsets[a]
        out[a:b] = np.searchsorted(hits, offsets[a + 1 : b + 1]) > np.searchsorted(hits, offsets[a:b])
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for batch in batches for part in text_slices(batch, 2)):
        texts, n = b.column(2), len(b)
        hot = may_have(texts)
        rows = {int(i): _scan_text(texts[int(i)].as_py() or "") for i in np.flatnonzero(hot)}
        none = ([0, 0, 0, 0], _EMPTY_SHA, [], [])
        picked = [rows.get(i, none) for i in range(n)]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                b.column(1),
                *(pa.array([p[0][k] for p in picked], pa.int64()) for k in range(4)),
                pa.array([p[1] for p in picked], pa.string()),
                pa.array([p[2] for p in picked], _SPAN_TYPE),
                pa.array([p[3] for p in picked], _OCC_TYPE),
            ],
            names=["doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "occurrences"],
        )


def text_key(column: F.Column) -> F.Column:
    return F.xxhash64(F.coalesce(column, F.lit("")))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Base spans, counts and identifier-like occurrences of each row."""
    return docs.select(docs[id_column].cast("long").alias("doc_id"), text_key(docs[text_column]).alias("text_key"), docs[text_column].alias("text")).mapInArrow(trimmed(_scan), _SCAN)


def discover(spark: SparkSession, scanned: DataFrame, min_support: int = 3, pattern_bound: float = 0.8, instance_bound: float = 0.8) -> DataFrame:
    """(doc_id, text_key, start, end, kind) of candidates that confident contexts mark, and of seeds of secrets.

    Scores of a round: pattern = sum of its instances' belief / (instances + 1), counted only with
    ``min_support`` instances; candidate = the best of its patterns at or above ``pattern_bound``.
    Beliefs only grow from round to round; rounds end when none changes in six places.
    """
    forms = F.create_map(*[F.lit(x) for k in ALL_KINDS for x in (k, FORM_OF[k])])
    occurrences = scanned.select("doc_id", "text_key", F.explode("occurrences").alias("o")).select("doc_id", "text_key", "o.*")
    edges = (
        occurrences.select("form", "kind", "value", F.explode("contexts").alias("pattern"))
        .groupBy("form", "pattern", "value")
        .agg(*[F.max(F.when(F.col("kind") == k, 1.0).otherwise(0.0)).alias(k) for k in ALL_KINDS])
    )
    edges = edges.select("pattern", "value", "form", F.explode(F.map_filter(F.create_map(*[x for k in ALL_KINDS for x in (F.lit(k), F.col(k))]), lambda k, _: forms[k] == F.col("form"))).alias("kind", "seed"))
    edges = materialize(spark, edges.groupBy("pattern", "value", "kind").agg(F.max("seed").alias("seed")), "pii-edges")
    belief, scores, state = None, None, None
    while True:
        believed = edges.withColumn("belief", F.col("seed"))
        if belief is not None:
            believed = edges.join(belief, ["value", "kind"], "left").withColumn("belief", F.greatest("seed", F.coalesce("found", F.lit(0.0)))).drop("found")
        summed = believed.groupBy("pattern", "kind").agg(F.sum("belief").alias("sum"), F.count(F.lit(1)).alias("n"))
        new_scores = materialize(spark, summed.where(F.col("n") >= min_support).select("pattern", "kind", F.round(F.col("sum") / (F.col("n") + 1), 6).alias("score")).where(F.col("score") >= pattern_bound), "pii-scores")
        new = materialize(spark, edges.where("seed = 0").join(new_scores, ["pattern", "kind"]).groupBy("value", "kind").agg(F.max("score").alias("found")), "pii-belief")
        seen = new.agg(F.count(F.lit(1)), F.coalesce(F.sum("found"), F.lit(0.0)).cast("decimal(30,3)")).first()
        for old in (belief, scores):
            if old is not None:
                drop_folder(spark, old)
        belief, scores = new, new_scores
        if seen == state or seen[0] == 0:
            break
        state = seen
    chosen = belief.where(F.col("found") >= instance_bound)
    best = chosen.groupBy("value").agg(F.max_by("kind", F.struct("found", "kind")).alias("kind"))
    # a value counts only where one of its contexts is confident
    marked = scores.select("pattern", F.col("kind").alias("by_kind"))
    open_ = occurrences.where(F.col("kind").isNull()).select("doc_id", "text_key", "start", "end", "value", F.explode("contexts").alias("pattern"))
    found = open_.join(best, "value").join(marked, "pattern").where(F.col("kind") == F.col("by_kind")).select("doc_id", "text_key", "start", "end", "kind")
    return found.unionByName(occurrences.where("kind = 'secret'").select("doc_id", "text_key", "start", "end", "kind")).distinct()


def with_discoveries(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """The scanned rows and, for each (doc_id, text_key) that has any, its additional spans."""
    scanned = materialize(spark, scan(docs, id_column, text_column), "pii-scan")
    rank = F.create_map(*[x for r, k in enumerate(ALL_KINDS) for x in (F.lit(k), F.lit(r))])
    more = discover(spark, scanned).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "end"))).alias("more"))
    return scanned, materialize(spark, more, "pii-more")


_LISTED = "array_join(transform({0}, s -> concat(element_at(array('email','ip','card','phone','secret'), s.rank + 1), ':', s.start, ':', s.end)), ',')"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and apart from them the secrets and the number of all spans."""
    scanned, more = with_discoveries(spark, table(spark, sf_dir, "documents"))
    joined = scanned.drop("occurrences").withColumnRenamed("doc_id", "id").join(more, F.col("id").eqNullSafe(more["doc_id"]) & (scanned["text_key"] == more["text_key"]), "left")
    every = F.array_sort(F.concat("spans", F.coalesce("more", F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)"))))
    split = joined.withColumn("all", every).withColumns({"personal": F.expr("filter(all, s -> s.rank < 4)"), "secret": F.expr("filter(all, s -> s.rank = 4)")})
    return split.select(
        F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.expr(_LISTED.format("personal")).alias("spans"),
        F.size("secret").cast("long").alias("n_secret"), F.expr(_LISTED.format("secret")).alias("secrets"), F.size("all").cast("long").alias("n_spans"),
    )


def redact(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = None) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans become one, named by the first.

    ``length_column``, if given and there as an integer, is set to the characters of the new text
    where it is not null. All other columns stay as they are.
    """
    _, more = with_discoveries(spark, docs, id_column, text_column)

    names = docs.columns
    own = {k: unused(k, names) for k in ("pii_id", "pii_key", "pii_more")}
    listed_more = F.expr("array_join(transform(more, s -> concat(s.start, ':', s.rank, ':', s.end)), ',')")
    more = more.select(F.col("doc_id").alias(own["pii_id"]), F.col("text_key").alias(own["pii_key"]), listed_more.alias(own["pii_more"]))
    joined = docs.join(more, docs[id_column].cast("long").eqNullSafe(F.col(own["pii_id"])) & (text_key(docs[text_column]) == F.col(own["pii_key"])), "left")
    at = names.index(text_column)
    length = names.index(length_column) if length_column in names and docs.schema[length_column].dataType.typeName() in ("integer", "long", "short") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in text_slices(batch, at)):
            columns = b.columns[:-1]
            texts = [redacted(t, a) for t, a in zip(columns[at].to_pylist(), b.columns[-1].to_pylist())]
            columns[at] = pa.array(texts, columns[at].type)
            if length is not None:
                columns[length] = pa.array([None if n is None else len(t or "") for t, n in zip(texts, columns[length].to_pylist())], columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*(docs[c] for c in names), own["pii_more"]).mapInArrow(trimmed(run), docs.schema)


_HINT = re.compile("[0-9@]")


def redacted(text: str | None, added: str | None) -> str | None:
    if text is None or not _HINT.search(text):
        return text
    spans = base_spans(text)
    if added:
        spans = sorted(spans + [tuple(map(int, a.split(":"))) for a in added.split(",")])
    out, at = [], 0
    for s, r, e in spans:
        if s >= at:
            out.append(text[at:s])
            out.append(f"[{ALL_KINDS[r].upper()}]")
            at = e
        else:
            at = max(at, e)
    out.append(text[at:])
    return "".join(out)
