"""Language, personal data, tokens, packing and scores against brute force and libraries."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import prose, thue_morse
from gatewright.llm import bpe, lang_id, lm_score, packing, pii

P = pytest.importorskip("public_tokenizers")


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.no_padding()
    t.no_truncation()
    return t


# --- language --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tongues(spark):
    rng = np.random.default_rng(1)
    parts = {"xx": ["ka", "to", "mi", "ra"], "yy": ["schl", "ung", "ver", "eit"], "zz": ["é", "oux", "que", "lle"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k], rng.integers(1, 4))) for _ in range(rng.integers(2, 120))), k) for i, k in enumerate(rng.choice(list(parts), 500))]
    return spark.createDataFrame([(int(i), t, str(k)) for i, t, k in rows], "doc_id long, text string, lang string")


def test_language_accuracy(tongues):
    net = lang_id.fit(tongues, 150)
    rows = tongues.join(lang_id.predict(tongues, net).withColumnRenamed("doc_id", "i"), F.col("doc_id") == F.col("i")).collect()
    held = [r for r in rows if r.held_out]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows} == {True}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_tables_are_the_convolution():
    rng = np.random.default_rng(0)
    net = lang_id.ByteCNN(["a", "b"])
    x = rng.integers(1, 256, (20, lang_id.LENGTH)).astype(np.uint8)
    assert np.allclose(net._forward(x)[1], lang_id.Predictor(net).windows(np.ascontiguousarray(x.T)), atol=1e-4)


def test_gradients():
    rng = np.random.default_rng(0)
    net = lang_id.ByteCNN(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = rng.integers(1, 256, (5, 12)), rng.integers(0, 3, 5)
    loss = lambda: -np.log(net._forward(x)[1][np.arange(5), y]).mean()
    g = net._gradients(x, y)
    for k in ("conv3", "bias2", "out", "embed"):
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        before = net.w[k][at]
        net.w[k][at] = before + 1e-5
        up = loss()
        net.w[k][at] = before - 1e-5
        down = loss()
        net.w[k][at] = before
        assert (up - down) / 2e-5 == pytest.approx(g[k][at], rel=1e-3)


def test_language_odd(odd_docs, no_docs, clashing):
    net = lang_id.fit(odd_docs, 50)
    rows = lang_id.predict(odd_docs, net).collect()
    assert len(rows) == odd_docs.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (5, 6, 7, 8))
    assert {r.lang_pred for r in rows} <= {"und", "en", "fr"}
    assert lang_id.fit(no_docs) is None and lang_id.predict(no_docs, None).count() == 0
    assert {r.lang_pred for r in lang_id.predict(odd_docs, None).collect()} == {"und"}
    kept = lang_id.keep_known(clashing, net)
    assert kept.columns == clashing.columns and {5, 6, 7, 8}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.where("doc_id = 1").count() == 1
    assert lang_id.keep_known(odd_docs, None).where("doc_id = 1").count() == 1


def test_every_label_teaches(spark):
    """Labels beyond the two hundred most frequent are in the sample, and about ``per_language`` texts of each."""
    rows = [(1000 * k + i, f"text {k} {i}", f"l{k:03}") for k in range(230) for i in range(12 if k < 200 else 3)] + [(500_000 + i, f"much {i}", "big") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels, texts = lang_id.training_sample(docs, 100)
    counts = Counter(labels)
    assert set(counts) == {f"l{k:03}" for k in range(230)} | {"big"} and all(counts[f"l{k:03}"] == (12 if k < 200 else 3) for k in range(230))
    assert 60 <= counts["big"] <= 140 and len(labels) == len(texts)
    with pytest.raises(ValueError, match="more than 200 labels"):
        lang_id.training_sample(docs, 100, most_labels=200)


def test_repeats_do_not_swell_the_sample(spark):
    """One id, or none, on all rows, and one text on most of them: the sample stays near its size."""
    rows = [(None if i % 2 else 5, f"text {i}" if i % 3 else "the same", "en") for i in range(6000)]
    labels, texts = lang_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 200)
    assert 130 <= len(labels) <= 270 and texts.count(b"the same") <= 1


def test_sure_windows_decide(tongues):
    """Texts of an unlabelled language mostly go; clean ones, and those in three languages, stay; with two labels chance is not enough."""
    net = lang_id.fit(tongues, 150)
    parts = {"xx": ["ka", "to", "mi", "ra"], "yy": ["schl", "ung", "ver", "eit"], "zz": ["é", "oux", "que", "lle"]}
    rng = np.random.default_rng(8)
    text = lambda k, n=300: " ".join("".join(rng.choice(parts[k], 3)) for _ in range(n))
    mixed = [" ".join(text(k) for k in parts) for _ in range(10)]
    predictor = lang_id.Predictor(net)
    share = lambda texts: predictor.judged([lang_id._folded(t) for t in texts], lang_id.sure_bound(3))[1]
    assert (share(mixed) > 0.9).all() and (share([text(k) for k in parts for _ in range(5)]) > 0.9).all()
    assert lang_id.sure_bound(2) == pytest.approx(0.6) and lang_id.sure_bound(200) < 0.21
    # windows are judged as a loop over them does
    long = lang_id._folded(mixed[0])
    ps, sizes = [], []
    for a in lang_id.window_starts(len(long)):
        w = np.frombuffer(long[a : a + lang_id.LENGTH].ljust(lang_id.LENGTH, b"\0"), np.uint8)
        ps.append(net._forward(w[None])[1][0])
        sizes.append(min(lang_id.LENGTH, len(long) - a))
    mean, sure = predictor.judged([long], 0.5)
    assert np.allclose(mean[0], np.average(ps, 0, sizes), atol=1e-4) and sure[0] == pytest.approx(np.average([p.max() >= 0.5 for p in ps], weights=sizes), abs=1e-6)


# --- personal data ---------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (12 <= len(d) <= 19 and pii.luhn(d)) or k == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), pii.KINDS.index(k), m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aB.@-+%_ ()0123459é\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii_odd(spark, odd_docs, no_docs, write):
    rows = pii.op10_pii(spark, write(documents=odd_docs)).collect()
    texts = defaultdict(list)
    for r in odd_docs.collect():
        texts[r.doc_id].append(r.text or "")
    assert len(rows) == odd_docs.count()
    for r in rows:
        lists = [pii.listed(brute_spans(t)) for t in texts[r.doc_id]]
        assert r.base_sha256 in {hashlib.sha256(x.encode()).hexdigest() for x in lists} and r.spans in lists
    row = next(r for r in rows if r.doc_id == 14)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    assert pii.op10_pii(spark, write(documents=no_docs)).count() == 0


def test_contexts_discover(spark):
    rows = [(i, f"please dial extension +1 555 010 {1000 + i} today") for i in range(20)] + [(100, "please dial extension 555-0199-22 today"), (101, "serial 555-0199-33 is stamped"), (102, "nothing")]
    scanned, more = pii.with_discoveries(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: r.more for r in more.collect()}
    assert set(found) == {100} and (found[100][0].start, found[100][0].end) == (22, 33)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("dial 555 010 1234 now", ["555 010 1234"]), ("dial 030 123 4567.", ["030 123 4567"]), ("dial (212) 555-0134, please", ["(212) 555-0134"]), ("dial (212)555-0134", ["(212)555-0134"]), ("card 4111 1111 1111 1112 x", ["4111 1111 1111 1112"]),
        ("dial 555.010.1234 now", ["555.010.1234"]), ("dial 555 - 010 - 1234", ["555 - 010 - 1234"]), ("dial 555-0199-22 5 times", ["555-0199-22"]), ("in 2019. 555 0199", ["555 0199"]), ("10 of 20 and 30, 4000 5", []), ("1 2 3 4", []), ("from 10.0.999.1 5", ["10.0.999.1"]),
        ("rows 1234567 12345678 1234567", ["1234567", "12345678", "1234567"]), ("555 010\n1234", []), ("1111 " * 6, []), ("pay 4111 1111 1111 1111 now", []),
    ],
)
def test_candidates_of_groups(text, found):
    assert [text[s:e] for s, e, *_ in pii.candidates(text, pii.base_spans(text))] == found


def test_contexts_discover_groups(spark):
    forms = ["555 010 1234", "030 123 4567", "(212) 555-0134", "4111 1111 1111 1112"]
    rows = [(i, f"please dial extension +1 555 010 {1000 + i} today") for i in range(40)] + [(100 + i, f"please dial extension {f} today") for i, f in enumerate(forms)] + [(200, "serial 555 010 9999 is stamped")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in pii.redact(spark, docs).collect()}
    assert all(texts[100 + i] == "please dial extension [PHONE] today" for i in range(len(forms))) and texts[200] == rows[-1][1]


@pytest.mark.parametrize("text", ["1" * 10_000_000, "1." * 100_000, "1-" * 3_000_000 + "x", "+1" + "(" * 5_000_000, "a@" * 2_000_000, "x" * 5_000_000 + " 1.2.3.4 " + "y" * 5_000_000, "+" * 5_000_000, "a1" * 3_000_000])
def test_long_texts_take_linear_time(text):
    import time

    began = time.perf_counter()
    pii._scan_text(text)
    assert time.perf_counter() - began < 20


def test_contexts_have_whole_words():
    long, other = "k" * 200, "k" * 199 + "z"
    of = lambda w: pii.contexts(f"the {w} 1.2.3.4 {w} x", len(w) + 5, len(w) + 12)
    assert of("short") == ["1 short", "2 the short", "3 short _ short"] and of(long) != of(other) and of(long) == of(long)
    assert of("k" * 257) == of("k" * 300) == ["1 #", "3 # _ #"]
    assert pii.contexts("1.2.3.4", 0, 7) == [] and pii.contexts("  a 1.2.3.4", 4, 11) == ["1 a"]


def brute_discoveries(occurrences, support=3, bound=0.8):
    """Places that confident contexts mark, by loops over all instances; an occurrence is (place, form, kind, value, contexts)."""
    instances = defaultdict(dict)
    for _, form, kind, value, patterns in occurrences:
        for p in patterns:
            for k in pii.ALL_KINDS:
                if pii.FORM_OF[k] == form:
                    instances[p, k][value] = max(instances[p, k].get(value, 0), kind == k)
    belief: dict = {}
    while True:
        good = {}
        for (p, k), values in instances.items():
            score = round(sum(max(seed, belief.get((v, k), 0)) for v, seed in values.items()) / (len(values) + 1), 6)
            if len(values) >= support and score >= bound:
                good[p, k] = score
        new: dict = {}
        for (p, k), score in good.items():
            for v, seed in instances[p, k].items():
                if not seed:
                    new[v, k] = max(score, new.get((v, k), 0))
        if new == belief:
            break
        belief = new
    best = {}
    for (v, k), score in belief.items():
        if score >= bound:
            best[v] = max(best.get(v, (0, "")), (score, k))
    return {(place, best[v][1]) for place, _, kind, v, patterns in occurrences if kind is None and v in best and any((p, best[v][1]) in good for p in patterns)}


def test_discoveries_equal_brute_force(spark):
    """Chains of contexts that need several rounds, shared values, kinds that compete for a form."""
    rng = np.random.default_rng(6)
    rows, listed = [], []
    for i in range(700):
        stage = int(rng.integers(0, 6))
        seeded = rng.random() < (0.97, 0.4, 0.1, 0.0, 0.9, 0.5)[stage]
        form = ("number", "ip", "email")[int(rng.integers(0, 3))]
        kind = {"number": ("card", "phone")[stage % 2], "ip": "ip", "email": "email"}[form] if seeded else None
        value = int(rng.integers(0, 60)) + 100 * stage * int(rng.random() < 0.8)
        patterns = [f"1 w{stage}", f"2 v{stage} w{int(rng.integers(0, 3))}"] + ([f"1 w{stage - 1}"] if stage and rng.random() < 0.5 else [])
        rows.append((i, i, [(i, i + 5, form, kind, value, patterns)]))
        listed.append((i, form, kind, value, patterns))
    schema = "doc_id long, text_key long, occurrences array<struct<start:int,end:int,form:string,kind:string,value:long,contexts:array<string>>>"
    found = {(r.doc_id, r.kind) for r in pii.discover(spark, spark.createDataFrame(rows, schema)).collect()}
    want = brute_discoveries(listed)
    assert found == want and len(want) > 20


def test_secrets(spark, write):
    """Long keys are seeds; where they usually stand, a short password is found, too, and nothing elsewhere."""
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'so token = "{key(i)}" stays') for i in range(20)] + [(50, 'so token = "hunter2-x" stays'), (51, "version = 1.2.3-rc4 of 12 things"), (52, "wordswithoutdigitsbutverylongandstill" * 2), (53, "Note: 24 words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.op10_pii(spark, write(documents=docs)).collect()}
    assert {i for i, r in found.items() if r.n_secret} == {*range(20), 50} and all(r.spans == "" for r in found.values())
    assert found[3].secrets == "secret:12:52" and found[50].secrets == "secret:12:21" and found[50].n_spans == 1
    texts = {r.doc_id: r.text for r in pii.redact(spark, docs).collect()}
    assert texts[50] == texts[3] == 'so token = "[SECRET]" stays' and all(texts[i] == t for i, t in rows if i > 50)


def test_redaction_sets_lengths(spark, odd_docs):
    out = pii.redact(spark, odd_docs, length_column="n_chars").where("doc_id = 14").first()
    assert out.n_chars == len(out.text)
    assert pii.redact(spark, odd_docs).where("doc_id = 14").first().n_chars != len(out.text)
    named = odd_docs.withColumn("n_chars", F.lit("many")).withColumn("_pii_more", F.lit(1)).withColumn("PII_key", F.lit(2)).withColumn("more", F.lit(3))
    assert pii.redact(spark, named, length_column="n_chars").where("doc_id = 14").select("n_chars", "_pii_more", "PII_key", "more").first() == ("many", 1, 2, 3)


def test_redaction(spark, clashing, no_docs):
    out = pii.redact(spark, clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    assert out.where("doc_id = 14").first().text == "mail me at [EMAIL] or [PHONE] from [IP] pay [CARD] now"
    assert out.where("doc_id = 1").first().text == clashing.where("doc_id = 1").first().text and out.where("doc_id = 5").first().text is None
    assert pii.redact(spark, no_docs).count() == 0


# --- tokens ----------------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte_level"), ("word_bpe_49k.json", "word_end")])
def test_encoder_equals_library(name, kind, odd_docs):
    texts = [r.text or "" for r in odd_docs.collect()] + ["a  b", "a   b", "\n\n x", " lead", "trail ", "aaa aaaa aaaaa", "don't we'll", "　wide   ", "Σίσυφος", "x<|endoftext|>y <|startoftext|>", "\x00\x00!\x00"]
    encoder, lib = bpe.TextEncoder(P.path(name), bpe.BYTE_LEVEL if kind == "byte_level" else bpe.WORD_END, kind == "word_end", 2000, library(name) if kind == "word_end" else None), library(name)
    for part in (texts, texts[::-1]):
        flat, at = encoder.encode([t.encode() for t in part])
        for i, t in enumerate(part):
            assert flat[at[i] : at[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t[:80])


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte_level"), ("word_bpe_49k.json", "word_end")])
def test_encoder_tells_bytes_apart(name, kind):
    encoder, lib = bpe.text_encoder(P.path(name), kind), library(name)
    texts = [*thue_morse(1024), *thue_morse(4096), "x " + " ".join(thue_morse(2048))]
    flat, at = encoder.encode([t.encode() for t in texts])
    assert [flat[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_merges_sort_nothing(monkeypatch):
    """A merge round marks the pairs that it touched, in linear time; words of one repeated letter have all touches side by side."""
    encoder, lib = bpe.TextEncoder(P.path("word_bpe_49k.json"), bpe.WORD_END, True), library("word_bpe_49k.json")
    monkeypatch.setattr(bpe.np, "unique", None)
    words = ["a" * n for n in range(1, 40)] + ["abab" * n for n in range(1, 9)] + prose(5, 200).split()
    coded = [w.encode() for w in words]
    last = np.cumsum([len(w) for w in coded])
    ids, offsets = encoder.merger.encode(np.frombuffer(b"".join(coded), np.uint8), np.concatenate(([0], last[:-1])), last)
    for i, w in enumerate(words):
        if w.isalpha():
            assert ids[offsets[i] : offsets[i + 1]].tolist() == lib.encode(w, add_special_tokens=False).ids


def test_encoder_forgets(odd_docs):
    """With next to no memory results are the same, and the memory stays small."""
    texts = [(r.text or "").encode() for r in odd_docs.collect()]
    small, large = (bpe.TextEncoder(P.path("byte_bpe_50k.json"), bpe.BYTE_LEVEL, False, k) for k in (100, 64 << 20))
    for t in texts * 2:
        assert small.encode([t])[0].tolist() == large.encode([t])[0].tolist()
    small.encode([b"a"])
    small.encode([b"b"])
    assert len(small.numbers) <= 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t'sé.,1 \x1cX<|>", max_size=30), max_size=6))
def test_byte_level_property(texts):
    encoder, lib = bpe.text_encoder(P.path("byte_bpe_50k.json"), "byte_level"), library("byte_bpe_50k.json")
    flat, at = encoder.encode([t.encode() for t in texts])
    for i, t in enumerate(texts):
        ids = flat[at[i] : at[i + 1]].tolist()
        assert ids == lib.encode(t, add_special_tokens=False).ids
        assert bpe.decode(ids, encoder.merger) == lib.decode(ids, skip_special_tokens=False)


def test_decode_of_broken_bytes():
    encoder, lib = bpe.text_encoder(P.path("byte_bpe_50k.json"), "byte_level"), library("byte_bpe_50k.json")
    ids = lib.encode("漢字", add_special_tokens=False).ids
    assert bpe.decode(ids[:1], encoder.merger) == lib.decode(ids[:1], skip_special_tokens=False)


def test_op9(spark, odd_docs, no_docs, write):
    lib = library("byte_bpe_50k.json")
    rows = bpe.op9_bpe(spark, write(documents=odd_docs)).collect()
    want = Counter()
    for r in odd_docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == want
    assert bpe.op9_bpe(spark, write(documents=no_docs)).count() == 0


# --- packing ---------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4095), max_size=60))
def test_windows(sizes):
    windows = packing.balanced_windows(sizes)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in w) <= 4096 for w in windows)


def test_differencing_balances():
    rng = np.random.default_rng(0)
    sizes = rng.integers(100, 1024, 400).tolist()
    sums = [sum(sizes[i] for i in w) for w in packing.kk_partition(sizes, 50)]
    assert len(sums) == 50 and max(sums) - min(sums) < 0.03 * max(sums)


def test_pack(spark, odd_docs, no_docs, clashing):
    lib = library("word_bpe_49k.json")
    unique = clashing.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack(unique, packing.default_tokenizer(), group_windows=4).collect()
    ids = {r.doc_id: np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in unique.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids[i])
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) <= 4096
    assert packing.pack(no_docs, packing.default_tokenizer()).count() == 0
    assert packing.pack(odd_docs, packing.default_tokenizer()).where("doc_id is null").count() == 2


# --- scores ----------------------------------------------------------------------------------


def test_scores(spark, odd_docs, no_docs, write):
    rows = lm_score.op8_lm_score(spark, write(documents=odd_docs)).collect()
    counts: Counter = Counter()
    tokens = []
    for r in odd_docs.collect():
        w = [*(r.text or "").encode().lower().split(), None]
        held = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 == 2
        tokens.append((r.doc_id, held, w))
        if not held:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, h, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 4)) for i, h, w in tokens), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows), key=repr) == want
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in rows)
    assert lm_score.op8_lm_score(spark, write(documents=no_docs)).count() == 0


def test_tokens_are_told_apart(spark):
    """Of two words that a polynomial hash confuses, only the one in the training texts is known."""
    x, y = thue_morse(2048)
    docs = spark.createDataFrame([(1, x), (2, y), (3, f"{x} {y}")], "doc_id long, text string")
    model = lm_score.Model(spark, docs.where("doc_id = 1"))
    assert {r.doc_id: (r.n_tokens, r.n_known) for r in model.score(spark, docs, F.lit(False)).collect()} == {1: (2, 2), 2: (2, 1), 3: (3, 2)}


def test_rare_tokens_meet_their_counts(spark, odd_docs):
    """With few hot tokens, most counts come from the join; results are the same."""
    held = lm_score.crc_mod("doc_id", 7) == 2
    runs = [sorted(((r.doc_id, r.n_known, round(r.base_score, 6)) for r in lm_score.Model(spark, odd_docs.where(~held), hot_tokens=k).score(spark, odd_docs, held).collect()), key=repr) for k in (3, 1 << 19)]
    assert runs[0] == runs[1]


def scalar_bits(mixer, text, end=1):
    """Bits of a canonical text (and its end), decision by decision in plain Python, with the mixture refined at the end of each block."""
    buf, starts, lengths = lm_score.joined([text])
    cells = lm_score.context_cells(buf, mixer.slots)
    odds = mixer.tables.reshape(-1, 16).astype(int)
    w = {(h, o, k): float(mixer.weights[h, o, k]) for h in (0, 1) for o in range(3) for k in range(4)}
    total = 0.0
    length = int(lengths[0]) - 1 + end
    for a, size in lm_score.blocks(length):
        slope = Counter()
        for i in range(a, min(a + size, length)):
            byte = int(buf[starts[0] + i])
            for h, half in ((0, byte >> 4), (1, byte & 15)):
                for k in range(4):
                    bit = half >> (3 - k) & 1
                    st = [int(odds[int(cells[o][h][starts[0] + i]) >> 4, 1 << k | half >> (4 - k)]) * (1 if bit else -1) / 16 for o in range(3)]
                    z = max(-lm_score.BOUND, min(lm_score.BOUND, sum(w[h, o, k] * st[o] for o in range(3))))
                    p = 1 / (1 + math.exp(-z))
                    total -= math.log2(p)
                    for o in range(3):
                        slope[h, o, k] += (1 - p) * st[o]
        for key, g in slope.items():
            w[key] += mixer.rate * g
    return total


@pytest.fixture(scope="module")
def mixer():
    """Predictors of some words, with weights that are not all the same."""
    c = lm_score.Counter((1 << 10, 1 << 12, 1 << 12))
    c.add([b"abracadabra abra cadabra, the rain in spain stays mainly in the plain"] * 3 + [b"a man a plan a canal"])
    m = lm_score.Mixer(lm_score.log_odds(c.cells), c.slots, np.random.default_rng(4).uniform(0.1, 0.9, (2, 3, 4)), 0.01)
    m.tables = lm_score.log_odds(c.cells)
    return m


def test_score_equals_the_scalar_loop(mixer):
    """Also with strong refinement, where weights reach far and the bound holds on both sides."""
    texts = [b"", b"a", b"abracadabra", b"the rain in spain " * 30, bytes(range(33, 127)) * 2, b"aaaa" * 400]
    texts = [lm_score.canonical(t) for t in texts]
    for rate in (0.01, 0.5):
        mixer.rate = rate
        assert np.allclose(mixer.bits(texts), [scalar_bits(mixer, t) for t in texts], rtol=2e-3, atol=1e-3)
    mixer.rate = 0.01


def test_score_is_a_probability(mixer):
    """After any text, also one that has driven the weights far, the next bytes' probabilities add up to one."""
    for rate, before in ((0.01, b""), (0.01, b"abra"), (5.0, b"abracadabra, " * 9)):
        mixer.rate = rate
        shorter = scalar_bits(mixer, before, 0)
        assert sum(2.0 ** (shorter - scalar_bits(mixer, before + bytes([x]), 0)) for x in range(256)) == pytest.approx(1, abs=1e-6)
    mixer.rate = 0.01


def test_least_loss():
    """The learnt weights are where the slope of the loss vanishes."""
    rng = np.random.default_rng(5)
    odds = rng.normal(0.6, 1, (4000, 3)).astype(np.float32)
    w = lm_score.least_loss(odds, np.zeros(3), 20)
    assert np.allclose(odds.T @ (1 / (1 + np.exp(odds @ w))) / len(odds), 0, atol=1e-4) and (w > 0).all()


def test_learnt_mixture_beats_the_base(spark):
    """On held-out texts of the test tables: fewer bits than with the weights that are set, and than the base."""
    from pathlib import Path

    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("the test tables are not here")
    docs = spark.read.parquet(str(path))
    held = lm_score.crc_mod("doc_id", 7) == 2
    model = lm_score.Model(spark, docs.where(~held))
    assert model.weights is not None and model.rate in lm_score.RATES
    score = lambda: model.score(spark, docs.where(held), F.lit(True)).agg(F.sum("score"), F.sum("base_score")).first()
    learnt, base = score()
    model.weights, model.rate = None, lm_score.RATE
    assert learnt > score()[0]
    print(learnt, base)


def test_scores_do_not_depend_on_neighbours():
    c = lm_score.Counter()
    texts = [b"one two three " * k for k in (1, 50, 7, 400)]
    c.add(texts)
    mixer = lm_score.Mixer(lm_score.log_odds(c.cells))
    texts = [lm_score.canonical(t) for t in texts]
    together = mixer.bits(texts)
    assert np.allclose(together, [mixer.bits([t])[0] for t in texts], rtol=1e-5)


def test_context_tables_grow_with_the_corpus(spark, monkeypatch):
    """Twice the training text, twice the slots, without an end; with them the score of what was learnt stays sharp."""
    assert lm_score.slots_of(0) == lm_score.slots_of(lm_score.SLOT_BYTES << 19) == lm_score.SLOTS
    assert [sum(lm_score.slots_of(lm_score.SLOT_BYTES << k)) // sum(lm_score.SLOTS) for k in (20, 21, 25, 30)] == [2, 4, 64, 2048]
    monkeypatch.setattr(lm_score, "SLOTS", (1 << 11, 1 << 10, 1 << 10))
    rng = np.random.default_rng(2)
    rows = [(i, " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(200))) for i in range(5)]
    rows = [(8 * i + k, t) for i, t in rows for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bits = []
    for each in (1 << 30, 1):
        monkeypatch.setattr(lm_score, "SLOT_BYTES", each)
        model = lm_score.Model(spark, docs)
        assert len(model.tables.value) == 16 * sum(model.slots) and sum(model.slots) == 4096 * (1 if each > 1 else 32)
        bits.append(sum(r.bits_per_byte for r in model.score(spark, docs, F.lit(False)).collect()) / 40)
    assert bits[1] < 0.8 * bits[0]
    c = lm_score.Counter(model.slots)
    c.add([t.encode() for _, t in rows])
    assert np.array_equal(model.tables.value, lm_score.log_odds(c.cells))


def test_runs_count_as_the_array_does(monkeypatch):
    """Tables beyond the bound take no array in a worker; what its sorted runs hand over adds up to the same counts."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 2000).astype(np.uint8)) for _ in range(30)]
    slots = (1 << 12, 1 << 14, 1 << 14)
    dense = lm_score.Counter(slots)
    dense.add(texts)
    monkeypatch.setattr(lm_score, "DENSE_CELLS", 1 << 10)
    monkeypatch.setattr(lm_score, "RUN_CELLS", 1 << 12)
    runs, total, handed = lm_score.Counter(slots), np.zeros(sum(slots) * 16, np.int64), 0

    def hand_over():
        for block, data in runs.blocks():
            at, n = lm_score.unpacked(data)
            np.add.at(total, block * lm_score.BLOCK + at, n)

    for t in texts:
        runs.add([t])
        if runs.full():
            hand_over()
            handed += 1
        assert len(runs.cells) == 0 and sum(len(x) for x, _ in runs.runs) + sum(map(len, runs.waiting)) <= 8 * (1 << 12) + 20_000
    hand_over()
    assert np.array_equal(total, dense.cells) and handed > 0 and not runs.runs and not runs.waiting


def test_tables_are_mapped_files(spark, odd_docs, tmp_path):
    """Neither the driver nor a worker holds a table: tasks get names of files, which they map side by side."""
    import pickle

    model = lm_score.Model(spark, odd_docs)
    tables = model.tables
    assert len(pickle.dumps(tables)) < 10_000 and len(tables.names) >= 1
    c = lm_score.Counter(model.slots)
    c.add([(r.text or "").encode() for r in odd_docs.collect()])
    assert np.array_equal(tables.value, lm_score.log_odds(c.cells))
    with pytest.raises(ValueError, match="read-only"):
        tables.mapped("odds")[0] = 1


def test_levels_are_of_counts_without_the_occurrence():
    rng = np.random.default_rng(7)
    cells = rng.integers(0, 4, 64 * 16)
    found = lm_score.deleted_levels(cells).reshape(-1, 16)
    for slot, v in np.argwhere(cells.reshape(-1, 16)):
        left = cells.reshape(-1, 16)[slot].copy()
        left[v] -= 1
        for k in range(4):
            side = lambda bit: left[[x for x in range(16) if x >> (4 - k) == v >> (4 - k) and x >> (3 - k) & 1 == bit]].sum()  # noqa: B023, E731
            mine, other = side(v >> (3 - k) & 1), side(1 - (v >> (3 - k) & 1))
            odds = math.log((mine + lm_score.PRIOR) / (other + lm_score.PRIOR))
            level = lm_score.LEVELS[found[slot, v] >> 4 * k & 15]
            assert abs(level) == pytest.approx(min(round(math.sqrt(6 * abs(odds))), 7) ** 2 / 6) and level * odds >= 0


def test_every_training_text_teaches_weights(spark, odd_docs, monkeypatch):
    """All decisions of all training texts are behind the weights, long texts and repeated ones whole; their counts are all in the tables."""
    seen = []
    learn = lm_score.learnt_weights
    monkeypatch.setattr(lm_score, "learnt_weights", lambda counts: seen.append(counts) or learn(counts))
    lm_score.Model(spark, odd_docs.repartition(4))
    size = sum(len(lm_score.canonical((r.text or "").encode())) + 1 for r in odd_docs.collect())
    assert [int(x.sum()) for x in seen[0]] == [size] * 8
    buf = np.zeros((8, 4096), np.int64)
    buf[:, 0x770] = buf[:, 0x990] = 5  # two predictors that are always sure, and as often wrong as right
    assert np.allclose(learn(buf)[:, 0] + learn(buf)[:, 1], 0, atol=0.05)


def test_texts_of_like_length_are_scored_together(spark, monkeypatch):
    """Lock step takes as many blocks as the longest text has, so texts are sorted by length first; ids stay with their texts."""
    docs = spark.createDataFrame([(i, "ab " * (1 if i % 2 else 400) + str(i)) for i in range(40)], "doc_id long, text string").coalesce(1)
    model = lm_score.Model(spark, docs)
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in docs.collect()]) for k in (0, 1)], names=["doc_id", "text"])
    rows, seen, bits = batch.add_column(1, "held_out", pa.array([False] * 40)), [], lm_score.Mixer.bits
    monkeypatch.setattr(lm_score, "PASS", 2000)
    monkeypatch.setattr(lm_score.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 1})())
    monkeypatch.setattr(lm_score.Mixer, "bits", lambda self, texts: seen.append([len(t) for t in texts]) or bits(self, texts))
    out = pa.Table.from_batches(lm_score._scorer(model.tables, model.hot, model.slots, model.weights, model.rate)(iter([rows])))
    assert len(seen) > 1 and sum(seen, []) == sorted(sum(seen, []))
    assert len(set(out["row"].to_pylist())) == 40 and all(n == (3 if i % 2 else 1200) + len(str(i)) for i, n in zip(out["doc_id"].to_pylist(), out["n_bytes"].to_pylist()))
    alone = lm_score.Mixer(model.tables.value, model.slots, model.weights)
    texts = {r.doc_id: lm_score.canonical(r.text.encode()) for r in docs.collect()}
    assert np.allclose(out["bits"].to_numpy(), [bits(alone, [texts[i]])[0] for i in out["doc_id"].to_pylist()], rtol=1e-5)


@pytest.mark.parametrize("slots", [(1 << 10, 1 << 12, 1 << 12), (1 << 26, 1 << 28, 1 << 28)])
def test_halves_of_a_byte_lie_side_by_side(slots):
    """The low half's slot is one of the sixteen around its context's, another for each high half; contexts are whole, also over long words."""
    text = bytes(range(33, 256)) + b" x" + b"y" * 40_000 + b" x" + b"y" * 40_000 + b"z " + b"x" + b"y" * 40_000
    buf, starts, lengths = lm_score.joined([text])
    cells = lm_score.context_cells(buf, slots)
    firsts = np.cumsum([0, *slots])
    for (high, low), a, b in zip(cells, firsts, firsts[1:]):
        assert (high % 16 == buf >> 4).all() and (low % 16 == buf & 15).all()
        assert (high // 256 == low // 256).all() and (high // 16 ^ low // 16 == buf >> 4 ^ 1).all() and a <= high.min() // 16 and high.max() // 16 < b
    ends = [m.end() + starts[0] for m in re.finditer(b"y{40000}", text)]
    word = cells[2][0] // 16
    assert word[ends[0]] == word[ends[1]] == word[ends[2]] != word[ends[0] - 1]


def test_canonical_texts_keys_and_counts():
    rng = np.random.default_rng(11)
    for _ in range(50):
        t = bytes(rng.choice(np.frombuffer(b" \t\n\v\f\r  aBZ[@z\x80\xc3\x00\x1c\x1f", np.uint8), 300))
        assert lm_score.canonical(t) == b" ".join(t.lower().split())
    words = sorted({bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in rng.integers(1, 40, 3000)} | {b"a\0", b"\0a", b"a", b"\0"})
    starts, keys = lm_score.token_keys(np.frombuffer(b"\n" + b" ".join(words + words) + b"\n", np.uint8))
    assert starts[0] == 1 and len(keys) == 2 * len(words) and len(set(keys.tolist())) == len(words) and (keys[: len(words)] == keys[len(words) :]).all()
    for kind in (np.int32, np.int64):
        n = np.array([1, 255, 256, 1 << 20, np.iinfo(kind).max], kind)
        at, counts = lm_score.unpacked(lm_score.packed(np.arange(5) * 7, n))
        assert (at == np.arange(5) * 7).all() and (counts == n).all()


@pytest.mark.parametrize("kind, most", [(np.uint32, 9), (np.uint32, 1 << 40), (np.uint64, 9)])
def test_merged_runs(kind, most):
    """Runs merge to the same counts whether or not a cell and its count have room in one integer."""
    rng = np.random.default_rng(12)
    runs = [(np.unique(rng.integers(0, 500, 200)) + (1 << 31)).astype(kind) for _ in range(5)]
    runs = [(x, rng.integers(1, most, len(x)).astype(np.int32 if most < 10 and i else np.int64)) for i, x in enumerate(runs)]
    counter, want = lm_score.Counter((1 << 26, 1 << 26, 1 << 26)), Counter()
    for x, n in runs:
        want.update(dict(zip(x.tolist(), n.tolist())))
    counter.runs = runs
    counter._merge()
    assert [len(x) for x, _ in counter.runs] == [len(want)] and dict(zip(*(c.tolist() for c in counter.runs[0]))) == want
