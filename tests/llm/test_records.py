"""Archives, media, preferences and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gatewright.llm import lang_id, media, packing, pii, preferences, warc
from gatewright.llm.common import new_folder
from gatewright.llm.registry import ORACLES, QUERIES

# --- archives --------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>é" + "x" * 200
    rows = [(3, "http://a/ b\nc", long), (1, "http://a/1", long), (2, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "y" * 99), (8, "u", "y" * 99), (9, "u", "y" * 100), (10, "u", "y" * 100), (11, "u", long + "z" * 50000), (9, "u", "y" * 100), (None, "n", long), (12, "ü" * 9, "漢" * 40), (13, "u", "漢" * 40)]
    return spark.createDataFrame(rows, PAGES)


def brute(rows):
    first: dict = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    out, used = [], set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        p = (h or "").encode()
        keep = first.get(p)
        original = keep is None or (keep == i and p not in used)
        if keep == i:
            used.add(p)
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if original else "revisit", None if original else keep))
    return Counter(out)


@pytest.mark.parametrize("roll", [1 << 20, 300])
def test_round_trip(spark, pages, roll):
    folder = new_folder(spark, "warc")
    manifest = warc.write_archives(spark, pages.withColumn("keep", F.lit(1)), folder, roll=roll)
    found = warc.read_archives(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, found)) == brute([tuple(r) for r in pages.collect()])
    fs, path = warc.file_system(folder)
    for r in manifest.collect():
        data = fs.open_input_stream(f"{path}/{r.name}", compression=None).read()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r.bytes, r.sha256)
        text = gzip.decompress(data)  # a standard reader takes the members as one stream
        assert text.count(b"WARC/1.1\r\n") == r.records + 1
    assert not fs.get_file_info(f"{path}/_temporary").is_file


def test_same_input_same_bytes(spark, pages):
    runs = []
    for shuffled in (pages.where("page_id is not null"), pages.where("page_id is not null").repartition(3)):
        folder = new_folder(spark, "warc")
        runs.append(sorted((r.records, r.bytes, r.sha256) for r in warc.write_archives(spark, shuffled, folder).collect()))
    assert runs[0] == runs[1]


def test_shards_follow_the_data(spark):
    """Exact ranges by bytes, also where ids are dense, far apart, repeated or null; the same files however pages are dealt."""
    ids = [*range(100), *range(10**15, 10**15 + 50), *[77] * 400, *[None] * 300, -(2**63), 2**63 - 1]
    rows = [(i, f"u{k}", f"{k} " + "x" * 900) for k, i in enumerate(ids)]
    pages = spark.createDataFrame(rows, PAGES)
    runs = []
    for dealt in (pages, pages.repartition(7), pages.orderBy(F.desc("url"))):
        folder = new_folder(spark, "warc")
        manifest = warc.write_archives(spark, dealt, folder, shard_bytes=20_000)
        runs.append(sorted((r.name, r.records, r.bytes, r.sha256) for r in manifest.collect()))
    assert runs[0] == runs[1] == runs[2]
    shards = Counter()
    for name, records, *_ in runs[0]:
        shards[name.split("-")[1]] += records
    assert sum(shards.values()) == len(ids) and 50 < len(shards) and max(shards.values()) < 60
    found = warc.read_archives(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, found)) == brute(rows)


def test_no_pages(spark, pages):
    folder = new_folder(spark, "warc")
    manifest = warc.write_archives(spark, pages.limit(0), folder)
    assert manifest.count() == 0 and warc.read_archives(spark, folder, manifest).count() == 0


def test_broken_archive():
    member = warc.gzip_member(warc.build_record(1, "u", b"x" * 10, "d", None))
    assert len(list(warc.records_of(io.BytesIO(member)))) == 1
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records_of(io.BytesIO(member[:-20])))
    with pytest.raises(ValueError):
        warc.parse_record(b"HTTP/1.1 200\r\n\r\n")


# --- media -----------------------------------------------------------------------------------


def test_media_round_trip():
    rng = random.Random(2)
    payloads = [media.padded(b""), media.padded(b"\xff" * 5000), media.padded(b"\x00\xff" * 3000)] + [media.padded(bytes(rng.choices(range(256), k=rng.randrange(1, 7000)))) for _ in range(20)]
    files = media.write_files(payloads)
    assert [p for p, _, _ in media.read_files(files)] == payloads
    assert media.write_files(payloads[:3]) == files[:3]


def test_files_without_index_or_with_other_codes():
    payload = media.padded(bytes(range(256)) * 20)
    data = media.write_files([payload])[0]
    bare = data.replace(b"idx1", b"JUNK")
    assert media.read_files([bare])[0][0] == payload
    at = data.index(b"movi")
    info = media.parse_avi(data)
    assert info["rate"] == media.RATE and info["size"] == (64, 32) and len(info["frames"]) == 3 and at > 0
    with pytest.raises(ValueError):
        media.parse_avi(b"RIFF" + struct.pack("<I", 4) + b"WAVE")
    with pytest.raises(ValueError):
        media.parse_avi(data[:-5])
    with pytest.raises(ValueError):
        media.parse_jpeg(b"\xff\xd8" + media._segment(0xC0, bytes(9)) + b"\xff\xd9", 0, 15)


def test_decoding_table_takes_any_code():
    """A table with codes of one to eight bits, coded by hand."""
    lengths = {0: 1, 3: 2, 5: 3, 8: 4, 1: 8}
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    table = media.decoding_table(bytes(counts) + bytes([0, 3, 5, 8, 1]))
    codes = media.canonical_codes(lengths)
    values = [5, -4, 0, 100, -200, 1, 7, -7]
    bits, want, total = "", [], 128
    for v in values:
        category = abs(v).bit_length()
        category = next(c for c in sorted(lengths) if c >= category) if category not in lengths else category
        if category != abs(v).bit_length():
            continue
        code, n = codes[category]
        bits += f"{code:0{n}b}" + (f"{v if v > 0 else v + (1 << category) - 1:0{category}b}" if category else "")
        total += v
        want.append(total & 255)
    bits += "1" * (-len(bits) % 8)
    data = np.frombuffer(int(bits, 2).to_bytes(len(bits) // 8, "big") + bytes(8), np.uint8)
    assert media.decode_lines(data, np.array([0]), table, len(want)).tolist() == [want]


def test_shots():
    frames = np.zeros((30, 4, 64), np.uint8)
    frames[10:20] = 200
    frames[20:] = 90
    assert media.shots(frames) == [(0, 10), (10, 20), (20, 30)]
    assert media.shots(frames[:1]) == [(0, 1)]


def test_op4(spark, odd_docs, no_docs, write):
    rows = media.op4_media(spark, write(documents=odd_docs)).collect()
    want = Counter()
    for r in odd_docs.collect():
        b = (r.text or "").encode()
        p = media.padded(b)
        want[r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert media.op4_media(spark, write(documents=no_docs)).count() == 0
    files = media.store(odd_docs)
    clips = media.clips(files).collect()
    assert {c.doc_id for c in clips} == {r.doc_id for r in rows} and all(c.end_frame > c.first_frame and c.end_s > c.start_s for c in clips)


# --- preferences -----------------------------------------------------------------------------

TURNS = "pair_id long, turn long, role string, text string"


def test_prefix_and_masks(spark):
    chosen = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (2, 0, "user", "same"), (3, 0, "user", None), (3, None, "assistant", "late"), (None, 0, "user", "x"), (4, 0, "assistant", "alone")], TURNS)
    rejected = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, None, "?"), (2, 0, "user", "same"), (3, 0, "user", "")], TURNS)
    out = {(r.pair_id, r.chunk): r for r in preferences.format_preferences(chosen.withColumn("c", F.lit(9)), rejected.withColumn("c", F.lit(9))).collect()}
    r = out[1, 0]
    assert r.prompt == "<|user|>\nhi<|end|>\n" and r.chosen == "<|assistant|>\nyes<|end|>\n" and r.rejected == "<|assistant|>\nno<|end|>\n<||>\n?<|end|>\n"
    a, b = map(int, r.chosen_mask.split(":"))
    assert r.chosen[a:b] == "yes<|end|>" and r.rejected_mask == "14:23"
    assert (out[2, 0].chosen, out[2, 0].rejected, out[2, 0].prompt_turns) == ("", "", 1)
    assert out[3, 0].prompt == "<|user|>\n<|end|>\n" and out[4, 0].prompt == ""
    assert sum(r.chosen_turns for (p, _), r in out.items() if p == 3) == 1 and None not in {p for p, _ in out}


def test_long_conversations_are_spread(spark):
    turns = spark.range(1000).select(F.lit(1).alias("pair_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    out = preferences.format_preferences(turns, turns.where("turn < 990")).orderBy("chunk").collect()
    assert len(out) == 16 and sum(r.prompt_turns for r in out) == 990 and sum(r.chosen_turns for r in out) == 10
    assert "".join(r.prompt for r in out) == "".join(f"<|user|>\nt{i}<|end|>\n" for i in range(990))


def test_no_turns(spark):
    none = spark.createDataFrame([], TURNS)
    assert preferences.format_preferences(none, none).count() == 0


def brute_preferences(chosen, rejected, chunk_turns=64):
    """Rows of format_preferences by loops, from lists of (pair, turn, role, text)."""
    last = preferences.LAST
    sides = []
    for rows in (chosen, rejected):
        side: dict = {}
        for p, t, role, text in rows:
            if p is not None:
                side.setdefault(p, set()).add((last if t is None else t, role or "", text or ""))
        sides.append(side)
    out = []
    for p in {*sides[0], *sides[1]}:
        a, b = (s.get(p, set()) for s in sides)
        split = min((t for t, *_ in a ^ b), default=None)
        for c in {t // chunk_turns for t, *_ in a | b}:
            part = lambda s, late: sorted(x for x in s if x[0] // chunk_turns == c and (split is not None and x[0] >= split) == late)  # noqa: B023, E731
            row = [p, c]
            for turns in (part(a, False), part(a, True), part(b, True)):
                body, mask = "", []
                for _, role, text in turns:
                    piece = f"<|{role}|>\n{text}<|end|>\n"
                    if role == "assistant":
                        mask.append(f"{len(body) + len(role) + 5}:{len(body) + len(piece) - 1}")
                    body += piece
                row += [body, ",".join(mask), len(turns)]
            prompt, _, kp, y, ym, ky, n, nm, kn = row[2:]
            out.append((p, c, prompt, y, ym, n, nm, kp, ky, kn))
    return Counter(out)


def test_preferences_equal_brute_force(spark):
    rng = random.Random(9)
    make = lambda: [(rng.choice([1, 2, 3, 4, None]), rng.choice([0, 1, 2, 3, 64, 70, 200, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é!", "", None, "b" * 50])) for _ in range(60)]
    for _ in range(2):
        chosen = make()
        rejected = [r for r in chosen if rng.random() < 0.9] + make()[:6]
        frames = [spark.createDataFrame(x, TURNS).withColumns({n: F.lit(3) for n in ("chunk", "split", "c", "r", "t", "mine", "h1")}) for x in (chosen, rejected)]
        assert Counter(map(tuple, preferences.format_preferences(*frames).collect())) == brute_preferences(chosen, rejected)


def test_preferences_stay_in_the_jvm(spark, sf):
    plan = preferences.op3_preferences(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


# --- SQL and the pipeline --------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    from pathlib import Path

    import duckdb
    from test_entry import rows

    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    found, want = QUERIES[name](spark, sf).toPandas(), c.sql(ORACLES[name]).df()
    assert sorted(found) == sorted(want) and rows(found) == rows(want)


def brute_pipeline(docs, network, more):
    """The rows that each stage keeps, by loops: (id, text) lists after stages 1 to 4."""
    from test_dedup import brute_near
    from test_text import brute_spans

    kept = []
    for r in docs:
        t = r.text
        if t and any(ch.isalpha() for ch in t):
            windows = [lang_id._folded(t)[a : a + lang_id.LENGTH] for a in lang_id.window_starts(len(lang_id._folded(t)))]
            sizes = [len(w) + 1e-9 for w in windows]
            best = [network._forward(np.frombuffer(w.ljust(lang_id.LENGTH, b"\0"), np.uint8)[None])[1][0].max() for w in windows]
            if np.average([p >= lang_id.sure_bound(len(network.classes)) for p in best], weights=sizes) >= 0.5:
                kept.append((r.doc_id, t))
    groups: dict = {}
    for i, t in kept:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append((i is None, i or 0, i, t))
    two = [min(g)[2:] for g in groups.values()]
    named = brute_near({(i, t) for i, t in two if i is not None}, 5, 80)
    three = [(i, t) for i, t in two if i is None or named[i][1] == i]
    four = []
    for i, t in three:
        spans, out, at = sorted(brute_spans(t) + more.get(i, [])), "", 0
        for s, k, e in spans:
            if s >= at:
                out += t[at:s] + f"[{pii.ALL_KINDS[k].upper()}]"
            at = max(at, e)
        four.append((i, out + t[at:]))
    return kept, two, three, four


def test_stages(spark, odd_docs, no_docs):
    """Every stage against loops over the rows; columns of documents throughout, also with clashing names."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "pii", "packing"]
    clash = ("extra", "id", "_gone", "digest", "_digest", "kept", "row", "a", "b", "_set", "text_key", "more", "_pii_more", "pii_key", "words", "component_id", "label", "key")
    docs = odd_docs.withColumns({n: F.lit(1) for n in clash})
    docs = docs.unionByName(docs.where("doc_id = 9").withColumn("text", F.lit("Another text of the same name, which stays.")))
    want = brute_pipeline(docs.collect(), lang_id.fit(docs), {})
    at = docs
    for (name, f), rows in zip(corpus_pipeline.STAGES, want):
        at = f(spark, at, "").cache()
        assert at.columns == docs.columns, name
        assert Counter((r.doc_id, r.text) for r in at.collect()) == Counter(rows), name
    assert {r.doc_id for r in at.collect()} >= {1, 9, 12, 14} and all(r.n_chars == len(r.text) for r in at.collect())
    five = corpus_pipeline.STAGES[4][1](spark, at, "").collect()
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.default_tokenizer())
    lib.no_padding()
    lib.no_truncation()
    tokens = Counter((r.doc_id, len(lib.encode(r.text, add_special_tokens=False).ids) + 1) for r in at.collect())
    assert Counter((r.doc_id, r.doc_tokens) for r in five if r.start == 0) == tokens and sum(r.length for r in five) == sum(n * k for (_, n), k in tokens.items())
    empty = no_docs
    for name, f in corpus_pipeline.STAGES:
        empty = f(spark, empty, "")
        assert empty.count() == 0, name


def test_run(spark, odd_docs, write):
    rows = corpus_pipeline.run(spark, write(documents=odd_docs)).collect()
    assert rows and sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


def test_large_fixture_is_kept_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = lang_id.keep_known(docs, lang_id.fit(docs))
    clean = docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert kept.count() >= clean - 1
    assert packing.pack(kept, packing.default_tokenizer()).where("start = 0").count() == kept.count()
