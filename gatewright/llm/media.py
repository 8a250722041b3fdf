"""Motion-JPEG in AVI: writing, parsing, decoding of intra frames, and shots.

Method. A RIFF parser walks the chunks of an AVI file and takes the frames from its index
(``idx1``), or from the ``movi`` list where there is none. Every frame is a JPEG picture of
its own. Frames here are lossless JPEG (process SOF3, one 8-bit component, predictor 1,
Huffman-coded differences), so stored samples come back bit for bit. One line of samples is
one restart interval, hence all lines of all frames of many files are decoded in lock step,
one sample of each line at a time, in numpy; the Huffman table of the file is used, whatever
it is. Shots are cut where the histogram difference of neighbouring frames exceeds a bound
that adapts to the differences before (mean and deviation of a sliding window); each shot is
a clip with its times.

Defined results: a null text is empty and is stored as one zero line; equal payloads give
equal files; files with wrong lengths or without frames raise ``ValueError``; repeated rows
and ids are each returned, and nothing is chosen among them, so there are no ties; a very long
text is whole, one file alone in memory; extra columns are ignored, whatever their names; an
empty table gives no row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import passes
from .common import table, text_slices, trimmed

WIDTH = 64
LINES = 32
RATE = 25
#: Lengths of the codes of the categories 0 to 8 of differences (canonical, no code of ones only).
CODE_LENGTHS = (4, 4, 3, 3, 3, 3, 3, 3, 4)


# --- Huffman codes ---------------------------------------------------------------------------


def canonical_codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), in the order of length and then of appearance, as JPEG assigns them."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda kv: kv[1]):
        code <<= n - last if last else 0
        out[symbol], last = (code, n), n
        code += 1
    return out


_CODES = canonical_codes(dict(enumerate(CODE_LENGTHS)))


def _symbol_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference -255..255 (at index 255 + difference)."""
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, n = _CODES[category]
        extra = d if d >= 0 else d + (1 << category) - 1
        bits[255 + d], size[255 + d] = code << category | extra, n + category
    return bits, size


_BITS, _SIZE = _symbol_tables()


def decoding_table(dht: bytes) -> np.ndarray:
    """For the next 16 bits, category << 8 | code length, of a DHT segment's table (without class byte)."""
    counts, symbols = dht[:16], dht[16:]
    table_ = np.zeros(65536, np.int32)
    code, k = 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            a = code << (16 - n)
            table_[a : a + (1 << (16 - n))] = symbols[k] << 8 | n
            code += 1
            k += 1
        code <<= 1
    return table_


# --- coding of lines -------------------------------------------------------------------------


def encode_lines(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of the lines (rows of ``samples``), stuffed, and each line's offset in them."""
    n, width = samples.shape
    diff = np.diff(samples.astype(np.int16), axis=1, prepend=np.int16(128)) + 255
    bits, size = _BITS[diff], _SIZE[diff]
    ends = np.cumsum(size, 1)
    lengths = (ends[:, -1] + 7) // 8
    room = int(lengths.max()) + 3 if n else 3
    out = np.zeros((n, room), np.uint8)
    flat, row = out.ravel(), np.arange(n, dtype=np.int64) * room
    for k in range(width):
        start = ends[:, k] - size[:, k]
        at = row + (start >> 3)
        word = bits[:, k] << (24 - (start & 7) - size[:, k])
        flat[at] |= (word >> 16).astype(np.uint8)
        flat[at + 1] |= (word >> 8 & 255).astype(np.uint8)
        flat[at + 2] |= (word & 255).astype(np.uint8)
    pad = lengths * 8 - ends[:, -1]  # the last byte is filled with ones
    flat[row + lengths - 1] |= ((1 << pad) - 1).astype(np.uint8)
    used = np.arange(room) < lengths[:, None]
    data = out[used]
    line = np.repeat(np.arange(n), lengths)
    stuffed = data == 255
    place = np.arange(len(data)) + np.cumsum(stuffed) - stuffed
    result = np.zeros(len(data) + int(stuffed.sum()), np.uint8)
    result[place] = data
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(lengths + np.bincount(line[stuffed], minlength=n), out=offsets[1:])
    return result, offsets


def decode_lines(data: np.ndarray, starts: np.ndarray, codes: np.ndarray, width: int) -> np.ndarray:
    """Samples of the lines whose unstuffed bits start at the byte offsets ``starts``; 8 spare bytes follow the data."""
    d = data.astype(np.uint32)
    words = d[:-3] << np.uint32(24) | d[1:-2] << np.uint32(16) | d[2:-1] << np.uint32(8) | d[3:]
    at = starts.astype(np.int64) << 3
    out = np.empty((width, len(starts)), np.int32)
    for k in range(width):
        here = words[np.minimum(at >> 3, len(words) - 1)] << (at & 7).astype(np.uint32)
        entry = codes[here >> np.uint32(16)]
        length, category = entry & 255, entry >> 8
        rest = (here << length.astype(np.uint32)) >> np.uint32(1)  # one bit less, so that a shift by 31 takes all of none
        extra = (rest >> (31 - category).astype(np.uint32)).astype(np.int32)
        out[k] = extra - np.where(extra < (1 << category >> 1), (1 << category) - 1, 0)
        at += length + category
    out[0] += 128
    return (np.cumsum(out, 0, dtype=np.int32) & 255).astype(np.uint8).T


# --- JPEG and RIFF ---------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_head(width: int, height: int) -> bytes:
    lengths = sorted(CODE_LENGTHS)
    symbols = [s for s, _ in sorted(enumerate(CODE_LENGTHS), key=lambda kv: kv[1])]
    dht = bytes([0, *(lengths.count(n) for n in range(1, 17)), *symbols])
    return (
        b"\xff\xd8" + _segment(0xC3, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)) + _segment(0xC4, dht) + _segment(0xDD, struct.pack(">H", width)) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
    )


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def build_avi(frames: list[bytes], width: int, height: int, payload: int) -> bytes:
    """An AVI 1.0 file of MJPG frames with an index; the payload's length is in the INFO list."""
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, RATE, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        c = chunk(b"00dc", f)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    info = b"INFO" + chunk(b"ICMT", b"payload=%d\0" % payload)
    body = b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", info) + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def riff_chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks between two offsets."""
    while at + 8 <= end:
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + n > end:
            raise ValueError("a RIFF chunk is longer than its file")
        yield name, at + 8, at + 8 + n
        at += 8 + n + (n & 1)


def parse_avi(data: bytes) -> dict:
    """Frame spans by the index, the frame rate, picture size and the stored payload length."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out = {"frames": [], "rate": 0.0, "size": (0, 0), "payload": None}
    movi, index, plain = None, None, []
    for name, a, e in riff_chunks(data, 12, len(data)):
        kind = data[a : a + 4] if name == b"LIST" else b""
        if kind == b"hdrl":
            for inner, b, _ in riff_chunks(data, a + 4, e):
                if inner == b"avih":
                    micro = struct.unpack_from("<I", data, b)[0]
                    out["rate"], out["size"] = 1_000_000 / micro if micro else 0.0, struct.unpack_from("<II", data, b + 32)
        elif kind == b"INFO":
            for inner, b, f in riff_chunks(data, a + 4, e):
                if inner == b"ICMT" and data[b:f].startswith(b"payload="):
                    out["payload"] = int(data[b + 8 : f].rstrip(b"\0"))
        elif kind == b"movi":
            movi = a
            plain = [(b, f) for inner, b, f in riff_chunks(data, a + 4, e) if inner[2:] in (b"dc", b"db")]
        elif name == b"idx1":
            index = [struct.unpack_from("<III", data, b + 4) for b in range(a, e - 15, 16) if data[b + 2 : b + 4] in (b"dc", b"db")]
    if movi is None:
        raise ValueError("the file has no frames")
    if index:
        # offsets count from the list's type, in some files from the start of the file
        base = movi if data[movi + index[0][1] : movi + index[0][1] + 4][2:] in (b"dc", b"db") else 0
        out["frames"] = [(base + at + 8, base + at + 8 + n) for _, at, n in index]
    else:
        out["frames"] = plain
    return out


def parse_jpeg(data: bytes, a: int, e: int) -> dict:
    """Size, restart interval, Huffman table and span of the scan of a lossless one-component picture."""
    if data[a : a + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG picture")
    out: dict = {"restart": 0}
    at = a + 2
    while at < e:
        marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xC3:
            bits, out["height"], out["width"], components = struct.unpack_from(">BHHB", body)
            if bits != 8 or components != 1:
                raise ValueError("only one component of 8 bits is decoded")
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError(f"JPEG process {marker - 0xC0} is not lossless")
        elif marker == 0xC4:
            out["dht"] = body[1:]
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if body[3] != 1:
                raise ValueError("only predictor 1 is decoded")
            break
    out["scan"] = (at, e - 2 if data[e - 2 : e] == b"\xff\xd9" else e)
    if out["restart"] != out.get("width"):
        raise ValueError("lines must be restart intervals")
    return out


def write_files(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload, whose length is a positive multiple of the line width."""
    flat = np.frombuffer(b"".join(_framed(p) for p in payloads), np.uint8).reshape(-1, WIDTH)
    coded, offsets = encode_lines(flat)
    raw = coded.tobytes()
    markers = [bytes([0xFF, 0xD0 + i % 8]) for i in range(LINES)]
    files, line = [], 0
    for p in payloads:
        height = min(LINES, len(p) // WIDTH)
        head = jpeg_head(WIDTH, height)
        frames = []
        for _ in range(len(_framed(p)) // (WIDTH * height)):
            parts = [head]
            for i in range(height):
                parts.append(raw[offsets[line] : offsets[line + 1]])
                parts.append(markers[i] if i + 1 < height else b"\xff\xd9")
                line += 1
            frames.append(b"".join(parts))
        files.append(build_avi(frames, WIDTH, height, len(p)))
    return files


def _framed(payload: bytes) -> bytes:
    """The payload, with zero lines up to full frames if it is longer than one."""
    full = WIDTH * LINES
    return payload if len(payload) <= full else payload + bytes(-len(payload) % full)


def read_files(files: list[bytes]) -> list[tuple[bytes, dict, np.ndarray]]:
    """(payload, what the file says, frames as an array frame, line, sample) of each file."""
    groups: dict[tuple, list[tuple[int, int]]] = {}  # by table and width: lines' spans
    infos, placed, parts, total = [], [], [], 0
    for data in files:
        info = parse_avi(data)
        lines = []
        for a, e in info["frames"]:
            j = parse_jpeg(data, a, e)
            b, f = j["scan"]
            parts.append(data[b:f] + b"\xff\xd9")
            lines.append((j["dht"], j["width"], j["height"], total, total + f - b + 2))
            total += f - b + 2
        infos.append(info)
        placed.append(lines)
    buf = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    marks = np.flatnonzero((buf[:-1] == 255) & (buf[1:] != 0))  # RSTn and the end
    keep = np.ones(len(buf), bool)
    keep[1:][(buf[:-1] == 255) & (buf[1:] == 0)] = False  # stuffed zeros
    keep[marks] = keep[marks + 1] = False
    plain = np.concatenate((buf[keep], np.zeros(8, np.uint8)))
    moved = np.concatenate(([0], np.cumsum(keep)))
    for lines in placed:
        for dht, width, height, a, e in lines:
            groups.setdefault((dht, width), []).append((a, height))
    decoded: dict[int, np.ndarray] = {}
    for (dht, width), spans in groups.items():
        first = np.array([a for a, _ in spans])
        heights = np.array([h for _, h in spans])
        at = np.searchsorted(marks, first)
        # the lines of a frame start at its scan and after each of its markers but the last
        line_frame = np.repeat(np.arange(len(spans)), heights)
        nth = np.arange(len(line_frame)) - np.repeat(np.cumsum(heights) - heights, heights)
        starts = np.where(nth == 0, first[line_frame], marks[at[line_frame] + np.maximum(nth, 1) - 1] + 2)
        samples = decode_lines(plain, moved[starts], decoding_table(dht), width)
        ends = np.cumsum(heights)
        for (a, h), e in zip(spans, ends.tolist()):
            decoded[a] = samples[e - h : e]
    out = []
    for info, lines in zip(infos, placed):
        frames = np.stack([decoded[a] for _, _, _, a, _ in lines])
        payload = frames.tobytes()
        out.append((payload if info["payload"] is None else payload[: info["payload"]], info, frames))
    return out


# --- shots -----------------------------------------------------------------------------------


def shots(frames: np.ndarray, window: int = 8, deviations: float = 2.5, least: float = 0.1) -> list[tuple[int, int]]:
    """(first frame, end) of the shots: cuts where the histogram difference exceeds mean + deviations of the window before."""
    n = len(frames)
    pixels = frames.reshape(n, -1)
    hist = np.bincount((np.repeat(np.arange(n), pixels.shape[1]) << 5 | pixels.ravel() >> 3), minlength=32 * n).reshape(n, 32) / pixels.shape[1]
    change = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    cuts = []
    for i in range(len(change)):
        before = change[max(0, i - window) : i]
        bound = least if len(before) < 2 else max(least, before.mean() + deviations * before.std())
        if change[i] > bound:
            cuts.append(i + 1)
    edges = [0, *cuts, n]
    return list(zip(edges[:-1], edges[1:]))


CLIPS = "doc_id long, clip long, first_frame long, end_frame long, start_s double, end_s double, mean double"


def clip_rows(doc_id: int | None, info: dict, frames: np.ndarray) -> list[tuple]:
    rate = info["rate"] or RATE
    return [(doc_id, k, a, e, a / rate, e / rate, float(frames[a:e].mean())) for k, (a, e) in enumerate(shots(frames))]


def clips(files: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """Timed clip rows of AVI files in a binary column; null media give no clip. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, m) for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if m is not None]
            for part in passes(rows, lambda r: len(r[1])):
                out = [row for (i, _), (_, info, frames) in zip(part, read_files([m for _, m in part])) for row in clip_rows(i, info, frames)]
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), *(pa.array(x, pa.float64()) for x in c[4:])], names=[f.split()[0] for f in CLIPS.split(", ")])

    return files.select(files[id_column].cast("long").alias("doc_id"), files[media_column].alias("media")).mapInArrow(run, CLIPS)


def padded(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64) if text else bytes(64)


def store(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, media): each text's payload as an AVI file. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in text_slices(b):
                part = list(zip(rows.column(0).to_pylist(), [(t or "").encode() for t in rows.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array(write_files([padded(t) for _, t in part]), pa.binary())], names=["doc_id", "media"])

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, "doc_id long, media binary")


OP4_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows in text_slices(b, 1, 2 << 20):
            part = list(zip(rows.column(0).to_pylist(), [(t or "").encode() for t in rows.column(1).to_pylist()]))
            files = write_files([padded(t) for _, t in part])
            out = []
            for (doc_id, text), media, (payload, info, frames) in zip(part, files, read_files(files)):
                cut = clip_rows(doc_id, info, frames)
                feature = f"{len(frames)} frames;" + ",".join(f"{r[4]:.2f}-{r[5]:.2f}:{r[6]:.3f}" for r in cut)
                out.append((doc_id, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            c = list(zip(*out))
            kinds = [pa.string() if f.endswith("string") else pa.int64() for f in OP4_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=[f.split()[0] for f in OP4_SCHEMA.split(", ")])


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(trimmed(_round_trip), OP4_SCHEMA)
