"""A deterministic, sharded writer of WARC archives, and the reader that checks them.

Method. Payload digests decide, by one aggregation, which record of equal payloads is the
response; the others revisit it. Pages are then range-sorted by id: an exact histogram of
bytes over ids, refined where it is heavy, gives the ranges (shards) of about ``shard_bytes``,
so their number follows the data and not the cluster, and an id with more than that is dealt
to several by payload. Each shard is written by one task: every record is a gzip member of its
own, headers, block digests, payload digests and record ids are generated anew, and files roll
when their compressed size reaches a bound. A task writes under a temporary name with its attempt's token and
reports each file (final name, temporary name, records, bytes, SHA-256). Those reports,
committed by Spark as a table in which only successful attempts appear, are the manifest;
a second, idempotent step renames exactly the listed files, and what failed attempts left
under temporary names is removed. The same input gives the same bytes.

Pages cross the network once, in the range exchange; the decisions travel as small marker
rows in the same exchange, so no join moves payloads. Files are written through
``pyarrow.fs``, that is to any store it knows, in the shared folder by default.

Defined results: null html counts as empty; null urls are empty; payloads below
``least`` bytes never revisit; rows that repeat an id are all written, and of those with
equal payloads one is the response; null ids are written first, and never referred
to if another id has the payload; very long payloads are whole, alone in memory; extra columns
are ignored, whatever their names; an empty table gives no file and no row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_folder, materialize, new_folder, table

#: Pages carry no time of capture; a fixed one keeps the bytes deterministic.
DATE = "2024-01-01T00:00:00Z"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it; Hadoop's s3a is pyarrow's s3."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member without time or name, so equal data give equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def record_id(page_id: int | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}/{nth}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, nth: int = 0) -> bytes:
    """A response record, or a revisit if ``refers_to`` is given; a revisit keeps the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, nth)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=chr(37) + ':/?#[]@!$&()*+,;=~-._')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-X-Payload-Length: {len(payload)}",
        f"WARC-X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest, 0)}", f"WARC-X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


_MANIFEST = "name string, temporary string, records long, bytes long, sha256 string"


class _Roller:
    """Files of one task, rolled by compressed size."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.path = file_system(folder)
        self.shard, self.roll, self.token = shard, roll, uuid.uuid4().hex
        self.nth, self.out, self.reports = 0, None, []

    def add(self, member: bytes) -> None:
        if self.out is not None and self.size + len(member) > self.roll:
            self.close()
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.nth:06d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{self.token}"
            self.fs.create_dir(f"{self.path}/_temporary", recursive=True)
            self.out = self.fs.open_output_stream(f"{self.path}/{self.temporary}", compression=None)
            self.size, self.records, self.sha = 0, 0, hashlib.sha256()
            self.nth += 1
            self._write(gzip_member(self._info()))
        self._write(member)
        self.records += 1

    def _info(self) -> bytes:
        body = b"software: sharded range-sorted writer\r\nformat: WARC File Format 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.name)}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.reports.append((self.name, self.temporary, self.records, self.size, self.sha.hexdigest()))
            self.out = None


def _writer(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, shard, reports = None, None, []
        now, markers, seen = object(), {}, {}

        def close():
            if files is not None:
                files.close()
                reports.extend(files.reports)

        for b in batches:
            for own_shard, page_id, keep, digest, url, html in zip(*(c.to_pylist() for c in b.columns)):
                if own_shard != shard:
                    close()
                    files, shard = _Roller(folder, own_shard, roll), own_shard
                    now = object()
                if page_id != now:
                    now, markers, seen = page_id, {}, {}
                if keep is not None:  # a marker comes before the rows of its page
                    markers[digest] = keep
                    continue
                payload = (html or "").encode()
                own = hashlib.sha256(payload).hexdigest()
                nth = seen.get(own, 0)
                seen[own] = nth + 1
                refers_to = markers.get(own)
                if refers_to is not None and refers_to == page_id and nth == 0:
                    refers_to = None
                files.add(gzip_member(build_record(page_id, url, payload, own, refers_to, nth)))
        close()
        if reports:
            c = list(zip(*reports))
            yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1]), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4])], names=["name", "temporary", "records", "bytes", "sha256"])

    return run


def _committer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        for b in batches:
            for name, temporary in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if fs.get_file_info(f"{path}/{temporary}").type == pafs.FileType.File:
                    fs.move(f"{path}/{temporary}", f"{path}/{name}")
            yield b

    return run


#: Bins of a level of the histogram of ids.
BINS = 1 << 16


class Shards:
    """Ranges of ids with about ``size`` bytes each, from exact sums of bytes (page_id, digest, bytes)."""

    def __init__(self, sizes: DataFrame, size: int):
        whole = sizes.agg(F.min("page_id"), F.max("page_id"), F.coalesce(F.sum(F.when(F.col("page_id").isNull(), F.col("bytes"))), F.lit(0))).first()
        self.null_pieces = -(-whole[2] // size) if whole[2] else 1
        leaves: list[tuple[int, int, int]] = []  # first id, last id, bytes
        heavy = [(whole[0], whole[1])] if whole[0] is not None else []
        while heavy:
            bins = self._level(sizes, heavy)
            heavy = [(a, z) for a, z, n in bins if n > size and z > a]
            leaves += [x for x in bins if not (x[2] > size and x[1] > x[0])]
        #: First ids of the shards, and how many pieces each has.
        self.firsts, self.pieces, held = [], [], None
        for a, _, n in sorted(leaves):
            if held is None or held + n > size:
                self.firsts.append(a)
                self.pieces.append(max(1, -(-n // size)))
                held = n
            else:
                held += n
        self.numbers = self.null_pieces + np.concatenate(([0], np.cumsum(self.pieces))).astype(np.int64)
        self.count = int(self.numbers[-1])

    @staticmethod
    def _level(sizes: DataFrame, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Bytes in equal parts of each of the ranges, which are in no order and apart."""
        ranges = sorted(ranges)
        parts = max(2, BINS // len(ranges))
        widths = [max(1, -(-(z - a + 1) // parts)) for a, z in ranges]
        lows, highs, steps = np.array([a for a, _ in ranges]), np.array([z for _, z in ranges]), np.array(widths)

        @F.pandas_udf("long")
        def bin_of(ids: pd.Series) -> pd.Series:
            x = ids.to_numpy(np.int64)
            at = np.maximum(np.searchsorted(lows, x, "right") - 1, 0)
            # differences of 64-bit integers as unsigned ones do not overflow
            inside = (x.astype(np.uint64) - lows[at].astype(np.uint64)) // steps[at].astype(np.uint64)
            return pd.Series(np.where((x >= lows[at]) & (x <= highs[at]), at * (parts + 1) + inside.astype(np.int64), -1))

        rows = sizes.where("page_id is not null").groupBy(bin_of("page_id").alias("bin")).agg(F.sum("bytes").alias("n")).where("bin >= 0").collect()
        out = []
        for r in rows:
            at, inside = divmod(r["bin"], parts + 1)
            first = ranges[at][0] + inside * widths[at]
            out.append((first, min(ranges[at][1], first + widths[at] - 1), r["n"]))
        return out

    def of(self, page_id: F.Column, digest: F.Column) -> F.Column:
        """The shard of a row; rows of one id and payload are in one."""
        firsts, pieces, numbers, nulls = np.array(self.firsts, np.int64), np.array(self.pieces, np.int64), self.numbers, self.null_pieces

        @F.pandas_udf("long")
        def shard_of(ids: pd.Series, mixed: pd.Series) -> pd.Series:
            empty, mixed = ids.isna().to_numpy(), mixed.to_numpy(np.int64)
            out = mixed % nulls
            if len(firsts) and not empty.all():
                at = np.maximum(np.searchsorted(firsts, ids.fillna(0).astype(np.int64).to_numpy(), "right") - 1, 0)
                out = np.where(empty, out, numbers[at] + mixed % pieces[at])
            return pd.Series(out)

        return shard_of(page_id, F.pmod(F.xxhash64(digest), F.lit(1 << 30)))


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least: int = 100, roll: int = 256 << 20, shard_bytes: int = 64 << 20) -> DataFrame:
    """Write the archives into ``folder`` and return the manifest, itself written to ``folder``/_manifest."""
    rows = pages.select(pages[id_column].cast("long").alias("page_id"), pages[url_column].cast("string").alias("url"), F.coalesce(pages[html_column], F.lit("")).alias("html"))
    # a record has some hundred bytes beside its payload
    sizes = materialize(spark, rows.select("page_id", F.sha2("html", 256).alias("digest"), (F.octet_length("html") + 500).cast("long").alias("bytes")), "warc-sizes")
    shards = Shards(sizes, shard_bytes)
    digests = sizes.where(F.col("bytes") >= least + 500).select("page_id", "digest")
    groups = digests.groupBy("digest").agg(F.min("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("keep").isNotNull())
    none = F.lit(None).cast("string")
    markers = digests.join(groups, "digest").select("page_id", "keep", "digest").distinct().select("page_id", "keep", "digest", none.alias("url"), none.alias("html"))
    records = rows.select("page_id", F.lit(None).cast("long").alias("keep"), F.sha2("html", 256).alias("digest"), "url", "html")
    placed = records.unionAll(markers).select(shards.of(F.col("page_id"), F.col("digest")).alias("shard"), "page_id", "keep", "digest", "url", "html")
    n = max(1, shards.count)
    sorted_rows = placed.repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", F.col("keep").isNull(), "url", "html")
    manifest = f"{folder}/_manifest"
    sorted_rows.mapInArrow(_writer(folder, roll), _MANIFEST).write.parquet(f"{manifest}-written")
    written = spark.read.schema(_MANIFEST).parquet(f"{manifest}-written")
    written.repartition(n, "name").mapInArrow(_committer(folder), _MANIFEST).write.parquet(manifest)
    fs, path = file_system(folder)
    for left in ("_temporary", "_manifest-written"):
        if fs.get_file_info(f"{path}/{left}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{path}/{left}")
    drop_folder(spark, sizes)
    return spark.read.schema(_MANIFEST).parquet(manifest)


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member of an open archive; reads a few MB at a time."""
    unpacker, out, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(1 << 20)
        rest = b""
        if not data:
            break
        out.append(unpacker.decompress(data))
        if unpacker.eof:
            rest = unpacker.unused_data
            yield parse_record(b"".join(out))
            unpacker, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the archive ends within a record")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(headers["Content-Length"])
    if body[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return headers, body[:n]


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        for b in batches:
            for name, sha in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for headers, block in records_of(stream):
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        if headers["WARC-Block-Digest"] != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
                            raise ValueError(f"{name}: a block digest is wrong")
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        n = int(headers["WARC-X-Payload-Length"])
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            n, found = len(payload), hashlib.sha256(payload).hexdigest()
                            if found != digest:
                                raise ValueError(f"{name}: a payload digest is wrong")
                        page, other = headers["WARC-X-Page-Id"], headers.get("WARC-X-Refers-To-Page-Id")
                        rows.append((int(page) if page else None, n, digest, kind, int(other) if other else None, headers["WARC-Target-URI"]))
                        if len(rows) >= 20_000:
                            yield _read_batch(rows)
                            rows = []
                if rows:
                    yield _read_batch(rows)

    return run


def _read_batch(rows: list) -> pa.RecordBatch:
    c = list(zip(*rows))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=[f.split()[0] for f in _READ.split(", ")])


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The records of the manifest's files, their digests checked; each file is a task's work."""
    n = max(1, manifest.count())
    return manifest.select("name", "sha256").repartition(n, "name").mapInArrow(_reader(folder), _READ)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    manifest = write_archives(spark, table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH t AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS keep, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS nth FROM t
), r AS (SELECT *, payload_bytes >= 100 AND keep IS NOT NULL AND nth > 1 AS again FROM g)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keep END AS refers_to FROM r
"""
