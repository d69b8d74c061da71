"""Deterministic sharded WARC writer and reader.

Records are sorted by (id, digest) over all input and dealt to shards of about `shard_bytes` payload bytes by their place in that
order: sums over the ranges of a distributed sort give every key the exact number of bytes before it, so shards are even whatever
the ids are, and the same input gives the same files. One task writes one shard, one gzip member for each record; a file is closed when its compressed
size reaches `roll_bytes`. A file is written under a temporary name of its own for each attempt and renamed when it is
complete. The names that count are in the manifest: a table of files, written by the tasks, and `manifest.json`, which names
that table and is renamed into place last; so a lost executor or a second attempt leaves no half-written archive.

Of records with equal payloads of at least `revisit_bytes` bytes the one with the largest id holds the payload and the
others are revisit records that refer to it, those without an id too. A null payload is empty. A null id sorts first and
never is referred to; payloads that occur only without ids stay responses. Rows that share id and payload would refer to
themselves, so each stays a response. An empty table gives a manifest without files. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import run_folder
from .shared import keep, maybe_broadcast

REVISIT_BYTES = 1000
#: Compressed size at which a file is closed.
ROLL_BYTES = 32 << 20
#: Payload bytes meant for one shard, unless there were more than MOST_SHARDS of them: then shards are larger.
SHARD_BYTES, MOST_SHARDS = 32 << 20, 100_000
#: Files that a task reads back.
READ_FILES = 2
NO_ID = -(2**63)
DATE = "2024-01-01T00:00:00Z"
VERSION = b"WARC/1.1\r\n"
FILES = "file string, shard long, records long, bytes long, sha1 string"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def _uuid(*parts: object) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, "\x1f".join(map(str, parts))).urn


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, http: bytes) -> bytes:
    """One record with regenerated headers; a revisit holds the HTTP header only."""
    revisit = refers_to is not None
    block = http + (b"" if revisit else payload)
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_uuid('record', page_id, digest, revisit)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("WARC-Source-Id", "" if page_id is None else str(page_id)),
        ("WARC-Source-Payload-Length", str(len(payload))),
    ]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_uuid('record', refers_to, digest, False)}>"), ("WARC-Source-Refers-To", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _http(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)


class _Shard:
    """The open file of one shard."""

    def __init__(self, base: str, shard: int, roll: int):
        self.fs, self.dir = _filesystem(base)
        self.shard, self.roll, self.part, self.out, self.files = shard, roll, 0, None, []

    def write(self, rec: bytes) -> None:
        if self.out is None:
            self.temp = f"{self.dir}/_temporary.{uuid.uuid4().hex}.warc.gz"
            self.out, self.size, self.count, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha1()
        member = gzip.compress(rec, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.count += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        name = f"part-{self.shard:06d}-{self.part:05d}.warc.gz"
        self.fs.move(self.temp, f"{self.dir}/{name}")
        self.files.append((name, self.shard, self.count, self.size, self.sha.hexdigest()))
        self.part += 1


def _starts(meta: DataFrame, shard_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (id, digest) with which shards start; meta has them as k and d, and bytes. At most MOST_SHARDS of them come to the driver."""
    total = meta.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shard_bytes = max(shard_bytes, total // MOST_SHARDS + 1)
    ranges = keep(meta.groupBy("k", "d").agg(F.sum("bytes").alias("bytes")).repartitionByRange("k", "d").withColumn("p", F.spark_partition_id()), "warc-ranges")
    # one row for each range
    before = ranges.groupBy("p").agg(F.sum("bytes").alias("all")).withColumn("off", F.sum("all").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))).select("p", F.coalesce("off", F.lit(0)).alias("off"))
    upto = ranges.join(F.broadcast(before), "p").withColumn("sum", F.sum("bytes").over(Window.partitionBy("p").orderBy("k", "d")))
    shard = F.floor((F.col("off") + F.col("sum") - F.col("bytes")) / F.lit(shard_bytes))
    got = upto.groupBy(shard.alias("s")).agg(F.min(F.struct("k", "d")).alias("m")).select("m.k", "m.d").toArrow()
    k, d = (got.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    order = np.lexsort((d, k))
    return k[order], d[order]


def _shard_of(starts: tuple[np.ndarray, np.ndarray], k: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many starts are at or before each key, less one."""
    lo, hi = np.searchsorted(starts[0], k, "left"), np.searchsorted(starts[0], k, "right")
    for i in np.flatnonzero(hi > lo):
        lo[i] += np.searchsorted(starts[1][lo[i] : hi[i]], d[i], "right")
    return np.maximum(lo - 1, 0).astype(np.int32)


def write(pages: DataFrame, base: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the archives under `base`; returns the table of files that count (file, shard, records, bytes, sha1)."""
    spark = pages.sparkSession
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    key, part = F.coalesce("id", F.lit(NO_ID)), F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    src = src.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    meta = keep(src.select("id", "digest", F.octet_length("html").cast("long").alias("bytes")), "warc-meta")
    shown = meta.where(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.max("id").alias("ref"), F.count("*").alias("n")).where("n > 1 and ref is not null").select("digest", "ref")
    starts = _starts(meta.select(key.alias("k"), part.alias("d"), "bytes"), shard_bytes)
    shipped = spark.sparkContext.broadcast(starts)

    @F.pandas_udf("int")
    def dealt(k: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(_shard_of(shipped.value, k.to_numpy(np.int64), d.to_numpy(np.int64)))

    rows = src.join(maybe_broadcast(keep(shown, "warc-shown"), 48), "digest", "left").withColumn("ref", F.when(F.col("id").isNull() | (F.col("id") != F.col("ref")), F.col("ref")))
    rows = rows.select(dealt(key, part).alias("shard"), "id", "url", "html", "digest", "ref")
    rows = rows.repartitionById(max(1, len(starts[0])), F.col("shard")).sortWithinPartitions("id", "digest", "url")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        done = []
        for b in batches:
            for k, i, url, text, digest, ref in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now.shard != k:
                    if now is not None:
                        now.close()
                        done += now.files
                    now = _Shard(base, k, roll_bytes)
                payload = text.encode()
                now.write(record(i, url, payload, digest, ref, _http(payload)))
        if now is not None:
            now.close()
            done += now.files
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done)], names=["file", "shard", "records", "bytes", "sha1"])

    disk, top = _filesystem(base)
    disk.create_dir(top, recursive=True)
    name = f"_files-{uuid.uuid4().hex}"
    rows.mapInArrow(put, FILES).write.parquet(f"{base}/{name}")
    files = spark.read.schema(FILES).parquet(f"{base}/{name}")
    n, records, size = files.agg(F.count("*"), F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    temp = f"{top}/_temporary.{uuid.uuid4().hex}.json"
    with disk.open_output_stream(temp) as f:
        f.write(json.dumps({"table": name, "files": n, "records": records, "bytes": size}).encode())
    disk.move(temp, f"{top}/manifest.json")
    return files


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive, one gzip member at a time."""
    view, at = memoryview(data), 0
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            # in small pieces: what follows a member is copied when the member ends
            piece = view[at : at + 16384]
            if not piece:
                raise ValueError("the archive ends within a record")
            parts.append(z.decompress(piece))
            at += len(piece)
        at -= len(z.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] + "\r\n" != VERSION.decode():
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = rest[: int(headers["Content-Length"])]
        if f"sha1:{hashlib.sha1(block).hexdigest()}" != headers["WARC-Block-Digest"]:
            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
        yield headers, block


def read(spark: SparkSession, base: str) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of the manifest's files."""
    disk, top = _filesystem(base)
    with disk.open_input_stream(f"{top}/manifest.json") as f:
        manifest = json.loads(f.read())
    files = spark.read.schema(FILES).parquet(f"{base}/{manifest['table']}").select("file", "sha1")
    files = files.repartition(max(1, -(-manifest["files"] // READ_FILES)))
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        num = lambda x: int(x) if x else None
        disk, top = _filesystem(base)
        for b in batches:
            for name, sha in zip(*(c.to_pylist() for c in b.columns)):
                with disk.open_input_stream(f"{top}/{name}", compression=None) as f:
                    data = f.read()  # at most roll_bytes and one record
                if hashlib.sha1(data).hexdigest() != sha:
                    raise ValueError(f"damaged archive {name}")
                rows, size = [], 0
                for h, block in parse(data):
                    revisit = h["WARC-Type"] == "revisit"
                    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                    digest = h["WARC-Payload-Digest"].partition(":")[2]
                    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"damaged payload of {h['WARC-Record-ID']}")
                    rows.append((num(h["WARC-Source-Id"]), h["WARC-Target-URI"], payload, int(h["WARC-Source-Payload-Length"]), digest, h["WARC-Type"], num(h.get("WARC-Source-Refers-To"))))
                    size += len(payload or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), kind)], schema=kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    return files.mapInArrow(run, schema)


def archive_dir(spark: SparkSession, name: str = "warc") -> str:
    """A folder for archives that are read back and then done with."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
