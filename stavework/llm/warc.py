"""Deterministic sharded WARC archives: range-sorted records, files rolled by compressed size, commits by manifest."""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from stavework.session import share

SHARD_BYTES, ROLL_BYTES = 32 << 20, 8 << 20
REVISIT_FROM = 100
SAMPLE = 20_000
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, seq int, temp string, name string, records long, bytes long, sha256 string"


def record_id(key, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{key}:{digest}')}>"


def _line(value: str) -> str:
    """A header value on one line: control characters and % are escaped where there are control characters."""
    if value.isprintable():
        return value
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(key, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC/1.1 record as its own gzip member; a revisit has headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {_line(url) if url else f'urn:page:{key}'}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if key is not None:
        head.append(f"X-Source-Key: {key}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Key: {refers_to}", f"X-Payload-Length: {len(payload)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder given as a URI or a path; every task opens it for itself."""
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _uri(folder: str) -> str:
    return folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder


class _Shard:
    """The files of one attempt at one shard, under temporary names."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.store, self.root = filesystem(folder)
        self.shard, self.roll, self.attempt = shard, roll, uuid.uuid4().hex
        self.seq, self.out = 0, None
        self.done: list[tuple] = []

    def add(self, data: bytes) -> None:
        if self.out is not None and self.size and self.size + len(data) > self.roll:
            self.close()
        if self.out is None:
            self.temp = f"_temporary/{self.shard:06d}-{self.attempt}-{self.seq:05d}.warc.gz"
            self.out, self.size, self.records, self.digest = self.store.open_output_stream(f"{self.root}/{self.temp}", compression=None), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.seq, self.temp, f"part-{self.shard:06d}-{self.seq:05d}.warc.gz", self.records, self.size, self.digest.hexdigest()))
            self.seq, self.out = self.seq + 1, None


def _write_tasks(folder: str, roll: int):
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, refers, at = None, {}, object()
        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "key", "url", "payload", "digest", "refers")]
            for i in range(batch.num_rows):
                number, key, url, payload, digest, target = (c[i].as_py() for c in columns)
                if shard is None or shard.shard != number:
                    if shard is not None:
                        shard.close()
                    if shard is not None and shard.done:
                        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*shard.done), kinds)], names=names)
                    shard = _Shard(folder, number, roll)
                if key != at:
                    refers, at = {}, key
                if payload is None:
                    refers[digest] = target
                else:
                    shard.add(record(key, url, payload, digest, refers.get(digest)))
        if shard is not None:
            shard.close()
            if shard.done:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*shard.done), kinds)], names=names)

    return run


def write_archive(pages: DataFrame, folder: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes all rows as WARC files in `folder` and returns the manifest (shard, seq, temp, name, records, bytes, sha256).

    * Shards are ranges of the key, cut at quantiles of the SAMPLE keys with the least hashes, so they are the same whatever the partitions.
      A shard is written in key order by one task; a file that would pass `roll_bytes` of compressed data ends before the record.
      The files' bytes depend on the rows alone.
    * Of records with equal payloads of at least 100 bytes, those with the least key are responses and the others revisit it. Null payloads are empty.
      Rows with a null key come first and are responses; a repeated row is written each time.
    * Attempts write under names of their own in _temporary. The table of what succeeded names one attempt per shard; its files are then
      renamed, by tasks that can run twice, and the manifest is written last. A reader takes what the manifest names and nothing else.
    * An empty table gives no file and an empty manifest.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    slim = share(rows.select("key", "digest", "size"))
    total = slim.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    cuts: list[int] = []
    if shards > 1:
        sample = sorted(r["key"] for r in slim.where("key is not null").select("key", F.xxhash64("key").alias("h")).orderBy("h", "key").limit(SAMPLE).collect())
        cuts = sorted({sample[len(sample) * k // shards] for k in range(1, shards)}) if sample else []
    shard = F.lit(0) if not cuts else F.size(F.filter(F.lit(cuts), lambda c: c <= F.coalesce(F.col("key"), F.lit(-(1 << 63)))))
    firsts = slim.where((F.col("size") >= REVISIT_FROM) & F.col("key").isNotNull()).groupBy("digest").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1")
    turned = slim.join(firsts, "digest").where("key > least").select("key", "digest", F.col("least").alias("refers")).distinct()
    empty = F.lit(None)
    records = rows.select("key", "url", "payload", "digest", empty.cast("long").alias("refers"), F.lit(1).alias("turn"))
    marks = turned.select("key", empty.cast("string").alias("url"), empty.cast("binary").alias("payload"), "digest", "refers", F.lit(0).alias("turn"))
    both = records.union(marks).withColumn("shard", shard.cast("int"))
    dealt = both.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "turn", "digest", F.col("url").asc_nulls_first())
    folder = _uri(folder)
    store, root = filesystem(folder)
    store.create_dir(f"{root}/_temporary", recursive=True)
    manifest = share(dealt.select("shard", "key", "url", "payload", "digest", "refers").mapInArrow(_write_tasks(folder, roll_bytes), MANIFEST))

    def rename(batches):
        own, at = filesystem(folder)
        for batch in batches:
            for temp, name in zip(batch.column("temp").to_pylist(), batch.column("name").to_pylist()):
                if own.get_file_info(f"{at}/{temp}").type == fs.FileType.File:
                    own.move(f"{at}/{temp}", f"{at}/{name}")
            yield batch

    committed = share(manifest.mapInArrow(rename, MANIFEST))
    files = committed.count()
    with store.open_output_stream(f"{root}/_manifest.tmp") as out:
        out.write(json.dumps({"files": files, "shards": len(cuts) + 1, "records": committed.agg(F.sum("records")).first()[0] or 0}).encode())
    store.move(f"{root}/_manifest.tmp", f"{root}/_manifest.json")
    store.delete_dir(f"{root}/_temporary")
    return committed


def _members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one record each."""
    view, at = memoryview(data), 0
    while at < len(view):
        unzip, out = zlib.decompressobj(31), []
        while not unzip.eof:
            fed = view[at : at + 32768]
            if not len(fed):
                raise ValueError("a record is cut off")
            out.append(unzip.decompress(fed))
            at += len(fed) - len(unzip.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict, bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError("block digest differs")
    return fields, block.partition(b"\r\n\r\n")[2]


def read_archive(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(key, url, payload_bytes, payload_digest, record_type, refers_to, payload) of all records in the files the manifest names.

    Digests of blocks and payloads are computed anew and must agree; so must each file's size with the manifest.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", "length").join(manifest.select("name", F.col("bytes").alias("want")), "name")

    def run(batches):
        for batch in batches:
            for content, want in zip(batch.column("content"), batch.column("want").to_pylist()):
                data = content.as_buffer()
                if data.size != want:
                    raise ValueError("a file's size differs from the manifest")
                out: list = []
                held = 0
                for raw in _members(data):
                    fields, payload = parse(raw)
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("payload digest differs")
                    key = fields.get("X-Source-Key")
                    out.append((int(key) if key is not None else None, fields["WARC-Target-URI"], int(fields["X-Payload-Length"]) if revisit else len(payload), digest, fields["WARC-Type"],
                                int(fields["X-Refers-To-Key"]) if revisit else None, None if revisit else payload))
                    held += len(payload)
                    if held > 4 << 20:
                        yield _batch(out)
                        out, held = [], 0
                if out:
                    yield _batch(out)

    return files.select("content", "want").mapInArrow(run, "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
