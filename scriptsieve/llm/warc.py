"""WARC files: a deterministic sharded writer and a reader.

Method: records are range-sorted by id into shards whose boundaries come from exact sums of bytes by ranges of ids, of which those that hold more than
a shard are cut again until they don't or are one id, so that shards don't hang on the cluster's size or on how ids are spread; each shard writes files that roll by compressed size, with headers, record ids and digests made
anew, one gzip member a record. Files are written under temporary names, moved when complete, and named in a manifest; readers
open only what the manifest names. Two runs over the same rows give the same bytes.

Records with equal payloads of at least `least` bytes: that with the largest id is the response, the others are revisits of it.
The largest id of each payload is an aggregate with map-side partials, and large groups of copies are joined by Spark's skew join.

A null payload counts as empty, a null URL as `urn:none`; rows with a null id come first and name no other record, and if all
copies of a payload have null ids, all are responses. Rows that repeat the largest id of their payload are responses as well.
Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import cut, partitions, shared_folder, small_batches, table

SPACE = uuid.UUID("6f1c5d5e-5f43-5b0e-9d3b-0a6d3a2f9c11")
DATE = "2024-01-01T00:00:00Z"
#: Ranges into which one that holds more than a shard is cut; their sums are all that reaches the driver, so many rows for each shard at most and round.
CUTS = 256
SMALL, LARGE = 1 << 20, 256 << 20


def record_id(page: int | None, digest: str, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, json.dumps([page, digest, url]))}>"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record(page: int | None, url: str, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record: a response with its HTTP message, or a revisit without the payload."""
    digest = base32_sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page, digest, url)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes) -> dict:
    """Fields of one record; raises ValueError if a length or digest is wrong."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"bad record {fields.get('WARC-Record-ID')}")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block.split(b"\r\n\r\n", 1)[1]
    if kind == "response" and (base32_sha1(payload) != digest or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"bad payload in {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None, "payload_bytes": number("X-Payload-Length"), "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-ID")}


def members(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The contents of each gzip member of a stream, in bounded memory."""
    rest, unpacker, out = b"", zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(step)
        if not data:
            if out:
                raise ValueError("the file ends inside a record")
            return
        out.append(unpacker.decompress(data))
        rest = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(out)
            unpacker, out = zlib.decompressobj(31), []


def shards(sizes: DataFrame, shard_bytes: int | None = None) -> list[int]:
    """The first id of each shard but the first, in order, from rows (id, size). A shard holds shard_bytes at most, or one id. Without shard_bytes a shard has a 64th of all bytes, from SMALL to LARGE."""
    known = sizes.where("id is not null")
    least, most, total = known.agg(F.min("id"), F.max("id"), F.sum("size")).first()
    if least is None:
        return []
    limit = shard_bytes or min(max(total // 64, SMALL), LARGE)
    fine, heavy = [], [(least, most, total)]  # (first id, last id, bytes)
    while heavy:
        heavy.sort()
        done = [h for h in heavy if h[2] <= limit or h[0] == h[1]]
        fine += done
        heavy = [h for h in heavy if h[2] > limit and h[0] < h[1]]
        if not heavy:
            break
        first, last, width = ([h[0] for h in heavy], [h[1] for h in heavy], [(h[1] - h[0]) // CUTS + 1 for h in heavy])

        @F.pandas_udf("long")
        def cut_of(ids: pd.Series) -> pd.Series:
            values = ids.to_numpy(np.int64)
            at = np.searchsorted(np.array(first, np.int64), values, "right") - 1
            inside = (at >= 0) & (values <= np.array(last, np.int64)[at])
            # Differences of ids can need 64 bits, which unsigned numbers have.
            step = (values.view(np.uint64) - np.array(first, np.int64).view(np.uint64)[at]) // np.array(width, np.uint64)[at]
            return pd.Series(np.where(inside, at * CUTS + step.astype(np.int64), -1))

        sums = known.select(cut_of("id").alias("cut"), "size").where("cut >= 0").groupBy("cut").agg(F.sum("size").alias("size")).collect()
        heavy = []
        for r in sums:
            k, step = divmod(r["cut"], CUTS)
            start = first[k] + step * width[k]
            heavy.append((start, min(start + width[k] - 1, last[k]), r["size"]))
    out, held = [], 0
    for start, _, size in sorted(fine):
        if held and held + size > limit:
            out.append(start)
            held = 0
        held += size
    return out


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0, shard_bytes: int | None = None, file_bytes: int = 64 << 20, date: str = DATE) -> DataFrame:
    """Writes the rows of df as WARC files under folder and returns the manifest (file, records, bytes, sha256), which is kept there as well."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("urn:none")).alias("url"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"))
    bounds = shards(cut(rows.select("id", F.octet_length("payload").cast("long").alias("size"))), shard_bytes)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, np.int64), ids.to_numpy(np.int64), "right").astype(np.int32))

    keyed = rows.withColumn("digest", F.sha1("payload"))
    last = keyed.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("id").alias("last"))
    keyed = keyed.withColumn("shard", F.when(F.col("id").isNull(), 0).otherwise(shard_of(F.coalesce("id", F.lit(0)))))
    # Payloads move once: what a revisit refers to goes to its shard as a row of its own, before the record.
    known = keyed.where(F.octet_length("payload") >= least).select("shard", "id", "digest").distinct().join(last, "digest").where(F.col("last") != F.coalesce("id", F.lit(-1)))
    known = known.select("shard", "id", "digest", F.lit(0).alias("kind"), F.lit("").alias("url"), F.lit(b"").alias("payload"), F.col("last").alias("refers"))
    records = keyed.select("shard", "id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("refers"))
    dealt = known.unionByName(records).repartitionByRange(len(bounds) + 1, "shard").sortWithinPartitions("shard", "id", "digest", "kind", "url")
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def run(batches):
        draft, shard, part, count, size, hashed = None, None, 0, 0, 0, None
        revisit, target = None, None

        def closed():
            draft.commit()
            return pa.RecordBatch.from_pydict({"file": [draft.name.rsplit("/", 1)[1]], "records": [count], "bytes": [size], "sha256": [hashed.hexdigest()]}, schema=schema)

        try:
            for batch in batches:
                for at, page, digest, kind, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    if kind == 0:
                        revisit, target = (page, digest), refers
                        continue
                    data = member(record(page, url, payload, target if revisit == (page, digest) else None, date))
                    if draft is not None and (at != shard or size + len(data) > file_bytes):
                        yield closed()
                        draft, part = None, part + 1
                    if at != shard:
                        shard, part = at, 0
                    if draft is None:
                        draft, count, size, hashed = files.Draft(folder, f"records-{shard:05d}-{part:05d}.warc.gz"), 0, 0, hashlib.sha256()
                    draft.write(data)
                    hashed.update(data)
                    count, size = count + 1, size + len(data)
            if draft is not None:
                yield closed()
                draft = None
        finally:
            if draft is not None:
                draft.drop()

    made = dealt.mapInArrow(run, "file string, records long, bytes long, sha256 string")
    made.write.json(f"{folder}/manifest")
    return spark.read.schema(made.schema).json(f"{folder}/manifest")


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_READ_DDL = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files that a manifest names, checked against its counts and hashes and their own digests."""

    def run(batches):
        for batch in batches:
            for name, count, sha in zip(*(c.to_pylist() for c in batch.columns)):
                hashed, seen, held, size = hashlib.sha256(), 0, [], 0

                class Counted:
                    def __init__(self, stream):
                        self.stream = stream

                    def read(self, n):
                        data = self.stream.read(n)
                        hashed.update(data)
                        return data

                with files.read(f"{folder}/{name}") as stream:
                    for data in members(Counted(stream)):
                        fields, seen, size = parse(data), seen + 1, size + len(data)
                        held.append(fields if payloads else fields | {"payload": None})
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=_READ)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=_READ)
                if seen != count or hashed.hexdigest() != sha:
                    raise ValueError(f"{name} is not what the manifest says")

    spread = manifest.select("file", "records", "sha256").repartition(max(2, partitions(manifest.sparkSession)))
    return spread.mapInArrow(run, _READ_DDL)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write(table(spark, sf_dir, "pages"), folder)
    return read(manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The oracle of the query; base32 by taking five bits at a time of the digest's 160.
ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as payload_bytes, sha1(h) as x, max(page_id) over (partition by h) as last from p),
n as (select page_id, payload_bytes, last, x, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || substr(x, i::int, 1))::int), 4, '0')), '') as bits from d)
select page_id, payload_bytes::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda k: (substr(bits, (i * 5 + k + 1)::int, 1))::int * (16 >> k::int)))::int, 1)), '') as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type,
  case when page_id = last then null else last end as refers_to
from n
"""
