"""WARC: a deterministic sharded writer, and its reader.

Records are range-sorted by page id: exact byte histograms over the ids, refined where a bin is heavier than a shard, give
borders that depend on the rows alone. Shards grow with the input, so their number and the histogram's are bounded; one id
(or none) that is heavier than a shard is cut by its payloads' digests. Each shard is written as files that roll over by compressed size, one gzip member
per record, with headers and digests made anew and a fixed date. A file is written under a temporary name and moved to its
final one when it is whole; another attempt at the same shard writes the same bytes to the same name. The manifest (file,
size, SHA-256, records) is a table that Spark commits after all files; readers take the files that it lists, no others.

Files go through ``pyarrow.fs`` at the URI of the target folder (file, s3, gs, hdfs), so no executor keeps a local copy.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, fresh_dir, read_table, utf8

#: Raw bytes of a shard at least, compressed bytes after which a file is closed, and first bins of ids.
SHARD_BYTES, FILE_BYTES, BINS = 32 << 20, 16 << 20, 1024
#: Shards at most, about: above, they are larger (1.5 GiB each for 100 TB).
MOST_SHARDS = 1 << 16
#: A payload with more copies than this is joined by a broadcast of such payloads, at most one for so many rows.
HOT_COPIES = 1_000_000
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("7a1f36a5-6a0b-5d0e-9f43-6d9d2f7d7c11")

MANIFEST_SCHEMA = "file string, shard long, part int, records long, bytes long, sha256 string"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}')}>"


def _uri(url: str | None, page_id: int | None) -> str:
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    return clean or f"urn:page:{page_id}"


def make_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, digest: str) -> bytes:
    """One record, not compressed. first: the page whose response this one revisits, None for a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url, page_id)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}", f"X-Refers-To-Page-ID: {first}"]
    return utf8("\r\n".join(head)) + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(stream):
    """(headers, block) of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield headers, block


def parse_record(headers: dict[str, str], block: bytes) -> tuple:
    """A RECORD_SCHEMA row; digests are checked against the bytes that are there."""
    if headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError("payload digest")
    number = lambda name: int(headers[name]) if name in headers else None
    return number("x-page-id"), headers.get("warc-target-uri"), length, digest, kind, number("x-refers-to-page-id"), payload if kind == "response" else None


def _facts(pages: DataFrame) -> DataFrame:
    body = F.encode(F.coalesce(pages["html"].cast("string"), F.lit("")), "UTF-8")
    return pages.select(pages["page_id"].cast("long").alias("page_id"), F.sha1(body).alias("sha"), F.octet_length(body).cast("long").alias("size"))


def _bin_of(borders: np.ndarray):
    @F.pandas_udf("int")
    def bin_of(page_id: pd.Series) -> pd.Series:
        known = page_id.dropna()
        out = pd.Series(0, index=page_id.index, dtype="int32")  # null ids stand first
        out.loc[known.index] = np.searchsorted(borders, known.to_numpy(dtype="int64"), side="right").astype("int32")
        return out

    return bin_of


@dataclass(frozen=True)
class Shards:
    """starts: the smallest ids of all ranges but the first, null ids apart; numbers: the first shard of each range, null
    ids' first; pieces: in how many shards each is cut, by digest."""

    starts: np.ndarray
    numbers: np.ndarray
    pieces: np.ndarray

    @property
    def count(self) -> int:
        return int(self.pieces.sum())

    def of(self, page_id: str, sha: str):
        starts, numbers, pieces = self.starts, self.numbers, self.pieces

        @F.pandas_udf("long")
        def shard_of(page_id: pd.Series, sha: pd.Series) -> pd.Series:
            place = np.zeros(len(page_id), dtype="int64")
            known = page_id.notna().to_numpy()
            place[known] = 1 + np.searchsorted(starts, page_id[known].to_numpy(dtype="int64"), side="right")
            out, cut_up = numbers[place], pieces[place] > 1
            if cut_up.any():
                out[cut_up] += np.array([int(x[:8], 16) for x in sha[cut_up]], dtype="int64") * pieces[place[cut_up]] >> 32
            return pd.Series(out)

        return shard_of(page_id, sha)


def plan_shards(facts: DataFrame, shard_bytes: int = SHARD_BYTES) -> Shards:
    """Equal-width bins of ids are cut again while one is heavier than a shard and holds more than one id, in about twice
    as many as it has shards; then neighbours are joined up to a shard's size. Bins follow the number of shards, which is
    bounded by MOST_SHARDS, not the number of pages."""
    low, high, total, nulls = facts.agg(F.min("page_id"), F.max("page_id"), F.sum("size"), F.sum(F.when(F.col("page_id").isNull(), F.col("size")))).first()
    shard_bytes = max(shard_bytes, -(-(total or 0) // MOST_SHARDS))
    pieces = [max(1, -(-(nulls or 0) // shard_bytes))]

    def edges(a: int, b: int, n: int) -> set[int]:
        """Inner borders of n equal parts of a..b."""
        return {a + (b - a + 1) * i // n for i in range(1, n)} - {a}

    borders = np.array(sorted(edges(low, high, BINS)) if low is not None else [], dtype="int64")
    known = facts.where("page_id is not null")
    while True:
        sizes = {r["bin"]: r["size"] for r in known.groupBy(_bin_of(borders)("page_id").alias("bin")).agg(F.sum("size").alias("size")).collect()}
        starts = [low, *borders.tolist()]
        spans = list(zip(starts, [*(b - 1 for b in borders.tolist()), high], strict=True))
        heavy = [(a, b, sizes[i]) for i, (a, b) in enumerate(spans) if sizes.get(i, 0) > shard_bytes and b > a]
        if not heavy:
            break
        more = set().union(*(edges(a, b, 2 + 2 * size // shard_bytes) for a, b, size in heavy))
        borders = np.array(sorted(set(borders.tolist()) | more), dtype="int64")
    chosen, held = [], 0
    for i, (a, _) in enumerate(spans):
        size = sizes.get(i, 0)
        if held and held + size > shard_bytes:
            chosen.append(a)
            pieces.append(max(1, -(-held // shard_bytes)))
            held = 0
        held += size
    pieces.append(max(1, -(-held // shard_bytes)))
    return Shards(np.array(chosen, dtype="int64"), np.cumsum(pieces) - pieces, np.array(pieces, dtype="int64"))


def revisits_of(facts: DataFrame) -> DataFrame:
    """page_id, sha, first: pages whose payload has its response on another page. Payloads with very many copies are few,
    at most one for each HOT_COPIES rows, so their pages meet them by a broadcast; the others by a join on the payload."""
    firsts = cut(facts.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    hot = F.broadcast(firsts.where(F.col("copies") > HOT_COPIES))
    rest = facts.join(hot.select("sha", "size"), ["sha", "size"], "left_anti").join(firsts.where(F.col("copies") <= HOT_COPIES), ["sha", "size"])
    both = rest.unionByName(facts.join(hot, ["sha", "size"]))
    return both.where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "sha", "first").distinct()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Roller:
    """Writes records to files of one shard, each under a temporary name until it is whole."""

    def __init__(self, uri: str, shard: int, file_bytes: int, attempt: str):
        self.filesystem, self.base = _filesystem(uri)
        self.shard, self.file_bytes, self.attempt = shard, file_bytes, attempt
        self.part, self.stream, self.done = 0, None, []

    def add(self, member: bytes) -> None:
        if self.stream is None:
            self.name = f"{self.shard:08d}-{self.part:05d}.warc.gz"
            self.temporary = f"{self.base}/_temporary/{self.name}.{self.attempt}"
            self.stream, self.size, self.records, self.hash = self.filesystem.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        self.stream.write(member)
        self.hash.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.file_bytes:
            self.close()

    def close(self) -> None:
        if self.stream is None:
            return
        self.stream.close()
        final = f"{self.base}/{self.name}"
        try:
            self.filesystem.move(self.temporary, final)
        except OSError:  # stores that do not move over an existing file: an earlier attempt's, with the same bytes
            self.filesystem.delete_file(final)
            self.filesystem.move(self.temporary, final)
        self.done.append((self.name, self.shard, self.part, self.records, self.size, self.hash.hexdigest()))
        self.part, self.stream = self.part + 1, None


def write_archives(pages: DataFrame, uri: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, level: int = 5) -> DataFrame:
    """Writes one record per row of pages (page_id, url, html) below uri and returns the manifest.

    Null html is the empty payload; a null url becomes urn:page:ID. Of equal payloads the one with the smallest page_id is
    the response, null ids after all others; rows that repeat the response's id with the same payload are responses too;
    the rest revisit it. If all ids of a payload are null, all are responses. An empty table gives no file and an empty
    manifest; other columns are ignored, whatever their names.
    """
    from pyarrow import fs as _fs  # noqa: F401  fails here, not in tasks, where it is missing

    spark = pages.sparkSession
    facts = cut(_facts(pages))
    plan = plan_shards(facts, shard_bytes)
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha"))
    rows = rows.select(plan.of("page_id", "sha").alias("shard"), "page_id", "sha", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"), "url", "html")
    marks = revisits_of(facts).select(plan.of("page_id", "sha").alias("shard"), "page_id", "sha", F.lit(0).alias("kind"), "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    order = ["shard", "page_id", "sha", "kind", "url"]
    # Each shard is a partition, so tasks are even and none waits for another's file.
    sorted_ = rows.unionByName(marks).repartitionById(plan.count, F.col("shard").cast("int")).sortWithinPartitions(*order)
    columns = ["file", "shard", "part", "records", "bytes", "sha256"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        attempt = uuid.uuid4().hex
        roller, mark = None, (None, None, None)
        for batch in batches:
            for shard_, page_id, sha, kind, first, url, html_ in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if kind == 0:  # stands just before the rows that it is about
                    mark = (page_id, sha, first)
                    continue
                if roller is None or roller.shard != shard_:
                    if roller:
                        roller.close()
                        yield from listed(roller)
                    roller = _Roller(uri, shard_, file_bytes, attempt)
                payload = utf8(html_)
                revisit = mark[2] if mark[:2] == (page_id, sha) else None
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                roller.add(gzip.compress(make_record(page_id, url, payload, revisit, digest), level, mtime=0))
        if roller:
            roller.close()
            yield from listed(roller)

    def listed(roller):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*roller.done, strict=True), kinds, strict=True)], names=columns)

    filesystem, base = _filesystem(uri)
    filesystem.create_dir(f"{base}/_temporary", recursive=True)
    sorted_.mapInArrow(run, MANIFEST_SCHEMA).write.mode("error").json(f"{uri}/manifest")
    filesystem.delete_dir(f"{base}/_temporary")  # what failed attempts have left
    return spark.read.schema(MANIFEST_SCHEMA).json(f"{uri}/manifest")


def read_archives(manifest: DataFrame, uri: str, with_payload: bool = True) -> DataFrame:
    """Reads the files that the manifest lists, checks sizes and digests, and returns one row per record."""
    parts = 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # files are few and large: spread them
    names = [f.split(" ")[0] for f in RECORD_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    keep = 7 if with_payload else 6

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[:keep], kinds, strict=False)], names=names[:keep])

    def run(batches):
        filesystem, base = _filesystem(uri)
        for batch in batches:
            for name, records, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                path = f"{base}/{name}"
                if filesystem.get_file_info(path).size != size:
                    raise ValueError(f"{name}: the manifest has another size")
                rows, n, held = [], 0, 0
                with filesystem.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, block in read_records(stream):
                        rows.append(parse_record(headers, block))
                        n, held = n + 1, held + len(block)
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)
                if n != records:
                    raise ValueError(f"{name}: the manifest has another number of records")

    schema = ", ".join(RECORD_SCHEMA.split(", ")[:keep])
    return manifest.select("file", "records", "bytes").repartition(parts, "file").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = fresh_dir(spark, "warc")
    manifest = write_archives(read_table(spark, sf_dir, "pages"), uri)
    return read_archives(manifest, uri, with_payload=False).drop("url")


#: Base 32 takes five bits of the SHA-1 at a time.
SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p
), b AS (
  SELECT *, CAST(CAST(unhex(sha) AS BIT) AS VARCHAR) AS bits FROM f
)
SELECT page_id,
  CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
      + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
      + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""
