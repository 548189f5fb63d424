"""Deterministic sharded WARC output, and its reading.

Records are sorted by page (those of one page by a hash of url and html) and cut into shards of equal payload bytes. The cuts come from the exact
bytes before each record, so shards and files depend on the records alone, not on how the input lies in files or tasks. A shard's task writes gzip members of one record each
(no time stamps), rolls to the next file when the compressed size passes ``roll_bytes``, makes headers
and digests anew, and commits each file from a temporary name. The manifest is a Parquet table
written last: a reader takes only files that it lists, so leftovers of lost tasks never count. Reading checks each file's size,
CRC-32 and number of records against the manifest, and each record's block and payload digests; a damaged archive raises an error.

Among records of equal payload the one with the largest page id is a response, the others are revisits that refer to it;
payloads of fewer than ``least_bytes`` bytes are all responses. A null html is an empty payload. A null url becomes
``urn:page:<id>``. Records with a null page id are written last and never referred to while another of the group has an
id; rows that repeat the largest page id of a group are all responses. Line breaks in a url are escaped. Only the named
columns are read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .files import Committed, open_input

#: Groups of equal payloads up to this number (about 100 bytes each) are broadcast to the pages; more are shuffled.
BROADCAST_GROUPS = 100_000
#: Shards at most; their first keys (16 bytes each) go to the driver and to tasks.
MOST_SHARDS = 100_000
SPACE_OF_IDS = uuid.UUID("5c0f5a52-7f0e-5b0e-9e39-2f6a1d0c7a11")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_OF_IDS, f'{page_id}/{digest}')}>"


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """One gzip member: a response, or a revisit when ``refers_to`` is given."""
    digest = sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = (url if url else f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    whole = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(whole, compresslevel=6, mtime=0)


MANIFEST = "shard int, part int, name string, records long, bytes long, crc32 long"


def _write(folder: str, roll_bytes: int, date: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, part, out, count, crc = -1, 0, None, 0, 0
        done = []

        def close() -> None:
            nonlocal out, part, count, crc
            out.commit()
            done.append((shard, part, name, count, out.size, crc))
            out, part, count, crc = None, part + 1, 0, 0

        for frame in frames:
            for of, page_id, url, html, refers in zip(frame["shard"].tolist(), frame["page_id"], frame["url"], frame["html"], frame["refers"], strict=True):
                if of != shard:
                    if out is not None:
                        close()
                    shard, part = of, 0
                if out is None:
                    name = f"pages-{shard:05d}-{part:05d}.warc.gz"
                    out = Committed(folder, name)
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers, date)
                out.write(data)
                count, crc = count + 1, zlib.crc32(data, crc)
                if out.size >= roll_bytes:
                    close()
            yield pd.DataFrame(done, columns=[c.split()[0] for c in MANIFEST.split(", ")])
            done = []
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=[c.split()[0] for c in MANIFEST.split(", ")])

    return run


class Summed(io.RawIOBase):
    """A stream that keeps the size and CRC-32 of what was read from it."""

    def __init__(self, stream):
        self.stream, self.size, self.crc = stream, 0, 0

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        self.size, self.crc = self.size + len(data), zlib.crc32(data, self.crc)
        return len(data)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip stream, one at a time."""
    with gzip.open(io.BufferedReader(stream, 1 << 20)) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            head: dict[str, str] = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
                head[name] = value
            block = f.read(int(head["Content-Length"]))
            f.read(4)
            yield head, block


#: Ids are text outside Spark, for pandas would round a nullable integer beyond 2**53.
RECORD = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string"


def _read(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        table = lambda rows: pd.DataFrame(rows, columns=names, dtype=object).astype({"payload_bytes": "int64"})
        for frame in frames:
            for name, count, size, crc in zip(frame["name"], frame["records"], frame["bytes"], frame["crc32"], strict=True):
                rows = []
                with open_input(folder, name) as file:
                    stream = Summed(file)
                    for head, block in records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, response = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "response"
                        length = int(next(h.split(b": ")[1] for h in http.split(b"\r\n") if h.startswith(b"Content-Length")))
                        if head["WARC-Block-Digest"] != f"sha1:{sha1(block)}" or response and (sha1(payload) != digest or len(payload) != length):
                            raise ValueError(f"{name}: a record differs from its digest")
                        page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page")
                        rows.append((page, length, digest, head["WARC-Type"], refers, head["WARC-Target-URI"]))
                        count -= 1
                        if len(rows) >= 5000:
                            yield table(rows)
                            rows = []
                if count or (stream.size, stream.crc) != (size, crc):
                    raise ValueError(f"{name} is not the file of the manifest")
                yield table(rows)

    return run


def shard_starts(keys: DataFrame, shard_bytes: int, scratch: Scratch) -> list[tuple[int, int]]:
    """The first (k1, k2) of each shard, by the exact bytes of all records (k1, k2, size) before it.

    Records are placed by a range sort; where its partitions begin doesn't matter, for only sums over whole partitions and
    within one are added up.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keys.repartitionByRange(parts, "k1", "k2").sortWithinPartitions("k1", "k2").withColumn("at", F.monotonically_increasing_id())
    placed = scratch.keep(placed, "placed").withColumn("part", F.shiftright("at", 33))
    sums = placed.groupBy("part").agg(F.sum("size").alias("bytes"))
    before = sums.select("part", (F.sum("bytes").over(Window.orderBy("part")) - F.col("bytes")).alias("before"))  # a row a partition
    inside = F.sum("size").over(Window.partitionBy("part").orderBy("at")) - F.col("size")
    offset = placed.withColumn("inside", inside).join(F.broadcast(before), "part").select("k1", "k2", F.floor((F.col("before") + F.col("inside")) / shard_bytes).alias("shard"))
    first = offset.groupBy("shard").agg(F.min(F.struct("k1", "k2")).alias("k"))
    return sorted((r["k"]["k1"], r["k"]["k2"]) for r in first.collect())


def shard_of(starts: list[tuple[int, int]]):
    """A column function: the number of the shard that a key falls into."""

    @F.pandas_udf("int")
    def find(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series([max(0, bisect.bisect_right(starts, k) - 1) for k in zip(k1.tolist(), k2.tolist(), strict=True)], dtype="int32")

    return find


def write_warc(pages: DataFrame, folder: str, scratch: Scratch, roll_bytes: int = 64 << 20, least_bytes: int = 0, shard_bytes: int = 32 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the archive and return its manifest, a committed table. Shards grow beyond ``shard_bytes`` once there would be over ``MOST_SHARDS``."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    none = F.col("page_id").isNull()
    # null ids last; the second key tells records of one page apart
    order = {"k1": F.coalesce("page_id", F.lit(2**63 - 1)), "k2": F.xxhash64("url", "html").bitwiseAND(F.lit(2**62 - 1)) + F.when(none, F.lit(2**62)).otherwise(F.lit(0))}
    keys = pages.select("page_id", F.sha2(payload, 256).alias("key"), F.length(payload).alias("size"))
    groups = keys.filter(F.col("size") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 and last is not null").select("key", "last")
    groups = scratch.keep(groups, "groups")
    few = groups.count() <= BROADCAST_GROUPS
    sizes = pages.withColumns(order).select("k1", "k2", F.length(payload).cast("long").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    starts = shard_starts(sizes, max(shard_bytes, -(-total // MOST_SHARDS)), scratch)
    full = pages.withColumns(order).withColumn("key", F.sha2(payload, 256)).join(F.broadcast(groups) if few else groups, "key", "left")
    refers = F.when(none | (F.col("page_id") < F.col("last")), F.col("last"))
    dealt = full.select("k1", "k2", "page_id", "url", "html", refers.alias("refers")).withColumn("shard", shard_of(starts)("k1", "k2"))
    dealt = dealt.repartitionById(max(1, len(starts)), "shard").sortWithinPartitions("shard", "k1", "k2", "url", "html")
    dealt = dealt.select("shard", F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers").cast("string").alias("refers"))
    return scratch.keep(dealt.mapInPandas(_write(folder, roll_bytes, date), MANIFEST), "manifest")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the files that the manifest lists, which are dealt to as many tasks."""
    files = manifest.select("name", "records", "bytes", "crc32")
    out = files.repartition(max(1, manifest.count()), "name").mapInPandas(_read(folder), RECORD)
    return out.select(*(F.col(c).cast("long").alias(c) if c in ("page_id", "refers_to") else c for c in out.columns))


def round_trip(pages: DataFrame, roll_bytes: int = 64 << 20) -> DataFrame:
    scratch = Scratch(pages.sparkSession, "warc")
    folder = f"{scratch.root}/archive"
    return read_warc(write_warc(pages, folder, scratch, roll_bytes), folder)
