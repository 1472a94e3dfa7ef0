"""WARC records as a chunked record table.

Archives are a table of (record, chunk, chunks, data): the data of a record's
chunks, in order, are its WARC bytes.  A payload that fits one chunk is one
row; an oversized one is cut into many as it is read, and from then on only
chunks are moved, sorted, written and read.  Writers and readers carry an
incremental SHA-1 from chunk to chunk, and readers compare it with the digest
in the record's header.

Payloads that repeat an earlier one are written as ``revisit`` records, which
name the record they refer to and carry no payload.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 1 << 20
#: Bytes of chunks that a task hands over at once, about, and tasks, at most, over which the rows of one payload are spread.
BATCH, SALTS = 8 << 20, 64
#: Smallest payload that may be written as a revisit.
MIN_REVISIT = 0
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:softseg:page"


def base32_of_hex(digest: Column) -> Column:
    """Bare upper-case base32 of 40 hex digits: 60 or 40 bits at a time through base 32, then the other alphabet."""
    parts = [F.lpad(F.conv(F.substring(digest, at, n), 16, 32), n * 4 // 5, "0") for at, n in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK, min_revisit: int = MIN_REVISIT) -> None:
    """One record per row of ``pages``, to the record table at ``path``.

    Of equal payloads of at least ``min_revisit`` bytes the record with the
    smallest id is the response (null ids come last; of repeated ids one), the
    others revisit it; smaller ones are all responses.  Null payloads are
    empty, null urls give no target header, other columns are not read.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("none")).alias("k"),
        F.regexp_replace(F.col(f"`{url_col}`").cast("string"), r"[\x00-\x20\x7f]", "%20").alias("url"),
        payload.alias("payload"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    keys = rows.select("id", "k", "payload").mapInArrow(_digests(chunk), f"id {kind}, k string, size long, digest binary")
    # A payload goes to the salts at which its rows stand, so those of a very common one are looked up in many tasks.
    keys = keys.filter(F.col("size") >= min_revisit).withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)))
    firsts = keys.groupBy("digest", "size").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.collect_set("salt").alias("salts")).filter("n > 1")
    firsts = firsts.select("digest", "size", "first", F.explode("salts").alias("salt"))
    again = keys.join(firsts, ["digest", "size", "salt"]).select("k", "digest", "first", F.lit(True).alias("_same")).distinct()
    # What moves are chunks, each once: the join and the numbering of rows that repeat both id and payload find them in place.
    rows = rows.mapInArrow(_chunks(chunk), f"id {kind}, k string, url string, size long, digest binary, row long, chunk int, chunks int, data binary")
    rows = rows.repartition("k", "digest").join(again, ["k", "digest"], "left")
    rows = rows.withColumn("nth", F.dense_rank().over(Window.partitionBy("k", "digest").orderBy("row")))
    revisit = F.col("_same").isNotNull() & ~(F.col("id").eqNullSafe(F.col("first")) & (F.col("nth") == 1))
    name = lambda c, nth: F.concat(F.lit(f"<{RECORD_URN}:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(":"), F.base64("digest"), F.lit(":"), nth.cast("string"), F.lit(">"))
    block = F.length(F.lit(HTTP_HEAD)) + F.when(revisit, 0).otherwise(F.col("size"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("id", F.col("nth"))),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.hex("digest")))),
        line("X-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", name("first", F.lit(1))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit("\r\n" + HTTP_HEAD),
    ).cast("binary")
    rows = rows.filter(~revisit | (F.col("chunk") == 0)).withColumn("chunks", F.when(revisit, 1).otherwise(F.col("chunks")))
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("data"))
    first, last = F.when(F.col("chunk") == 0, head).otherwise(F.lit(b"")), F.when(F.col("chunk") == F.col("chunks") - 1, F.lit(b"\r\n\r\n")).otherwise(F.lit(b""))
    rows.select(name("id", F.col("nth")).alias("record"), "chunk", "chunks", F.concat(first, body, last).alias("data")).write.parquet(path)


def _payload_digest(payload: memoryview, chunk: int) -> bytes:
    """SHA-1, carried from chunk to chunk."""
    digest = hashlib.sha1()
    for at in range(0, len(payload), chunk):
        digest.update(payload[at : at + chunk])
    return digest.digest()


def _digests(chunk: int) -> Callable:
    """(id, k, payload) -> (id, k, size, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = [memoryview(x.as_buffer()) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array([len(v) for v in views], pa.int64()), pa.array([_payload_digest(v, chunk) for v in views], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "k", "size", "digest"])

    return run


def _chunks(chunk: int) -> Callable:
    """(id, k, url, payload) -> a row for each chunk, in batches of about ``BATCH`` bytes; an empty payload is one empty chunk."""
    names = ["id", "k", "url", "size", "digest", "row", "chunk", "chunks", "data"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            of, rows, held = [], [], 0

            def out() -> pa.RecordBatch:
                some = batch.select([0, 1, 2]).take(pa.array(of, pa.int64()))
                return pa.RecordBatch.from_arrays([*some.columns, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=names)

            for i, value in enumerate(batch.column(3)):
                payload = memoryview(value.as_buffer())
                digest, chunks = _payload_digest(payload, chunk), max(1, -(-len(payload) // chunk))
                for n in range(chunks):
                    data = bytes(payload[n * chunk : (n + 1) * chunk])
                    of.append(i)
                    rows.append((len(payload), digest, row, n, chunks, data))
                    held += len(data)
                    if held >= BATCH:
                        yield out()
                        of, rows, held = [], [], 0
                row += 1
            if rows:
                yield out()

    return run


@dataclass
class Record:
    """A record as it is read; ``feed`` takes the chunks' bytes in order."""

    headers: dict[str, str] = field(default_factory=dict)
    size: int = 0
    left: int = -1
    head: bytes = b""
    digest: object = field(default_factory=hashlib.sha1)

    def feed(self, data: memoryview | bytes) -> None:
        if self.left < 0:
            self.head += bytes(data)
            if b"\r\n\r\n" not in self.head:
                return
            top, _, rest = self.head.partition(b"\r\n\r\n")
            if not self.headers:
                lines = top.decode("utf-8", "surrogateescape").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("not a WARC record")
                self.headers = {name.strip(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
                self.left_in_block = int(self.headers["Content-Length"])
                self.head = b""
                self.feed(rest)
                return
            self.left = self.left_in_block - len(top) - 4
            self.head, data = b"", rest
        part = memoryview(data)[: self.left]
        self.digest.update(part)
        self.size += len(part)
        self.left -= len(part)

    def result(self) -> dict:
        if self.left:
            raise ValueError(f"record {self.headers.get('WARC-Record-ID')} is cut short")
        kind, found = self.headers.get("WARC-Type"), b32encode(self.digest.digest()).decode()
        said = self.headers.get("WARC-Payload-Digest", f"sha1:{found}")
        said = said.removeprefix("sha1:")
        size = int(self.headers.get("X-Payload-Length", self.size))
        if kind == "response" and (size != self.size or found != said):
            raise ValueError(f"record {self.headers.get('WARC-Record-ID')} doesn't match its digest")
        return {
            "id": _id_in(self.headers.get("WARC-Record-ID", "")),
            "url": self.headers.get("WARC-Target-URI"),
            "record_type": kind,
            "payload_bytes": size,
            "payload_digest": said,
            "refers_to": _id_in(self.headers.get("WARC-Refers-To", "")),
        }


def _id_in(urn: str) -> int | None:
    """The page of a record of our own; other records have none."""
    value = urn.removeprefix(f"<{RECORD_URN}:").partition(":")[0]
    return int(value) if value.lstrip("-").isdigit() else None


SCHEMA = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(id, url, record_type, payload_bytes, payload_digest, refers_to) of every record at ``path``.

    Raises if a response's payload doesn't match its digest or a record is cut
    short.  Ids are whole numbers; a null one is read back as null, as is that
    of a record that was not written here; headers that such a record lacks are
    filled in from what was read.
    """
    table = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for chunk, chunks, data in zip(*(batch.column(i) for i in range(3))):
                if chunk.as_py() == 0:
                    now = Record()
                now.feed(memoryview(data.as_buffer()))
                if chunk.as_py() == chunks.as_py() - 1:
                    out.append(now.result())
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    schema = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    cols = ["chunk", "chunks", "data"]
    small = table.filter("chunks = 1").select(*cols).mapInArrow(run, schema)
    # The chunks of a large record meet in one task and stream through it.
    large = table.filter("chunks > 1").repartition("record").sortWithinPartitions("record", "chunk").select(*cols).mapInArrow(run, schema)
    return small.union(large)
