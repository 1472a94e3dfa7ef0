"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits.  Of two fingerprints
within ``RADIUS`` = 2 bits, one segment differs in at most 2 // 2 = 1 bit.  So
every fingerprint stands in two tables under its segments, enumerates the
Hamming ball of radius 1 around each segment (33 values), fetches what the
table holds there, and the complete distance is verified.

A segment value that very many fingerprints share is indexed once more by the
other segment, cut into two parts of 16 bits: again one part differs in at
most one bit.  Then 48 bits are fixed, and what meets is looked up by the last
16.  A group gives pairs that join the members of
each of its components to one of them, never all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import row_digest, text_or_empty
from .components import connected_components
from .rows import keep_rows
from .store import materialise

SEGMENTS, SEGMENT_BITS, RADIUS = 2, 32, 2
#: Parts of the other segment by which a hot segment value is indexed.
PARTS, PART_BITS = 2, 16
SHINGLE_WORDS, SEED = 3, 42
#: Fingerprints under one segment value, at most, that are compared without a second index; hot values that are broadcast.
HOT_ROWS, BROADCAST_HOT = 1_024, 100_000
#: Bytes of a text that are cut into words in one go, and hashes counted in one go.
PIECE, BLOCK = 1 << 20, 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

#: A byte's bits, each in a lane of 16 bits: two words of four lanes.
_LANES = np.array([[sum(((b >> (4 * half + k)) & 1) << (16 * k) for k in range(4)) for half in range(2)] for b in range(256)], dtype=np.uint64)
#: Differences of up to ``RADIUS`` bits among the last 16.
_BALL = np.array([0, *(1 << i for i in range(16)), *((1 << i) | (1 << j) for i, j in combinations(range(16), 2))], dtype=np.int64)
#: Distances that are computed in one go.
CELLS = 1 << 22


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in ``hashes``."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK - 1):
        part = hashes[at : at + BLOCK - 1].astype("<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            lanes = _LANES[part[:, byte]].sum(axis=0, dtype=np.uint64)
            total[8 * byte : 8 * byte + 8] += lanes.astype("<u8").view("<u2")
    return total


def _shingles(raw: bytes, words: int) -> Iterator[list[bytes]]:
    """The shingles of a text, piece by piece; a text of fewer words is one shingle."""
    carry: list[bytes] = []
    at, some = 0, False
    while at < len(raw):
        space = _SPACE.search(raw, at + PIECE)
        stop = space.start() if space else len(raw)
        tokens = carry + raw[at:stop].split()
        at = stop
        if len(tokens) >= words:
            some = True
            yield list(map(b" ".join, zip(*(tokens[i:] for i in range(words)))))
            carry = tokens[len(tokens) - words + 1 :]
        else:
            carry = tokens
    if carry and not some:
        yield [b" ".join(carry)]


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a whole text; 0 for a text without words."""
    n, total = 0, np.zeros(64, np.int64)
    for block in _shingles((text or "").encode("utf-8", "surrogatepass").lower(), words):
        n += len(block)
        total += _bit_counts(np.fromiter(map(xxhash.xxh64_intdigest, block, repeat(SEED)), np.uint64, len(block)))
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, digest, fp long: the 64 bits as a signed number) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(2)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["id", "digest", "fp"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), row_digest(text).alias("digest"), text.alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, digest binary, fp long")


def _forest(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links (a, b) by place in ``fps`` -> pairs, one fewer than members, that join the same members."""
    root = np.arange(len(fps))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return list(zip(fps[moved].tolist(), fps[root[moved]].tolist()))


def ball_links(fps: np.ndarray, held: np.ndarray) -> list[tuple[int, int]]:
    """Links between the fingerprints that the table holds under a value and all that enumerated the value."""
    values, table = fps.view(np.uint64), np.flatnonzero(held)
    if len(table) == 0 or len(fps) < 2:
        return []
    found = []
    step = max(1, CELLS // len(fps))
    for at in range(0, len(table), step):
        some = table[at : at + step]
        t, q = np.nonzero(np.bitwise_count(values[some][:, None] ^ values[None, :]) <= RADIUS)
        t = some[t]
        found.append(np.stack([t[t != q], q[t != q]]))
    a, b = np.concatenate(found, axis=1)
    return _forest(fps, a, b) if len(a) else []


def part_links(fps: np.ndarray, held: np.ndarray, shift: int) -> list[tuple[int, int]]:
    """As ``ball_links`` where 48 bits of what the table holds are fixed: fetched by the 16 bits from ``shift`` on."""
    values, table = fps.view(np.uint64), np.flatnonzero(held)
    rest = ((values >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
    place = np.full(1 << 16, -1, np.int64)
    place[rest[table]] = table
    found = []
    for mask in _BALL:
        q = np.flatnonzero(place[rest ^ mask] >= 0)
        t = place[rest[q] ^ mask]
        near = (t != q) & (np.bitwise_count(values[t] ^ values[q]) <= RADIUS)
        if near.any():
            found.append(np.stack([t[near], q[near]]))
    a, b = np.concatenate(found, axis=1) if found else ((), ())
    return _forest(fps, a, b) if len(a) else []


def _bits(fp: Column, segment: Column | int, width: int) -> Column:
    return F.shiftrightunsigned(fp, segment * width).bitwiseAND(F.lit((1 << width) - 1)) if isinstance(segment, int) else F.when(segment == 0, _bits(fp, 0, width)).otherwise(_bits(fp, 1, width))


def _ball(value: Column, width: int) -> Column:
    """The values that differ from ``value`` in at most one bit."""
    return F.array(value, *[value.bitwiseXOR(F.lit(1 << i)) for i in range(width)])


def links(nodes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(fp) without repeats -> (a, b): links whose components are those of all pairs within two bits."""
    # One fingerprint becomes 66 rows, so few tasks of many fingerprints would be long ones.  A number given is kept, and a
    # key of its own keeps the shuffle from being taken for the one that found the fingerprints.
    nodes = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    segments = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), _bits(F.col("fp"), s, SEGMENT_BITS).alias("own")) for s in range(SEGMENTS)])).alias("k")
    own = nodes.select("fp", segments).select("fp", "k.s", "k.own")
    probes = own.withColumn("value", F.explode(_ball(F.col("own"), SEGMENT_BITS)))
    hot = materialise(own.groupBy("s", F.col("own").alias("value")).count().filter(F.col("count") > hot_rows).select("s", "value"), "simhash-hot")
    n_hot = hot.count()
    side = F.broadcast(hot) if n_hot <= BROADCAST_HOT else hot
    cold = probes.join(side, ["s", "value"], "left_anti") if n_hot else probes

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, value, fps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                fps = fps.values.to_numpy(zero_copy_only=False)
                own = (fps.view(np.uint64) >> np.uint64(SEGMENT_BITS * s)) & np.uint64((1 << SEGMENT_BITS) - 1)
                out += ball_links(fps, own == np.uint64(value))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, value, p, part, fps in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                fps = fps.values.to_numpy(zero_copy_only=False)
                other = (fps.view(np.uint64) >> np.uint64(SEGMENT_BITS * (1 - s))) & np.uint64((1 << SEGMENT_BITS) - 1)
                own = (fps.view(np.uint64) >> np.uint64(SEGMENT_BITS * s)) & np.uint64((1 << SEGMENT_BITS) - 1)
                held = (own == np.uint64(value)) & ((other >> np.uint64(PART_BITS * p)) & np.uint64(0xFFFF) == np.uint64(part))
                out += part_links(fps, held, SEGMENT_BITS * (1 - s) + PART_BITS * (1 - p))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    # A value under which the table holds nothing, or nothing but the one that asks, is not looked up.
    meet = cold.groupBy("s", "value").agg(F.collect_list("fp").alias("fps"), F.max((F.col("own") == F.col("value")).cast("int")).alias("held"))
    found = meet.filter("held = 1 and size(fps) > 1").select("s", "value", "fps").mapInArrow(near, "a long, b long")
    if not n_hot:
        return found
    other = _bits(F.col("fp"), 1 - F.col("s"), SEGMENT_BITS)
    parts = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), _ball(_bits(other, p, PART_BITS), PART_BITS).alias("ball")) for p in range(PARTS)])).alias("k")
    split = probes.join(side, ["s", "value"]).select("fp", "s", "value", parts).select("fp", "s", "value", "k.p", F.explode("k.ball").alias("part"))
    again = split.groupBy("s", "value", "p", "part").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")
    return found.union(again.select("s", "value", "p", "part", "fps").mapInArrow(parted, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, fp, component_id, kept_digest) of every row.

    ``component_id`` is the smallest id that can be reached by steps between
    fingerprints with at most two differing bits; ``kept_digest`` is that of
    the row that stands for the component.  Texts without words have the
    fingerprint zero and link like any other.  Null ids are never the smallest;
    a component of null ids only has a null one.  An empty table gives no rows.
    """
    rows = materialise(fingerprints(docs, id_col, text_col), "simhash")
    nodes = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "digest")).alias("first"))
    roots = connected_components(links(nodes.select("fp")))
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first").alias("least"))
    classes = labelled.join(smallest, "root").select("fp", F.col("least.id").alias("component_id"), F.col("least.digest").alias("kept_digest"))
    return rows.join(classes, "fp").select("id", "digest", "fp", "component_id", "kept_digest")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all columns: that with the smallest id."""
    found = near_duplicates(docs, id_col, text_col)
    kept = found.filter(F.col("id").eqNullSafe(F.col("component_id")) & (F.col("digest") == F.col("kept_digest")))
    return keep_rows(docs, kept.select("id", "digest"), id_col, row_digest(text_or_empty(text_col)))
