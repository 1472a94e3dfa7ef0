"""Document fingerprints from closed syncmers, in DataFrame functions only.

A k-mer is ``K`` code points that follow one another anywhere in a text.  It
is a closed syncmer if, of its inner substrings of ``INNER`` code points, one
with the smallest hash stands at its first or last place.  That depends on the
k-mer alone: an edit moves no anchor outside the k-mers that it touches, in
text with or without white space.  A fingerprint is all syncmers of a text
with their positions.

Because anchors know nothing of their context, those of a text put together
from parts of other texts are the parts' own, shifted, and the few k-mers
across the seam; an edited text is never hashed as a whole.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import row_digest, text_or_empty

#: Code points of a k-mer and of its inner substrings; one k-mer in twelve, about, is a syncmer.
K, INNER = 32, 9
PLACES = K - INNER + 1
#: k-mers looked at in one go, which bounds the memory for a long text.
BLOCK = 4096
#: Bits of a hash in a fingerprint; the position stands above them.
HASH_BITS = 32
#: Neighbour search: bytes of text in a bucket of ids, at most about, and buckets for each shuffle partition.
BUCKET_BYTES, BUCKETS_PER_PARTITION = 256 << 20, 4


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _code_points(text: Column) -> Column:
    """Four bytes for each code point, so that a place is found without counting."""
    return F.encode(text, "UTF-32")


def _part(points: Column, start: Column, n: Column) -> Column:
    return F.substring(points, 4 * start + 1, 4 * n)


def _anchor(pos: Column, points: Column) -> Column:
    return F.shiftleft(pos.cast("long"), HASH_BITS).bitwiseOR(F.xxhash64(points).bitwiseAND(F.lit((1 << HASH_BITS) - 1)))


def _ahead(x: Column, step: int) -> Column:
    """Minimum of each item and the one ``step`` places on; beyond the end there is none."""
    return _let(x, lambda y: F.zip_with(y, F.slice(y, F.lit(step + 1), F.size(y)), lambda a, b: F.least(a, b)))


def _block_anchors(points: Column, offset: Column) -> Column:
    """Anchors of a stretch of at least ``K`` code points that starts at ``offset`` of its text."""
    n = (F.octet_length(points) / 4).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), n - INNER), lambda i: F.xxhash64(_part(points, i, F.lit(INNER))))

    def of_hashes(h: Column) -> Column:
        # Eight places at a time; three such runs make up the places of a k-mer.
        eight = _ahead(_ahead(_ahead(h, 1), 2), 4)
        return _let(eight, lambda m: F.filter(F.sequence(F.lit(0), n - K), lambda i: F.least(F.get(h, i), F.get(h, i + PLACES - 1)) <= F.least(*[F.get(m, i + at) for at in range(0, PLACES, 8)])))

    return F.transform(_let(hashes, of_hashes), lambda i: _anchor(offset + i, _part(points, i, F.lit(K))))


def _kmer_anchors(points: Column) -> Column:
    """Anchors of code points, block by block; fewer than ``K`` have none."""
    kmers = (F.octet_length(points) / 4).cast("int") - K + 1
    starts = F.sequence(F.lit(0), kmers - 1, F.lit(BLOCK))
    found = F.flatten(F.transform(starts, lambda at: _let(_part(points, at, F.lit(BLOCK + K - 1)), lambda p: _block_anchors(p, at))))
    return F.when(kmers > 0, found).otherwise(F.array().cast("array<bigint>"))


def _all_anchors(points: Column) -> Column:
    short = F.when(F.octet_length(points) > 0, F.array(_anchor(F.lit(0), points))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.octet_length(points) < 4 * K, short).otherwise(_kmer_anchors(points))


def all_anchors(text: Column) -> Column:
    """The syncmers of a whole text in order, each as position << 32 | hash.

    A text shorter than a k-mer is one anchor, an empty one has none.
    """
    return _let(_code_points(text), _all_anchors)


def _pos(anchor: Column) -> Column:
    return F.shiftrightunsigned(anchor, HASH_BITS)


def joined_anchors(a: Column, a_anchors: Column, a_len: Column, b: Column, b_anchors: Column, b_len: Column) -> Column:
    """Anchors of the first ``a_len`` code points of ``a`` followed by the first ``b_len`` of ``b``, from the anchors of both."""
    inside = lambda anchors, n: F.filter(anchors, lambda x: _pos(x) + K <= n)
    shift = lambda anchors, n: F.transform(anchors, lambda x: x + F.shiftleft(n.cast("long"), HASH_BITS))

    def of_lengths(n: Column) -> Column:
        left = F.least(n["a"], F.lit(K - 1))
        seam = F.concat(F.substring(a, n["a"] - left + 1, left), F.substring(b, F.lit(1), F.least(n["b"], F.lit(K - 1))))
        across = shift(_let(_code_points(seam), _kmer_anchors), n["a"] - left)
        whole = F.concat(F.substring(a, F.lit(1), n["a"]), F.substring(b, F.lit(1), n["b"]))
        return F.when(n["a"] + n["b"] < K, all_anchors(whole)).otherwise(F.concat(inside(a_anchors, n["a"]), across, shift(inside(b_anchors, n["b"]), n["a"])))

    # Counted once: inside a function of anchors the lengths would be counted for each of them.
    return _let(F.struct(a_len.alias("a"), b_len.alias("b")), of_lengths)


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, anchors array<struct<pos, hash>>): the syncmers of every row by code point, for positional matching.

    Null texts count as empty and have no anchor.
    """
    found = F.transform(all_anchors(text_or_empty(text_col)), lambda x: F.struct(_pos(x).cast("int").alias("pos"), x.bitwiseAND(F.lit((1 << HASH_BITS) - 1)).alias("hash")))
    return docs.select(F.col(f"`{id_col}`").alias("id"), found.alias("anchors"))


def as_text(anchors: Column) -> Column:
    """Anchors as a string, sixteen hex digits each: position, then hash."""
    return F.lower(F.array_join(F.transform(anchors, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of the hashes of two texts' complete anchors, exact on them; two empty ones are alike."""
    hashes = lambda x: F.array_distinct(F.transform(x, lambda y: y.bitwiseAND(F.lit((1 << HASH_BITS) - 1))))
    dice = _let(F.struct(hashes(a).alias("x"), hashes(b).alias("y")), lambda s: 2 * F.size(F.array_intersect(s["x"], s["y"])) / F.nullif(F.size(s["x"]) + F.size(s["y"]), F.lit(0)))
    return F.coalesce(dice, F.lit(1.0))


def _bounds(docs: DataFrame) -> tuple[list[dict], str]:
    """The largest (id, digest) of each bucket but the first, descending, and their type; narrow rows only are sorted for it.

    Their number follows the session's shuffle partitions and the size of the
    texts, and is what the driver holds.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(BUCKETS_PER_PARTITION * parts, -(-size // BUCKET_BYTES))
    keys = docs.select(F.struct("id", "digest").alias("k"))
    ranged = keys.repartitionByRange(buckets, F.col("k").desc()).groupBy(F.spark_partition_id().alias("part")).agg(F.max("k").alias("k"))
    found = ranged.select("k").distinct().orderBy(F.col("k").desc()).select(F.to_json("k").alias("k"))
    return [json.loads(r["k"]) for r in found.collect()][1:], keys.schema["k"].dataType.simpleString()


def _bucket(key: Column, bounds: list[dict], kind: str) -> Column:
    """How many bounds ``key`` does not lie above: rows of descending keys; a short search among parts, then one within the part."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    nested = F.from_json(F.lit(json.dumps([bounds[i : i + width] for i in range(0, len(bounds), width)])), f"array<array<{kind}>>")
    before = lambda items: F.size(F.filter(items, lambda b: key <= b))
    coarse = F.size(F.filter(nested, lambda part: key <= F.get(part, F.lit(0))))
    return F.when(coarse == 0, 0).otherwise(_let(coarse, lambda c: width * (c - 1) + before(F.get(nested, c - 1))))


def with_next(docs: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """(id, digest, text, carried...) with ``next_`` columns from the following row by descending id; after the last comes the first.

    Null ids come last, rows of equal id by digest.  Rows are dealt to buckets
    of neighbouring (id, digest); the first row of a bucket also goes to the
    end of the bucket before it, so the texts move once, and ``carried`` is
    computed after they have moved.
    """
    bounds, kind = _bounds(docs)
    key = F.struct("id", "digest")
    placed = docs.withColumn("bucket", _bucket(key, bounds, kind))
    heads = placed.groupBy("bucket").agg(F.max(F.struct("id", "digest")).alias("head"))
    # One row per bucket: as many as there are bounds.
    up = Window.orderBy("bucket")
    heads = heads.withColumn("before", F.coalesce(F.lag("bucket").over(up), F.max("bucket").over(Window.partitionBy())))
    placed = placed.join(F.broadcast(heads), "bucket")
    again = F.when(key.eqNullSafe(F.col("head")), F.array(F.struct(F.lit(False).alias("copy"), F.col("bucket").alias("to")), F.struct(F.lit(True).alias("copy"), F.col("before").alias("to"))))
    placed = placed.withColumn("d", F.explode(F.coalesce(again, F.array(F.struct(F.lit(False).alias("copy"), F.col("bucket").alias("to"))))))
    placed = placed.select("id", "digest", "text", F.col("d.to").alias("to"), F.col("d.copy").alias("copy")).repartition("to").withColumns(carried)
    order = Window.partitionBy("to").orderBy("copy", F.col("id").desc_nulls_last(), F.col("digest").desc())
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *carried)]
    return placed.select("id", "digest", "text", *carried, "copy", *following).filter("not copy").drop("copy")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, whose second half comes from the next row's beginning.

    (id, n_chars, edited, fingerprint, edited_fingerprint, near_edited,
    near_next).  Ids may be of any type that orders.  Null texts count as
    empty; an empty text stays as it is and has the empty fingerprint.  An only
    row is its own next row; an empty table gives no rows.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).withColumn("digest", row_digest(F.col("text")))
    pairs = with_next(rows, {"fp": all_anchors(F.col("text"))})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    taken = F.least(half, F.char_length("next_text"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), taken))
    pairs = pairs.withColumns({"edited": edited, "edited_fp": joined_anchors(F.col("text"), F.col("fp"), n - half, F.col("next_text"), F.col("next_fp"), taken)})
    return pairs.select(
        "id",
        n.cast("long").alias("n_chars"),
        "edited",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
