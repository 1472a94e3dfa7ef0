"""Exact deduplication by progressive refinement.

Rows are grouped by length, then by a hash of a short prefix, and only rows
whose (length, prefix) still has company are compared by a hash of the whole
text.  Each step groups fixed-width keys with partial aggregation, so a group
that holds a third of all rows costs one row per task in the shuffle.

``drop_exact_duplicates`` tells survivors in the scan by a bitmap of the shared
(length, prefix) keys: other rows are neither hashed nor moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import lower_ascii, text_or_empty
from .rows import keep_rows, packed, unpacked
from .store import materialise

PREFIX_CHARS = 128
#: Tasks, at most, over which the rows of one key are spread.
SALTS = 64
#: Bits of the survivors' bitmap for each shared key, and at most (64 MB); a fuller bitmap lets more rows through, and the result is the same.
KEY_BITS, MAX_BITS = 16, 1 << 29
_PAGE = 1 << 15


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
) -> DataFrame:
    """One row per input row: ``_row, id, digest, keep_id, group_size, kept``.

    Texts are equal when identical after lower-casing A-Z.  ``digest`` is the
    SHA-256 of the normalised text.  The row with the largest id stays; a null
    id loses to any other, and of rows that repeat the same id one stays.  Null
    texts count as empty and equal each other.  An empty table gives no rows.
    Columns other than the two named are not read.
    """
    norm = lower_ascii(text_or_empty(text_col))
    keys = materialise(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(f"`{id_col}`").alias("id"),
            F.octet_length(norm).alias("_len"),
            F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("_prefix"),
            F.unhex(F.sha2(norm, 256)).alias("digest"),
        ),
        "exact-keys",
    )
    # A key goes to the salts at which its rows stand, so the rows of a hot one are looked up in many tasks.
    survivors = keys = keys.withColumn("_salt", F.pmod("_row", F.lit(SALTS)).cast("int"))
    for step in (["_len"], ["_len", "_prefix"]):
        shared = survivors.groupBy(*step).agg(F.count(F.lit(1)).alias("_n"), F.collect_set("_salt").alias("_salts")).filter("_n > 1")
        survivors = survivors.join(shared.select(*step, F.explode("_salts").alias("_salt")), [*step, "_salt"], "left_semi")
    full = ["_len", "_prefix", "digest"]
    groups = (
        survivors.groupBy(*full)
        .agg(F.max(F.struct("id", "_row")).alias("_top"), F.count(F.lit(1)).alias("_n"), F.collect_set("_salt").alias("_salts"))
        .filter("_n > 1")
        .select(*full, "_top", "_n", F.explode("_salts").alias("_salt"))
    )
    return keys.join(groups, [*full, "_salt"], "left").select(
        "_row",
        "id",
        "digest",
        F.when(F.col("_n").isNull(), F.col("id")).otherwise(F.col("_top.id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).alias("group_size"),
        (F.col("_n").isNull() | (F.col("_row") == F.col("_top._row"))).alias("kept"),
    )


def _page_and_bit(key: Column, bits: int) -> tuple[Column, Column]:
    place = F.pmod(key, F.lit(bits))
    return F.floor(place / _PAGE).cast("int"), (place % _PAGE).cast("int")


def _survivors(docs: DataFrame, key: Column) -> DataFrame:
    """``docs`` as row structs with ``maybe``: the key's bit is set, which it is for every key of more than one row."""
    keys = docs.select(key.alias("k")).groupBy("k").count().filter("count > 1").select("k")
    shared = materialise(keys, "exact-shared")
    bits = _PAGE
    while bits < min(MAX_BITS, KEY_BITS * shared.count()):
        bits *= 2
    page, bit = _page_and_bit(F.col("k"), bits)
    # At most MAX_BITS bits in pages of 4 KB.
    pages = shared.select(page.alias("page"), bit.cast("long").alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    page, bit = _page_and_bit(F.col("k"), bits)
    rows = packed(docs, k=key).withColumns({"at": page, "bit": bit}).join(F.broadcast(pages), F.col("at") == F.col("page"), "left")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.select("row", F.coalesce(F.getbit(byte, F.col("bit") % 8) == 1, F.lit(False)).alias("maybe"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``docs`` without exact duplicates, all columns; which row stays: see ``duplicate_groups``.

    Lengths and prefixes are grouped first.  A row that is alone with its
    length and prefix passes as it is; the full hash is read for the others
    only, and only they are moved.
    """
    norm = lower_ascii(text_or_empty(text_col))
    rows = _survivors(docs, F.xxhash64(F.octet_length(norm), F.substring(norm, 1, prefix_chars)))
    alone, several = unpacked(rows.filter("not maybe")), unpacked(rows.filter("maybe"))
    digest = F.unhex(F.sha2(norm, 256))
    hashed = several.select(F.col(f"`{id_col}`").alias("id"), digest.alias("digest"))
    kept = hashed.groupBy("digest").agg(F.max(F.struct("id")).alias("top")).select("top.id", "digest")
    return alone.unionByName(keep_rows(several, kept, id_col, digest))
