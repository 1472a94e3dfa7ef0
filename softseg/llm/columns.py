"""Small column helpers that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the operators define words by.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def id_bucket(name: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.pmod(F.crc32(F.col(f"`{name}`").cast("string").cast("binary")), F.lit(n))


def row_digest(text: Column) -> Column:
    """16 bytes that tell texts apart where an id does not."""
    return F.unhex(F.md5(text.cast("binary")))
