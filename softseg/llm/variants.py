"""Spelling variants by asymmetric q-chunks.

Two words are near if one insertion, deletion or replacement of a code point
makes one the other.  Of two words the shorter (either, if equally long)
contributes two disjoint chunks, its first and last half; the other one its
positional grams of that length.  One edit leaves one of the chunks whole, and
moves it by at most one place: the first half stands at the start of the other
word, or the last half at its end, so of the grams within shift one of a
chunk's place only those two are emitted.  Words that share a chunk are
verified by their edit distance.

A chunk that many words share on both sides is not joined: the edit then lies
in the rest of the word, which is halved again, and the key grows by that
half, until few words share it or one place is left, where the alphabet bounds
them.  So no pair is lost and none of a large group is spelt out.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import lower_ascii, text_or_empty
from .store import materialise

#: A word: letters, of ASCII or the Latin-1 block.
LETTERS = r"[A-Za-zÀ-ÿ]+"
SHORTEST, LEAST = 5, 3
#: How many times commoner a word's form is.
COMMONER = 2
#: Words on the narrower side of a chunk that is joined, at most.
NARROW = 16
#: Rows of one chunk from which they are spread, and the tasks that they are spread over, at most.
WIDE, SALTS = 1_000, 64
MAX_ROUNDS = 64


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): every maximal run of letters with A-Z in lower case, repeats included; null texts have none."""
    runs = F.regexp_extract_all(lower_ascii(text_or_empty(text_col)), F.lit(LETTERS.replace("A-Z", "")), F.lit(0))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(runs).alias("run"))


def word_counts(words: DataFrame, column: str, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): values of ``column`` of at least ``shortest`` code points that occur ``least`` times or more."""
    long = words.select(F.col(f"`{column}`").alias("word")).filter(F.char_length("word") >= shortest)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _halves(rows: DataFrame) -> DataFrame:
    """The two parts of each row's open places [lo, hi) in which the edit may be, with the key of what is then known to be equal."""
    half = F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
    parts = F.array(F.struct((F.col("lo") + half).alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), (F.col("hi") - half).alias("hi")))
    out = rows.select("word", "n", "size", "base", "chunk", F.explode(parts).alias("at")).select("word", "n", "size", "base", "chunk", "at.lo", "at.hi")
    before = F.substring("word", F.lit(1), F.col("lo"))
    after = F.substring("word", F.col("hi") + F.col("size") - F.col("base") + 1, F.col("size"))
    key = F.xxhash64("base", "lo", "hi", before, after)
    return out.withColumn("key", key).withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))


def _with_sides(rows: DataFrame) -> DataFrame:
    """Rows of keys that both sides have, with ``narrow``, the words on the narrower one, and the salts at which each is joined."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    salts = lambda c: F.collect_set(F.when(c, F.col("salt")))
    sides = rows.groupBy("key").agg(
        one(F.col("chunk")).alias("chunks"), one(~F.col("chunk")).alias("grams"),
        salts(F.col("chunk")).alias("chunk_salts"), salts(~F.col("chunk")).alias("gram_salts"), F.collect_set("salt").alias("salts"),
    ).filter("chunks > 0 and grams > 0")
    # A key is looked up at the salts at which its rows stand, so a very common one by many tasks.
    sides = sides.select("key", "chunks", "grams", "chunk_salts", "gram_salts", F.explode("salts").alias("salt"))
    narrow = F.col("chunk") == (F.col("chunks") <= F.col("grams"))
    wide = F.greatest("chunks", "grams") > WIDE
    other = F.when(F.col("chunk"), F.col("gram_salts")).otherwise(F.col("chunk_salts"))
    at = F.when(~wide, F.array(F.lit(0))).when(narrow, other).otherwise(F.array("salt"))
    return rows.join(sides, ["key", "salt"]).select("word", "n", "size", "base", "chunk", "lo", "hi", "key", F.least("chunks", "grams").alias("narrow"), at.alias("at"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n) of distinct words -> (a, a_n, b, b_n): every pair of words one edit apart, once."""
    size = F.char_length("word")
    words = words.select("word", "n", size.alias("size"))
    roles = F.array(
        F.struct(F.col("size").alias("base"), F.lit(True).alias("chunk")),
        F.struct(F.col("size").alias("base"), F.lit(False).alias("chunk")),
        F.struct((F.col("size") - 1).alias("base"), F.lit(False).alias("chunk")),
    )
    rows = words.select("word", "n", "size", F.explode(roles).alias("r")).filter("r.base >= 0").select("word", "n", "size", "r.base", "r.chunk", F.lit(0).alias("lo"), F.col("r.base").alias("hi"))
    found = []
    for nth in range(MAX_ROUNDS):
        # Overlapping parts of the round before may have a part in common.
        parts = _halves(rows).distinct() if nth else _halves(rows)
        keyed = materialise(_with_sides(parts), "variant-keys")
        last = (F.col("narrow") <= NARROW) | (F.col("hi") - F.col("lo") <= 1)
        side = lambda chunk, a: keyed.filter(last & (F.col("chunk") == chunk)).select("key", F.explode("at").alias("at"), F.col("word").alias(a), F.col("n").alias(f"{a}_n"), "size", "base")  # noqa: B023, E731
        short, long = side(True, "a").drop("size", "base"), side(False, "b")
        once = (F.col("size") > F.col("base")) | (F.col("a") < F.col("b"))
        pairs = short.join(long, ["key", "at"]).filter(once & (F.levenshtein("a", "b", 1) == 1))
        found.append(materialise(pairs.select("a", "a_n", "b", "b_n").distinct(), "variant-pairs"))
        rows = keyed.filter(~last)
        if rows.isEmpty():
            return functools.reduce(DataFrame.union, found).distinct()
    raise RuntimeError(f"chunks did not end in {MAX_ROUNDS} rounds")


def _roots(links: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the last word that the forms lead to, by doubling the steps."""
    now = materialise(links.select("word", F.col("form").alias("root")), "variant-roots")
    for _ in range(MAX_ROUNDS):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = now.join(further, "root", "left")
        now = materialise(ahead.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
    raise RuntimeError(f"forms did not end in {MAX_ROUNDS} rounds")


def spelling_variants(words: DataFrame, commoner: int = COMMONER) -> DataFrame:
    """(word, n) -> ``word, n, n_near, form, form_n, root``, one row per word.

    ``n_near`` counts the words one edit away.  ``form`` is the commonest of
    them, of equals the first in code-point order, if it is at least
    ``commoner`` times as common; else it and ``form_n`` are null.  ``root`` is
    where the forms lead, the word itself if it has none.  Words are expected
    distinct, with counts above zero and ``commoner`` above one; null words
    have no near words.  No words give no rows.
    """
    if commoner < 2:
        raise ValueError("forms may run in circles unless they are commoner")
    words = materialise(words.select("word", F.col("n").cast("long").alias("n")), "variant-words")
    pairs = near_pairs(words.filter("word is not null"))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(pairs.select("b", "a", "a_n"))
    top: Column = F.min(F.struct((-F.col("near_n")).alias("rank"), "near"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), top.alias("top"))
    has = -F.col("top.rank") >= F.col("n") * commoner
    out = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("top.near")).alias("form"), F.when(has, -F.col("top.rank")).alias("form_n")
    )
    out = materialise(out, "variant-forms")
    return out.join(_roots(out.filter("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
