"""The operators applied to whole tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, mixing, packing, periodic, quality, sanitise, simhash, suffix_dedup, syncmers, token_tree, variants, warc
from .columns import WORD, id_bucket
from .store import new_path

Query = Callable[[SparkSession, str], DataFrame]

#: Bytes of a chunk of a record, which long pages exceed.
WARC_CHUNK = 1 << 14


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = langid.prototypes(docs.filter(id_bucket("doc_id", 4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", F.size("passages").cast("long").alias("n_passages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path, chunk=WARC_CHUNK)
    return warc.read_archives(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op6_token_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits of it: an insertion, a replacement and a deletion."""
    n, text = F.char_length("text"), F.col("text")
    edit = lambda start, deleted, inserted: F.struct(F.floor(start).cast("int").alias("start"), F.lit(deleted).alias("deleted"), inserted.alias("inserted"))
    edits = F.array(edit(n / 4, 0, F.substring(text, 1, 40)), edit(n / 2, 25, F.reverse(F.substring(text, 1, 16))), edit(3 * n / 4, 60, F.lit("")))
    found = token_tree.count_edits(_table(spark, sf_dir, "documents"), edits)
    return found.withColumnRenamed("id", "doc_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = syncmers.fingerprint_edits(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), id_bucket("_id", 5) != 0)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.find_personal(_table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        F.col("id").alias("doc_id"), *[number(kind) for kind in sanitise.KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_terms"),
    )


def _with_periods(docs: DataFrame) -> DataFrame:
    """``documents`` in which one text in ten, by a hash of its id, repeats a stretch of its words from some word to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    placed = words.withColumns({"n": F.when(n > 0, n), "g": g}).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), rest)), " ")
    return placed.select("doc_id", F.when(F.col("n").isNull(), F.col("text")).otherwise(changed).alias("text"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_with_periods(_table(spark, sf_dir, "documents")))
    # Exact comparison of length / period: by cross products.
    above = lambda s, t: s["length"] * t["period"] - t["length"] * s["period"]
    later = lambda s, t: F.when(above(s, t) != 0, -above(s, t)).when(s["start"] != t["start"], s["start"] - t["start"]).otherwise(s["period"] - t["period"])
    top = F.get(F.array_sort("runs", lambda s, t: F.signum(later(s, t)).cast("int")), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * top.length div top.period").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", "top.start", "top.length", "top.period", milli, "runs_sha256", "collapsed_sha256")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents``, of which a code point is deleted where 97 divides a hash of id and word; a null id deletes nothing."""
    runs = variants.letter_runs(_table(spark, sf_dir, "documents")).filter(F.char_length("run") >= variants.SHORTEST)
    h = F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % 97 == 0, damaged).otherwise(F.col("run")).alias("word"))
    return variants.spelling_variants(variants.word_counts(words, "word")).select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_mixing, op2_language, op3_repeats, op4_simhash, op5_warc, op6_token_edits, op7_exact_dedup, op8_syncmers, op9_quality, op10_packing, op11_sanitise, op12_periods, op13_spelling)}


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": OP5_SQL, "op7_exact_dedup": OP7_SQL}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = f"""
with t as (select doc_id, {_LOWER} as norm from documents)
select doc_id,
       max(doc_id) over (partition by norm) as keep_id,
       count(*) over (partition by norm) as group_size,
       doc_id = max(doc_id) over (partition by norm) as kept,
       sha256(norm) as text_sha256
from t
"""

#: Five bits at a time of the hex digits of SHA-1, as base32 letters.
_NIBBLE = "(strpos('0123456789abcdef', substr(h, {}, 1)) - 1)"
OP5_SQL = f"""
with t as (select page_id, url, coalesce(html, '') as body from pages),
d as (select page_id, url, body, octet_length(encode(body)) as payload_bytes, sha1(body) as h from t),
e as (
  select *, {" || ".join(
      "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ("
      + f"({_NIBBLE.format(5 * i // 4 + 1)} * 16 + {_NIBBLE.format(5 * i // 4 + 2)}) // {1 << (3 - 5 * i % 4)}"
      + ") % 32 + 1, 1)" for i in range(32))} as payload_digest,
    min(page_id) over (partition by h) as first
  from d)
select page_id, payload_bytes, payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to, url
from e
"""
