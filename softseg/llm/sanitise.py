"""Personal data by patterns, and by what words disclose of it.

Patterns give the base: emails, ip addresses, card and phone numbers.  Every
value so found is a protected entity.  The words and pairs of words that stand
near its mentions are weighed by co-occurrence over the whole corpus: a term t
discloses an entity e by their pointwise mutual information,

    PMI(e; t) = log2 (n(e, t) N / (n(e) n(t))),

of documents that have t near e, e, and t, where mentions of e that have t
between the same two neighbours count once, so that copies of a text are one
piece of evidence.  It is at most the information content of the entity, IC(e)
= log2 (N / n(e)), which it reaches if t never stands elsewhere.  A term is
disclosing if its PMI is at least ``BITS`` and falls short of IC(e) by at most
``GAP`` bits, with ``SUPPORT`` such mentions behind it.  Disclosing terms are generalised to the
class of words that begin alike if that class discloses nothing, and removed
otherwise; so are they where the entity itself is not mentioned.

All of it is DataFrame functions.  The words of all texts are hashed in one
scan; what does not meet a near term's hash leaves it by bitmaps of bounded
size, and what is left serves both the counts and the marks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap_of
from .columns import row_digest, text_or_empty
from .rows import row_key
from .store import materialise

_LOCAL = "[A-Za-z0-9._%+-]"
#: Fixed patterns, in the order in which kinds are listed.  Each starts where a leftmost match can start, and what can't be given back is possessive, so that a long run is read once.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: Kind of the spans that the method adds.
TERM = "term"
TERM_WORD = r"[\p{L}\p{N}]+"
#: Code points on either side of a mention in which a term is near it.
REACH = 120
#: Code points of a term, at least, and of the beginning that names its class.
TERM_CHARS, CLASS_CHARS = 4, 3
SUPPORT, BITS, GAP = 3, 4.0, 1.0
REMOVED = "[removed]"
#: Tasks, at most, over which the rows of one entity or document are spread.
SALTS = 16
#: Bits of the first of the two bitmaps of near terms, which the plan holds as a literal of 32 KB whatever the corpus.
COARSE_BITS = 1 << 18
#: Items of a prefix sum that are added up one by one.
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x)


def _places(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def sums_before(numbers: Column) -> Column:
    """For each item of an array of ints the sum of those before it; blocks are added up first, so long arrays stay cheap."""

    def with_blocks(a: Column) -> Column:
        blocks = F.transform(_places(F.ceil(F.size(a) / _BLOCK).cast("int")), lambda b: _total(F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK))))
        heads = lambda s: F.transform(_places(F.size(s)), lambda b: _total(F.slice(s, F.lit(1), b)))
        item = lambda h: F.transform(_places(F.size(a)), lambda i: F.get(h, F.floor(i / _BLOCK).cast("int")) + _total(F.slice(a, i - i % _BLOCK + 1, i % _BLOCK)))
        return let(blocks, lambda s: let(heads(s), item))

    return let(numbers, with_blocks)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return _total(F.transform(F.sequence(F.lit(1), n), worth)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """Whether a match counts; one that fails is dropped, and nothing in it is tried again."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.char_length(part(p)) < 3) | ((F.char_length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.char_length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.char_length(_digits(value)).between(8, 15)
    return F.lit(True)


def _pieces(text: Column, pattern: str, body: Callable[[Column, Column], Column], none: Column) -> Column:
    """``body`` of the matches of a pattern and the gaps around them, one more; ``none`` where nothing matches."""
    cut = lambda m: let(F.split(text, pattern, -1), lambda gaps: body(m, gaps))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, cut(m)).otherwise(none))


def _edge(context: Column, cut: Column, pattern: str) -> Column:
    """A context without the word that its far end may cut."""
    return F.when(cut, F.regexp_replace(context, pattern, "")).otherwise(context)


_MENTION = "array<struct<kind: string, start: int, end: int, entity: string, before: string, after: string>>"


def _mentions(text: Column, kind: str) -> Column:
    """Valid matches of a kind with their places in code points, their entity, and the text around up to the next match."""

    def found(matches: Column, gaps: Column) -> Column:
        sizes = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.char_length(m) + F.char_length(g))

        def one(start: Column) -> Column:
            def at(i: Column) -> Column:
                m, before, after = F.get(matches, i), F.get(gaps, i), F.get(gaps, i + 1)
                first = F.get(start, i) + F.char_length(before)
                entity = F.concat(F.lit(f"{kind}:"), F.lower(m) if kind == "email" else m if kind == "ip" else _digits(m))
                return F.struct(
                    F.lit(kind).alias("kind"), first.alias("start"), (first + F.char_length(m)).alias("end"), entity.alias("entity"),
                    _edge(F.right(before, F.lit(REACH + 1)), F.char_length(before) > REACH, rf"^{TERM_WORD}").alias("before"),
                    _edge(F.left(after, F.lit(REACH + 1)), F.char_length(after) > REACH, rf"{TERM_WORD}$").alias("after"),
                )

            return F.transform(F.filter(_places(F.size(matches)), lambda i: _valid(kind, F.get(matches, i))), at)

        return let(sums_before(sizes), one)

    return _pieces(text, PATTERNS[kind], found, F.array().cast(_MENTION))


#: What a text must have to hold a match, as a cheaper test.
_SIGNS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}


def _all_mentions(text: Column) -> Column:
    some = lambda kind: F.when(F.rlike(text, F.lit(_SIGNS[kind])), _mentions(text, kind)).otherwise(F.array().cast(_MENTION))
    return F.concat(*[some(kind) for kind in KINDS])


def _key(id_col: str, text_col: str) -> Column:
    return row_key(F.col(f"`{id_col}`"), row_digest(text_or_empty(text_col)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, key, mentions) of every row, written; ``key`` stands for id and text, so rows that repeat both share it."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), _key(id_col, text_col).alias("key"), text_or_empty(text_col).alias("text"))
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "id", "key", _all_mentions(F.col("text")).alias("mentions")), "sanitise-scan")


def _hash(term: Column) -> Column:
    """The hash of a word, class or pair; that of a pair is taken of its two words, so a scan need not join them."""
    return F.when(F.contains(term, F.lit(" ")), F.xxhash64(F.substring_index(term, " ", 1), F.substring_index(term, " ", -1))).otherwise(F.xxhash64(term))


def _class_of(word: Column) -> Column:
    return F.concat(F.left(word, F.lit(CLASS_CHARS)), F.lit("*"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_WORD), F.lit(0))


def _is_term(word: Column) -> Column:
    return F.char_length(word) >= TERM_CHARS


def _near_terms(context: Column) -> Column:
    """(term, beside) of the words, pairs and classes in a context; ``beside`` stands for the words next to it."""

    def of(w: Column) -> Column:
        beside = lambda i, width: F.hash(F.coalesce(F.when(i > 0, F.get(w, i - 1)), F.lit("")), F.coalesce(F.get(w, i + width), F.lit("")))
        places = F.filter(_places(F.size(w)), lambda i: _is_term(F.get(w, i)))
        words = F.transform(places, lambda i: F.struct(F.get(w, i).alias("term"), beside(i, 1).alias("beside")))
        classes = F.transform(places, lambda i: F.struct(_class_of(F.get(w, i)).alias("term"), beside(i, 1).alias("beside")))
        pairs = F.transform(_places(F.greatest(F.size(w) - 1, F.lit(0))), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)).alias("term"), beside(i, 2).alias("beside")))
        return F.concat(words, classes, pairs)

    return let(_words(context), of)


def _coarse(near: DataFrame) -> Column:
    """Whether ``hash`` may be among those of ``near``: a test by one bit of COARSE_BITS."""
    word, bit = F.shiftright(F.pmod("hash", F.lit(COARSE_BITS)), 6), F.expr("shiftleft(1L, cast(hash & 63 as int))")
    words = dict(near.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).collect())
    bits = F.split(F.lit(",".join(str(words.get(i, 0)) for i in range(COARSE_BITS // 64))), ",").cast("array<long>")
    return F.getbit(F.get(bits, word.cast("int")), F.col("hash").bitwiseAND(F.lit(63)).cast("int")) == 1


def _seen(docs: DataFrame, near: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, key, hash) of the words, classes and pairs of all texts whose hash is among those of ``near``, once a row, written."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), _key(id_col, text_col).alias("key"), _words(text_or_empty(text_col)).alias("word"))
    next_ = F.slice("word", F.lit(2), F.greatest(F.size("word") - 1, F.lit(0))).alias("next")
    words = texts.select("row", "key", "word", next_).select("row", "key", F.explode(F.arrays_zip("word", "next")).alias("w"))
    word, after = F.col("w.word"), F.col("w.next")
    alone = F.when(_is_term(word), F.xxhash64(word))
    class_ = F.when(_is_term(word), F.xxhash64(_class_of(word)))
    pair = F.when(after.isNotNull(), F.xxhash64(word, after))
    hashes = words.select("row", "key", F.explode(F.array(alone, class_, pair)).alias("hash")).filter(F.col("hash").isNotNull() & _coarse(near))
    return materialise(bitmap_of(near, "hash").passed(hashes, "hash").distinct(), "sanitise-seen")


def _near_counts(scanned: DataFrame, n_docs: int) -> DataFrame:
    """(entity, term, n_both, n_entity) of terms near enough entities to weigh them, written."""
    rows = scanned.filter(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m"))
    rows = rows.select("row", "m.entity", "m.before", "m.after").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    # An entity is looked up at the salts at which its mentions stand, so those of a very common one by many tasks.
    held = rows.groupBy("entity", "row").agg(F.first("salt").alias("salt")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.collect_set("salt").alias("salts"))
    content = F.log2(F.lit(float(max(n_docs, 1))) / F.col("n_entity"))
    weighed = held.filter((F.col("n_entity") >= SUPPORT) & (content >= BITS)).select("entity", "n_entity", F.explode("salts").alias("salt"))
    near = rows.join(weighed, ["entity", "salt"]).select("row", "entity", "n_entity", F.explode(F.concat(_near_terms(F.col("before")), _near_terms(F.col("after")))).alias("t"))
    once = near.groupBy("entity", "t.term", "row").agg(F.min("t.beside").alias("beside"), F.first("n_entity").alias("n_entity"))
    found = once.groupBy("entity", "term").agg(F.count_distinct("beside").alias("n_both"), F.max("n_entity").alias("n_entity"))
    found = found.filter(F.col("n_both") >= SUPPORT).withColumn("hash", _hash(F.col("term")))
    # A term stands in as many documents, at least, as have it near any mention: by that alone most common words disclose nothing.
    hashes = F.transform(F.concat(_near_terms(F.col("before")), _near_terms(F.col("after"))), lambda t: _hash(t["term"]))
    around = rows.select("row", F.explode(hashes).alias("hash")).distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_term"))
    return materialise(found.join(around, "hash").filter(_discloses(n_docs)).drop("n_term"), "sanitise-near")


def _bits(n_docs: int) -> Column:
    """Pointwise mutual information of entity and term."""
    return F.log2(F.col("n_both") * F.lit(float(n_docs)) / (F.col("n_entity") * F.col("n_term")))


def _discloses(n_docs: int) -> Column:
    return (_bits(n_docs) >= BITS) & (_bits(n_docs) >= F.log2(F.lit(float(n_docs)) / F.col("n_entity")) - GAP)


_DISCLOSING = "term string, hash long, generalise boolean, bits double"


def _weigh(docs: DataFrame, scanned: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(term, hash, generalise, bits) of the terms that disclose, and where near terms stand; both written, the latter None without near terms."""
    n_docs = scanned.count()
    near = _near_counts(scanned, n_docs)
    if near.isEmpty():
        return docs.sparkSession.createDataFrame([], _DISCLOSING), None
    seen = _seen(docs, near.select("hash"), id_col, text_col)
    counts = seen.groupBy("hash").agg(F.count(F.lit(1)).alias("n_term"))
    over = materialise(near.join(counts, "hash").filter(_discloses(n_docs)).select("entity", "term", "hash", _bits(n_docs).alias("bits")), "sanitise-over")
    is_class = F.endswith("term", F.lit("*"))
    classes = over.filter(is_class).select("entity", F.col("term").alias("class"), F.lit(True).alias("discloses"))
    terms = over.filter(~is_class).select("entity", "term", "hash", "bits", F.explode(F.transform(F.split("term", " "), _class_of)).alias("class"))
    judged = terms.join(classes, ["entity", "class"], "left").groupBy("term", "hash").agg(F.every(F.col("discloses").isNull()).alias("generalise"), F.max("bits").alias("bits"))
    return materialise(judged, "sanitise-terms"), seen


def disclosing_terms(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, hash, generalise, bits): terms that disclose an entity, by counts over all documents, written.

    ``generalise`` tells that the classes of the term's words disclose nothing.
    """
    return _weigh(docs, scanned, id_col, text_col)[0]


def _marks(seen: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, marks map<term, generalise>) of the documents in which disclosing terms stand, written."""
    # A term goes to all salts, so the documents of a common one are looked up in many tasks.
    salted = seen.select("key", "hash", F.pmod(F.crc32("key"), F.lit(SALTS)).cast("int").alias("salt"))
    every = terms.select("term", "hash", "generalise", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    held = salted.join(every, ["hash", "salt"]).groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("term", "generalise"))).alias("marks"))
    return materialise(held, "sanitise-marks")


def _marked(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text, marks) of the documents that have marks, one row a key; others' texts stay where they are."""
    rows = docs.select(_key(id_col, text_col).alias("key"), text_or_empty(text_col).alias("text")).withColumn("kh", F.xxhash64("key"))
    maybe = bitmap_of(marks.select(F.xxhash64("key").alias("kh")), "kh").passed(rows, "kh")
    return maybe.join(marks, "key").select("key", "text", "marks").dropDuplicates(["key"])


def _word_marks(words: Column, marks: Column) -> Column:
    """For each word null, or whether it is generalised (else removed): by itself or a pair that it is in; removal goes first."""
    low = F.transform(words, F.lower)

    def of(w: Column) -> Column:
        pair = lambda i: F.element_at(marks, F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
        return F.transform(_places(F.size(w)), lambda i: F.least(F.element_at(marks, F.get(w, i)), pair(i), F.when(i > 0, pair(i - 1))))

    return let(low, of)


def _term_spans(text: Column, marks: Column, base: Column) -> Column:
    """Places of marked words outside the base spans."""
    kind = "array<struct<start: int, end: int>>"

    def found(words: Column, gaps: Column) -> Column:
        sizes = F.zip_with(words, F.slice(gaps, F.lit(1), F.size(words)), lambda w, g: F.char_length(w) + F.char_length(g))

        def spans(start: Column, marked: Column) -> Column:
            def at(i: Column) -> Column:
                first = F.get(start, i) + F.char_length(F.get(gaps, i))
                return F.struct(first.alias("start"), (first + F.char_length(F.get(words, i))).alias("end"))

            return F.transform(F.filter(_places(F.size(words)), lambda i: F.get(marked, i).isNotNull()), at)

        all_ = let(sums_before(sizes), lambda start: let(_word_marks(words, marks), lambda marked: spans(start, marked)))
        return F.filter(all_, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    return _pieces(text, TERM_WORD, found, F.array().cast(kind))


def _span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``id, base, terms``, arrays of (kind, start, end) in code points, ``end`` excluded.

    ``base`` are the matches of the patterns by kind as listed, then start;
    matches of different kinds may overlap.  ``terms`` are the words by which
    the method adds, in order, none of which overlaps the base.  Null texts
    count as empty and have no spans; rows with null or repeated ids are rows
    like any other, and rows that repeat id and text get equal spans; no rows
    give no rows; other columns are not read.
    """
    scanned = scan(docs, id_col, text_col)
    base = F.transform("mentions", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    rows = scanned.select("row", "id", "key", base.alias("base"))
    terms, seen = _weigh(docs, scanned, id_col, text_col)
    kind = "array<struct<kind: string, start: int, end: int>>"
    if terms.isEmpty():
        return rows.select("id", "base", F.array().cast(kind).alias("terms"))
    texts = _marked(docs, _marks(seen, terms), id_col, text_col).withColumn("base", _all_mentions(F.col("text")))
    added = F.transform(_term_spans(F.col("text"), F.col("marks"), F.col("base")), lambda s: F.struct(F.lit(TERM).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    found = materialise(texts.select("key", added.alias("terms")).filter(F.size("terms") > 0), "sanitise-added")
    # Rows that repeat id and text share a key: its spans go to all salts.
    salted = rows.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    every = found.select("key", "terms", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return salted.join(every, ["key", "salt"], "left").select("id", "base", F.coalesce("terms", F.array().cast(kind)).alias("terms"))


def _replaced(text: Column, kind: str) -> Column:
    """The text with a mark for every valid match of a kind."""
    mark = lambda m: F.when(_valid(kind, m), F.lit(f"[{kind}]")).otherwise(m)
    return _pieces(text, PATTERNS[kind], lambda m, gaps: F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: F.concat(g, mark(x))), ""), F.element_at(gaps, -1)), text)


def _without_terms(text: Column, marks: Column, base: Column) -> Column:
    """The text with marked words outside the base spans generalised or removed."""

    def of(words: Column, gaps: Column) -> Column:
        sizes = F.zip_with(words, F.slice(gaps, F.lit(1), F.size(words)), lambda w, g: F.char_length(w) + F.char_length(g))

        def joined(start: Column, marked: Column) -> Column:
            def at(i: Column) -> Column:
                w, first = F.get(words, i), F.get(start, i) + F.char_length(F.get(gaps, i))
                free = ~F.exists(base, lambda b: (b["start"] < first + F.char_length(w)) & (first < b["end"]))
                changed = F.when(F.get(marked, i), _class_of(w)).otherwise(F.lit(REMOVED))
                return F.concat(F.get(gaps, i), F.when(F.get(marked, i).isNotNull(), F.when(free, changed).otherwise(w)).otherwise(w))

            return F.concat(F.array_join(F.transform(_places(F.size(words)), at), ""), F.element_at(gaps, -1))

        return let(sums_before(sizes), lambda start: let(_word_marks(words, marks), lambda marked: joined(start, marked)))

    return _pieces(text, TERM_WORD, of, text)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data out of ``text_col``: values by their kind, disclosing terms generalised or removed; nulls stay null."""
    terms, seen = _weigh(docs, scan(docs, id_col, text_col), id_col, text_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(id_col, text_col).alias("key"), text_or_empty(text_col).alias("text"))
    if terms.isEmpty():
        rows = packed.withColumn("clean", F.lit(None).cast("string"))
    else:
        texts = _marked(docs, _marks(seen, terms), id_col, text_col).withColumn("base", _all_mentions(F.col("text")))
        clean = materialise(texts.select("key", _without_terms(F.col("text"), F.col("marks"), F.col("base")).alias("clean")), "sanitise-clean")
        every = clean.select("key", "clean", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rows = packed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(every, ["key", "salt"], "left")
    text = F.coalesce("clean", "text")
    for kind in KINDS:
        text = _replaced(text, kind)
    text = F.when(F.col("row").getField(text_col).isNotNull(), text)
    return rows.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
