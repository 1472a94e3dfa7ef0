"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram binds its letters:
the vectors are rotated by their place and multiplied.  A text bundles (adds)
its n-gram vectors, a language prototype bundles the texts of the language,
and a text gets the language whose prototype has the largest cosine with it.

Vectors follow from the code points alone, so tasks agree without sharing
anything; a prototype sum leaves a task as one row per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

DIM, NGRAM, SEED = 1024, 3, 2
UNDETERMINED = "und"
#: Texts are bundled together up to so many code points and documents.
BLOCK_CHARS, BLOCK_DOCS = 1 << 20, 256
#: n-grams whose vectors exist at one time.
BLOCK_NGRAMS = 1 << 13


class Encoder:
    """Texts to bundles.  Letters are numbered as they are met; 0 is any run of other characters."""

    def __init__(self, dim: int = DIM) -> None:
        self.dim = dim
        self.number = np.full(0x110000, -1, np.int32)
        self.letters = [np.random.default_rng([SEED, 0x110000]).integers(0, 2, dim, np.int8) * 2 - 1]
        self.of: dict[int, int] = {}

    def _number(self, codes: np.ndarray) -> np.ndarray:
        """Letter numbers; capitals count as their small letters."""
        got = self.number[codes]
        for code in np.unique(codes[got < 0]).tolist():
            char = chr(code)
            low = ord(char.lower()[0]) if char.isalpha() else None
            if low is not None and low not in self.of:
                self.of[low] = len(self.letters)
                self.letters.append(np.random.default_rng([SEED, low]).integers(0, 2, self.dim, np.int8) * 2 - 1)
            self.number[code] = 0 if low is None else self.of[low]
        return self.number[codes]

    def ngrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """(document, n-gram code, base) of every n-gram; a text begins and ends with a 0, runs of 0 are one."""
        joined = "".join(f"\n{t}\n" for t in texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
        x = self._number(codes)
        keep = x > 0
        keep[1:] |= (x[:-1] > 0) | (doc[1:] != doc[:-1])
        keep[0] = True
        x, doc = x[keep].astype(np.int64), doc[keep]
        base = len(self.letters)
        n = len(x) - NGRAM + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), base
        code = x[:n]
        for k in range(1, NGRAM):
            code = code * base + x[k : n + k]
        inside = doc[:n] == doc[NGRAM - 1 :]
        return doc[:n][inside], code[inside], base

    def vectors(self, codes: np.ndarray, base: int) -> np.ndarray:
        out = np.ones((len(codes), self.dim), np.int8)
        table = np.stack(self.letters)
        for k in range(NGRAM):
            turned = np.roll(table, NGRAM - 1 - k, axis=1)
            out *= turned[codes // base ** (NGRAM - 1 - k) % base]
        return out

    def bundle(self, rows: np.ndarray, codes: np.ndarray, base: int, n_rows: int, weights: np.ndarray | None = None) -> np.ndarray:
        """(n_rows, dim): weighted sums of the n-gram vectors of each row."""
        if base**NGRAM <= 1 << 22:
            seen = np.zeros(base**NGRAM, bool)
            seen[codes] = True
            distinct = np.flatnonzero(seen)
            place = np.zeros(base**NGRAM, np.int64)
            place[distinct] = np.arange(len(distinct))
            at = place[codes]
        else:
            distinct, at = np.unique(codes, return_inverse=True)
        total = np.zeros((n_rows, self.dim), np.float32)
        for lo in range(0, len(distinct), BLOCK_NGRAMS):
            part = distinct[lo : lo + BLOCK_NGRAMS]
            pick = slice(None) if len(part) == len(distinct) else (at >= lo) & (at < lo + len(part))
            counts = np.bincount(rows[pick] * len(part) + (at[pick] - lo), None if weights is None else weights[pick], n_rows * len(part))
            total += counts.reshape(n_rows, -1).astype(np.float32) @ self.vectors(part, base).astype(np.float32)
        return total


def blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first place, texts) of runs within the block bounds; a longer text is a run of its own."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        if i > start and (chars + len(t) > BLOCK_CHARS or i - start >= BLOCK_DOCS):
            yield start, texts[start:i]
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, texts[start:]


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Language -> prototype, from rows with a language and a letter; every text weighs the same.

    What reaches the driver is one vector per language.
    """
    rows = docs.filter(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    rows = rows.select(F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            own = np.array([names.index(v) for v in langs])
            for at, texts in blocks(batch.column(1).to_pylist()):
                doc, codes, base = encoder.ngrams(texts)
                share = 1 / np.maximum(np.bincount(doc, minlength=len(texts)), 1)
                # A text without letters gives no n-gram of three characters.
                part = encoder.bundle(own[at + doc], codes, base, len(names), share[doc])
                for name, vector in zip(names, part):
                    sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "vector"])

    parts = rows.mapInArrow(run, "lang string, vector array<double>")
    total = parts.select("lang", F.posexplode("vector").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    got = total.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("v")).collect()
    return {r["lang"]: np.array(r["v"]) for r in got if any(r["v"])}


def identify(docs: DataFrame, learned: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (cosine, 0 to 1) instead of the text.

    Texts that are null or have no letter, and all texts if nothing was
    learned, get ``und`` and 0.  Of equal cosines the first language by name
    wins.  Input columns of the two result names are replaced.
    """
    names = sorted(learned)
    unit = np.stack([learned[n] / np.linalg.norm(learned[n]) for n in names]).astype(np.float32) if names else None
    held = docs.sparkSession.sparkContext.broadcast((names, unit))
    rest = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").cast("string").alias(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        names, unit = held.value
        for batch in batches:
            langs, scores = [], []
            for _, texts in blocks([t or "" for t in batch.column(len(rest)).to_pylist()]):
                doc, codes, base = encoder.ngrams(texts)
                vectors = encoder.bundle(doc, codes, base, len(texts))
                length = np.linalg.norm(vectors, axis=1)
                some = (np.bincount(doc, minlength=len(texts)) > 0) & (length > 0) & bool(names)
                cosine = (vectors @ unit.T) / np.maximum(length, 1e-9)[:, None] if names else np.zeros((len(texts), 1))
                best = cosine.argmax(axis=1)
                langs += [names[b] if s else UNDETERMINED for b, s in zip(best, some)]
                scores += np.where(some, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*rest, "lang_pred", "score"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def learn_and_identify(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows for which ``usable`` holds, predict every row."""
    learned = prototypes(docs.filter(usable), text_col, lang_col)
    return identify(docs, learned, text_col)
