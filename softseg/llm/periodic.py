"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q that is at least
``SHORTEST`` words and ``EXPONENT`` periods long and that no neighbouring word
extends.  It is found through one dyadic block that lies in it:

1. strings of 1, 2, 4, ... words are named by doubling (the dictionary of basic
   factors); the last names give the suffix array, those of a level the
   interval of the suffix array where a block's occurrences stand;
2. a run of length L holds an aligned block of b words, b the largest power of
   two up to L / EXPONENT, and the same block one period later, which is less
   than 2 b words away.  Range successor queries on a wavelet tree over the
   suffix array find the block's occurrences in the two windows of b places
   after it;
3. the occurrences in a window are an arithmetic progression.  Its first two
   terms are candidate periods; if it goes on, its difference is the block's
   own period and the ends of the two stretches of that period, around block
   and progression, give the others;
4. comparing names from long to short extends every candidate both ways.

All of it is numpy over some documents at a time: words are numbered by
document, so nothing matches across documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import text_or_empty

SHORTEST, EXPONENT = 24, 3
#: Words searched together, about; a longer text is searched alone.
WORDS = 200_000


class Factors:
    """Names of all strings of 1, 2, 4, ... words, by place; equal names at two places are equal whole strings.

    ``keys`` tell words of different texts apart, ``ends`` is the end of each
    place's text.  A name is the first place of the string's interval in the
    suffix array ``sa``.  Levels stop when all names differ, or at ``widest``.
    """

    def __init__(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, widest: int | None = None):
        n = len(keys)
        self.starts, self.ends = starts, ends
        sa = np.argsort(keys, kind="stable")
        new = np.ones(n, bool)
        new[1:] = keys[sa[1:]] != keys[sa[:-1]]
        name = np.empty(n, np.int64)
        name[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.levels, width = [name], 1
        while widest is None or width < widest:
            slots = np.flatnonzero(~(new & np.append(new[1:], True)))
            if not len(slots):
                break
            at = sa[slots]
            then = at + width
            second = np.where(then < ends[at], name[np.minimum(then, n - 1)], -1)
            pair = name[at] * (n + 1) + second + 1
            order = np.argsort(pair, kind="stable")
            at, pair = at[order], pair[order]
            sa[slots] = at
            head = np.ones(len(at), bool)
            head[1:] = pair[1:] != pair[:-1]
            new[slots[head]] = True
            name = name.copy()
            name[at] = np.maximum.accumulate(np.where(head, slots, 0))
            self.levels.append(name)
            width *= 2
        self.sa = sa

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words from which i and j (of one text, i < j) on agree."""
        i, first = i.copy(), i
        j = j.copy()
        last = len(self.sa) - 1
        for k in range(len(self.levels) - 1, -1, -1):
            same = (j < self.ends[first]) & (self.levels[k][np.minimum(i, last)] == self.levels[k][np.minimum(j, last)])
            i[same] += 1 << k
            j[same] += 1 << k
        return i - first

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words before i and j (of one text, i < j) that agree."""
        i, first = i.copy(), i
        j = j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            p, q = i - (1 << k), j - (1 << k)
            same = (p >= self.starts[first]) & (self.levels[k][np.maximum(p, 0)] == self.levels[k][np.maximum(q, 0)])
            i[same] -= 1 << k
            j[same] -= 1 << k
        return first - i


class WaveletTree:
    """Order queries on ranges of a permutation, by its bits from high to low."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.bits, self.zeros = max(1, int(self.n).bit_length()), []
        for bit in range(self.bits - 1, -1, -1):
            one = ((values >> bit) & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def _below(self, lo: np.ndarray, hi: np.ndarray, v: np.ndarray) -> np.ndarray:
        count = np.zeros(len(lo), np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            one, zl, zh = (v >> bit) & 1 == 1, zeros[lo], zeros[hi]
            count += np.where(one, zh - zl, 0)
            lo, hi = np.where(one, zeros[-1] + lo - zl, zl), np.where(one, zeros[-1] + hi - zh, zh)
        return count

    def successor(self, lo: np.ndarray, hi: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Smallest value >= v in [lo, hi) of each query; a number past all places if there is none."""
        rank = self._below(lo, hi, np.minimum(v, self.n))
        none = (rank >= hi - lo) | (v >= self.n)
        rank, out = np.where(none, 0, rank), np.zeros(len(lo), np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            zl, zh = zeros[lo], zeros[hi]
            one = rank >= zh - zl
            rank = np.where(one, rank - (zh - zl), rank)
            out |= one.astype(np.int64) << bit
            lo, hi = np.where(one, zeros[-1] + lo - zl, zl), np.where(one, zeros[-1] + hi - zh, zh)
        return np.where(none, np.iinfo(np.int64).max // 2, out)


def _candidates(found: Factors, smallest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs: a block at ``place`` stands again ``period`` words later."""
    tree, n, places, periods = WaveletTree(found.sa), len(found.sa), [], []

    def add(p: np.ndarray, d: np.ndarray, b: int) -> None:
        ok = (d > 0) & (d < 2 * b) & (p + d < found.ends[p])
        places.append(p[ok])
        periods.append(d[ok])

    for k in range(smallest.bit_length() - 1, len(found.levels)):
        b, level = 1 << k, found.levels[k]
        p = np.arange(0, n, b)
        size = np.bincount(level, minlength=n)
        p = p[(p + b <= found.ends[p]) & (size[level[p]] > 1)]
        if not len(p):
            continue
        lo, hi = level[p], level[p] + size[level[p]]
        # Periods up to b: the first occurrence after the block.
        add(p, tree.successor(lo, hi, p + 1) - p, b)
        # Periods from b to 2 b: the progression in the next window.
        first = tree.successor(lo, hi, p + b + 1)
        p, lo, hi, first = (x[first < p + 2 * b] for x in (p, lo, hi, first))
        add(p, first - p, b)
        second = tree.successor(lo, hi, first + 1)
        p, first, second = (x[second < p + 2 * b] for x in (p, first, second))
        add(p, second - p, b)
        step = second - first
        add(p, first + found.ahead(first, second) - p - found.ahead(p, p + step), b)
        add(p, first - found.behind(first, second) - p + found.behind(p, p + step), b)
    return np.concatenate(places) if places else np.zeros(0, np.int64), np.concatenate(periods) if periods else np.zeros(0, np.int64)


def find_runs(keys: np.ndarray, lengths: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs by start, then period.

    ``keys`` are the words of texts that lie one after another, ``lengths``
    their numbers of words; no run crosses from one text into the next.
    """
    if exponent < 3 or shortest < exponent:
        raise ValueError("runs need an exponent of at least 3 and as many words")
    none = (np.zeros(0, np.int64),) * 3
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    if not len(keys):
        return none
    keys = text * (int(keys.max()) + 1) + keys
    smallest = 1 << ((shortest // exponent).bit_length() - 1)
    brief = Factors(keys, (ends - lengths)[text], ends[text], smallest).levels
    # Without a block that repeats there is no run; most texts end here.
    repeated = np.bincount(brief[-1], minlength=len(keys))[brief[-1]] > 1
    keep = np.zeros(len(lengths), bool)
    keep[text[repeated]] = len(brief) == smallest.bit_length()
    if not keep.any():
        return none
    own = keep[text]
    offset = np.flatnonzero(own)
    sizes = lengths[keep]
    stop = np.cumsum(sizes)
    which = np.repeat(np.arange(len(sizes)), sizes)
    found = Factors(keys[own], (stop - sizes)[which], stop[which])
    p, d = _candidates(found, smallest)
    if not len(p):
        return none
    start = p - found.behind(p, p + d)
    length = p + d + found.ahead(p, p + d) - start
    ok = (length >= shortest) & (length >= exponent * d)
    start, length, d = start[ok], length[ok], d[ok]
    # A multiple of a period has the same stretch: the smallest stays.
    order = np.lexsort((d, length, start))
    start, length, d = start[order], length[order], d[order]
    once = np.ones(len(start), bool)
    once[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, d = start[once], length[once], d[once]
    order = np.lexsort((d, start))
    return offset[start[order]], length[order], d[order]


def _search(shortest: int, exponent: int) -> Callable:
    """(id, text) -> (id, n_words, runs, collapsed)."""

    def part(ids: pa.Array, words: list[list[bytes]]) -> pa.RecordBatch:
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.empty(int(lengths.sum()), object)
        flat[:] = [w for text in words for w in text]
        start, length, period = find_runs(pd.factorize(flat)[0].astype(np.int64), lengths, shortest, exponent)
        edge = np.zeros(len(flat) + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        dropped = np.cumsum(edge)[:-1] > 0
        ends = np.cumsum(lengths)
        text = np.searchsorted(ends, start, "right")
        collapsed = [b" ".join(w) for w in words]
        for t in np.unique(text):
            here = slice(ends[t] - lengths[t], ends[t])
            collapsed[t] = b" ".join(flat[here][~dropped[here]])
        start = start - (ends - lengths)[text]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(words)))]).astype(np.int32)
        runs = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())], names=["start", "length", "period"])
        columns = [ids, pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), runs), pa.array(collapsed, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, count, held = 0, 0, []
            for i, text in enumerate(batch.column(1)):
                words = bytes(text.as_buffer()).split()
                if held and count + len(words) > WORDS:
                    yield part(batch.column(0).slice(begin, len(held)), held)
                    begin, count, held = i, 0, []
                held.append(words)
                count += len(words)
            if held:
                yield part(batch.column(0).slice(begin, len(held)), held)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, exponent: int = EXPONENT) -> DataFrame:
    """One row per row of ``docs``: ``id, n_words, runs array<struct<start, length, period>>, collapsed``.

    Words are the runs of other bytes than ASCII white space, numbered from 0;
    ``runs`` come by start, then period.  ``collapsed`` is the text of the words
    that stay, joined by one space: a run keeps its first period only.  Null
    and empty texts have no words, no runs and an empty ``collapsed``; null and
    repeated ids are rows like any other; other columns are not read.  A text
    is searched whole, in memory that grows with the words of the longest text
    times its logarithm.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_search(shortest, exponent), f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
