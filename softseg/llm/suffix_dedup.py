"""Removal of long repeated byte strings by sorting suffixes, deep-shallow.

A string of ``LENGTH`` bytes is a repeat if it also starts anywhere else.  Its
anchor, the leftmost smallest hash of the ``CORE``-byte strings in it, depends
on its bytes alone, so equal strings have equal anchors at equal places.  Only
suffixes that start at anchors whose core occurs twice have to be sorted:

1. every text gives its anchors; those with a unique core are dropped;
2. the others fetch their surroundings from the text and meet by core;
3. their suffixes, and their prefixes read backwards, are sorted: a multikey
   quicksort by words to a shallow depth, then a blind trie for each group
   that still agrees there.  Sorted neighbours' common prefixes give, for each
   place of the anchor, the classes of strings that agree to the right and to
   the left; two anchors in the same two classes are one repeated string;
4. the covered bytes return to their text.

Everything is keyed by text, not row, so copies of a text are sorted once.

Strings of ``WORDS`` words that are shorter than ``LENGTH`` bytes take the same
way: their anchors are found and their suffixes sorted together with the
others.  They are not removed; they are reported as passages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import text_or_empty, word_count

LENGTH, CORE = 400, 150
#: Places that an anchor can have in a string.
PLACES = LENGTH - CORE + 1
#: Words of a passage: strings of so many words and ``CORE`` to ``LENGTH`` bytes are looked for as well.
WORDS = 51
#: Bytes hashed in one go; longer texts are read in overlapping pieces.
PIECE = 1 << 21
#: Depth in bytes at which blind tries take over from multikey quicksort.
SHALLOW = 224
#: Surroundings sorted together, about.
SORT_ROWS = 40_000
#: Anchors that may share a core; those of commoner cores are split by ``SPLIT`` places each, and meet by the longer core.
HOT_ROWS, SPLIT = 20_000, 8
#: Bytes before the anchor by which the passages of a hot core are split.
WORD_SPLIT = 64
#: Tasks, at most, over which the anchors of one core are spread.
SALTS = 64
_SPACE = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))
_BASE = 0x9E3779B97F4A7C15 | 1
_LOCAL = np.uint64((1 << 24) - 1)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = PIECE + 2 * LENGTH
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, _BASE, np.uint64))
        down = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))
    return up, down


def core_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of every CORE-byte string."""
    up, down = _powers()
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
        h = (total[CORE:] - total[:-CORE]) * down[: len(raw) - CORE + 1]
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA5CB9243F1E3C49B)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
        h ^= h >> np.uint64(32)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    square = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of x[lo .. hi] of each pair, both included, from minima over runs of 1, 2, 4, ... items."""
    out = np.empty(len(lo), x.dtype)
    level = np.frexp((hi - lo + 1).astype(float))[1] - 1
    for j in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero(level == j)
        out[own] = np.minimum(x[lo[own]], x[hi[own] - (1 << j) + 1])
        x = np.minimum(x[: -(1 << j)], x[1 << j :])
    return out


def word_windows(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of every string of ``WORDS`` words and ``CORE`` to ``LENGTH`` - 1 bytes; none crosses an end of a text."""
    word = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends[ends < len(raw)]] = True
    edge[0] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    start, stop = start[: max(0, len(start) - WORDS + 1)], stop[WORDS - 1 :]
    inside = np.searchsorted(ends, start, "right") == np.searchsorted(ends, stop - 1, "right")
    keep = inside & (stop - start >= CORE) & (stop - start < LENGTH)
    return start[keep], stop[keep]


def _runs(place: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last item of every run of equal (place, text)."""
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    return head, np.concatenate([head[1:], [len(place)]])[: len(head)] - 1


FIELDS = ("text", "place", "least", "most", "before", "after", "h")


def anchors(raw: np.ndarray, ends: np.ndarray, owned: tuple[int, int] | None = None) -> tuple[np.ndarray, ...]:
    """``FIELDS`` of the anchors of texts that lie one after another and end at ``ends``.

    ``place`` is counted from the start of all texts; the anchor belongs to the
    strings that start from ``place - most`` to ``place - least`` (none if
    ``most`` < ``least``) and to the passages from ``place - before`` to
    ``place + after`` (none if both are 0).  Only strings that start in
    ``owned`` count, if it is given.
    """
    if len(raw) < CORE:
        return (np.zeros(0, np.int64),) * 6 + (np.zeros(0, np.uint64),)
    h = core_hashes(raw)
    ranked = (h & ~_LOCAL) | np.arange(len(h), dtype=np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    n = np.maximum(ends - starts - LENGTH + 1, 0)
    s = np.arange(n.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    text, (w, stop) = np.repeat(np.arange(len(ends)), n), word_windows(raw, ends)
    if owned:
        here = (s >= owned[0]) & (s < owned[1])
        s, text = s[here], text[here]
        here = (w >= owned[0]) & (w < owned[1])
        w, stop = w[here], stop[here]
    place = (_sliding_min(ranked, PLACES)[s] & _LOCAL).astype(np.int64) if len(s) else s
    head, tail = _runs(place, text)
    w_place = (_range_min(ranked, w, stop - CORE) & _LOCAL).astype(np.int64)
    w_head, w_tail = _runs(w_place, w_place)
    every, at = np.unique(np.concatenate([place[head], w_place[w_head]]), return_inverse=True)
    least, most, before, after = (np.full(len(every), v) for v in (0, -1, 0, 0))
    at, w_at = at[: len(head)], at[len(head) :]
    least[at], most[at] = place[head] - s[tail], place[head] - s[head]
    before[w_at], after[w_at] = w_place[w_head] - w[w_head], stop[w_tail] - w_place[w_head]
    return np.searchsorted(ends, every, "right"), every, least, most, before, after, h[every]


def text_anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """``FIELDS`` of the anchors of texts of any length; ``place`` is counted in the text."""
    batch: list[int] = []
    size = 0

    def together() -> tuple[np.ndarray, ...]:
        ends = np.cumsum([len(texts[i]) for i in batch])
        text, place, *rest = anchors(np.frombuffer(b"".join(texts[i] for i in batch), np.uint8), ends)
        return np.array(batch)[text], place - np.concatenate([[0], ends[:-1]])[text], *rest

    for i, t in enumerate(texts):
        if len(t) > PIECE:
            # One byte before and LENGTH after a piece show where its words begin and end.
            for lo in range(0, len(t), PIECE):
                at = max(lo - 1, 0)
                part = np.frombuffer(t[at : lo + PIECE + LENGTH], np.uint8)
                text, place, *rest = anchors(part, np.array([len(part)]), (lo - at, lo - at + PIECE))
                yield text + i, place + at, *rest
            continue
        if batch and size + len(t) > PIECE:
            yield together()
            batch, size = [], 0
        batch.append(i)
        size += len(t)
    if batch:
        yield together()


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of distinct strings and each one's common prefix with the one before (first: 0).

    A node holds the depth of a branch and its children by the byte there (-1:
    the string ends).  A string walks down by branch bytes only, is compared
    once with the leaf it comes to, and is put in where the two part.
    """
    root: list | int = 0
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while not isinstance(node, int):
            depth, children = node
            node = children.get(s[depth] if depth < len(s) else -1)
            if node is None:
                node = next(iter(children.values()))
        other = strings[node]
        depth = _common(s, other)
        above, key, node = None, None, root
        while not isinstance(node, int) and node[0] < depth:
            above, key = node, s[node[0]] if node[0] < len(s) else -1
            node = above[1].get(key)
        mine = s[depth] if depth < len(s) else -1
        if not isinstance(node, int) and node[0] == depth:
            node[1][mine] = i
            continue
        branch = [depth, {mine: i, other[depth] if depth < len(other) else -1: node}]
        if above is None:
            root = branch
        else:
            above[1][key] = branch
    order, common, stack = [], [], [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, int):
            order.append(node)
            common.append(shared)
            continue
        depth, children = node
        for k, byte in reversed(list(enumerate(sorted(children)))):
            stack.append((children[byte], depth if k else shared))
    return order, common


def deep_shallow(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): strings sorted within ``group``, and each one's common prefix with the one before.

    Strings of different groups have nothing in common.
    """
    n = len(strings)
    words = max(1, SHALLOW // 8)
    joined = b"".join(s[: 8 * words].ljust(8 * words, b"\0") for s in strings)
    table = np.frombuffer(joined, ">u8").reshape(n, words)
    lengths = np.fromiter(map(len, strings), np.int64, n)
    order = np.argsort(group, kind="stable")
    start = np.ones(n, bool)  # a class begins here
    start[1:] = group[order][1:] != group[order][:-1]
    common = np.zeros(n, np.int64)
    for w in range(words):
        number = np.cumsum(start) - 1
        many = np.flatnonzero(np.bincount(number)[number] > 1)
        if not len(many):
            break
        key = table[order[many], w].astype(np.uint64)
        way = np.lexsort((key, number[many]))
        order[many], key = order[many][way], key[way]
        part = (key[1:] != key[:-1]) & (number[many][1:] == number[many][:-1])
        cut = many[1:][part]
        differ = (key[1:] ^ key[:-1])[part]
        same = np.zeros(len(differ), np.int64)
        for byte in range(1, 8):
            same += differ >> np.uint64(64 - 8 * byte) == 0
        common[cut] = 8 * w + same
        start[cut] = True
    heads = np.flatnonzero(start)
    for lo, hi in zip(heads, [*heads[1:], n]):
        if hi - lo == 1:
            continue
        alike: dict[bytes, list[int]] = {}
        for i in order[lo:hi]:
            alike.setdefault(strings[i], []).append(i)
        distinct = list(alike)
        rank, shared = blind_trie(distinct) if len(distinct) > 1 else ([0], [0])
        at = lo
        for r, c in zip(rank, shared):
            for k, i in enumerate(alike[distinct[r]]):
                if at > lo:
                    common[at] = len(distinct[r]) if k else c
                order[at] = i
                at += 1
    # Padding may have stood in for bytes that a shorter string lacks.
    common[1:] = np.minimum(common[1:], np.minimum(lengths[order[1:]], lengths[order[:-1]]))
    return order, common


class Sorted:
    """Surroundings of anchors, sorted to the right and to the left within their group.

    ``around[i]`` has ``left[i]`` bytes before the anchor.
    """

    def __init__(self, around: list[bytes], left: np.ndarray, group: np.ndarray) -> None:
        self.n = len(around)
        self.right_order, self.right = deep_shallow([a[m:] for a, m in zip(around, left)], group)
        self.left_order, self.left = deep_shallow([a[:m][::-1] for a, m in zip(around, left)], group)
        # In different groups nothing is shared, not even the empty string.
        self.edge_r = np.ones(self.n, bool)
        self.edge_l = np.ones(self.n, bool)
        self.edge_r[1:] = group[self.right_order][1:] != group[self.right_order][:-1]
        self.edge_l[1:] = group[self.left_order][1:] != group[self.left_order][:-1]

    def left_class(self, depth: int) -> np.ndarray:
        """Equal numbers for anchors with the same ``depth`` bytes before them."""
        out = np.empty(self.n, np.int64)
        out[self.left_order] = np.cumsum(self.edge_l | (self.left < depth))
        return out

    def repeated_places(self, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor, the smallest and largest place at which its string is a repeat; (-1, -1) if none."""
        low, high = np.full(self.n, -1), np.full(self.n, -1)
        right_class = np.empty(self.n, np.int64)
        some = most >= least
        if not some.any():
            return low, high
        for place in range(int(least[some].min()), int(most.max()) + 1):
            own = np.flatnonzero((least <= place) & (place <= most))
            if len(own) < 2:
                continue
            right_class[self.right_order] = np.cumsum(self.edge_r | (self.right < LENGTH - place))
            key = right_class[own] * (self.n + 1) + self.left_class(place)[own]
            way = np.argsort(key)
            ranked = key[way]
            same = np.zeros(len(own), bool)
            same[1:] = ranked[1:] == ranked[:-1]
            same[:-1] |= ranked[1:] == ranked[:-1]
            hit = own[way[same]]
            low[hit] = np.where(low[hit] < 0, place, low[hit])
            high[hit] = place
        return low, high

    def repeated_windows(self, row: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Which strings, of ``before`` bytes before and ``after`` bytes from the anchor of ``row`` on, are repeats."""
        found = np.zeros(len(row), bool)
        if not len(row):
            return found
        rank = np.empty(self.n, np.int64)
        rank[self.right_order] = np.arange(self.n)
        shared = np.where(self.edge_r, -1, self.right)
        by_depth = np.argsort(before, kind="stable")
        for own in np.split(by_depth, np.flatnonzero(np.diff(before[by_depth])) + 1):
            side = self.left_class(int(before[own[0]]))[row[own]]
            way = own[np.lexsort((rank[row[own]], after[own], side))]
            side = self.left_class(int(before[own[0]]))[row[way]]
            pair = np.flatnonzero((side[1:] == side[:-1]) & (after[way[1:]] == after[way[:-1]]))
            if len(pair):
                least = _range_min(shared, rank[row[way[pair]]] + 1, rank[row[way[pair + 1]]])
                pair = pair[least >= after[way[pair]]]
                found[way[pair]] = found[way[pair + 1]] = True
        return found


def _split(raw: memoryview, h: int, place: int, least: int, most: int, before: int, after: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(group, least, most, before, after) for every few places of a hot anchor: the group is a hash of all bytes that its strings share.

    Equal strings have equal places, so they stay together; strings that only
    have the common core in common part.
    """

    def group(kind: int, part: memoryview) -> int:
        key = h.to_bytes(8, "little", signed=True) + kind.to_bytes(4, "little", signed=True)
        return int.from_bytes(hashlib.blake2b(part, digest_size=8, key=key).digest(), "little", signed=True)

    for lo in range(least - least % SPLIT, most + 1, SPLIT):
        hi = lo + SPLIT - 1
        yield group(lo, raw[max(place - lo, 0) : place - hi + LENGTH]), max(lo, least), min(hi, most), 0, 0
    if before or after:
        start, stop = word_windows(np.frombuffer(raw[place - before : place + after], np.uint8), np.array([before + after]))
        own = (start <= before) & (stop >= before + CORE)
        depth, rest = before - start[own], stop[own] - before
        for k in np.unique(depth // WORD_SPLIT).tolist():
            some = depth // WORD_SPLIT == k
            yield group(-1 - k, raw[place - k * WORD_SPLIT : place + CORE]), 0, -1, int(depth[some].max()), int(rest[some].max())


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with the bytes around them; equal ones of a batch go out once, and are known to be repeats."""
    kinds = [("h", pa.int64()), ("key", pa.binary()), ("place", pa.int64()), ("least", pa.int32()), ("most", pa.int32()), ("before", pa.int32()), ("after", pa.int32()), ("left", pa.int32()), ("around", pa.binary()), ("known", pa.bool_())]
    for batch in batches:
        found: dict[tuple, list] = {}

        def flush() -> pa.RecordBatch:
            cols = [[] for _ in kinds]
            for (h, *of, around), owners in found.items():
                if len(owners) == 1:
                    rows = [(h, *owners[0], *of, around, False)]
                else:
                    # What is known meets nothing any more, so it need not go where the core goes.
                    rows = [(int.from_bytes(key[:8], "little", signed=True), key, place, *of, None, True) for key, place in owners]
                    rows.append((h, None, 0, *of, around, False))
                for row in rows:
                    for c, v in zip(cols, row):
                        c.append(v)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds)], names=[n for n, _ in kinds])

        for key, raw, marks in zip(*(batch.column(i) for i in range(3))):
            key, raw = key.as_py(), memoryview(raw.as_buffer())
            for h, place, *of, hot in zip(*(marks.values.field(i).to_pylist() for i in range(7))):
                for group, least, most, before, after in _split(raw, h, place, *of) if hot else ((h, *of),):
                    left = max(most, before)
                    around = bytes(raw[place - left : place + max(LENGTH - least if most >= least else 0, after)])
                    found.setdefault((group, least, most, before, after, left, around), []).append((key, place))
            if len(found) >= SORT_ROWS:
                yield flush()
        yield flush()


def _covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by h -> covered [start, stop) by text, of long strings or of passages; whole groups of h are sorted together."""

    def frame(key, start, stop, passage: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": key, "start": start, "stop": stop, "passage": passage})

    def spans(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows[rows["known"]]
        strings, passages = known[known["most"] >= known["least"]], known[known["before"] + known["after"] > 0]
        out = [
            frame(strings["key"], strings["place"] - strings["most"], strings["place"] - strings["least"] + LENGTH, False),
            frame(passages["key"], passages["place"] - passages["before"], passages["place"] + passages["after"], True),
        ]
        rows = rows[~rows["known"]]
        if len(rows) > 1:
            around, key = rows["around"].tolist(), rows["key"].to_numpy()
            place, least, most, before, after, left = (rows[c].to_numpy(np.int64) for c in ("place", "least", "most", "before", "after", "left"))
            ordered = Sorted(around, left, rows["h"].to_numpy())
            low, high = ordered.repeated_places(least, most)
            own = rows["key"].notna().to_numpy()
            hit = (low >= 0) & own
            out.append(frame(key[hit], (place - high)[hit], (place - low)[hit] + LENGTH, False))
            row, depth, rest = _windows(around, left, before, after)
            hit = ordered.repeated_windows(row, depth, rest) & own[row]
            # All passages of an anchor contain it, so together they are one run.
            far = np.zeros((2, len(rows)), np.int64)
            np.maximum.at(far[0], row[hit], depth[hit])
            np.maximum.at(far[1], row[hit], rest[hit])
            hit = far[1] > 0
            out.append(frame(key[hit], (place - far[0])[hit], (place + far[1])[hit], True))
        return pd.concat(out, ignore_index=True)

    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= SORT_ROWS:
            rows = pd.concat(held, ignore_index=True)
            last = rows["h"].iloc[-1]
            done = rows["h"].to_numpy() != last
            held = [rows[~done]]
            n = len(held[0])
            if done.any():
                yield spans(rows[done])
    if n:
        yield spans(pd.concat(held, ignore_index=True))


def _windows(around: list[bytes], left: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bytes before the anchor, bytes from it on) of every passage of every anchor."""
    rows = np.flatnonzero(before + after > 0)
    if not len(rows):
        return rows, rows, rows
    parts = [around[i][left[i] - before[i] : left[i] + after[i]] for i in rows]
    ends = np.cumsum([len(x) for x in parts])
    start, stop = word_windows(np.frombuffer(b"".join(parts), np.uint8), ends)
    at = np.searchsorted(ends, start, "right")
    anchor = (ends - before[rows] - after[rows] + before[rows])[at]
    own = (start <= anchor) & (stop >= anchor + CORE)
    return rows[at[own]], (anchor - start)[own], (stop - anchor)[own]


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _remains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", _SPANS), ("passages", _SPANS)]
    listed = lambda spans: [{"start": a, "stop": b} for a, b in spans]
    for batch in batches:
        cols = [[] for _ in kinds]
        for key, raw, found in zip(*(batch.column(i) for i in range(3))):
            raw, found = raw.as_py(), list(zip(*(found.values.field(i).to_pylist() for i in range(3))))
            removed, passages = _merged([(a, b) for a, b, passage in found if not passage]), _merged([(a, b) for a, b, _ in found])
            digest, at = hashlib.sha256(), 0
            for start, stop in removed:
                digest.update(raw[at:start])
                at = stop
            digest.update(raw[at:])
            row = (key.as_py(), sum(b - a for a, b in removed), len(removed), digest.hexdigest(), listed(removed), listed(passages))
            for c, v in zip(cols, row):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds)], names=[n for n, _ in kinds])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans, passages) of every row.

    ``spans`` are the maximal runs of bytes that a repeated string of
    ``LENGTH`` bytes covers, ``passages`` those that such a string or a
    repeated string of ``WORDS`` words and at least ``CORE`` bytes covers;
    ``kept_sha256`` is of the text without ``spans``.  Null texts are empty;
    shorter texts have no repeat; equal texts that are long enough are repeats
    of each other from end to end; null and repeated ids are rows of their own;
    an empty table gives no rows.
    """
    text = text_or_empty(text_col)
    raw = text.cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.substring(F.sha2(raw, 256), 1, 32)).alias("key"), raw.alias("raw"), text.alias("text"))
    # The key is never null; saying so keeps the shuffle of the texts the same wherever it is used.
    long = rows.filter((F.octet_length("raw") >= CORE) & F.col("key").isNotNull()).select("key", "raw")
    of = ("place", "least", "most", "before", "after")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for text, place, *rest, h in text_anchors(batch.column(1).to_pylist()):
                arrays = [keys.take(pa.array(text)), pa.array(place), *(pa.array(x.astype(np.int32)) for x in rest), pa.array(h.view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", *of, "h"])

    # Copies of a text would repeat all its anchors; each text comes once, and the shuffle that sees to it is used again.
    texts = long.groupBy("key").agg(F.first("raw").alias("raw"))
    marks = texts.mapInArrow(mark, "key binary, place long, least int, most int, before int, after int, h long").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    # Counted before they are joined, and joined only at the salts where a core stands: one that very many texts share is in many tasks.
    counts = marks.groupBy("h", "salt").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
    common = counts.filter("n > 1").select("h", (F.col("n") > HOT_ROWS).alias("hot"), F.explode("salts").alias("salt"))
    shared = marks.join(common, ["h", "salt"])
    wanted = shared.groupBy("key").agg(F.collect_set(F.struct("h", *of, "hot")).alias("marks"))
    around = texts.join(wanted, "key").select("key", "raw", "marks").mapInArrow(_surroundings, "h long, key binary, place long, least int, most int, before int, after int, left int, around binary, known boolean")
    covered = around.repartition("h").sortWithinPartitions("h").mapInPandas(_covered, "key binary, start long, stop long, passage boolean")
    spans = covered.groupBy("key").agg(F.collect_set(F.struct("start", "stop", "passage")).alias("found"))
    kind = "array<struct<start:bigint,stop:bigint>>"
    partly = texts.join(spans, "key").select("key", "raw", "found").mapInArrow(_remains, f"key binary, n_removed long, n_spans long, kept_sha256 string, spans {kind}, passages {kind}")
    n_bytes = F.octet_length("raw").cast("long")
    wordy = F.when(n_bytes >= LENGTH, True).otherwise((n_bytes >= CORE) & (word_count(F.col("text")) >= WORDS))
    keys = rows.select("id", "key", n_bytes.alias("n_bytes"), F.sha2("raw", 256).alias("whole"), wordy.alias("wordy"))
    copies = keys.filter(F.col("n_bytes") >= CORE).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    found = keys.join(partly, "key", "left").join(copies, "key", "left")
    again = F.col("rows").isNotNull() & (F.col("n_bytes") >= LENGTH)
    empty, all_ = F.array().cast(kind), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    return found.select(
        "id",
        "n_bytes",
        F.when(again, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(again, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(again, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(again, all_).otherwise(F.coalesce("spans", empty)).alias("spans"),
        F.when(F.col("rows").isNotNull() & F.col("wordy"), all_).otherwise(F.coalesce("passages", empty)).alias("passages"),
    )
