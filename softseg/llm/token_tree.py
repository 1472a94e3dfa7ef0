"""Edit-aware token counts.

A text is cut into the pre-tokens of the vocabulary, which no token crosses.
They are the leaves of a balanced tree, stored in runs of up to ``RUN`` with
the characters and tokens of each; inner nodes hold the sums.  An edit takes the
pre-tokens it touches and those whose end it could have decided out of the
tree, cuts and encodes them again until a cut of the new text falls on one of
the old, and puts them back: splits and joins take steps in the logarithm of
the number of runs, and no other text is looked at.

The counts of a document's leaves can be stored (``token_leaves``) and serve
later batches of edits (``edit_leaves``), which encode what they touch only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import SPECIAL, VOCABULARY, encoding

#: Pre-tokens of a run, at most.
RUN = 64
#: Characters beyond its end, at most, that decide where a pre-token ends: a special token's string begins there.
CONTEXT = max(map(len, SPECIAL)) + 3

_PRETOKEN = regex.compile(public_tokenizers.PATTERN)
_SPECIAL = regex.compile("|".join(map(regex.escape, SPECIAL)))


@lru_cache(maxsize=2)
def _lengths(vocabulary: str) -> np.ndarray:
    """Bytes of every token."""
    known = encoding(vocabulary)
    held = np.zeros(known.n_vocab, np.int64)
    for token in range(known.n_vocab):
        try:
            held[token] = len(known.decode_single_token_bytes(token))
        except KeyError:
            continue
    return held


def sizes_of(text: str) -> list[int]:
    """Characters of each pre-token; a special token's string is one."""
    found, at = [], 0
    for special in _SPECIAL.finditer(text):
        found += map(len, _PRETOKEN.findall(text, at, special.start()))
        found.append(special.end() - special.start())
        at = special.end()
    found += map(len, _PRETOKEN.findall(text, at))
    return found


def counts_of(text: str, sizes: list[int], vocabulary: str = VOCABULARY) -> list[int]:
    """Tokens of each pre-token."""
    if not sizes:
        return []
    ids = encoding(vocabulary).encode_to_numpy(text, allowed_special="all")
    ends = np.array(sizes).cumsum()
    if not text.isascii():
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        ends = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[ends]
    tokens = _lengths(vocabulary)[ids].cumsum().searchsorted(ends, side="right")
    tokens[1:] -= tokens[:-1].copy()
    return tokens.tolist()


class Node:
    """A run of pre-tokens, or two nodes with their sums; never changed."""

    __slots__ = ("chars", "tokens", "leaves", "height", "left", "right", "text", "sizes", "counts")

    def __init__(self, left: Node | None = None, right: Node | None = None, text: str = "", sizes: list[int] | None = None, counts: list[int] | None = None) -> None:
        self.left, self.right, self.text, self.sizes, self.counts = left, right, text, sizes, counts
        if left is None:
            self.chars, self.tokens, self.leaves, self.height = len(text), sum(counts), len(sizes), 0
        else:
            self.chars, self.tokens, self.leaves = left.chars + right.chars, left.tokens + right.tokens, left.leaves + right.leaves
            self.height = 1 + max(left.height, right.height)


def runs_of(node: Node | None) -> Iterator[Node]:
    """The runs below a node, in order."""
    stack = [node] if node else []
    while stack:
        now = stack.pop()
        if now.left is None:
            yield now
        else:
            stack += (now.right, now.left)


def built(text: str, sizes: list[int], counts: list[int]) -> Node | None:
    """A tree of runs of ``RUN`` pre-tokens, of least height."""
    ends = [0, *accumulate(sizes)]
    runs = [Node(text=text[ends[i] : ends[min(i + RUN, len(sizes))]], sizes=sizes[i : i + RUN], counts=counts[i : i + RUN]) for i in range(0, len(sizes), RUN)]
    return _halves(runs) if runs else None


def _halves(runs: list[Node]) -> Node:
    at = len(runs) // 2
    return Node(_halves(runs[:at]), _halves(runs[at:])) if at else runs[0]


def _balanced(left: Node, right: Node) -> Node:
    """Both under one node, turned where one is higher by two."""
    if left.height > right.height + 1:
        a, b = left.left, left.right
        return Node(a, Node(b, right)) if a.height >= b.height else Node(Node(a, b.left), Node(b.right, right))
    if right.height > left.height + 1:
        a, b = right.left, right.right
        return Node(Node(left, a), b) if b.height >= a.height else Node(Node(left, a.left), Node(a.right, b))
    return Node(left, right)


def joined(left: Node | None, right: Node | None) -> Node | None:
    """One tree of two; short runs that meet become one."""
    if left is None or right is None:
        return left or right
    if left.left is None and right.left is None and left.leaves + right.leaves <= RUN:
        return Node(text=left.text + right.text, sizes=left.sizes + right.sizes, counts=left.counts + right.counts)
    if left.height > right.height + 1:
        return _balanced(left.left, joined(left.right, right))
    if right.height > left.height + 1:
        return _balanced(joined(left, right.left), right.right)
    return Node(left, right)


def split(node: Node | None, char: int) -> tuple[Node | None, Node | None]:
    """The trees before and from ``char``, where a pre-token begins."""
    if node is None or char <= 0:
        return None, node
    if char >= node.chars:
        return node, None
    if node.left is None:
        at = bisect_left(list(accumulate(node.sizes)), char) + 1
        return Node(text=node.text[:char], sizes=node.sizes[:at], counts=node.counts[:at]), Node(text=node.text[char:], sizes=node.sizes[at:], counts=node.counts[at:])
    if char < node.left.chars:
        before, rest = split(node.left, char)
        return before, joined(rest, node.right)
    rest, after = split(node.right, char - node.left.chars)
    return joined(node.left, rest), after


def _begin(node: Node, char: int) -> tuple[int, int]:
    """(first, end) of the pre-token that holds ``char``."""
    at = 0
    while node.left is not None:
        if char - at < node.left.chars:
            node = node.left
        else:
            at += node.left.chars
            node = node.right
    ends = list(accumulate(node.sizes))
    i = bisect_right(ends, char - at)
    return at + ends[i] - node.sizes[i], at + ends[i]


def _head(node: Node | None, chars: int) -> str:
    """The first characters below a node."""
    found, n = [], 0
    for run in runs_of(node):
        found.append(run.text)
        n += run.chars
        if n >= chars:
            break
    return "".join(found)[:chars]


class TokenTree:
    """The pre-tokens of a text in a balanced tree of their (characters, tokens)."""

    def __init__(self, text: str, vocabulary: str = VOCABULARY, leaves: tuple[list[int], list[int]] | None = None) -> None:
        """``leaves``: sizes and counts of the text's pre-tokens, if they are known."""
        self.vocabulary = vocabulary
        self.encoded = 0
        self.root = built(text, *(leaves or self._counted(text, sizes_of(text))))

    def _counted(self, text: str, sizes: list[int]) -> tuple[list[int], list[int]]:
        self.encoded += len(text)
        return sizes, counts_of(text, sizes, self.vocabulary)

    @property
    def chars(self) -> int:
        return self.root.chars if self.root else 0

    @property
    def tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def n_leaves(self) -> int:
        return self.root.leaves if self.root else 0

    @property
    def text(self) -> str:
        return "".join(run.text for run in runs_of(self.root))

    @property
    def leaves(self) -> tuple[list[int], list[int]]:
        """Sizes and counts of all pre-tokens."""
        runs = list(runs_of(self.root))
        return [n for r in runs for n in r.sizes], [n for r in runs for n in r.counts]

    def edit(self, start: int, deleted: int, inserted: str) -> None:
        """Replace ``deleted`` characters from ``start`` by ``inserted``; both are cut to the text."""
        start = min(max(start, 0), self.chars)
        stop = min(start + max(deleted, 0), self.chars)
        if self.root is None:
            self.root = built(inserted, *self._counted(inserted, sizes_of(inserted)))
            return
        lo = _begin(self.root, max(min(start, self.chars - 1) - CONTEXT, 0))[0]
        before, rest = split(self.root, lo)
        shift = len(inserted) - (stop - start)
        reach = stop - lo + CONTEXT
        while True:
            hi = rest.chars if reach >= rest.chars else _begin(rest, reach)[1]
            middle, after = split(rest, hi)
            old = _head(middle, hi)
            new = old[: start - lo] + inserted + old[stop - lo :]
            # Where both texts have a cut behind the edit, all that follows is cut alike.
            seen = new + _head(after, CONTEXT)
            sizes = sizes_of(seen)
            cuts = list(accumulate(sizes))
            held = {shift, *(shift + c for c in accumulate(n for r in runs_of(middle) for n in r.sizes))}
            n = next((c for c in cuts[bisect_left(cuts, start - lo + len(inserted)) :] if c <= len(new) and c in held), None)
            if n is not None or after is None:
                break
            reach = 2 * hi
        n = len(new) if n is None else n
        # What follows is encoded too, as spaces at the end would be cut otherwise without it.
        fresh = built(new[:n], *(x[: bisect_right(cuts, n)] for x in self._counted(seen, sizes)))
        self.root = joined(joined(before, fresh), joined(split(middle, n - shift)[1], after))


_EDITS = "array<struct<start:int,deleted:int,inserted:string>>"
_FIGURES = ["n_chars", "n_tokens", "edited_chars", "edited_tokens", "reencoded_chars", "n_leaves"]


def _edited(tree: TokenTree, todo: list | None) -> tuple[int, ...]:
    """The figures of a document whose edits are applied one after the other."""
    before, read = (tree.chars, tree.tokens), tree.encoded
    for e in todo or ():
        if e:
            tree.edit(e["start"] or 0, e["deleted"] or 0, e["inserted"] or "")
    return *before, tree.chars, tree.tokens, tree.encoded - read, tree.n_leaves


def _rows(table: DataFrame, edits: Column, id_col: str, text_col: str, *more: str) -> DataFrame:
    return table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), edits.cast(_EDITS).alias("edits"), *more)


def _types(rows: DataFrame) -> str:
    return f"id {rows.schema['id'].dataType.simpleString()}"


def count_edits(docs: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_chars, n_tokens, edited_chars, edited_tokens, reencoded_chars, n_leaves) of every row.

    ``edits`` is array<struct<start int, deleted int, inserted string>>; each
    edit is applied to what the ones before it left.  Null texts are empty, a
    null array has no edits, null fields are 0 or empty, places beyond the text
    are moved to its end; an empty table gives no rows.
    """
    rows = _rows(docs, edits, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_edited(TokenTree(text.as_py() or "", vocabulary), todo.as_py()) for text, todo in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * len(_FIGURES)))], names=["id", *_FIGURES])

    return rows.mapInArrow(run, ", ".join([_types(rows), *(f"{n} long" for n in _FIGURES)]))


_LEAVES = pa.list_(pa.int32())
_STORED = "text string, sizes array<int>, counts array<int>"


def token_leaves(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text, sizes, counts) of every row: characters and tokens of each pre-token, to be stored as a table.

    Null texts are empty and have no leaves; an empty table gives no rows.
    """
    return edit_leaves(docs.withColumns({"sizes": F.lit(None).cast("array<int>"), "counts": F.lit(None).cast("array<int>")}), F.lit(None), id_col, text_col, vocabulary).select("id", "text", "sizes", "counts")


def edit_leaves(stored: DataFrame, edits: Column, id_col: str = "id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows of ``token_leaves`` with ``edits`` applied, and the figures of ``count_edits``.

    Only what an edit touches is encoded; where sizes or counts are null, the
    whole text is.  Edits are taken as by ``count_edits``.
    """
    rows = _rows(stored, edits, id_col, text_col, "sizes", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, found = [], []
            for text, todo, sizes, counts in zip(*(batch.column(i) for i in range(1, 5))):
                known = (sizes.as_py(), counts.as_py()) if sizes.is_valid and counts.is_valid else None
                tree = TokenTree(text.as_py() or "", vocabulary, known)
                found.append(_edited(tree, todo.as_py()))
                out.append((tree.text, *tree.leaves))
            texts, sizes, counts = zip(*out) if out else ((), (), ())
            figures = zip(*found) if found else [[]] * len(_FIGURES)
            columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(sizes, _LEAVES), pa.array(counts, _LEAVES), *(pa.array(c, pa.int64()) for c in figures)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "sizes", "counts", *_FIGURES])

    return rows.mapInArrow(run, ", ".join([_types(rows), _STORED, *(f"{n} long" for n in _FIGURES)]))
