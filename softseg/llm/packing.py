"""Packing of token pieces into sequences by vector bin packing.

A piece needs room in three respects: tokens, segments and loss-bearing
tokens.  The open sequence takes, of the pieces that fit, the one whose demand
has the largest dot product with the room left, each respect measured in parts
of its capacity.  When none fits, the largest piece is cut to the room left.
What remains at the end of a partition is cut into powers of two, which need
no padding.

Every task packs the documents of its own partition as they stream by and
keeps a bounded pool of pieces, so nothing is shuffled and a hot source or a
very long text costs no task more than its share of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import VOCABULARY, token_ids

TOKENS, SEGMENTS, LOSS = 1024, 256, 1024
#: Pieces that wait for a sequence, at most; half of them go out when it is full.
POOL = 1024
END = (0).to_bytes(4, "little")


@dataclass(slots=True)
class Piece:
    doc: int  # place of the document in the caller's records
    start: int
    ids: bytes
    loss: bytes | None = None  # one flag per token; None: all bear loss

    def __len__(self) -> int:
        return len(self.ids) // 4

    @property
    def loss_tokens(self) -> int:
        return len(self) if self.loss is None else self.loss.count(1)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        own, rest = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return Piece(self.doc, self.start, self.ids[: 4 * n], own), Piece(self.doc, self.start + n, self.ids[4 * n :], rest)


class Packer:
    """Sequences of pieces within ``(tokens, segments, loss)``; ``tokens`` is a power of two."""

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL) -> None:
        if tokens < 1 or tokens & (tokens - 1) or segments < 1 or loss < 1 or pool < 2:
            raise ValueError("tokens must be a power of two, segments and loss at least 1, pool at least 2")
        self.tokens, self.segments, self.loss, self.pool = tokens, segments, loss, pool
        self.waiting: list[Piece] = []

    def add(self, doc: int, ids: bytes, loss: bytes | None = None) -> Iterator[list[Piece]]:
        """Take a document in; gives the sequences that became full."""
        at = 0
        for at in range(self.tokens, len(ids) // 4 + 1, self.tokens):
            # Cut by offset, so a long document is copied once.
            start = at - self.tokens
            head = Piece(doc, start, ids[4 * start : 4 * at], loss and loss[start:at])
            if head.loss_tokens <= self.loss:
                yield [head]
            else:
                self.waiting += self._bearable(head)
        piece = Piece(doc, at, ids[4 * at :], loss and loss[at:])
        if len(piece):
            self.waiting += self._bearable(piece)
        if len(self.waiting) >= self.pool:
            yield from self._sequences(self.pool // 2)

    def finish(self) -> Iterator[list[Piece]]:
        yield from self._sequences(0)

    def _bearable(self, piece: Piece) -> list[Piece]:
        """The piece cut so that each part can stand in a sequence of its own."""
        out = []
        while piece.loss_tokens > self.loss:
            at = np.flatnonzero(np.frombuffer(piece.loss, np.uint8) == 1)[self.loss] if piece.loss is not None else self.loss
            head, piece = piece.cut(int(at))
            out.append(head)
        return [*out, piece]

    def _sequences(self, leave: int) -> Iterator[list[Piece]]:
        items = self.waiting
        need = np.array([(len(p), 1, p.loss_tokens) for p in items], float).reshape(-1, 3)
        scale = 1 / np.array([self.tokens, self.segments, self.loss], float)
        alive = np.ones(len(items), bool)
        left = len(items)
        while left > leave:
            room, bin_ = np.array([self.tokens, self.segments, self.loss], float), []
            while room[0] > 0 and room[1] > 0 and left:
                fits = alive & (need <= room).all(axis=1)
                gain = (need * scale) @ (room * scale)
                if fits.any():
                    best = int(np.where(fits, gain, -1.0).argmax())
                    bin_.append(items[best])
                    room -= need[best]
                    alive[best] = False
                    left -= 1
                    continue
                best = int(np.where(alive, need[:, 0], -1.0).argmax())
                n = self._cut_at(items[best], room)
                if n < 1 or n >= len(items[best]):
                    break
                head, items[best] = items[best].cut(n)
                need[best] = (len(items[best]), 1, items[best].loss_tokens)
                bin_.append(head)
                room -= (len(head), 1, head.loss_tokens)
            if not left and room[0] > 0:
                yield from self._powers(bin_)
            else:
                yield bin_
        self.waiting = [p for p, a in zip(items, alive) if a]

    def _cut_at(self, piece: Piece, room: np.ndarray) -> int:
        n = int(min(room[0], len(piece)))
        if piece.loss is None:
            return int(min(n, room[2]))
        return int(np.searchsorted(np.cumsum(np.frombuffer(piece.loss[:n], np.uint8)), room[2], side="right"))

    def _powers(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        """The last sequence as sequences whose lengths are powers of two."""
        total = sum(map(len, pieces))
        queue = list(pieces)
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            out = []
            while size:
                piece = queue.pop(0)
                if len(piece) > size:
                    piece, rest = piece.cut(size)
                    queue.insert(0, rest)
                out.append(piece)
                size -= len(piece)
            yield out


SCHEMA = "start long, length long, ids_crc32 long, loss_tokens long, doc_tokens long, sequence_id long, segment int, offset long"


def _parts(docs: DataFrame, parts_col: str) -> Column:
    return F.transform(F.col(f"`{parts_col}`"), lambda p: F.struct(p["text"].cast("string").alias("text"), F.coalesce(p["loss"].cast("boolean"), F.lit(False)).alias("loss"))).alias("parts")


def _with_flags(parts: list[dict] | None, vocabulary: str) -> tuple[bytes, bytes]:
    """Ids of the parts and the final one, and one flag a token."""
    ids = [token_ids(p["text"], vocabulary) for p in parts or []]
    flags = [bytes([p["loss"]]) * (len(i) // 4) for p, i in zip(parts or [], ids)]
    last = parts[-1]["loss"] if parts else True
    return b"".join(ids) + END, b"".join(flags) + bytes([last])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, with_ids: bool = False, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL, parts_col: str | None = None) -> DataFrame:
    """One row per piece of each document: id, start, length, ids_crc32, loss_tokens, doc_tokens, sequence_id, segment, offset (and ids).

    A document is its ids and a final id 0; every token bears loss.  With
    ``parts_col``, an array of structs (text, loss), a document is its parts in
    order, each tokenised by itself (``text_col`` is not read): a part's tokens
    bear loss if its ``loss`` is true, the final id if the last part's is; a
    document without parts bears it.  Null and empty texts, null arrays and
    null parts are no ids but the final one; null and repeated ids are documents of
    their own; an empty table gives no rows.  ``sequence_id`` holds the
    partition in its upper bits, so equal input splits give equal sequences.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text") if parts_col is None else _parts(docs, parts_col))
    id_type = rows.schema["id"].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "loss_tokens", "doc_tokens", "sequence_id", "segment", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tokens, segments, loss, pool)
        base = TaskContext.get().partitionId() << 40
        known: dict[int, list] = {}  # document -> id, tokens, tokens not yet out
        n_docs = n_seqs = 0
        kind = None

        def table(found: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal n_seqs
            cols, ids = [[] for _ in names], []
            raw = []
            for pieces in found:
                at = 0
                for segment, p in enumerate(pieces):
                    doc = known[p.doc]
                    row = (p.start, len(p), zlib.crc32(p.ids), p.loss_tokens, doc[1], base + n_seqs, segment, at)
                    for c, v in zip(cols, row):
                        c.append(v)
                    ids.append(doc[0])
                    raw.append(p.ids)
                    at += len(p)
                    doc[2] -= len(p)
                    if not doc[2]:
                        del known[p.doc]
                n_seqs += 1
            kinds = [pa.int32() if n == "segment" else pa.int64() for n in names]
            arrays = [pa.array(ids, kind), *(pa.array(c, k) for c, k in zip(cols, kinds))]
            extra = [pa.array([np.frombuffer(r, "<u4").astype(np.int64).tolist() for r in raw], pa.list_(pa.int64()))] if with_ids else []
            return pa.RecordBatch.from_arrays([*arrays, *extra], names=["id", *names, *(["ids"] if with_ids else [])])

        for batch in batches:
            kind = batch.column(0).type
            out: list[list[Piece]] = []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, flags = _with_flags(text.as_py(), vocabulary) if parts_col else (token_ids(text.as_py(), vocabulary) + END, None)
                known[n_docs] = [id_, len(ids) // 4, len(ids) // 4]
                out += packer.add(n_docs, ids, flags)
                n_docs += 1
                if len(out) >= 2048:
                    yield table(out)
                    out = []
            yield table(out)
        if kind is not None:
            yield table(list(packer.finish()))

    return rows.mapInArrow(run, f"id {id_type}, {SCHEMA}{', ids array<long>' if with_ids else ''}")
