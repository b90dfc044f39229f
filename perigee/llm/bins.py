"""Packing examples into training sequences: vector bin packing by dot products.

A sequence has limits on three things at once: its tokens, its segments and its tokens that
bear loss. Sequences are filled one at a time: of the waiting examples that fit in every
respect, the one with the largest dot product of its sizes and the room left, both as shares
of the limits, goes in next, so that what there is most room for is used up first. Where
nothing fits any more, or the last segment is reached, a longer example is cut to fill the
rest. A sequence that still is not full gives back what exceeds a power of two.

A task packs the examples it reads as they come, among some thousands that wait. Nothing is
shuffled, and a task leaves short sequences behind only at its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from perigee.llm.rows import named, rows_and_text, schema_with_row, slices, texts
from perigee.llm.token_files import END_ID, VOCABULARY, encoder

#: Examples that wait while more are read, and tokens that are not worth a segment of their own.
WAITING, SHORT = 2048, 64
#: Bytes of ids sent back in one batch.
SENT_BYTES = 4 << 20


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold. Tokens are a power of two."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1 or self.tokens & (self.tokens - 1):
            raise ValueError("limits are at least one, and that of tokens a power of two")


@dataclass(frozen=True)
class Piece:
    """Tokens of an example from `start` on; the first `free` of them bear no loss."""

    example: object
    start: int
    size: int
    free: int

    @property
    def loss(self) -> int:
        return max(0, self.size - self.free)

    def split(self, size: int) -> tuple[Piece, Piece]:
        return (Piece(self.example, self.start, size, min(self.free, size)),
                Piece(self.example, self.start + size, self.size - size, max(0, self.free - size)))


class Bins:
    """Waiting pieces, and the sequences made of them. No piece exceeds an empty sequence."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.pieces: list[Piece] = []
        self.size, self.loss = np.zeros(64, np.int64), np.zeros(64, np.int64)

    def __len__(self) -> int:
        return len(self.pieces)

    def _put(self, piece: Piece) -> None:
        n = len(self.pieces)
        if n == len(self.size):
            self.size, self.loss = np.resize(self.size, 2 * n), np.resize(self.loss, 2 * n)
        self.size[n], self.loss[n] = piece.size, piece.loss
        self.pieces.append(piece)

    def _take(self, i: int, size: int) -> Piece:
        """The first tokens of a waiting piece; what is left of it goes on waiting."""
        piece, last = self.pieces[i], self.pieces.pop()
        n = len(self.pieces)
        if i < n:
            self.pieces[i], self.size[i], self.loss[i] = last, self.size[n], self.loss[n]
        if size == piece.size:
            return piece
        first, rest = piece.split(size)
        self._put(rest)
        return first

    def add(self, example: object, size: int, free: int = 0) -> Iterator[list[Piece]]:
        """Lets an example wait; of a long one, the full sequences it makes alone come at once."""
        rest = Piece(example, 0, size, min(free, size))
        while rest.size:
            part, rest = rest.split(min(rest.size, self.limits.tokens, rest.free + self.limits.loss))
            if part.size == self.limits.tokens:
                yield [part]
            else:
                self._put(part)

    def _best(self, tokens: int, loss: int) -> int | None:
        size, own, limits = self.size[: len(self)], self.loss[: len(self)], self.limits
        # the share of a segment is the same for all, and so leaves their order alone
        dot = size * (tokens / limits.tokens**2) + own * (loss / limits.loss**2)
        dot[(size > tokens) | (own > loss)] = -1
        best = int(dot.argmax())
        return best if dot[best] >= 0 else None

    def _longest(self, tokens: int, loss: int) -> int | None:
        """The longest piece whose first tokens fill the room exactly."""
        size, free = self.size[: len(self)], self.size[: len(self)] - self.loss[: len(self)]
        held = np.where((size > tokens) & (tokens - free <= loss), size, 0)
        best = int(held.argmax())
        return best if held[best] else None

    def sequence(self) -> list[Piece]:
        """The next sequence of waiting pieces; there must be one."""
        tokens, segments, loss, out = self.limits.tokens, self.limits.segments, self.limits.loss, []
        while tokens and segments and self.pieces:
            i = self._best(tokens, loss)
            left = tokens if i is None else tokens - int(self.size[i])
            stuck = i is None or segments == 1 or (left < SHORT and self.size[: len(self)].min() > left)
            j = self._longest(tokens, loss) if left and stuck else None
            if j is not None:
                out.append(self._take(j, tokens))
                tokens = 0
                break
            if i is None:
                break
            piece = self._take(i, int(self.size[i]))
            out.append(piece)
            tokens, segments, loss = tokens - piece.size, segments - 1, loss - piece.loss
        used = self.limits.tokens - tokens
        self._give_back(out, used - (1 << (used.bit_length() - 1)))
        return out

    def _give_back(self, pieces: list[Piece], excess: int) -> None:
        while excess:
            piece = pieces.pop()
            kept, back = piece.split(max(0, piece.size - excess))
            if kept.size:
                pieces.append(kept)
            self._put(back)
            excess -= back.size


def pack_texts(
    docs: DataFrame, keep: list[str] | None = None, text: str = "text", prompt: str | None = None,
    limits: Limits = Limits(), vocabulary: str = VOCABULARY, end_id: int = END_ID,
) -> DataFrame:
    """Per piece: `row` (kept columns), start (ids of its example before it), length, ids
    (little-endian unsigned 32-bit), loss_tokens, doc_tokens (ids of its example, the end id
    included), sequence_id, offset (ids of its sequence before it).

    An example is the ids of its prompt, if such a column is named, those of its text and the
    end id. Those of the prompt bear no loss. Every id lies in exactly one piece. A sequence
    keeps to all limits and has as many tokens as a sequence may have, or a power of two, so
    that none needs padding. A null or empty text is its end id alone. Rows of equal id and
    repeated rows are packed each; an empty table gives none.

    Sequence ids name the task and its order of reading and are unique in a result. Keep a
    result by writing it: read anew, other tasks may pack the rows differently.
    """
    more = {"prompt": named(prompt).cast("string")} if prompt else {}
    rows = rows_and_text(docs, text, keep, **more)
    end = int(end_id).to_bytes(4, "little")
    schema = schema_with_row(
        rows, ("start", "long"), ("length", "long"), ("ids", "binary"), ("loss_tokens", "long"),
        ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bins, kind = encoder(vocabulary), Bins(limits), None
        number, out, held = TaskContext.get().partitionId() << 32, [], 0

        def sent() -> pa.RecordBatch:
            """The pieces of finished sequences, as a batch."""
            nonlocal out, held
            flat = [(s, p, at) for s, pieces in out for p, at in zip(pieces, _offsets(pieces), strict=True)]
            out, held = [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([p.example[0] for _, p, _ in flat], kind), *[pa.array(x, pa.int64()) for x in (
                    [p.start for _, p, _ in flat], [p.size for _, p, _ in flat])],
                 pa.array([p.example[1][4 * p.start : 4 * (p.start + p.size)] for _, p, _ in flat], pa.binary()),
                 *[pa.array(x, pa.int64()) for x in (
                    [p.loss for _, p, _ in flat], [len(p.example[1]) // 4 for _, p, _ in flat],
                    [s for s, _, _ in flat], [at for _, _, at in flat])]],
                schema.names)

        def finish(pieces: list[Piece]) -> None:
            nonlocal number, held
            out.append((number, pieces))
            number, held = number + 1, held + 4 * sum(p.size for p in pieces)

        for part in slices(batches):
            kind = part.column("row").type
            ids = own.encode(texts(part.column("text")))
            asked = own.encode(texts(part.column("prompt"))) if prompt else [b""] * len(ids)
            for row, before, learned in zip(part.column("row").to_pylist(), asked, ids, strict=True):
                whole = before + learned + end
                for full in bins.add((row, whole), len(whole) // 4, len(before) // 4):
                    finish(full)
                while len(bins) > WAITING:
                    finish(bins.sequence())
                if held > SENT_BYTES:
                    yield sent()
        while len(bins):
            finish(bins.sequence())
            if held > SENT_BYTES:
                yield sent()
        if out:
            yield sent()

    return rows.mapInArrow(work, schema)


def _offsets(pieces: list[Piece]) -> list[int]:
    after = np.cumsum([p.size for p in pieces])
    return [0, *after[:-1].tolist()]


def padding(pieces: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row over packed pieces: sequences, tokens, and the tokens that padding adds. A
    sequence is padded to its limit unless its length is a power of two."""
    each = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    even = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return each.agg(
        F.count("*").alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(~even, F.lit(limits.tokens) - F.col("n"))), F.lit(0)).alias("padding"))
