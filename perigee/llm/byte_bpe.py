"""Byte-level BPE by length-bucketed matrices, and decoding.

Distinct pieces of a slice are laid out as padded rows of token ids, rows of similar length
together. In each round every row merges its leftmost pair of lowest rank; pairs are looked up
in an open-addressing hash table held in numpy arrays, and merged rows close up by one place.
Rows without a pair left are done. A row of more bytes than LONG_ROW, where rounds would cost
the square of its length, takes the same merges from a heap.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from perigee.llm.arrays import mix
from perigee.llm.rows import rows_and_text, schema_with_row, slices

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Upper bounds of the bytes in a bucket's rows; the last also bounds what the matrices take.
BUCKETS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512)
LONG_ROW = BUCKETS[-1]
#: Ids in one matrix; entries in a cache, and bytes of all caches, before they start anew.
CELLS, CACHED, CACHE_BYTES = 1 << 20, 200_000, 64 << 20
NONE = np.int32(np.iinfo(np.int32).max)
U = np.uint64
_EMPTY = U(2**64 - 1)
#: A space beside more white space: only there can a match begin before a word's own space.
_ODD = re.compile(r" (?:\s|$)|\s |^ ")


class PairTable:
    """(left id, right id) to the id of the joined bytes, by hashing with linear probing."""

    def __init__(self, pairs: np.ndarray, joined: np.ndarray):
        self.mask = U((1 << max(4, int(len(pairs) * 2).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, _EMPTY)
        self.values = np.full(int(self.mask) + 1, NONE)
        slot, left = mix(pairs) & self.mask, np.arange(len(pairs))
        while len(left):
            free = self.keys[slot[left]] == _EMPTY
            place, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[place], self.values[place] = pairs[put], joined[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + U(1)) & self.mask

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joined ids; NONE where the pair is unknown or an id is negative."""
        shape = a.shape
        a, b = a.reshape(-1), b.reshape(-1)
        out = np.full(len(a), NONE)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        key = (a[live].astype(U) << U(32)) | b[live].astype(U)
        slot = mix(key) & self.mask
        while len(live):
            held = self.keys[slot]
            same = held == key
            out[live[same]] = self.values[slot[same]]
            on = ~same & (held != _EMPTY)
            live, key, slot = live[on], key[on], (slot[on] + U(1)) & self.mask
        return out.reshape(shape)


class Encoder:
    """A vocabulary of byte strings by rank, and the cache of one task."""

    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        pairs, joined = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    joined.append(rank)
        self.table = PairTable(np.array(pairs, U), np.array(joined, np.int32))
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        size = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            size[rank] = len(token)
        by_rank = sorted(self.ranks, key=self.ranks.get)
        self.sizes, self.starts = size, np.cumsum(size) - size
        self.held = np.frombuffer(b"".join(by_rank), np.uint8)
        self.pieces: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.kept = 0

    # pieces -----------------------------------------------------------------------------

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        rows: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > LONG_ROW:
                out[i] = self._by_heap(piece)
            elif piece:
                rows.setdefault(int(np.searchsorted(BUCKETS, len(piece))), []).append(i)
        for bucket, members in rows.items():
            step = max(1, CELLS // BUCKETS[bucket])
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self._by_matrix([pieces[j] for j in part], BUCKETS[bucket]), strict=True):
                    out[i] = ids
        return out

    def _by_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        held = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        length = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < length[:, None], self.byte_ids[held], np.int32(-1))
        rank = self.table(ids[:, :-1], ids[:, 1:])
        row, out = np.arange(n), [b""] * n
        while len(row):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            best = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NONE)
            done = best == NONE
            if done.any():
                ready = ids[done].astype("<u4")
                whole, stride = ready.tobytes(), 4 * ready.shape[1]
                for k, (i, m) in enumerate(zip(row[done].tolist(), length[done].tolist(), strict=True)):
                    out[i] = whole[k * stride : k * stride + 4 * m]
                go = ~done
                row, length, ids, rank, at, best = row[go], length[go], ids[go], rank[go], at[go], best[go]
                if not len(row):
                    break
            each = np.arange(len(row))
            ids[each, at] = best
            keep = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, keep + (keep > at[:, None]), 1)
            keep = np.arange(rank.shape[1] - 1)
            rank = np.take_along_axis(rank, keep + (keep >= at[:, None]), 1)
            length = length - 1
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.table(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < rank.shape[1])
            rank[right, at[right]] = self.table(ids[right, at[right]], ids[right, at[right] + 1])
        return out

    def _by_heap(self, piece: bytes) -> bytes:
        tokens: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(piece):
                pair = tokens[i] + tokens[after[i]]
                if pair in self.ranks:
                    heapq.heappush(heap, (self.ranks[pair], i, pair))

        for i in range(len(piece) - 1):
            offer(i)
        while heap:
            _, i, pair = heapq.heappop(heap)
            if tokens[i] is None or after[i] >= len(piece) or tokens[i] + tokens[after[i]] != pair:
                continue
            gone = after[i]
            tokens[i], tokens[gone], after[i] = pair, None, after[gone]
            if after[i] < len(piece):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return np.array([self.ranks[t] for t in tokens if t is not None], "<u4").tobytes()

    # texts ------------------------------------------------------------------------------

    def _learn(self, cache: dict[str, bytes], wanted: set[str], lead: str) -> None:
        """Fills the cache for strings that the pattern may still cut, each after `lead`."""
        cut = {s: self.pattern.findall(lead + s) for s in wanted}
        self._keep(set().union(*cut.values()) if cut else set())
        get = self.pieces.__getitem__
        for s, parts in cut.items():
            cache[s] = b"".join(map(get, parts))
            self.kept += len(s) + len(cache[s])

    def _keep(self, pieces: set[str]) -> None:
        new = list(pieces - self.pieces.keys())
        ids = self.encode_pieces([p.encode() for p in new])
        self.pieces.update(zip(new, ids, strict=True))
        self.kept += sum(map(len, new)) + sum(map(len, ids))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers.

        Between two characters that are no white space, a space always begins a new match, so
        a text falls into words that are cut and merged once each.
        """
        if self.kept > CACHE_BYTES or len(self.pieces) > CACHED or len(self.spaced) > CACHED:
            self.pieces, self.spaced, self.kept = {}, {}, 0
        whole: list[list[str] | None] = []
        parts: list[list[str]] = []
        for text in texts:
            if _ODD.search(text):
                whole.append(self.pattern.findall(text))
                parts.append([])
            else:
                head, *rest = text.split(" ")
                whole.append(self.pattern.findall(head))
                parts.append(rest)
        self._keep(set().union(*whole) if whole else set())
        self._learn(self.spaced, set().union(*parts) - self.spaced.keys(), " ")
        piece, spaced = self.pieces.__getitem__, self.spaced.__getitem__
        return [
            b"".join([*map(piece, head), *map(spaced, rest)]) for head, rest in zip(whole, parts, strict=True)
        ]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each text's ids."""
        all_ids = np.frombuffer(b"".join(ids), "<u4")
        size = self.sizes[all_ids]
        after = np.cumsum(size)
        place = np.repeat(self.starts[all_ids] - (after - size), size) + np.arange(after[-1] if len(after) else 0)
        whole = self.held[place].tobytes()
        last = np.cumsum([len(x) // 4 for x in ids])
        ends = [0, *np.concatenate([[0], after])[last].tolist()]
        return [whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str = RANKS) -> Encoder:
    """The encoder of this process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(
    docs: DataFrame, keep: list[str] | None = None, text: str = "text", path: str = RANKS
) -> DataFrame:
    """Per document: `row` (kept columns), n_tokens, ids, decoded.

    `ids` holds little-endian unsigned 32-bit integers, `decoded` the bytes that the ids give
    back. A null text is empty and has no ids. Every row gives one row, repeated rows too; an
    empty table gives none. `path` is a rank file that every executor can open.
    """
    rows = rows_and_text(docs, text, keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for part in slices(batches):
            ids = own.encode([x or "" for x in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(own.decode(ids), pa.binary()),
                ],
                ["row", "n_tokens", "ids", "decoded"],
            )

    return rows.mapInArrow(
        work, schema_with_row(rows, ("n_tokens", "long"), ("ids", "binary"), ("decoded", "binary"))
    )
