"""Substring dedup with fixed-block anchors.

Every document is cut into non-overlapping blocks of BLOCK words; their hashes are the index.
Every rolling window of BLOCK words probes it. A window of WINDOW words is long enough to hold
a whole block wherever it begins, so a repeated window always shows as a hit of its block. The
hits are extended in the words around them: all windows over a hit block are compared by their
own hash, and windows that follow each other make up the maximal exact repeats.

No pairs are formed: a shard answers each chunk which of its keys are anchors found elsewhere,
then which least doc_id a window's words start in. A passage that thousands of documents share
is one key per chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from perigee.llm.arrays import Rolling, Words, covered, fits, runs_of, split_words, sum_per_text
from perigee.llm.packing import by_shard, chunked, from_body, planes, size_of, unplanes
from perigee.llm.rows import flat, named, rows_and_text, schema_with_row

BLOCK, WINDOW = 25, 50
#: Words whose keys one shard holds, and bytes sent of an anchor's hash: an anchor only points
#: to places to look at, windows are compared by all 64 bits.
SHARD_WORDS, ANCHOR_BYTES = 1_500_000, 6
REFERENCE, SEVERAL = 1, 2
_LAST = np.iinfo(np.int64).max
U = np.uint64
_LOW = U((1 << (64 - 8 * ANCHOR_BYTES)) - 1)


def _words(chunk: pa.Table) -> tuple[Words, Rolling, np.ndarray]:
    """Words of a chunk, their rolling hashes, and each document's id (null: beyond all)."""
    words = split_words(*flat(chunk.column("text")))
    ids = chunk.column("id").fill_null(_LAST).to_numpy()
    return words, Rolling(words.hashes()), ids


def _anchors(words: Words, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Places of rolling windows of BLOCK words, and their keys."""
    places = np.flatnonzero(fits(words, BLOCK))
    return places, rolling.windows(BLOCK)[places] & ~_LOW


def _windows(words: Words, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    places = np.flatnonzero(fits(words, WINDOW))
    return places, rolling.windows(WINDOW)[places]


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the least id of each."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = runs_of(keys)
    return keys[first], ids[first]


def send_anchors(body: bytes, shards: int) -> list[tuple]:
    """(shard, keys, flags): all distinct rolling windows of a chunk; flags say whether one is
    a block of its document, and whether several documents have it."""
    words, rolling, _ = _words(from_body(body))
    places, keys = _anchors(words, rolling)
    text = words.text_of()[places]
    block = ((places - words.first[text]) % BLOCK == 0).astype(np.uint8) * REFERENCE
    order = np.lexsort((text, keys))
    keys, text, block = keys[order], text[order], block[order]
    first = runs_of(keys)
    if not len(first):
        return []
    flags = np.bitwise_or.reduceat(block, first)
    last = np.append(first[1:], len(keys)) - 1
    flags |= (text[first] != text[last]).astype(np.uint8) * SEVERAL
    return [(s, planes(k >> U(64 - 8 * ANCHOR_BYTES), ANCHOR_BYTES), f.tobytes()) for s, k, f in by_shard(keys[first], shards, flags)]


def answer_anchors(chunks: list[int], keys: list[np.ndarray], flags: list[np.ndarray]) -> list[tuple]:
    """(chunk, keys): of each chunk's keys those that are a block of some document and occur
    in more than one."""
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    first = runs_of(key[order])
    flag = np.bitwise_or.reduceat(np.concatenate(flags)[order], first)
    many = np.diff(np.append(first, len(order))) > 1
    hot = key[order][first][(flag & REFERENCE > 0) & (many | (flag & SEVERAL > 0))]
    out = []
    for chunk, own in zip(chunks, keys, strict=True):
        found = own[np.isin(own, hot, assume_unique=True)]
        if len(found):
            out.append((chunk, planes(found, ANCHOR_BYTES)))
    return out


def send_windows(body: bytes, hits: np.ndarray, shards: int) -> list[tuple]:
    """(shard, keys, least ids): the windows of a chunk around its hit anchors."""
    words, rolling, ids = _words(from_body(body))
    places, keys = _anchors(words, rolling)
    hit = places[np.isin(keys >> U(64 - 8 * ANCHOR_BYTES), hits)]
    near = covered(np.maximum(hit - BLOCK, 0), BLOCK + 1, len(words.starts))
    at, windows = _windows(words, rolling)
    chosen = near[at]
    key, least = _least(windows[chosen], ids[words.text_of()[at[chosen]]])
    return [(s, planes(k, 8), planes(i.view(U), 8)) for s, k, i in by_shard(key, shards, least)]


def answer_windows(chunks: list[int], keys: list[np.ndarray], ids: list[np.ndarray]) -> list[tuple]:
    """(chunk, keys, ids): where another chunk has a lesser id for a window, that id."""
    key, least = _least(np.concatenate(keys), np.concatenate(ids))
    out = []
    for chunk, own, mine in zip(chunks, keys, ids, strict=True):
        found = least[np.searchsorted(key, own)]
        less = found < mine
        if less.any():
            out.append((chunk, planes(own[less], 8), planes(found[less].view(U), 8)))
    return out


def repeated(words: Words, rolling: Rolling, ids: np.ndarray, keys: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which words a window covers that also starts in a document of lesser id."""
    at, windows = _windows(words, rolling)
    own = ids[words.text_of()[at]]
    key, first = _least(np.concatenate([windows, keys]), np.concatenate([own, least]))
    gone = first[np.searchsorted(key, windows)] < own if len(at) else np.zeros(0, bool)
    return covered(at[gone], WINDOW, len(words.starts))


def _rest(text: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the words that are gone; white space between kept words stays, and
    what surrounded a removed run shrinks to the space before it."""
    out, at = [], 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(text[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else int(ends[b - 1])
    out.append(text[at:])
    return b"".join(out)


def remove_repeats(
    docs: DataFrame, keep: list[str] | None = None, text: str = "text", doc_id: str = "doc_id", want_text: bool = True
) -> DataFrame:
    """Per document: `row` (kept columns), n_words, n_removed, spans, kept_sha256, text_left.

    Words stand between white space. A word is removed if a window of 50 consecutive words of
    its document covers it whose words also start in a document with a smaller doc_id. `spans`
    lists the removed runs as (first word, number of words); kept_sha256 is the digest of the
    kept words joined by spaces; text_left (null unless wanted) is the text without them, its
    other white space unchanged. A null text has no words. A null doc_id counts as greater
    than all others. Documents of equal id, repeated rows too, do not remove each other's
    words; each row gives one row. An empty table gives none.

    Windows are compared by a 64-bit hash of their words: among n distinct windows some two
    differ in words and agree in hash with a chance of about n * n / 2**65.
    """
    rows = rows_and_text(docs, text, keep, id=named(doc_id).cast("long"))
    shards = max(1, size_of(docs, text) // 6 // SHARD_WORDS)
    chunks = chunked(rows)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body"), strict=True):
                sent = send_anchors(body.as_py(), shards)
                yield pa.RecordBatch.from_pydict(
                    {"shard": [s for s, _, _ in sent], "chunk": [chunk] * len(sent),
                     "keys": [k for _, k, _ in sent], "flags": [f for _, _, f in sent]},
                    pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("flags", pa.binary())]))

    def find_hits(held: pa.Table) -> pa.Table:
        keys = [unplanes(k, ANCHOR_BYTES) for k in held.column("keys").to_pylist()]
        flags = [np.frombuffer(f, np.uint8) for f in held.column("flags").to_pylist()]
        out = answer_anchors(held.column("chunk").to_pylist(), keys, flags)
        return pa.Table.from_pydict({"chunk": [c for c, _ in out], "hits": [h for _, h in out]},
                                    pa.schema([("chunk", pa.int64()), ("hits", pa.binary())]))

    def windows(chunk: pa.Table, hits: pa.Table) -> pa.Table:
        sent = []
        if hits.num_rows:
            for body in chunk.column("body").to_pylist():
                found = np.concatenate([unplanes(h, ANCHOR_BYTES) for h in hits.column("hits").to_pylist()])
                sent += send_windows(body, found, shards)
        own = chunk.column("chunk")[0].as_py() if chunk.num_rows else 0
        return pa.Table.from_pydict(
            {"shard": [s for s, _, _ in sent], "chunk": [own] * len(sent), "keys": [k for _, k, _ in sent], "ids": [i for _, _, i in sent]},
            pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary())]))

    def compare(held: pa.Table) -> pa.Table:
        keys = [unplanes(k, 8) for k in held.column("keys").to_pylist()]
        ids = [unplanes(k, 8).view(np.int64) for k in held.column("ids").to_pylist()]
        out = answer_windows(held.column("chunk").to_pylist(), keys, ids)
        return pa.Table.from_pydict({"chunk": [c for c, _, _ in out], "keys": [k for _, k, _ in out], "ids": [i for _, _, i in out]},
                                    pa.schema([("chunk", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary())]))

    def cut(chunk: pa.Table, earlier: pa.Table) -> pa.Table:
        keys = np.concatenate([np.zeros(0, U), *[unplanes(k, 8) for k in earlier.column("keys").to_pylist()]])
        least = np.concatenate([np.zeros(0, np.int64), *[unplanes(k, 8).view(np.int64) for k in earlier.column("ids").to_pylist()]])
        parts = [_cut_chunk(from_body(b), keys, least, want_text) for b in chunk.column("body").to_pylist()]
        return pa.concat_tables(parts)

    sent = chunks.mapInArrow(anchors, "shard long, chunk long, keys binary, flags binary")
    hits = sent.groupBy("shard").applyInArrow(find_hits, "chunk long, hits binary")
    asked = chunks.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(windows, "shard long, chunk long, keys binary, ids binary")
    earlier = asked.groupBy("shard").applyInArrow(compare, "chunk long, keys binary, ids binary")
    return chunks.groupBy("chunk").cogroup(earlier.groupBy("chunk")).applyInArrow(cut, schema_with_row(
        rows, ("n_words", "long"), ("n_removed", "long"), ("spans", "array<struct<first:long,n:long>>"),
        ("kept_sha256", "string"), ("text_left", "string")))


def _cut_chunk(chunk: pa.Table, keys: np.ndarray, least: np.ndarray, want_text: bool) -> pa.Table:
    data, bounds = flat(chunk.column("text"))
    words, rolling, ids = _words(chunk)
    gone = repeated(words, rolling, ids, keys, least)
    removed = sum_per_text(gone.astype(np.int64), words.first)
    spans, digests, left = [], [], []
    whole = data.tobytes()
    for i, n in enumerate(removed.tolist()):
        text = whole[bounds[i] : bounds[i + 1]]
        kept = text.split()
        if n:
            a, b = int(words.first[i]), int(words.first[i + 1])
            own = gone[a:b]
            kept = [w for w, g in zip(kept, own.tolist(), strict=True) if not g]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            spans.append([{"first": x, "n": y - x} for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
            if want_text:
                text = _rest(text, words.starts[a:b] - bounds[i], words.ends[a:b] - bounds[i], own)
        else:
            spans.append([])
        digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        left.append(text.decode() if want_text else None)
    if want_text and chunk.column("text").null_count:
        left = [None if null else x for x, null in zip(left, chunk.column("text").is_null().to_pylist(), strict=True)]
    return pa.table(
        [chunk.column("row"), pa.array(words.per_text.astype(np.int64)), pa.array(removed),
         pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))),
         pa.array(digests, pa.string()), pa.array(left, pa.string())],
        ["row", "n_words", "n_removed", "spans", "kept_sha256", "text_left"],
    )
