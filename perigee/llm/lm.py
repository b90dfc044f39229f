"""LM scoring with a log-frequency Bloom filter.

The counts of all words and word pairs of the training texts are quantised on a logarithmic
scale and entered in a Bloom filter: an n-gram of level q once for each level 1..q. A count is
read back by probing level after level until one is missing, and all that the model's
probabilities take from the corpus is read in that way.

The filter grows with the corpus, so it is not broadcast whole: it lies in slices, one for each
range of hashes, each as large as its n-grams need. Chunks of documents send their distinct
n-grams, a row for each slice, and get back what the probes found. The same answers carry the
exact counts that the unigram base is made of.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from perigee.llm.arrays import LOWER, mix, runs_of, split_words, sum_per_text
from perigee.llm.packing import by_shard, chunked, from_body, planes, size_of, unplanes
from perigee.llm.rows import flat, rows_and_text, schema_with_row, slices

#: Probes for each level: one in 2**PROBES of the absent n-grams is read as present, at most.
PROBES = 24
#: Tokens whose n-grams one slice holds.
SHARD_TOKENS = 1_000_000
#: Weight of the unigrams, in tokens, and what is taken off the count of a pair.
STRENGTH, DISCOUNT = 64.0, 0.1
#: Least count of each level from 1 on: powers of two, and half way between them.
STEPS = np.array(sorted({1 << k for k in range(62)} | {3 << k for k in range(61)}), np.int64)
#: Bytes sent of the hash of a word and of a pair.
KEY_BYTES = {1: 8, 2: 6}
U = np.uint64
_END = mix(np.array([0xE0D], U))
_PAIR = U(0x13198A2E03707344)
_CLEAR = ~U((1 << (64 - 8 * KEY_BYTES[2])) - 1)


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text's words, and where each text begins."""
    words = split_words(LOWER[data], bounds)
    n = len(bounds) - 1
    first = words.first + np.arange(n + 1)
    out = np.empty(first[-1], U)
    ends = first[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = words.hashes(), _END
    return out, first


def contexts(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before each; before a text's first token stands an end."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first[:-1]] = _END
    return before


def pair_keys(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(before ^ _PAIR) * U(3) ^ token) & _CLEAR


def level_of(count: np.ndarray) -> np.ndarray:
    """0 for a count of 0, then the number of steps up to it."""
    return np.searchsorted(STEPS, count, side="right")


def least_of(level: np.ndarray) -> np.ndarray:
    """The least count of a level, 0 for level 0."""
    return np.where(level > 0, STEPS[np.maximum(level, 1) - 1], 0)


def most_of(level: np.ndarray) -> np.ndarray:
    """The largest count of a level."""
    return STEPS[level] - 1


class Slice:
    """A log-frequency Bloom filter of some n-grams, at most half full."""

    def __init__(self, keys: np.ndarray, level: np.ndarray):
        entries = max(1, int(level.sum()))
        self.bits = 1 << max(6, int(np.ceil(np.log2(entries * PROBES / np.log(2)))))
        self.held = np.zeros(self.bits, bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            place, step = self._first(keys[level >= q], q)
            for _ in range(PROBES):
                self.held[place & U(self.bits - 1)] = True
                place = place + step

    def _first(self, keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the probes of a level begin, and how far apart they are."""
        place = mix(keys + U(level * 0x9E3779B97F4A7C15 % 2**64))
        return place, mix(place) | U(1)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram, by probing level after level while all bits are set."""
        out, live, q = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
        while len(live) and q < len(STEPS) - 1:
            q += 1
            place, step = self._first(keys[live], q)
            for _ in range(PROBES):
                hit = self.held[place & U(self.bits - 1)]
                if not hit.all():
                    live, place, step = live[hit], place[hit], step[hit]
                place = place + step
            out[live] = q
        return out


def log10_probability(context: np.ndarray, word: np.ndarray, both: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 of the probability of words after their contexts, from the levels of the context,
    the word and the pair.

    The pair's count, a little discounted, and STRENGTH tokens dealt out by the unigrams, over
    the context's count and STRENGTH. Counts above the line are read as the least of their
    level, those below it as the largest, and no pair is read above its context or word: so
    the probabilities of all words after a context come to no more than one.
    """
    unigram = (least_of(word) + 1) / (total + distinct + 1)
    both = np.minimum(both, np.minimum(context, word))
    seen = np.maximum(least_of(both) - DISCOUNT, 0.0)
    return np.log10((seen + STRENGTH * unigram) / (most_of(context) + STRENGTH))


def pack_counts(count: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as a byte each, and in full where that does not do."""
    return np.minimum(count, 255).astype(np.uint8).tobytes(), planes(count[count >= 255].astype(U), 6)


def unpack_counts(small: bytes, large: bytes) -> np.ndarray:
    count = np.frombuffer(small, np.uint8).astype(np.int64)
    count[count == 255] = unplanes(large, 6).astype(np.int64)
    return count


_SENT = {"shard": "long", "chunk": "long", "size": "int", "keys": "binary", "small": "binary", "large": "binary"}
_TOLD = {"chunk": "long", "shard": "long", "size": "int", "levels": "binary", "small": "binary", "large": "binary"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _table(fields: dict[str, str], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.table([pa.array(x, _ARROW[kind]) for x, kind in zip(columns, fields.values(), strict=True)], list(fields))


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


def ngrams(token: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    yield 1, token
    yield 2, pair_keys(contexts(token, first), token)


def send(chunk: int, token: np.ndarray, first: np.ndarray, learned: np.ndarray, shards: int, sizes=(1, 2)) -> pa.Table:
    """The distinct n-grams of a chunk and how often its training texts have them."""
    out, trains = [], np.repeat(learned, np.diff(first))
    for size, keys in ngrams(token, first):
        if size in sizes:
            key, back = np.unique(keys, return_inverse=True)
            count = np.bincount(back, weights=trains, minlength=len(key)).astype(np.int64)
            width = KEY_BYTES[size]
            out += [(s, chunk, size, planes(k >> U(64 - 8 * width), width), *pack_counts(c)) for s, k, c in by_shard(key, shards, count)]
    return _table(_SENT, out)


def merged(held: pa.Table, size: int) -> tuple[pa.Table, list[np.ndarray], np.ndarray, np.ndarray]:
    """Of the n-grams of a size: the rows, their keys, the distinct keys and their counts."""
    rows = held.filter(pc.equal(held.column("size"), size))
    width = KEY_BYTES[size]
    keys = [unplanes(k, width) << U(64 - 8 * width) for k in rows.column("keys").to_pylist()]
    counts = [unpack_counts(a, b) for a, b in zip(rows.column("small").to_pylist(), rows.column("large").to_pylist(), strict=True)]
    if not keys:
        return rows, keys, np.zeros(0, U), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    begin = runs_of(key[order])
    return rows, keys, key[order][begin], np.add.reduceat(count[order], begin)


def tell(held: pa.Table) -> pa.Table:
    """Answers to the chunks of one shard, in the order of their own n-grams: levels, as the
    probes of the shard's filter find them, and exact counts of words."""
    out = []
    for size in KEY_BYTES:
        rows, keys, key, count = merged(held, size)
        known = count > 0
        level = Slice(key[known], level_of(count[known])).level(key).astype(np.uint8)
        for chunk, shard, own in zip(rows.column("chunk").to_pylist(), rows.column("shard").to_pylist(), keys, strict=True):
            at = np.searchsorted(key, own)
            out.append((chunk, shard, size, level[at].tobytes(), *(pack_counts(count[at]) if size == 1 else (None, None))))
    return _table(_TOLD, out)


def totals(docs: DataFrame, trains: Column, text: str, shards: int) -> tuple[int, int]:
    """All tokens of the training texts, and the distinct ones."""
    rows = rows_and_text(docs.where(trains), text, [docs.columns[0]]).select("text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            token, first = tokens(*flat(part.column("text")))
            yield from send(0, token, first, np.ones(len(first) - 1), shards, sizes=(1,)).to_batches()

    def count(held: pa.Table) -> pa.Table:
        _, _, key, n = merged(held, 1)
        return pa.table({"total": [int(n.sum())], "distinct": [len(key)]})

    found = rows.mapInArrow(words, _ddl(_SENT)).groupBy("shard").applyInArrow(count, "total long, distinct long")
    row = found.agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).first()
    return row["total"] or 0, row["distinct"] or 0


def score(docs: DataFrame, trains: Column, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Per document: `row` (kept columns), n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows for which `trains` is true (null: false) and scores all.
    Tokens are the words between white space with A-Z in lower case, then one end. base_score
    is the log10 probability under exact unigram counts plus one, `score` the one the model
    gives. A null or empty text is its end alone. Without training rows every token has a
    probability of one. Repeated rows count as often as they are there, and give a row each;
    an empty table gives none.

    Words are told apart by 64-bit hashes; that some two of n distinct ones share theirs has
    a chance of about n * n / 2**65. Pairs go by 48 bits, which adds a little to the filter's
    own errors: of n distinct pairs, a share of n / 2**48 is read as another.
    """
    trains = F.coalesce(trains, F.lit(False))
    shards = max(1, size_of(docs, text) // 6 // SHARD_TOKENS)
    total, distinct = totals(docs, trains, text, shards)
    rows = rows_and_text(docs, text, keep, trains=trains)
    chunks = chunked(rows)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body"), strict=True):
                held = from_body(body.as_py())
                learned = held.column("trains").to_numpy()
                yield from send(chunk, *tokens(*flat(held.column("text"))), learned, shards).to_batches()

    def judge(chunk: pa.Table, told: pa.Table) -> pa.Table:
        told, out = told.sort_by("shard"), []
        for body in chunk.column("body").to_pylist():
            held = from_body(body)
            token, first = tokens(*flat(held.column("text")))
            found = {}
            for size, keys in ngrams(token, first):
                answers = told.filter(pc.equal(told.column("size"), size))
                back = np.unique(keys, return_inverse=True)[1]
                level = np.frombuffer(b"".join(answers.column("levels").to_pylist()), np.uint8).astype(np.int64)
                found[size] = level[back]
                if size == 1:
                    parts = zip(answers.column("small").to_pylist(), answers.column("large").to_pylist(), strict=True)
                    exact = np.concatenate([unpack_counts(*x) for x in parts])[back]
            context = np.empty_like(found[1])
            context[1:] = found[1][:-1]
            context[first[:-1]] = found[1][first[1:] - 1]  # the end of a text stands before its first word
            base = np.log10(exact + 1.0) - np.log10(total + distinct + 1)
            value = log10_probability(context, found[1], found[2], total, distinct)
            out.append(pa.table(
                [held.column("row"), pa.array(np.diff(first)), pa.array(sum_per_text((exact > 0).astype(np.int64), first)),
                 pa.array(np.full(len(first) - 1, total)), pa.array(sum_per_text(base, first)), pa.array(sum_per_text(value, first))],
                ["row", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    told = chunks.mapInArrow(ask, _ddl(_SENT)).groupBy("shard").applyInArrow(tell, _ddl(_TOLD))
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(judge, schema_with_row(
        rows, ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")))
