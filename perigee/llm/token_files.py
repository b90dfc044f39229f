"""Token ids in files of patched frame-of-reference blocks.

A row of a file is a segment: some documents in order of doc_id. Its body holds their ids in
blocks of BLOCK ids. A block subtracts its minimum and packs what is left at the width that
holds a set percentile of it; the outliers stand in an exception list. An index of block
starts lets a reader unpack any block alone. Segments are written by Spark's own Parquet
writer, so any store that Spark writes to can hold them and a lost task leaves nothing behind.

Body, little-endian: magic, documents, ids, blocks (4 x u32); doc_ids (i64 each, and a bit for
each that is null); ids per document (u32 each); block starts (u32 each); blocks: minimum
(u32), width (u8), exceptions (u16), packed ids, places (u8 each) and values (u32 each) of
exceptions.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from perigee.llm.components import shared_folder
from perigee.llm.rows import named, slices, texts

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
MAGIC, BLOCK, PERCENTILE, END_ID = 0x31524650, 256, 90, 1
#: Words kept with their ids, and bytes of both, before the cache starts anew.
CACHED, CACHE_BYTES = 600_000, 64 << 20
U = np.uint64


def width_of(bits: np.ndarray) -> np.ndarray:
    """The next width that fills whole bytes: even to 16, then a multiple of 4."""
    return np.where(bits <= 16, (bits + 1) // 2 * 2, (bits + 3) // 4 * 4)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of bytes."""
    each = 4 if width <= 16 else 2
    lanes = values.reshape(len(values), BLOCK // each, each).astype(U)
    word = np.zeros(lanes.shape[:2], U)
    for i in range(each):
        word |= lanes[:, :, i] << U(i * width)
    size = each * width // 8
    return word.astype("<u8").view(np.uint8).reshape(len(values), -1, 8)[:, :, :size].reshape(len(values), -1)


def _unpack(held: np.ndarray, width: int) -> np.ndarray:
    each = 4 if width <= 16 else 2
    size = each * width // 8
    word = np.zeros((len(held), BLOCK // each, 8), np.uint8)
    word[:, :, :size] = held.reshape(len(held), -1, size)
    word = word.reshape(len(held), -1).view("<u8")
    mask = U((1 << width) - 1)
    return np.stack([(word >> U(i * width)) & mask for i in range(each)], axis=2).reshape(len(held), BLOCK)


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Block starts and blocks of 32-bit ids."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint32), b""
    full = np.concatenate([ids, np.full(n * BLOCK - len(ids), ids[-1])]).astype(np.int64).reshape(n, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    at = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    width = width_of(np.frexp(np.partition(rest, at, axis=1)[:, at].astype(np.float64))[1])
    outlier = rest >> width[:, None] > 0
    flat = np.where(outlier, 0, rest)
    packed: list[bytes] = [b""] * n
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        for i, held in zip(rows.tolist(), _pack(flat[rows], w), strict=True):
            packed[i] = held.tobytes()
    many = outlier.sum(axis=1)
    block, place = np.nonzero(outlier)
    value = rest[block, place].astype("<u4")
    first = np.cumsum(many) - many
    parts = []
    for i, (m, w, k, f) in enumerate(zip(low.tolist(), width.tolist(), many.tolist(), first.tolist(), strict=True)):
        parts.append(m.to_bytes(4, "little") + bytes([w]) + k.to_bytes(2, "little") + packed[i]
                     + place[f : f + k].astype(np.uint8).tobytes() + value[f : f + k].tobytes())
    size = np.array([len(p) for p in parts])
    return (np.cumsum(size) - size).astype(np.uint32), b"".join(parts)


def unpack_blocks(held: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The n ids of the blocks that begin at these places of the bytes."""
    at = starts.astype(np.int64)
    head = held[at[:, None] + np.arange(7)]
    low = head[:, :4].copy().view("<u4")[:, 0].astype(np.int64)
    width = head[:, 4].astype(np.int64)
    many = head[:, 5:7].copy().view("<u2")[:, 0].astype(np.int64)
    out = np.zeros((len(at), BLOCK), np.int64)
    size = width * BLOCK // 8
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        out[rows] = _unpack(held[at[rows, None] + 7 + np.arange(w * BLOCK // 8)], w)
    block = np.repeat(np.arange(len(at)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    base = (at + 7 + size)[block]
    place = held[base + nth].astype(np.int64)
    value = held[(base + many[block] + 4 * nth)[:, None] + np.arange(4)].reshape(-1, 4).copy().view("<u4")[:, 0]
    out[block, place] = value
    return (out + low[:, None]).reshape(-1)[:n].astype("<u4")


def to_segment(doc_ids: list, ids: list[bytes]) -> bytes:
    data = np.frombuffer(b"".join(ids), "<u4")
    starts, blocks = pack_blocks(data)
    missing = np.packbits([x is None for x in doc_ids]).tobytes()
    return b"".join([
        np.array([MAGIC, len(ids), len(data), len(starts)], "<u4").tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), missing,
        np.array([len(x) // 4 for x in ids], "<u4").tobytes(), starts.astype("<u4").tobytes(), blocks])


def from_segment(body: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, ids per document, and all ids of a segment."""
    magic, docs, n, blocks = np.frombuffer(body, "<u4", 4).tolist()
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = 16
    doc_ids = np.frombuffer(body, "<i8", docs, at).tolist()
    at += 8 * docs
    missing = np.unpackbits(np.frombuffer(body, np.uint8, -(-docs // 8), at), count=docs)
    at += -(-docs // 8)
    sizes = np.frombuffer(body, "<u4", docs, at)
    at += 4 * docs
    starts = np.frombuffer(body, "<u4", blocks, at)
    held = np.frombuffer(body, np.uint8, offset=at + 4 * blocks)
    return [None if m else d for d, m in zip(doc_ids, missing, strict=True)], sizes, unpack_blocks(held, starts, n)


#: Latin letters, then ASCII signs without an apostrophe: for such a word the vocabulary's
#: own normaliser only lowers the letters, and its splitter cuts once, before the signs.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)\Z")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How byte-level vocabularies spell bytes: printed ones as themselves, the rest from 256 on.
_SPELLED = {b: chr(b) for b in _PRINTED} | {
    b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTED)
}


#: Words that the ways to encode one are tried with when a vocabulary is loaded.
_TRIED = ["word", "Word", "WORDS", "naïve", "ÀÉÎÕÜ", "ÿþ", "x", "don", "tokenization", "end.", "(!)", "...", "a,", "#$%&", "Größe!?",
          "it's", "12", "a1b2", "“x”", "日本語", "İ", "ſ", "ﬁ", "\u0301a", "e\u0301", "<|endoftext|>", "<unk>", "\u00ad", "😀!"]


class WordEncoder:
    """The library's ids of texts. Where a vocabulary splits text at white space before anything
    else, each distinct word is encoded once and its ids are kept. Where moreover the parts of
    plain words can go straight to the library's merges, they do; all other words go through
    the whole tokenizer, and so do whole texts where the vocabulary does not split them like
    that. Both are tried out on some words when the vocabulary is loaded."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # marks inside a text are ordinary text
        self.merge = self.tokenizer.model.tokenize
        self._forget()
        whole = [self._whole([w])[0] for w in _TRIED]
        spaced = self._whole(["  ".join(_TRIED), "\n".join(_TRIED), "\t" + " \x0b".join(_TRIED) + "\r", " "])
        self.splits = spaced == [b"".join(whole)] * 3 + [b""]
        plain = [(_PLAIN.match(w), ids) for w, ids in zip(_TRIED, whole, strict=True)]
        self.plain = all(self._parts(m) == ids for m, ids in plain if m)
        self._forget()

    def _forget(self) -> None:
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        self.held = 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", one.ids).tobytes() for one in done]

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            spelled = part if part.isascii() else part.encode().decode("latin-1").translate(_SPELLED)
            ids = self.parts[part] = array("I", [t.id for t in self.merge(spelled)]).tobytes()
            self.held += len(part) + len(ids)
        return ids

    def _parts(self, plain: re.Match) -> bytes:
        letters, signs = plain.groups()
        return self._part(letters.lower()) + self._part(signs)

    def _learn(self, new: list[bytes]) -> None:
        rest = []
        for word in new:
            plain = _PLAIN.match(word.decode()) if self.plain else None
            if plain:
                self.words[word] = self._parts(plain)
            else:
                rest.append(word)
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            self.words.update(zip(part, self._whole([w.decode() for w in part]), strict=True))
        self.held += sum(len(word) + len(self.words[word]) for word in new)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.splits:
            return self._whole([t.decode() for t in texts])
        if self.held > CACHE_BYTES or len(self.words) + len(self.parts) > CACHED:
            self._forget()
        split = [t.split() for t in texts]
        self._learn(list(set().union(*split) - self.words.keys()))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_tokens(
    docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, end_id: int = END_ID
) -> None:
    """Encodes all texts, an end id after each, and writes them in order of doc_id.

    Files are ranges of doc_id (nulls first) and go by their number. Documents of equal id
    follow each other, equal texts together. A null text is its end id alone. `path`
    must not exist and must be in a store that all executors reach; `vocabulary` is a file
    that every executor can open.
    """
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = encoder(vocabulary), TaskContext.get().partitionId()
        for segment, part in enumerate(slices(batches)):
            ids = [x + end for x in own.encode(texts(part.column("text")))]
            yield pa.RecordBatch.from_pydict(
                {"file": [number], "segment": [segment], "n_tokens": [sum(map(len, ids)) // 4],
                 "body": [to_segment(part.column("id").to_pylist(), ids)]},
                pa.schema([("file", pa.int64()), ("segment", pa.int64()), ("n_tokens", pa.int64()), ("body", pa.binary())]))

    rows = docs.select(named(doc_id).cast("long").alias("id"), named(text).cast("string").alias("text"))
    # many rows of one id, and many equal rows, still go to several files
    order = ["id", "hash", "turn"]
    rows = rows.withColumns({"hash": F.xxhash64("text"), "turn": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    ranged.mapInArrow(encode, "file long, segment long, n_tokens long, body binary").write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, **columns: Column) -> DataFrame:
    """Per document of the files at `path`: doc_id, start (ids of all documents before it),
    n_tokens (with the end), and named columns made of `ids`, which holds little-endian
    unsigned 32-bit integers; by default `ids` itself."""
    segments = spark.read.schema("file long, segment long, n_tokens long, body binary").parquet(path)
    files = segments.groupBy("file").agg(F.sum("n_tokens").alias("size"))
    before = F.sum("size").over(Window.orderBy("file")) - F.col("size")
    inside = Window.partitionBy("file").orderBy("segment")
    starts = segments.select("file", "segment", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("own"))
    starts = starts.join(files.select("file", before.alias("before")), "file")
    starts = starts.select("file", "segment", (F.col("own") + F.col("before")).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, sizes, ids = from_segment(batch.column("body")[i].as_py())
                after = np.cumsum(sizes, dtype=np.int64)
                held = ids.tobytes()
                n = len(doc_ids)
                yield pa.RecordBatch.from_pydict(
                    {"file": [batch.column("file")[i].as_py()] * n, "segment": [batch.column("segment")[i].as_py()] * n,
                     "doc_id": doc_ids, "own": after - sizes, "n_tokens": sizes.astype(np.int64),
                     "ids": [held[4 * (b - s) : 4 * b] for b, s in zip(after.tolist(), sizes.tolist(), strict=True)]},
                    pa.schema([("file", pa.int64()), ("segment", pa.int64()), ("doc_id", pa.int64()), ("own", pa.int64()),
                               ("n_tokens", pa.int64()), ("ids", pa.binary())]))

    held = segments.select("file", "segment", "body").mapInArrow(
        decode, "file long, segment long, doc_id long, own long, n_tokens long, ids binary")
    wanted = [c.alias(k) for k, c in (columns or {"ids": F.col("ids")}).items()]
    small = held.select("file", "segment", "doc_id", "own", "n_tokens", *wanted)  # before the join
    return small.join(starts, ["file", "segment"]).select(
        "doc_id", (F.col("own") + F.col("base")).alias("start"), "n_tokens", *(columns or ["ids"]))


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for token files in the store that the session shares."""
    return f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
