"""Phrase collocations by stripes.

Each prefix of one to three words keys a stripe: an associative counter of the words that come
next. A task builds the stripes of its chunk of documents; stripes of a prefix from many chunks
are merged elementwise. One structure gives all there is to know: a slot is the count of an
extension, a stripe's total that of its prefix, and its largest slot the longest a phrase's
count is kept by a longer one.

A slot travels as the hash of its prefix and next word, the total as that of the prefix alone,
and slots are dealt out by that hash: the stripe of a hot prefix is spread over all shards, and
a chunk sends a slot once. Stripes of longer prefixes are only built where all shorter phrases
within are frequent: a chunk is told which of its slots are, and one chunk, told to name a
phrase, sends its words. No words of rare phrases travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from perigee.llm.arrays import LOWER, Rolling, hash_spans, mix, runs_of, split_words
from perigee.llm.components import checkpoint
from perigee.llm.packing import by_shard, chunked, from_body, planes, size_of, unplanes
from perigee.llm.rows import flat, named

LONGEST, LEAST, PERCENT, MOST = 4, 30, 80, 2000
UNKNOWN = "und"
#: Words whose slots one shard holds, and groups in which a language is ranked at first.
SHARD_WORDS, RANKED = 1_000_000, 32
U = np.uint64
#: What ends a piece of text, and what else ends a word.
PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BREAK = PIECE.copy()
BREAK[[0x20, 0x09]] = True


class Chunk:
    """The words of a chunk and the keys of its phrases; a phrase stays in its piece."""

    def __init__(self, body: bytes):
        table = from_body(body)
        data, bounds = flat(table.column("text"))
        self.langs = table.column("lang").to_pylist()
        self.words = split_words(LOWER[data], bounds, BREAK)
        self.text = self.words.text_of()
        lang = mix(hash_spans(*_spans(table.column("lang"))))
        self.rolling = Rolling(mix(self.words.hashes() ^ lang[self.text]))
        breaks = np.concatenate([[0], np.cumsum(PIECE[data])])[self.words.starts]
        self.joined = (breaks[1:] == breaks[:-1]) & (self.text[1:] == self.text[:-1])
        self.bytes = self.words.data.tobytes()

    def keys(self, width: int) -> np.ndarray:
        return self.rolling.windows(width)

    def fits(self, width: int) -> np.ndarray:
        """Where a phrase of so many words can begin."""
        n = max(0, len(self.words.starts) - width + 1)
        out = np.ones(n, bool)
        for k in range(width - 1):
            out &= self.joined[k : k + n]
        return out

    def grown(self, width: int, hot: np.ndarray) -> np.ndarray:
        """Where a phrase one word longer than `width` begins, both whose parts of that width
        are among the hot keys."""
        frequent = _among(self.keys(width), hot)
        return np.flatnonzero(self.fits(width + 1) & frequent[:-1] & frequent[1:])

    def phrases(self, width: int, places: np.ndarray, count: np.ndarray) -> list:
        """Columns of the phrases at these places: language, words, key, count, and the keys of
        the parts before and after each cut."""
        starts, ends, raw = self.words.starts, self.words.ends, self.bytes
        bounds = [(starts[places + k].tolist(), ends[places + k].tolist()) for k in range(width)]
        words = [[raw[a:b] for a, b in zip(*pair, strict=True)] for pair in bounds]
        said = [b" ".join(x).decode() for x in zip(*words, strict=True)]
        first = [self.keys(k)[places] for k in range(1, width)]
        rest = [self.keys(width - k)[places + k] for k in range(1, width)]
        return [
            pa.array([self.langs[t] for t in self.text[places].tolist()], pa.string()), pa.array(said, pa.string()),
            pa.array(self.keys(width)[places].view(np.int64)), pa.array(count.astype(np.int64)),
            _lists(first, len(places)), _lists(rest, len(places)),
        ]

    def sizes(self) -> list:
        """The same columns for the number of words of each language, as a phrase of none."""
        n = np.bincount(self.text, minlength=len(self.langs))
        total: dict[str, int] = {}
        for lang, k in zip(self.langs, n.tolist(), strict=True):
            total[lang] = total.get(lang, 0) + k
        none = _lists([], len(total))
        return [pa.array(list(total), pa.string()), pa.array([""] * len(total), pa.string()),
                pa.array([0] * len(total), pa.int64()), pa.array(list(total.values()), pa.int64()), none, none]


_PHRASE = [("lang", "string"), ("phrase", "string"), ("key", "long"), ("n", "long"), ("first", "array<long>"), ("rest", "array<long>")]
_SLOTS = [("shard", "long"), ("chunk", "long"), ("keys", "binary"), ("many", "binary"), ("counts", "binary")]
_ANSWER = [("chunk", "long"), ("keys", "binary"), ("mine", "binary"), ("counts", "binary")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _schema(fields: list[tuple[str, str]]) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in fields])


def _ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields)


def _spans(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, bounds = flat(column)
    return data, bounds[:-1], bounds[1:]


def _lists(columns: list[np.ndarray], n: int) -> pa.Array:
    values = np.stack(columns, axis=1).reshape(-1) if columns else np.zeros(0, U)
    offsets = np.arange(n + 1, dtype=np.int32) * len(columns)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _among(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which keys are among the held ones, which are sorted."""
    if not len(held):
        return np.zeros(len(keys), bool)
    return held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys


def send_slots(chunk: int, keys: np.ndarray, shards: int) -> pa.Table:
    """The distinct slots of a chunk with their counts, a row for each shard."""
    key, count = np.unique(keys, return_counts=True)
    sent = by_shard(key, shards, count.astype(U))
    return pa.Table.from_pydict(
        {"shard": [s for s, _, _ in sent], "chunk": [chunk] * len(sent), "keys": [planes(k, 8) for _, k, _ in sent],
         "many": [np.packbits(c > 1).tobytes() for _, _, c in sent], "counts": [planes(c[c > 1], 4) for _, _, c in sent]},
        _schema(_SLOTS))


def merge_slots(held: pa.Table, least: int) -> pa.Table:
    """Merges the chunks' slots elementwise and tells each chunk which of its own come to
    `least`. The first chunk that has a slot is to name it, and gets its count."""
    held = held.filter(held.column("keys").is_valid())
    if not held.num_rows:
        return _schema(_ANSWER).empty_table()
    chunks = held.column("chunk").to_pylist()
    keys = [unplanes(k, 8) for k in held.column("keys").to_pylist()]
    counts = []
    for own, many, c in zip(keys, held.column("many").to_pylist(), held.column("counts").to_pylist(), strict=True):
        count = np.ones(len(own), np.int64)
        count[np.unpackbits(np.frombuffer(many, np.uint8), count=len(own)).astype(bool)] = unplanes(c, 4)
        counts.append(count)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    first = runs_of(key[order])
    total = np.add.reduceat(np.concatenate(counts)[order], first)
    namer = np.repeat(np.arange(len(keys)), [len(k) for k in keys])[order][first]
    hot = total >= least
    key, total, namer = key[order][first][hot], total[hot], namer[hot]
    out = []
    for i, own in enumerate(keys):
        found = own[_among(own, key)]
        if len(found):
            at = np.searchsorted(key, found)
            mine = namer[at] == i
            out.append((chunks[i], planes(found, 8), np.packbits(mine).tobytes(), planes(total[at[mine]].astype(U), 8)))
    return pa.Table.from_pydict({name: [x[i] for x in out] for i, (name, _) in enumerate(_ANSWER)}, _schema(_ANSWER))


def _told(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent keys of a chunk in order; those it is to name, and their counts."""
    keys, mine, counts = [np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, U)]
    for row in answers.to_pylist():
        own = unplanes(row["keys"], 8)
        keys.append(own)
        mine.append(own[np.unpackbits(np.frombuffer(row["mine"], np.uint8), count=len(own)).astype(bool)])
        counts.append(unplanes(row["counts"], 8))
    named, count = np.concatenate(mine), np.concatenate(counts)
    order = np.argsort(named)
    return np.sort(np.concatenate(keys)), named[order], count[order]


def _named(chunk: Chunk, widths: tuple[int, ...], mine: np.ndarray, counts: np.ndarray) -> list[list]:
    """The phrases of these widths that a chunk is to name."""
    out = []
    for width in widths:
        places = np.flatnonzero(chunk.fits(width))
        key, at = np.unique(chunk.keys(width)[places], return_index=True)
        wanted = _among(key, mine)
        out.append(chunk.phrases(width, places[at[wanted]], counts[np.searchsorted(mine, key[wanted])]))
    return out


def count_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """Frequent phrases of one to four words: lang, phrase, key, n, and the keys of the parts
    before and after each cut (`first`, `rest`, as many as there are cuts). A phrase without
    words has the number of all words of the language."""
    rows = docs.select(
        F.coalesce(named(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), named(text).cast("string").alias("text"))
    shards = max(1, size_of(docs, text) // 6 // SHARD_WORDS)
    chunks = chunked(rows)
    both = [*_SLOTS, *_PHRASE]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column("chunk").to_pylist(), batch.column("body"), strict=True):
                held = Chunk(body.as_py())
                slots = np.concatenate([held.keys(1), held.keys(2)[held.fits(2)]])
                yield from send_slots(number, slots, shards).to_batches()

    def second(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        hot, mine, counts = _told(answers)
        out = [_schema(both).empty_table()]
        for number, body in zip(chunk.column("chunk").to_pylist(), chunk.column("body").to_pylist(), strict=True):
            held = Chunk(body)
            slots = send_slots(number, held.keys(3)[held.grown(2, hot)], shards)
            out.append(pa.table([*slots.columns, *[pa.nulls(slots.num_rows, _ARROW[kind]) for _, kind in _PHRASE]], schema=_schema(both)))
            for columns in _named(held, (1, 2), mine, counts):
                key = columns[2].to_numpy().view(U)
                owner = pa.array((((key >> U(32)) * U(shards)) >> U(32)).astype(np.int64))
                out.append(pa.table([owner, *[pa.nulls(len(key), _ARROW[kind]) for _, kind in _SLOTS[1:]], *columns], schema=_schema(both)))
        return pa.concat_tables(out)

    def third(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        hot, mine, counts = _told(answers)
        out = [_schema(_PHRASE).empty_table()]
        for body in chunk.column("body").to_pylist():
            held = Chunk(body)
            places = held.grown(3, hot)
            _, at, count = np.unique(held.keys(4)[places], return_index=True, return_counts=True)
            for columns in [held.sizes(), *_named(held, (3,), mine, counts), held.phrases(4, places[at], count)]:
                out.append(pa.table(columns, schema=_schema(_PHRASE)))
        return pa.concat_tables(out)

    def names(held: pa.Table) -> pa.Table:
        return held.filter(held.column("phrase").is_valid()).select([name for name, _ in _PHRASE])

    def merge(held: pa.Table) -> pa.Table:
        return merge_slots(held, least)

    pairs = chunks.mapInArrow(first, _ddl(_SLOTS)).groupBy("shard").applyInArrow(merge, _ddl(_ANSWER))
    sent = chunks.groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInArrow(second, _ddl(both)).repartition("shard")
    triples = sent.groupBy("shard").applyInArrow(merge, _ddl(_ANSWER))
    longer = chunks.groupBy("chunk").cogroup(triples.groupBy("chunk")).applyInArrow(third, _ddl(_PHRASE))
    found = sent.groupBy("shard").applyInArrow(names, _ddl(_PHRASE)).unionByName(longer)
    summed = found.groupBy("lang", "phrase", "key", "first", "rest").agg(F.sum("n").alias("n"))
    return summed.where((F.col("phrase") == "") | (F.col("n") >= least))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, percent: int = PERCENT, most: int = MOST
) -> DataFrame:
    """The best phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    A-Z are lowered; pieces of text end at punctuation and line ends, words at spaces and
    tabs; a phrase is two to four consecutive words of a piece. Candidates occur `least` times
    or more, overlaps included. Of the cuts of a candidate in two, with counts l and r, the one
    with the lowest floor(2000000 a / (l + r)) counts, the earliest of several. A candidate
    inside a longer one with `percent` of its count or more is left out. `most` phrases of a
    language are returned, by score and a descending, then phrase in order of its bytes; n is
    the number of all words of the language.

    A null text is empty, a null language `und`. Repeated rows count as often as they are
    there. Without candidates, as for an empty table, there are no rows. Phrases are told apart
    by 64-bit hashes: that some two of n share theirs has a chance of about n * n / 2**65.
    """
    held = checkpoint(count_phrases(docs, text, lang, least))
    total = held.where("phrase = ''").select("lang", F.col("n").alias("words"))
    known = held.where("phrase <> ''").select("key", "n")
    candidates = held.where(F.size("first") > 0).withColumnRenamed("n", "a")
    cuts = candidates.select("key", "a", F.posexplode(F.arrays_zip("first", "rest")).alias("cut", "part")).select(
        "key", "a", "cut", F.col("part.first").alias("left"), F.col("part.rest").alias("right"))
    cuts = cuts.join(known.select(F.col("key").alias("left"), F.col("n").alias("l")), "left")
    cuts = cuts.join(known.select(F.col("key").alias("right"), F.col("n").alias("r")), "right")
    score = F.expr("CAST(CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(20, 0)) DIV (l + r) AS BIGINT)")
    best = cuts.select("key", F.struct(score.alias("score"), "cut", "l", "r").alias("at")).groupBy("key").agg(F.min("at").alias("at"))
    # of longer phrases around a candidate, one word longer ones have the largest counts
    around = candidates.where(F.size("first") > 1).select(
        F.explode(F.array(F.element_at("first", -1), F.element_at("rest", 1))).alias("key"), "a")
    around = around.groupBy("key").agg(F.max("a").alias("kept"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    alone = candidates.join(around, "key", "left").where(
        F.col("kept").isNull() | (F.lit(100) * exact("kept") < F.lit(percent) * exact("a")))
    scored = alone.join(best, "key").select("lang", "phrase", "a", "at.l", "at.r", "at.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # no task ranks a whole language: first in groups, then what they leave
    group = F.pmod(F.xxhash64("phrase"), F.lit(RANKED))
    led = scored.withColumn("group", group).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order)))
    led = led.where(F.col("rank") <= most).drop("group", "rank")
    placed = led.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return placed.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
