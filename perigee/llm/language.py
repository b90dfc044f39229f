"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every string that occurs in
it. A text is parsed greedily into the longest strings the automaton knows; the language that
needs the fewest phrases, normalised by the length of both texts, wins. Automata are flat
transition tables, and all segments of a slice of documents are parsed in step with numpy.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from perigee.llm.rows import flat, named, rows_and_text, schema_with_row, slices

UNKNOWN = "und"
#: Bounds of the labelled sample: documents of a language, characters of a document.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 64, 800
#: Bound of all automata together; languages share it evenly.
TABLE_BYTES = 96 << 20
#: Groups in which the hashes of a language are ranked at first.
RANKED = 16
#: Texts are parsed in segments of so many bytes; a phrase ends where its segment ends.
SEGMENT = 256

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_GAP = np.uint8(32)


@dataclass
class Model:
    """Transitions of all automata: `table[state * width + code]`, -1 for none; `codes` maps
    bytes to codes, `roots` and `size` (bytes learned from) go by language."""

    languages: list[str]
    codes: np.ndarray
    width: int
    table: np.ndarray
    roots: np.ndarray
    size: np.ndarray


def letters_only(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case text with every run of other characters as one space, none in front."""
    letter = _LETTER[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = letter
    before[bounds] = False
    keep = letter | before[:-1]
    after = np.concatenate([[0], np.cumsum(keep)])[bounds]
    return np.where(letter, data, _GAP)[keep], after


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the root."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return moves


def sample_texts(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """Of each language the SAMPLE_DOCUMENTS distinct texts of least hash, in lower case and
    cut to SAMPLE_CHARS characters. Hashes are made distinct first, so that a text which many
    rows repeat takes one place; then the texts up to the last of them are read."""
    rows = labelled.select(named(lang).cast("string").alias("lang"), named(text).cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("at", F.xxhash64("text"))
    # first in groups of a language's hashes, then what those leave: no task ranks a language
    first = rows.select("lang", "at").distinct().withColumn("group", F.pmod("at", F.lit(RANKED)))
    for keys in (["lang", "group"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("at"))
        first = first.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCUMENTS)
    bounds = {r["lang"]: r["last"] for r in first.groupBy("lang").agg(F.max("at").alias("last")).collect()}
    if not bounds:
        return {}
    last = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])
    begin = F.substring(F.lower("text"), 1, SAMPLE_CHARS)
    drawn = rows.where(F.col("at") <= last[F.col("lang")]).groupBy("lang", "at").agg(F.min(begin).alias("text"))
    held: dict[str, list[str]] = defaultdict(list)
    for row in drawn.orderBy("lang", "at").collect():
        held[row["lang"]].append(row["text"])
    return dict(held)


def even_cut(texts: list[str], most: int) -> bytes:
    """The letters of the texts, one after another, of at most `most` bytes. Where they have
    more, all texts are cut to the same length, the longest that fits."""
    held = [letters_only(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tobytes() for t in texts]
    held = [h.rstrip(b" ") + b" " for h in held if h.strip()]
    if sum(map(len, held)) > most:
        sizes, room, length = sorted(map(len, held)), most, 0
        for i, size in enumerate(sizes):
            length = room // (len(sizes) - i)
            if size > length:
                break
            room -= size
        held = [h[:length] for h in held]
    return b"".join(held).rstrip(b" ")


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", table_bytes: int = TABLE_BYTES) -> Model:
    """A model of the languages of the labelled rows, from a bounded sample.

    Of each language at most SAMPLE_DOCUMENTS distinct texts with letters are used, those of
    least hash, and of each at most SAMPLE_CHARS characters. All automata together hold at
    most `table_bytes`, shared evenly: with so many languages, or so many different bytes in
    them, that a language's sample is above its share, all its texts are cut to one shorter
    length. It is an error if a share does not hold a byte. Rows without language or text are
    left out; a text counts once, however many rows repeat it.
    """
    held = sample_texts(labelled, text, lang)
    joined = {name: even_cut(texts, sys.maxsize) for name, texts in sorted(held.items())}
    languages = [name for name, data in joined.items() if data]
    seen = sorted({_GAP, *b"".join(joined.values())})
    codes = np.full(256, len(seen), np.uint8)  # the last code is known to no automaton
    codes[seen] = np.arange(len(seen))
    width = len(seen) + 1
    most = table_bytes // (8 * width * max(1, len(languages)))
    if languages and not most:
        raise ValueError(f"{len(languages)} languages do not fit into tables of {table_bytes} bytes")
    tables, roots, sizes, states = [], [], [], 0
    for name in languages:
        data = even_cut(held[name], most)
        moves = suffix_automaton(codes[np.frombuffer(data, np.uint8)].tolist())
        table = np.full((len(moves), width), -1, np.int32)
        for state, out in enumerate(moves):
            table[state, list(out)] = [x + states for x in out.values()]
        tables.append(table.reshape(-1))
        roots.append(states)
        sizes.append(len(data))
        states += len(moves)
    return Model(languages, codes, width, np.concatenate(tables) if tables else np.zeros(0, np.int32),
                 np.array(roots, np.int32), np.array(sizes))


def phrases(model: Model, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Phrases that each language needs for each text: languages x texts. A byte that a
    language does not have is a phrase of its own; only then is the root left anew."""
    size = np.diff(bounds)
    parts = -(-size // SEGMENT)
    text = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = bounds[:-1][text] + SEGMENT * nth
    length = np.minimum(SEGMENT, bounds[1:][text] - start)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    live = np.searchsorted(-length, -np.arange(SEGMENT), side="left")
    code = model.codes[data].astype(np.int32)
    roots = model.roots[:, None]
    state = np.repeat(roots, len(start), 1)
    count = np.zeros((len(model.roots), len(start)), np.int64)
    first = model.table[roots * model.width + np.arange(model.width, dtype=np.int32)]
    first = np.where(first < 0, roots, first)
    for t in range(SEGMENT):
        n = live[t]
        if not n:
            break
        c = code[start[:n] + t]
        after = model.table[state[:, :n] * model.width + c]
        ends = after < 0
        count[:, :n] += ends | (state[:, :n] == roots)  # where a phrase begins
        state[:, :n] = np.where(ends, first[:, c], after)
    out = np.zeros((len(model.roots), len(size)), np.int64)
    for k in range(len(out)):
        out[k] = np.bincount(text[order], weights=count[k], minlength=len(size))
    return out


def identify(
    docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text"
) -> DataFrame:
    """Per document: `row` (kept columns), lang_pred, score, bits.

    `bits` is the winner's cross-parsing entropy in bits per byte of the letters, `score` by
    how large a part the runner-up needs more, 0 to 1; ties go to the first language in
    alphabetical order. `und` with score 0 stands for a text that is null or has no letter,
    and for all if no language was learned. Whole texts are parsed. Every row gives one row,
    repeated rows too; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = rows_and_text(docs, text, keep, letter=F.coalesce(named(text).cast("string").rlike(r"\p{L}"), F.lit(False)))
    rows = rows.withColumn("text", F.lower("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches):
            letter = part.column("letter").to_numpy(zero_copy_only=False).astype(bool)
            names, score, bits = [UNKNOWN] * len(letter), np.zeros(len(letter)), np.zeros(len(letter))
            if own.languages:
                data, bounds = letters_only(*flat(part.column("text")))
                size = np.maximum(np.diff(bounds), 1)
                cost = phrases(own, data, bounds) * np.log2(np.maximum(own.size, 2))[:, None] / size
                best = cost.argmin(axis=0)
                low = np.sort(cost, axis=0)
                score = 1 - low[0] / np.maximum(low[min(1, len(low) - 1)], 1e-12) if len(low) > 1 else np.ones(len(letter))
                score = np.where(letter, np.clip(score, 0, 1), 0.0)
                bits = np.where(letter, low[0], 0.0)
                names = [own.languages[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())],
                ["row", "lang_pred", "score", "bits"],
            )

    return rows.mapInArrow(work, schema_with_row(rows, ("lang_pred", "string"), ("score", "double"), ("bits", "double")))
