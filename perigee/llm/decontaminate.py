"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items.

Texts are folded byte by byte (A-Z to lower case, every other ASCII byte that is no letter or
digit to a space), so a folded byte stands where its original stands and hits map straight
back. Words are then joined by single spaces and scanned once.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from perigee.llm.components import checkpoint
from perigee.llm.rows import named, rows_and_text, schema_with_row, slices, texts

WINDOW = 10
#: Windows of more text than this are dealt into blocks of about so much, each broadcast and
#: scanned for after the one before; what is found so far goes along with the texts.
AUTOMATON_BYTES = 16 << 20

FOLD = bytes(
    i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32
    for i in range(256)
)


def item_windows(benchmark: DataFrame, item_id: str, item_text: str, window: int = WINDOW) -> DataFrame:
    """The distinct windows of all items: `key`, the words with a space between and on both
    sides; n, their number; `items`, the ids as sorted text."""
    rows = rows_and_text(benchmark, item_text, [item_id], item=named(item_id).cast("string")).select("item", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: dict[str, list] = {"item": [], "key": [], "n": []}
            for item, text in zip(part.column("item").to_pylist(), texts(part.column("text")), strict=True):
                words = text.translate(FOLD).split()
                found = {tuple(words[i : i + window]) for i in range(max(len(words) - window + 1, min(len(words), 1)))}
                out["item"] += [item] * len(found)
                out["key"] += [b" " + b" ".join(w) + b" " for w in found]
                out["n"] += map(len, found)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("item", pa.string()), ("key", pa.binary()), ("n", pa.int32())]))

    each = rows.mapInArrow(cut, "item string, key binary, n int")
    return each.groupBy("key", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))


def build(block: list[tuple]) -> ahocorasick.Automaton | None:
    """The automaton of windows (key, n, items); none for no windows."""
    if not block:
        return None
    automaton = ahocorasick.Automaton()
    for key, n, items in block:
        automaton.add_word(bytes(key).decode("latin-1"), (n, tuple(items)))
    automaton.make_automaton()
    return automaton


def scan(text: bytes, automaton) -> tuple[int, list[tuple[int, int]], set]:
    """Words of the text, runs of hit words as (first, beyond), and ids found."""
    words = text.translate(FOLD).split()
    if not words:
        return 0, [], set()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits: list[tuple[int, int]] = []
    ids: set = set()
    after = None
    for end, (n, items) in automaton.iter(joined) if automaton else ():
        if after is None:
            after = np.cumsum([len(w) + 1 for w in words])
        last = int(np.searchsorted(after, end))
        hits.append((last - n + 1, last + 1))
        ids.update(items)
    return len(words), merged(hits), ids


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in order, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of words as spans of characters of the original text."""
    inside = np.frombuffer(text.translate(FOLD), np.uint8) != 32
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(chars[starts[a]]), "end": int(chars[ends[b - 1]])} for a, b in runs]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Per document: `row` (kept columns), n_words, n_hit, items, spans.

    A window is `window` consecutive words of an item; an item of fewer words, but not none,
    is one window. `n_hit` counts the document's words inside an occurrence of any window,
    `items` lists the item ids (as text, sorted) whose windows occur, `spans` the hit parts of
    the original text in characters. Null or empty texts have no words and no hits. Items
    without id mark words and are not listed; one id on several rows is listed once. With an
    empty benchmark nothing is hit. Every row of `docs` gives one row, repeated ones too.
    """
    windows = checkpoint(item_windows(benchmark, item_id, item_text, window))
    size = windows.agg(F.sum(F.octet_length("key")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // AUTOMATON_BYTES))
    context = docs.sparkSession.sparkContext
    rows = rows_and_text(docs, text, keep)
    state = schema_with_row(rows, ("text", "string"), ("runs", "array<struct<a:int,b:int>>"), ("found", "array<string>"))
    held = rows.select("row", "text", F.array().cast("array<struct<a:int,b:int>>").alias("runs"), F.array().cast("array<string>").alias("found"))
    for number in range(blocks):
        block = windows.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == number).select("key", "n", "items")
        shared = context.broadcast([tuple(r) for r in block.collect()])
        if number < blocks - 1:
            held = checkpoint(held.mapInArrow(_pass(shared, last=False), state))
            shared.destroy()
    return held.mapInArrow(_pass(shared, last=True), schema_with_row(
        rows, ("n_words", "long"), ("n_hit", "long"), ("items", "array<string>"),
        ("spans", "array<struct<start:long,end:long>>"),
    ))


def _pass(shared, last: bool):
    """The scan with one block of windows, after those with the blocks before it."""
    pair = pa.struct([("a", pa.int32()), ("b", pa.int32())])
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build(shared.value)
        for part in slices(batches):
            held = texts(part.column("text"))
            words, runs, found = [], [], []
            for text, before, ids in zip(held, part.column("runs").to_pylist(), part.column("found").to_pylist(), strict=True):
                n, own, items = scan(text, automaton)
                words.append(n)
                runs.append(merged(own + [(r["a"], r["b"]) for r in before]) if before else own)
                found.append(sorted(items.union(ids)))
            items = pa.array(found, pa.list_(pa.string()))
            if not last:
                kept = pa.array([[{"a": a, "b": b} for a, b in r] for r in runs], pa.list_(pair))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), kept, items], ["row", "text", "runs", "found"])
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"), pa.array(words, pa.int64()),
                    pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()), items,
                    pa.array([original_spans(x, r) if r else [] for x, r in zip(held, runs, strict=True)], pa.list_(span)),
                ],
                ["row", "n_words", "n_hit", "items", "spans"],
            )

    return work
