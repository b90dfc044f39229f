"""SimHash near-duplicates with BK-trees.

Distinct fingerprints are dealt into shards such that any two within the radius share a shard:
the bits are cut into blocks, and a shard is a choice of blocks and their values (of more
blocks than the radius, at least one less the radius stays equal). Each shard's fingerprints
form a BK-tree, whose children are keyed by their Hamming distance to the parent; a search
follows the edges within the radius of its own distance. A task keeps the links it finds as a
forest, so a group of near copies leaves one link per member and shard, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from perigee.llm.arrays import LOWER
from perigee.llm.components import checkpoint, components
from perigee.llm.rows import rows_and_text, schema_with_row, slices, texts

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: A shard of more members is cut again by the bits its members need not share.
CUT_ABOVE = 2048
#: (fingerprint, node) pairs looked at together: bounds a search's memory.
FRONTIER = 1 << 20
_FOLD = bytes(LOWER.tolist())
U = np.uint64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text: a bit is set if it is in over half of the shingles' hashes."""
    words = text.translate(_FOLD).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    starts = [0]
    for w in words[:-1]:
        starts.append(starts[-1] + len(w) + 1)
    ends = [s - 1 for s in starts[shingle:]]
    ends.append(len(joined))
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], U)
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """`row` (kept columns) and `print`, the fingerprint as a signed 64-bit integer."""
    rows = rows_and_text(docs, text, keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            held = np.array([fingerprint(x) for x in texts(part.column("text"))], U)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(held.view(np.int64))], ["row", "print"])

    return rows.mapInArrow(work, schema_with_row(rows, ("print", "long")))


class Trees:
    """The BK-trees of many shards: node i has value[i]; its children lie together, by edge."""

    def __init__(self, value: np.ndarray, shard: np.ndarray):
        n = len(value)
        self.value = value
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.zeros(0, np.int64)
        self.root = np.repeat(first, np.diff(np.append(first, n)))
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        at, left = self.root.copy(), np.flatnonzero(self.root != np.arange(n))
        child = np.zeros(0, np.int64), np.zeros(0, np.int64)  # (key, node), sorted by key
        while len(left):
            d = np.bitwise_count(value[left] ^ value[at[left]]).astype(np.int64)
            key = at[left] * (BITS + 1) + d
            fresh, index = np.unique(key, return_index=True)
            chosen = left[index]  # the first fingerprint of each edge becomes the child
            parent[chosen], edge[chosen] = fresh // (BITS + 1), fresh % (BITS + 1)
            keys, nodes = np.concatenate([child[0], fresh]), np.concatenate([child[1], chosen])
            order = np.argsort(keys, kind="stable")
            child = keys[order], nodes[order]
            rest = np.ones(len(left), bool)
            rest[index] = False
            left, key = left[rest], key[rest]
            at[left] = chosen[np.searchsorted(fresh, key)]
        self.keys, self.nodes = child

    def within(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (i, j): fingerprints of one shard at most `radius` apart, i < j."""
        stack = [(np.arange(len(self.value)), self.root)]
        while stack:
            query, node = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            d = np.bitwise_count(self.value[query] ^ self.value[node]).astype(np.int64)
            hit = (d <= radius) & (query < node)
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.keys, node * (BITS + 1) + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, node * (BITS + 1) + np.minimum(d + radius, BITS), side="right")
            size = high - low
            total = int(size.sum())
            if total:
                stack += _unfold(query, low, size, self.nodes)


def _unfold(query: np.ndarray, low: np.ndarray, size: np.ndarray, nodes: np.ndarray) -> list[tuple]:
    """The next (query, node) pairs, in parts that fit a frontier."""
    out, after = [], np.cumsum(size)
    begin = 0
    while begin < len(size):
        done = after[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(after, done + FRONTIER, side="right")))
        part = size[begin:end]
        total = int(part.sum())
        if total:
            first = np.cumsum(part) - part
            place = np.repeat(low[begin:end] - first, part) + np.arange(total)
            out.append((np.repeat(query[begin:end], part), nodes[place]))
        begin = end
    return out


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = parent[up]


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[i] and b[i]; the lesser root stays."""
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        if len(a):
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def block_bounds(count: int) -> list[int]:
    return [BITS * i // count for i in range(count + 1)]


def blocks_for(n: int, radius: int) -> int:
    """Blocks such that shards of n evenly spread fingerprints stay small."""
    count = radius + 1
    while count < radius + 4 and n >> (BITS * (count - radius) // count) > 64:
        count += 1
    return count


def shard_keys(value: Column, count: int, radius: int) -> list[Column]:
    """One key per choice of count - radius blocks: the choice and the bits of its blocks."""
    bounds = block_bounds(count)
    out = []
    for number, chosen in enumerate(combinations(range(count), count - radius)):
        mask = sum((1 << bounds[b + 1]) - (1 << bounds[b]) for b in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.xxhash64(F.lit(number), value.bitwiseAND(F.lit(signed).cast("long"))))
    return out


def _cut(value: np.ndarray, shard: np.ndarray, radius: int, level: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in `value` in shard order, and their shards. A shard above CUT_ABOVE is cut by
    radius + 1 groups of those bits in which its members differ: two within the radius agree
    in at least one group, so that no link is lost."""
    order = np.lexsort((value, shard))
    begins = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]]))
    size = np.diff(np.append(begins, len(order)))
    big = size > CUT_ABOVE if level < 4 else np.zeros(len(size), bool)
    small = ~np.repeat(big, size)
    if small.any():
        yield order[small], shard[order][small]
    for begin, n in zip(begins[big].tolist(), size[big].tolist(), strict=True):
        members = order[begin : begin + n]
        own = value[members]
        vary = int(np.bitwise_or.reduce(own ^ own[0]))
        places = [i for i in range(BITS) if vary >> i & 1]
        for part in range(radius + 1):
            mask = sum(1 << i for i in places[part :: radius + 1])
            sub = np.unique(own & U(mask), return_inverse=True)[1]
            for inner, shards in _cut(own, sub, radius, level + 1):
                yield members[inner], shards


def shard_links(value: np.ndarray, shard: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each distinct value, the least value its links in these shards reach."""
    distinct, at = np.unique(value, return_inverse=True)
    parent = np.arange(len(distinct))
    for places, shards in _cut(value, shard, radius):
        trees = Trees(value[places], shards)
        own = at[places]
        for i, j in trees.within(radius):
            _merge(parent, own[i], own[j])
    return distinct[_find(parent, np.arange(len(distinct)))], distinct


def split_shards(dealt: DataFrame, radius: int, limit: int = CUT_ABOVE, levels: int = 4) -> DataFrame:
    """The rows (print, id, shard) with shards above `limit` members dealt anew, before any
    task gathers one: by radius + 1 groups of those bits in which its members differ, of
    which two within the radius agree in at least one. Members of a cut shard are repeated
    radius + 1 times a level; shards as small as the limit stay as they are."""
    bits = F.expr("filter(sequence(0, 63), i -> (shiftright(vary, i) & 1) = 1)")
    masks = F.expr(f"""transform(sequence(0, {radius}), p -> aggregate(
        filter(places, (x, i) -> i % {radius + 1} = p), 0L, (m, x) -> m | shiftleft(1L, x)))""")
    for _ in range(levels):
        sizes = dealt.groupBy("shard").agg(
            F.count("*").alias("n"), F.bit_or("print").bitwiseXOR(F.bit_and("print")).alias("vary")
        )
        large = checkpoint(sizes.where(F.col("n") > limit).withColumn("places", bits).select("shard", masks.alias("masks")))
        if large.isEmpty():
            break
        cut = dealt.join(large, "shard").select("print", "id", F.explode(F.transform(
            "masks", lambda m, i: F.xxhash64("shard", i, F.col("print").bitwiseAND(m)))).alias("shard"))
        dealt = checkpoint(dealt.join(large, "shard", "left_anti").select("print", "id", "shard").unionByName(cut))
    return dealt


def links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between ids of fingerprints at most `radius` bits apart: the forest of
    each task. `distinct` has print and id, each print once; n is about its size."""
    count = blocks_for(n, radius)
    dealt = distinct.select("print", "id", F.explode(F.array(*shard_keys(F.col("print"), count, radius))).alias("shard"))
    dealt = split_shards(dealt, radius)
    tasks = max(1, n // 8_000)
    dealt = dealt.withColumn("task", F.pmod("shard", F.lit(tasks)))

    def work(held: pa.Table) -> pa.Table:
        value = held.column("print").to_numpy().view(U)
        ids = held.column("id").to_numpy()
        least, each = shard_links(value, np.unique(held.column("shard").to_numpy(), return_inverse=True)[1], radius)
        order = np.argsort(value, kind="stable")
        place = lambda x: ids[order[np.searchsorted(value[order], x)]]
        linked = least != each
        return pa.table({"a": place(each[linked]), "b": place(least[linked])})

    return dealt.groupBy("task").applyInArrow(work, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, keep: list[str] | None = None, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS
) -> DataFrame:
    """Per document: `row` (kept columns, only `doc_id` by default), print, component (the same
    for all documents of a component), component_id.

    `component_id` is the least doc_id reachable over links of at most `radius` differing
    bits, the document's own included. Texts without words, null ones too, have print zero
    and are linked like any other. A null doc_id takes part, but names no component unless
    all ids in it are null. Repeated rows and ids give a row each; an empty table gives none.
    Join the result to the table by doc_id for further columns.
    """
    kept = keep or [doc_id]
    found = fingerprints(docs, list(dict.fromkeys([*kept, doc_id])), text)
    prints = checkpoint(found.select(F.col(f"row.`{doc_id}`").cast("long").alias("id"), "print", "row"))
    nodes = checkpoint(prints.groupBy("print").agg(F.min("id").alias("least")))
    linked = components(links(nodes.select("print", F.col("print").alias("id")), nodes.count(), radius))
    classes = nodes.join(linked.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "least", F.coalesce("component", "print").alias("component")
    )
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    known = classes.join(least, "component").select("print", "component", "component_id")
    return prints.join(known, "print").select(
        F.struct(*[F.col(f"row.`{c}`").alias(c) for c in kept]).alias("row"), "print", "component", "component_id"
    )
