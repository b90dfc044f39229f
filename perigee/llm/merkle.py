"""Merkle manifest of a dataset, as a nested rollup.

Rows become leaves, leaves become binary trees, one for each value of a column, and the trees'
roots become leaves of a last tree. A leaf's rank in its tree is spelled in binary digits, a
column each; grouping the digits away one after another, the last first, nests two child
structs in a parent each time and hashes them. This goes on inside blocks of 2**DIGITS leaves,
which bound a row; the blocks' roots are the leaves of the next round, until one is left.

A block's struct holds all that the proofs of its leaves need: nested transforms walk down to
the leaves, collecting what stands beside the way, and one explode emits them. Only what lies
above a block, a row for 2**DIGITS leaves, is joined to it: nesting that too would put a whole
tree into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from perigee.llm.components import checkpoint
from perigee.llm.rows import named

#: Digits grouped away in a round; a block has up to 2**DIGITS leaves.
DIGITS = 10
_STEP = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def spelled(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(*[spelled(v) for v in values])


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the steps of its proof lead to."""
    return F.aggregate(steps, leaf, lambda held, s: digest(s["left"], held, s["right"]))


def siblings(steps: Column) -> Column:
    """Digests beside the way from leaf to root, one after another."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with `rank`, their place in their `tree` by these columns from 0, and `size`,
    the rows of the tree. Rows are sorted over all tasks; only counts of tasks are windowed."""
    rows = checkpoint(rows)  # bounds of the ranges are sampled: rows are made once
    placed = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = checkpoint(placed.withColumn("at", F.monotonically_increasing_id()))
    runs = placed.groupBy("tree", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("low"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    runs = runs.select(
        "tree", "part", "low", F.sum("n").over(tree).alias("size"),
        (F.sum("n").over(tree.orderBy("part")) - F.col("n")).alias("first"),
    )
    joined = placed.withColumn("part", F.shiftright("at", 33)).join(runs, ["tree", "part"])
    return joined.select(*rows.columns, (F.col("at") - F.col("low") + F.col("first")).alias("rank"), "size")


def roll(rows: DataFrame, digits: int) -> DataFrame:
    """Blocks (tree, block, size, node) of rows (tree, rank, size, hash, payload). A node has its
    hash and `kids`, one or two nodes below it; at the bottom stand the payloads. A level that
    has a single node is the root already: above it nothing is hashed."""
    names = [f"d{j}" for j in range(digits)]
    at = rows.select(
        "tree", F.shiftright("rank", digits).alias("block"), "size",
        *[F.shiftright("rank", j).bitwiseAND(F.lit(1)).alias(name) for j, name in enumerate(names)],
        F.struct("hash", "payload").alias("node"),
    )
    # one exchange and one sort serve all the groupings: each has a prefix of the keys before
    at = at.repartition("tree", "block").sortWithinPartitions("tree", "block", "size", *reversed(names))
    for j, name in enumerate(names):
        keys = ["tree", "block", "size", *reversed(names[j + 1 :])]
        side = lambda digit: F.first(F.when(F.col(name) == digit, F.col("node")), ignorenulls=True)  # noqa: B023, E731
        pair = at.groupBy(*keys).agg(side(0).alias("left"), side(1).alias("right"))
        joined = digest(F.col("left.hash"), F.coalesce("right.hash", F.lit("")))
        held = F.when(F.col("size") > F.lit(1 << j), joined).otherwise(F.col("left.hash"))
        at = pair.select(*keys, F.struct(held.alias("hash"), F.array_compact(F.array("left", "right")).alias("kids")).alias("node"))
    return at


def build(rows: DataFrame, digits: int) -> list[tuple[DataFrame, int]]:
    """The blocks of every round and the digits grouped away in it; in the last round each tree
    has one block. A round takes no more digits than its largest tree has."""
    rounds = []
    largest = rows.agg(F.max("size")).first()[0] or 1
    while True:
        taken = max(1, min(digits, (largest - 1).bit_length()))
        blocks = checkpoint(roll(rows, taken))
        rounds.append((blocks, taken))
        largest = -(-largest // (1 << taken))
        if largest == 1:
            return rounds
        size = F.shiftright(F.col("size") + F.lit((1 << taken) - 1), taken)
        rows = blocks.select("tree", F.col("block").alias("rank"), size.alias("size"), "node.hash", F.struct("block").alias("payload"))


def _members(node: Column, digits: int, size: Column, steps: Column) -> Column:
    """The payloads under a node, each with the steps from it to the root."""
    if digits == 0:
        return F.array(F.struct(node["payload"].alias("payload"), steps.alias("steps")))
    kids, nothing = node["kids"], F.lit("")

    def under(kid: Column, place: Column) -> Column:
        beside = F.struct(
            F.when(place == 1, kids[0]["hash"]).otherwise(nothing).alias("left"),
            F.when(place == 0, F.coalesce(F.get(kids, F.lit(1))["hash"], nothing)).otherwise(nothing).alias("right"),
        )
        here = F.when(size > F.lit(1 << (digits - 1)), F.array(beside)).otherwise(F.array().cast(_STEP))
        return _members(kid, digits - 1, size, F.concat(here, steps))

    return F.flatten(F.transform(kids, under))


def descend(rounds: list[tuple[DataFrame, int]], above: DataFrame) -> DataFrame:
    """(tree, payload, steps, further columns of `above`) for each leaf. `above` has for each
    tree the steps from its root upwards."""
    more = [c for c in above.columns if c not in ("tree", "block", "steps")]
    above = above.withColumn("block", F.lit(0).cast("long"))
    out = above
    for number, (blocks, digits) in reversed(list(enumerate(rounds))):
        held = blocks.join(above, ["tree", "block"])
        members = _members(F.col("node"), digits, F.col("size"), F.col("steps"))
        out = held.select("tree", *more, F.explode(members).alias("m")).select("tree", *more, "m.payload", "m.steps")
        if number:
            above = out.select("tree", F.col("payload.block").alias("block"), "steps", *more)
    return out


def manifest(
    docs: DataFrame, fields: list[str], tree: str = "lang", order: str = "doc_id", keep: list[str] | None = None,
    digits: int = DIGITS, **carried: Column,
) -> DataFrame:
    """Per row: `row` (kept columns, `order` by default), leaf, subroot, root, steps and the
    carried columns, which are made of the row's own.

    A leaf is the digest of the fields in this order, each with its length. The rows of each
    value of `tree` are leaves of a tree by ascending `order` (null first, equal ones by leaf);
    while it has several nodes, every two consecutive ones become the digest of both, and a
    last single one the digest of it alone. `subroot` is what remains. The subroots, by value
    of `tree` (null first, by UTF-8 bytes), are built up to `root` in the same way. `steps`
    are what stands left and right of the way from leaf to root, so that `fold(leaf, steps)`
    gives `root` for rows that are as they were.

    Null and empty values differ in their leaves. Repeated rows are leaves of their own; an
    empty table has no rows and no root.
    """
    source = docs.select(
        F.coalesce(F.concat(F.lit("+"), named(tree).cast("string")), F.lit("")).alias("tree"),
        named(order).alias("place"), leaf_of(*[named(c) for c in fields]).alias("hash"),
        F.struct(*[named(c) for c in keep or [order]]).alias("row"), *[c.alias(f"carried_{k}") for k, c in carried.items()],
        F.monotonically_increasing_id().alias("turn"),  # equal rows can go to several tasks
    )
    payload = F.struct("row", *[F.col(f"carried_{k}").alias(k) for k in carried], F.col("hash").alias("leaf"))
    leaves = ranked(source, ["place", "hash", "turn"]).withColumn("payload", payload)
    rounds = build(leaves, digits)
    tops = rounds[-1][0].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("node.hash").alias("hash"))
    tops = ranked(tops, ["name"]).withColumn("payload", F.struct("name", "hash"))
    last = build(tops, digits)
    none = F.array().cast(_STEP)
    root = last[-1][0].select("tree", none.alias("steps"), F.col("node.hash").alias("root"))
    above = descend(last, root).select(
        F.col("payload.name").alias("tree"), "steps", "root", F.col("payload.hash").alias("subroot"))
    return descend(rounds, above).select(
        "payload.row", *[F.col(f"payload.{k}").alias(k) for k in carried], "payload.leaf", "subroot", "root", "steps")
