"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered as an opening mark, the role, a line feed, the text, a closing mark and a
line feed. Each rendered turn is parsed again; where the parser does not give the turn back,
its content is escaped: a backslash goes between `<` and `|`, after any that stand there. So
`<|` cannot occur in escaped content, and taking one backslash out restores it. The whole
conversation is parsed once more at the end and compared with its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, CLOSE, FEED = "<|im_start|>", "<|im_end|>", "<|nl|>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE + "\n"))


def _escaped_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(FEED))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text). A part goes from an
    opening mark to the first closing mark; its role ends at the first line feed."""

    def turn(part: Column) -> Column:
        head = F.substring_index(part, CLOSE, 1)
        role = F.substring_index(head, "\n", 1)
        return F.struct(
            unescape(F.replace(role, F.lit(FEED), F.lit("\n"))).alias("role"),
            unescape(F.substring(head, F.length(role) + 2, F.length(head))).alias("text"),
        )

    parts = F.split(formatted, r"<\|im_start\|>")
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted text, loss mask, turns as parsed back.

    `turns` has conv_id, turn, role and text. Turns go by (turn, role, text); repeated rows
    are repeated turns. A null role or text is empty, a null turn comes first, and rows
    without conv_id form one conversation. `loss` lists the texts to learn from: ordinal of
    the turn, and the span of its text in `formatted`, in code points from 0. The call fails
    at run time if a conversation is not recovered exactly. Other columns are ignored; an
    empty table gives no rows. A conversation is one value and must fit into one task.
    """
    source = turns.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    plain = _render(F.col("role"), F.col("text"))
    safe = _render(_escaped_role(F.col("role")), escape(F.col("text")))
    turn = F.struct("role", "text")
    pieces = source.withColumn("raw", plain).withColumn(
        "piece", F.when(parse(F.col("raw")) == F.array(turn), F.col("raw")).otherwise(safe)
    )
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = pieces.select(
        "conv_id", "turn", "role", "text", "piece",
        F.row_number().over(before).alias("ordinal"),
        F.coalesce(F.sum(F.length("piece")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
    )
    gathered = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "role", "text", "piece", "start"))).alias("all")
    )
    built = gathered.select(
        "conv_id",
        F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
        F.transform(
            F.filter("all", lambda x: x["role"] == LEARNED_ROLE),
            lambda x: F.struct(
                x["ordinal"].alias("ordinal"),
                (x["start"] + len(OPEN + LEARNED_ROLE) + 1).cast("long").alias("start"),
                (F.length(x["piece"]) - len(OPEN + LEARNED_ROLE + CLOSE) - 2).cast("long").alias("length"),
            ),
        ).alias("loss"),
    )
    read = built.withColumn("parsed", parse(F.col("formatted")))
    return read.select(
        "conv_id",
        "formatted",
        "loss",
        F.when(F.col("parsed") == F.col("source"), F.col("parsed"))
        .otherwise(F.raise_error(F.lit("a conversation is not recovered from its formatted text")))
        .alias("turns"),
    )


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted text and its mask give back: counts and digests per conversation. The
    learned texts are cut out of `formatted` by the spans of the mask."""
    cut = lambda x: F.substring("formatted", (x["start"] + 1).cast("int"), x["length"].cast("int"))
    learned = F.array_join(F.transform("loss", lambda x: unescape(cut(x))), "")
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
