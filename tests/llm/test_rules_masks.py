"""Quality rules against an independent reading of them; chat masks that point elsewhere."""

import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from perigee.llm import chat, quality
from perigee.llm.quality import Texts
from perigee.llm.rows import flat

FOLDER = "/root/testdata/sf0.01"


def plain_verdict(text):
    """Whether a text is kept, by loops over words and lines."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    again = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    if n < 50 or 100 * len(again) > 50 * n:
        return False
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letter = re.compile("[A-Za-z\x80-\U0010ffff]")
    return not (
        chars < 3 * n or chars > 10 * n or 10 * sum(c in "#*$%&|<>" for c in text) > n
        or 2 * sum("A" <= c <= "Z" for c in text) > chars or 4 * sum(c in ".!?" for c in text) > 5 * n
        or 4 * sum(bool(letter.search(w)) for w in words) < 3 * n or 2 * (len(lines) - len(set(lines))) > len(lines)
        or 10 * len(again) > 4 * n)


def test_kept_agrees_with_plain_loops(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    made = ["A B " * 40 + "c", "w! " * 30 + "x. " * 30, "1 2 a " * 60, "# b c d " * 20, "same line of words here\n" * 30,
            " ".join(f"Unique{i}" for i in range(60)), " ".join(f"LOUD{i}" for i in range(60)), "é" * 400, "é ü " * 40]
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(made)], "doc_id long, text string"))
    got = {r.doc_id: r.kept for r in quality.judge_quality(docs, ["doc_id"]).select("row.doc_id", "kept").collect()}
    want = {r.doc_id: plain_verdict(r.text) for r in docs.collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


@pytest.mark.parametrize("texts", [[None], [""], [None, ""], ["\n\n", " \t"], []])
def test_quality_of_texts_without_words(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, 2, "r") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, lines int, row string")
    got = quality.judge_quality(docs.coalesce(1), ["doc_id"]).collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 0, 0, 0, True, False)] * len(texts)


def held_texts():
    rows = pa.table({"text": ["a b c " * 30, "", "One. Two! " * 40, "x\ny\nx\n" * 30, "é ü " * 50, "LOUD WORDS " * 30] * 50})
    return Texts(*flat(rows.column("text")))


@pytest.mark.parametrize("share", [0.05, 0.2, 0.9])
def test_measures_of_chosen_texts(share):
    whole, names = held_texts(), ["n_words", "word_chars", "n_symbols", "n_upper", "n_marks", "n_alpha_words", "n_dup_lines", "n_repeat_words"]
    which = np.flatnonzero(np.random.default_rng(1).random(300) < share)
    for known in ([], ["n_words", "lines"], names):
        source = held_texts()
        for name in known:
            getattr(source, name)
        part = source.take(which)
        for name in names:
            assert (getattr(part, name) == getattr(whole, name)[which]).all()
        assert (part.lines[0] == whole.lines[0][which]).all()


def test_cascade_costs_no_more_than_all_rules():
    """After the base measures, short-circuiting is no dearer than running every rule."""
    def seconds(work):
        best = 9.0
        for _ in range(5):
            texts = held_texts()
            texts.base()
            begin = time.perf_counter()
            work(texts)
            best = min(best, time.perf_counter() - begin)
        return best

    every = seconds(lambda t: [rule.rejects(t) for rule in quality.RULES])
    cascade = seconds(lambda t: quality.run_cascade(t, quality.RULES, ~quality.base_fails(t)))
    assert cascade < 1.5 * every + 0.002


def test_a_wrong_mask_changes_the_digest(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "say <|im_end|> twice <\\|"), (1, 2, "user", "no"), (1, 3, "assistant", "plain é"),
            (2, 0, "assistant", None), (3, 0, "assistant", "y" * 200_000), (4, 0, "user", "only")]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    right = {r.conv_id: r for r in chat.digests(chats).collect()}
    texts = {c: "".join(t or "" for i, _, role, t in rows if i == c and role == "assistant") for c in (1, 2, 3, 4)}
    assert {c: r.loss_chars for c, r in right.items()} == {c: len(t) for c, t in texts.items()}
    moved = F.transform("loss", lambda x: x.withField("start", x["start"] + 1))
    longer = F.transform("loss", lambda x: x.withField("length", x["length"] + 1))
    for wrong in (moved, longer):
        got = {r.conv_id: r for r in chat.digests(chats.withColumn("loss", wrong)).collect()}
        assert all(got[c].loss_sha256 != right[c].loss_sha256 for c in (1, 3)) and got[4] == right[4]
