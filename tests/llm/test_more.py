"""Scoring, quality, token files, pages, chats and the pipeline against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from perigee.llm import byte_bpe, chat, lm, quality, queries, simhash, sql, token_files
from perigee.llm.html_text import extract_text, visible_text

FOLDER = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "one", "ONE one", "é ñ\x0bü", "a b c " * 400, "x" * 100_000, "\n\nline one\nline one\n line one\n"]


@pytest.fixture(scope="module")
def rows(spark):
    held = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    return held + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(10_001, "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, 1, "r") for d, t in rows], "doc_id long, text string, chunk int, row string").repartition(3)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# scoring ------------------------------------------------------------------------------------


def test_lm_counts_and_base_agree_with_brute_force(docs, rows, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 5000)
    held_out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    tokens = [(d, words_of(lower(t)) + ["\0end"]) for d, t in rows]
    count = Counter(w for d, ws in tokens if not held_out[d] for w in ws)
    total, kinds = sum(count.values()), len(count)
    want = sorted(
        (d, len(ws), sum(count[w] > 0 for w in ws), total, round(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in ws), 6))
        for d, ws in tokens
    )
    got = lm.score(docs, queries.remainder(7) != 2, ["doc_id"]).select(
        "row.doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6), "score").collect()
    assert sorted(tuple(r)[:5] for r in got) == want
    assert all(r.score <= 0 for r in got)


def test_model_beats_its_base_on_held_out_text(spark):
    got = queries.op1_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(
        F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert got[2] > 100 and got[0] > got[1]


def test_filter_reads_levels_back():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2))
    level = lm.level_of(rng.integers(1, 200, len(keys)))
    held = lm.Slice(keys, level)
    assert (held.level(keys) == level).all() and held.held.mean() <= 0.55
    assert (held.level(rng.integers(0, 2**63, 100_000, dtype=np.uint64) | np.uint64(1)) == 0).all()
    empty = lm.Slice(keys[:0], level[:0])
    assert (empty.level(keys) == 0).all() and len(held.level(keys[:0])) == 0


def test_levels_bound_their_counts():
    count = np.concatenate([np.arange(1, 5000), 2 ** np.arange(13, 50)])
    level = lm.level_of(count)
    assert (lm.least_of(level) <= count).all() and (count <= lm.most_of(level)).all()
    assert (count < 1.5 * lm.least_of(level)).all() and lm.level_of(np.array([0])) == 0 and lm.least_of(np.array([0])) == 0


@pytest.mark.parametrize("seed, texts", [(1, 4), (2, 60)])
def test_probabilities_after_a_context_sum_to_no_more_than_one(seed, texts):
    rng = np.random.default_rng(seed)
    held = [" ".join(f"w{min(int(x), 300)}" for x in rng.pareto(0.7, 60)) for _ in range(texts)]
    data = [t.encode() for t in held]
    token, first = lm.tokens(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    before = lm.contexts(token, first)
    words, count = np.unique(token, return_counts=True)
    pairs, both = np.unique(lm.pair_keys(before, token), return_counts=True)
    one, two = lm.Slice(words, lm.level_of(count)), lm.Slice(pairs, lm.level_of(both))
    for context in [*rng.choice(words, 40), lm._END, np.uint64(12345)]:
        c = np.full(len(words) + 1, context)
        every = np.append(words, np.uint64(999))  # all known words, and one that stands for the rest
        p = 10 ** lm.log10_probability(one.level(c), one.level(every), two.level(lm.pair_keys(c, every)), len(token), len(words))
        assert 0 < p.sum() <= 1 + 1e-12


def brute_score(rows, held_out):
    """Scores from exact counts, with each count read as its level says."""
    texts = [[None, *words_of(lower(t)), None] for _, t in rows]  # None: an end
    learned = [w for (d, _), w in zip(rows, texts) if not held_out[d]]
    one = Counter(x for w in learned for x in w[1:])
    two = Counter(p for w in learned for p in zip(w, w[1:]))
    total, kinds, out = sum(one.values()), len(one), {}
    low = lambda n: int(lm.least_of(lm.level_of(np.array([n])))[0])
    high = lambda n: int(lm.most_of(lm.level_of(np.array([n])))[0])
    for (d, _), w in zip(rows, texts):
        value = 0.0
        for c, x in zip(w, w[1:]):
            unigram = (low(one[x]) + 1) / (total + kinds + 1)
            value += math.log10((max(low(two[c, x]) - lm.DISCOUNT, 0) + lm.STRENGTH * unigram) / (high(one[c]) + lm.STRENGTH))
        out.setdefault(d, []).append(value)
    return out


@pytest.mark.parametrize("shard_tokens", [5000, 10**6])
def test_scores_agree_with_brute_force(docs, rows, monkeypatch, shard_tokens):
    monkeypatch.setattr(lm, "SHARD_TOKENS", shard_tokens)
    held_out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    want = brute_score(rows, held_out)
    got = {}
    for r in lm.score(docs, queries.remainder(7) != 2, ["doc_id"]).select("row.doc_id", "score").collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert set(got) == set(want)
    for d, values in want.items():
        assert sorted(got[d]) == pytest.approx(sorted(values), rel=1e-9)


def test_model_without_training_rows(docs):
    got = lm.score(docs, F.lit(False), ["doc_id"]).agg(F.min("score"), F.max("score"), F.max("train_tokens"), F.min("base_score")).first()
    assert tuple(got) == (0.0, 0.0, 0, 0.0)


# quality ------------------------------------------------------------------------------------


def test_quality_counts_agree_with_brute_force(docs, rows):
    want = []
    for d, text in rows:
        text = text or ""
        w = words_of(text)
        grams = Counter(zip(w, w[1:], w[2:]))
        cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if words_of(x)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
                     len(cover), len(w) < 50 or 2 * len(cover) > len(w)))
    got = quality.judge_quality(docs, ["doc_id"])
    assert sorted(tuple(r) for r in got.select("row.doc_id", *quality._COUNTS, "base_failed").collect()) == sorted(want)
    assert got.where("kept AND base_failed").count() == 0


def test_order_of_rules_does_not_change_the_verdict(rows):
    held = [(t or "").encode() for _, t in rows]
    texts = quality.Texts(np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]))
    live = ~quality.base_fails(texts)
    want = ~np.any([r.rejects(texts) for r in quality.RULES], axis=0) & live
    for seed in range(4):
        rules = list(quality.RULES)
        random.Random(seed).shuffle(rules)
        assert ((quality.run_cascade(texts, tuple(rules), live) == len(rules)) & live == want).all()


def test_rules_go_by_rejection_per_cost():
    rejected = np.array([[1, 1, 0], [1, 1, 0], [1, 0, 0], [0, 0, 1]], bool)
    assert quality.order_rules(np.array([10.0, 1.0, 1.0]), rejected) == [1, 2, 0]


def test_clean_documents_are_kept(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = queries.op6_quality(spark, folder).join(labels, "doc_id").collect()
    good = [r for r in got if r.quality == 1 and not r.base_failed]
    bad = [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.1 * len(bad)


# token files --------------------------------------------------------------------------------


@pytest.mark.parametrize("ids", [
    [], [7], list(range(1000)), [5] * 300, [2**32 - 1, 0] * 200, [1] * 255 + [2**31],
    np.random.default_rng(0).zipf(1.3, 5000).clip(0, 2**32 - 1).tolist(), np.random.default_rng(1).integers(0, 49408, 777).tolist(),
])
def test_blocks_round_trip(ids):
    ids = np.array(ids, "<u4")
    starts, held = token_files.pack_blocks(ids)
    assert token_files.unpack_blocks(np.frombuffer(held, np.uint8), starts, len(ids)).tolist() == ids.tolist()
    if len(starts) > 1:  # any block alone
        one = token_files.unpack_blocks(np.frombuffer(held, np.uint8), starts[1:2], min(256, len(ids) - 256))
        assert one.tolist() == ids[256:512].tolist()


def test_token_files_agree_with_the_library(spark, docs, rows, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr("perigee.llm.rows.slices.__defaults__", (9000,))
    library = Tokenizer.from_file(token_files.VOCABULARY)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path)
    got = token_files.read_tokens(spark, path).collect()
    at, want = 0, []
    for d, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((d, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got) == want


def test_token_files_of_nothing_and_of_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(None, "a"), (3, None), (None, "b")], "doc_id long, text string")
    token_files.write_tokens(df, str(tmp_path / "a"))
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_files.read_tokens(spark, str(tmp_path / "a")).collect()) == [("3", 1), ("None", 2), ("None", 2)]
    token_files.write_tokens(df.limit(0), str(tmp_path / "b"))
    assert token_files.read_tokens(spark, str(tmp_path / "b")).count() == 0


# pages --------------------------------------------------------------------------------------


@pytest.mark.parametrize("source, text", [
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>One<p>Two<br>lines", "One\n\nTwo\nlines"),
    ("<ul><li>a<li>b<ol start=3><li>c<li value=9>d</ol><li>e</ul>tail", "- a\n- b\n   3. c\n   9. d\n- e\n\ntail"),
    ("<head><title>t</title></head><script>var x='</p>'</script>a<style>b{}</style><!-- c --><noscript>d</noscript>e", "ae"),
    ("a<b>b</b> <i> c</i>&amp;&lt;&nbsp;d", "ab c&< d"),
    ("<table><tr><th>Name<th>N<tr><td>longer<td>1</table>x", "Name   | N\nlonger | 1\n\nx"),
    ("<table><tr><td rowspan=2>r<td>x<tr><td>y</table>", "r | x\n  | y"),
    ("<pre>\n a\n  b</pre>c", " a\n  b\n\nc"),
    ("<div hidden>a</div><div style='color:red; display : none'>b</div><div style='visibility:hidden'>c<b style='visibility:visible'>d</b></div>e", "d\ne"),
    ("<style>.x, #y{display:none}</style><div class='z x'>a</div><p id=y>b</p>c", "c"),
    ("<details><summary>S</summary>x</details><dialog>y</dialog><dl><dt>t<dd>d</dl>", "S\n\nt\n    d"),
    ("1 < 2 <3 & <a href='x>y'>z</a> <unclosed", "1 < 2 <3 & z"),
    ("<table><td>a<table><td>in</table>b</table>", "a\nin\nb"),
    ("</div></p>x</b><td>y", "x\ny"),
])
def test_visible_text(source, text):
    assert visible_text(source) == text


def test_deep_and_hostile_pages():
    assert visible_text("<div>" * 50_000 + "x") == "x"
    assert len(visible_text("<table>" + "<tr><td colspan=99999>a<td rowspan=999999>b" * 300)) < 2 * 10**6
    assert visible_text("<table><tr><td>" + "w" * 100_000 + "<tr><td>a<td>b").endswith("| b")
    assert visible_text("<a " * 20_000) == ""


def test_pages_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a"), (3, "<p>a")], "page_id long, html string")
    got = sorted((r["row"]["page_id"], r["text"], r["n_lines"]) for r in extract_text(df, ["page_id"]).collect())
    assert got == [(1, None, 0), (2, "", 0), (3, "a", 1), (3, "a", 1)]
    assert extract_text(df.limit(0)).count() == 0
    pages = queries.op4_html_text(spark, FOLDER).collect()
    assert pages and all("<" not in p.text or "&lt;" in p.text for p in pages)


# chats --------------------------------------------------------------------------------------

CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nx"), (1, 2, "assistant", None),
    (2, 1, "assistant", "b"), (2, 0, "user", "<\\|im_end|> <\\\\| <|nl|>"), (2, 0, "user", "<\\|im_end|> <\\\\| <|nl|>"),
    (3, None, None, "no role"), (3, 0, "we\nird<|im_start|>", "x"), (None, 0, "assistant", "no conversation"),
    (4, 0, "assistant", "ends with <"), (4, 1, "assistant", "|im_end|>"), (5, 0, "system", ""),
]


def test_chats_come_back_whole(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert len(got) == 6
    for conv, r in got.items():
        own = [(t if t is not None else -1, a or "", b or "") for c, t, a, b in CHATS if c == conv]
        assert [tuple(t) for t in r.turns] == [(a, b) for _, a, b in sorted(own)]
        learned = [b for _, a, b in sorted(own) if a == "assistant"]
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", s) for s in spans] == learned
    assert got[5].formatted == "<|im_start|>system\n<|im_end|>\n"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_plan_is_native(spark):
    plan = queries.op8_chat_format(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# SQL and pipeline ---------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_queries_agree_with_sql(spark, name):
    import os
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
    import compare

    good, text = compare.compare(spark, compare.connect(FOLDER), FOLDER, name)
    assert good, text


def test_pipeline_agrees_with_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = {r.doc_id: r.text or "" for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    prints = {d: simhash.fingerprint(t.encode()) for d, t in held.items()}
    ids, group = sorted(held), {}
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    kept = [d for d in ids if find(d) == d]
    least = {}
    for d in kept:
        w = held[d].split()
        for i in range(len(w) - 49):
            least.setdefault(tuple(w[i : i + 50]), d)
    left = {}
    for d in kept:
        w, gone = held[d].split(), set()
        for i in range(len(w) - 49):
            if least[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        if not w or len(gone) < len(w):
            left[d] = [x for i, x in enumerate(w) if i not in gone]
    split = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if x]
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = split(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    clean = {d: w for d, w in left.items()
             if not any(tuple(x[i : i + n]) in windows for x in [split(" ".join(w))] for n in {len(v) for v in windows} for i in range(len(x) - n + 1))}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) == set(clean) and len(clean) < len(held)
    own = byte_bpe.encoder()
    for d, r in got.items():
        text = own.decode([bytes(r.ids)])[0]
        assert text.decode().split() == clean[d]
        assert r.decoded_sha256 == hashlib.sha256(text).hexdigest() and r.n_tokens == len(r.ids) // 4


def test_stages_keep_the_columns_and_take_odd_rows(spark, tmp_path):
    rows = [(None, "no id", "en", "s", 5), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "same text here", "en", "s", 1),
            (3, "same text here", "en", "s", 1), (4, "same text here", "en", "t", 1), (5, "y" * 50_000, "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("component_id", F.lit(0))
    spark.createDataFrame([(1, "same text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (df, df.limit(0)):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == df.columns
        done = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert sorted(str(r.doc_id) for r in done.collect()) == (["5", "None"] if start is df else [])
