"""Collocations, the Merkle manifest and packing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee.llm import bins, merkle, phrases, queries, token_files
from perigee.llm.bins import Bins, Limits

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# collocations ---------------------------------------------------------------------------------


def brute_collocations(rows, least=30, percent=80, most=2000):
    counts, words = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            held = counts.setdefault(lang, Counter())
            for size in range(1, 5):
                held.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                         for q, b in candidates.items())
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = random.Random(3)
    words = ["a", "B", "the", "of", "é", "x-y", " z", "new", "york", "city"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ",", "!", "\n", "\t", "  "]) for _ in range(rng.randrange(60))),
             rng.choice(["en", "en", "de", None, "und"])) for _ in range(150)]
    rows += [("in New York City today", "en")] * 40 + [("a a a a a", "fr")] * 31 + [("one two three four five six", "fr")] * 30
    rows += [(None, "en"), ("", None), (" \t\n.,", "de"), ("x " * 50_000, "long"), ("rare words", "none"), ("w" * 90_000, "en")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_words, least, most", [(1_000_000, 30, 2000), (500, 3, 7)])
def test_collocations_agree_with_brute_force(spark, monkeypatch, shard_words, least, most):
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard_words)
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, g, i, "c") for i, (t, g) in enumerate(rows)], "text string, lang string, chunk int, phrase string")
    got = phrases.collocations(docs.repartition(5), least=least, most=most)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, least, most=most)


def test_collocations_without_candidates(spark):
    docs = spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.where("text IS NULL")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    expression = "CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(20, 0)) DIV (l + r)"
    big = 9_000_000_000_000_000_000
    got = spark.createDataFrame([(big, big // 2, big // 2)], "a long, l long, r long").select(F.expr(expression).alias("s")).first()
    assert got.s == 2_000_000 and "DIV (l + r)" in open(phrases.__file__).read()


def test_chunks_answer_each_slot_once():
    sent = [phrases.send_slots(c, np.array(k, np.uint64) << np.uint64(40), 1) for c, k in ((7, [5, 5, 9]), (8, [9, 5, 1]))]
    import pyarrow as pa

    told = {r["chunk"]: r for r in phrases.merge_slots(pa.concat_tables(sent), 2).to_pylist()}
    assert set(told) == {7, 8}
    hot, mine, counts = phrases._told(pa.Table.from_pylist([told[7]]))
    assert (hot >> np.uint64(40)).tolist() == [5, 9] and counts.tolist() == [3, 2] and len(mine) == 2
    assert len(phrases._told(pa.Table.from_pylist([told[8]]))[1]) == 0


# manifest -------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute_tree(leaves):
    """The root, and for each leaf its siblings and sides up to it."""
    paths, level, members = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        above, groups = [], []
        for i in range(0, len(level), 2):
            run, below = level[i : i + 2], members[i : i + 2]
            for side, held in enumerate(below):
                for m in held:
                    paths[m].append((run[0] if side else "", run[1] if side == 0 and len(run) > 1 else ""))
            above.append(sha(*run))
            groups.append([m for held in below for m in held])
        level, members = above, groups
    return level[0], paths


def brute_manifest(rows):
    trees = {}
    for row in rows:  # doc_id, source, lang, n_chars, text
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, brute_leaf(row), row))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        built[name] = brute_tree([x[2] for x in trees[name]])
    root, tops = brute_tree([built[name][0] for name in names])
    out = []
    for name, top in zip(names, tops):
        for (_, _, leaf, row), path in zip(trees[name], built[name][1]):
            held = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                held = brute_leaf((*row[:3], row[3] + 1, row[4]))
            for left, right in path + top:
                held = sha(left, held, right)
            beside = "".join(a + b for a, b in path + top)
            out.append((row[0], leaf, built[name][0], root, sha(beside), held, held == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("digits", [2, 10])
def test_manifest_agrees_with_brute_force(spark, monkeypatch, tmp_path, digits):
    rng = random.Random(digits)
    rows = [(i, f"s{i % 3}", rng.choice(["en", "en", "de", "é", "zz"]), i * 3, f"text {i} ünï") for i in range(60)]
    rows += [(500, None, None, None, None), (501, "", "", 0, ""), (None, "a", "en", 1, "b"), (None, "a", "en", 2, "b"), (7, "s", "en", 7, "again"),
             (7, "s", "en", 7, "again"), (900, "s", "one", None, "y" * 70_000), (901, "1:x", "-", 3, "-")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.withColumn("tree", F.lit("t")).withColumn("rank", F.lit(1)).withColumn("hash", F.lit("h"))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    plain = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a, **k: plain(*a, digits=digits, **k))
    got = [tuple(r) for r in queries.op12_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute_manifest(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_few_rows(spark):
    one = spark.createDataFrame([(3, "t", "en", "s", 1)], DOCUMENTS)
    row = merkle.manifest(one, ["doc_id", "text"]).first()
    assert row.leaf == row.subroot == row.root == sha("1:3", "1:t") and row.steps == []
    assert merkle.manifest(one.limit(0), ["doc_id", "text"]).count() == 0


def test_manifest_sorts_once_and_joins_only_blocks(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 2).cast("string").alias("tree"), F.col("id").alias("rank"), (F.col("id") * 0 + 2500).alias("size"),
                                    F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.struct("id").alias("payload"))
    rows.write.parquet(str(tmp_path / "rows"))
    plan = merkle.roll(spark.read.parquet(str(tmp_path / "rows")), 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count(" Sort ") == 1 and "Join" not in plan


# packing --------------------------------------------------------------------------------------


def check_sequences(made, sizes, free, limits):
    """Every token of every example lies in one piece, and sequences keep to the limits."""
    seen = {}
    for pieces in made:
        total = sum(p.size for p in pieces)
        assert total <= limits.tokens and total & (total - 1) == 0 and 0 < len(pieces) <= limits.segments
        loss = 0
        for p in pieces:
            assert p.size > 0
            seen.setdefault(p.example, []).append((p.start, p.size))
            own = max(0, p.start + p.size - max(p.start, free[p.example]))
            assert own == p.loss
            loss += own
        assert loss <= limits.loss
    for e, size in enumerate(sizes):
        at = 0
        for start, n in sorted(seen.pop(e, [])):
            assert start == at
            at += n
        assert at == size
    assert not seen


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 3, 64), Limits(64, 8, 20), Limits(256, 2, 5), Limits(8, 1, 1), Limits(1, 1, 1)])
def test_bins_keep_to_all_limits(limits):
    rng = random.Random(str(limits))
    sizes = [rng.choice([1, 2, 5, 30, 100, rng.randrange(1, 700)]) for _ in range(250)] + [5000]
    free = [rng.choice([0, 0, n // 2, n, n * 3]) for n in sizes]
    bins_ = Bins(limits)
    made = []
    for e, (n, q) in enumerate(zip(sizes, free)):
        made += bins_.add(e, n, q)
        while len(bins_) > 60:
            made.append(bins_.sequence())
    while len(bins_):
        made.append(bins_.sequence())
    check_sequences(made, sizes, [min(q, n) for q, n in zip(free, sizes)], limits)


def test_bins_mix_examples_by_what_there_is_room_for():
    bins_ = Bins(Limits(64, 4, 32))
    for e, (n, free) in enumerate([(32, 0), (32, 0), (32, 32), (32, 32)]):
        list(bins_.add(e, n, free))
    for _ in range(2):  # one that bears loss and one that does not, never two alike
        assert sorted(p.loss for p in bins_.sequence()) == [0, 32]


def test_limits_are_checked():
    for bad in ((0, 1, 1), (100, 1, 1), (64, 0, 1), (64, 1, 0)):
        with pytest.raises(ValueError):
            Limits(*bad)


def test_packed_texts_agree_with_the_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.VOCABULARY)
    tokenizer.encode_special_tokens = True
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(5000, None), (5001, ""), (5001, ""), (5002, "word " * 9000), (None, "ONE one <|endoftext|>"), (5003, "x" * 30_000)]
    docs = spark.createDataFrame([(d, t, 1, 2, "r") for d, t in rows], "doc_id long, text string, start int, sequence_id int, row string")
    got = bins.pack_texts(docs.repartition(3), keep=["doc_id"]).select("row.doc_id", *[
        "start", "length", "ids", "loss_tokens", "doc_tokens", "sequence_id", "offset"]).collect()
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    pieces, sequences = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length == 4 * r.loss_tokens
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, want in ids.items():
        if len(want) == 1:
            held = sorted(pieces[d])
            assert [x for _, part, _ in held for x in part] == want[0]
            assert [s for s, _, _ in held] == np.cumsum([0, *[len(p) for _, p, _ in held]])[:-1].tolist()
            assert {n for _, _, n in held} == {len(want[0])}
    assert sorted(pieces[5001]) == [(0, [1], 1)] * 2
    for held in sequences.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0 and len(held) <= 64
    total = bins.padding(bins.pack_texts(docs, keep=["doc_id"])).first()
    assert total.padding == 0 and total.tokens == sum(len(x) for v in ids.values() for x in v)


def test_prompts_bear_no_loss(spark):
    docs = spark.createDataFrame([(1, "what is it", "an answer of words"), (2, None, "x"), (3, "only asked", None)], "id int, ask string, reply string")
    got = bins.pack_texts(docs, ["id"], text="reply", prompt="ask", limits=Limits(64, 8, 64)).select(
        "row.id", "loss_tokens", "length", "doc_tokens").collect()
    assert {(r.id, r.doc_tokens - r.loss_tokens) for r in got if r.length == r.doc_tokens} <= {(1, 3), (2, 0), (3, 2)}
    assert sum(r.loss_tokens for r in got) == 5 + 2 + 1
    assert bins.pack_texts(docs.limit(0), ["id"], text="reply").count() == 0
