"""The document operators against brute force, with nulls, empty and odd texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee.llm import byte_bpe, components, decontaminate, language, queries, repeats, simhash

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, row string, chunk long"


def docs_of(spark, texts):
    """Documents with columns that clash with names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "r", 5) for i, t in enumerate(texts)], SCHEMA)


def words_of(text):
    return (text or "").encode().split()


# repeats ------------------------------------------------------------------------------------


def brute_repeats(rows):
    least, out = {}, []
    for doc_id, text in rows:
        w = words_of(text)
        key = float("inf") if doc_id is None else doc_id
        for i in range(len(w) - 49):
            g = tuple(w[i : i + 50])
            least[g] = min(least.get(g, key), key)
    for doc_id, text in rows:
        w, gone = words_of(text), set()
        key = float("inf") if doc_id is None else doc_id
        for i in range(len(w) - 49):
            if least[tuple(w[i : i + 50])] < key:
                gone.update(range(i, i + 50))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc_id, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def repeat_rows():
    rng = random.Random(5)
    word = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    passages = [word(n) for n in (50, 51, 73, 120, 49)]
    rows = [(None, " ".join(passages[1])), (900, None), (901, ""), (902, " \n\t ")]
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += word(rng.randrange(0, 70)) + rng.choice(passages)
        rows.append((rng.randrange(0, 40), rng.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(50, " ".join(["same"] * 300)), (51, " ".join(["same"] * 55)), (7, rows[5][1]), (7, rows[5][1])]
    return rows


@pytest.mark.parametrize("limit", [4 << 20, 700])
def test_repeats_agree_with_brute_force(spark, monkeypatch, limit):
    rows = repeat_rows()
    monkeypatch.setattr(repeats, "SHARD_WORDS", 900)
    monkeypatch.setattr("perigee.llm.rows.slices.__defaults__", (limit,))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeats.remove_repeats(df, ["doc_id"]).select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows)


def test_text_left_keeps_other_white_space(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, passage), (2, "head\n\nline  two " + passage + " tail\n"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["row"]["doc_id"]: r for r in repeats.remove_repeats(df).collect()}
    assert got[1]["text_left"] == passage and got[3]["text_left"] is None
    assert got[2]["text_left"] == "head\n\nline  two tail\n"
    assert [tuple(s) for s in got[2]["spans"]] == [(3, 50)]


# simhash ------------------------------------------------------------------------------------


def brute_print(text):
    import xxhash

    w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(set(prints))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    return {p: find(p) for p in distinct}


def test_simhash_agrees_with_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(5000, None), (5001, ""), (5002, "one"), (5003, "One"), (5004, "two Words"), (None, "two words"), (5002, "one")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "print", "component_id").collect()
    prints = [(d, brute_print(t)) for d, t in rows]
    root = brute_components([p for _, p in prints])
    least = {}
    for d, p in prints:
        if d is not None:
            least[root[p]] = min(least.get(root[p], d), d)
    want = sorted((str(d), p, least[root[p]]) for d, p in prints)
    assert sorted((str(r.doc_id), r["print"] % 2**64, r.component_id) for r in got) == want


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_tree_links_agree_with_brute_force(spark, monkeypatch, blocks):
    rng = np.random.default_rng(3)
    centers = rng.integers(0, 2**63, 12, dtype=np.uint64)
    values = [int(c) for c in centers]
    for c in centers:
        for _ in range(60):
            values.append(int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 5))))
    for _ in range(600):  # a dense cloud, to be cut again
        values.append(int(centers[0]) ^ int(rng.integers(0, 2**11)) << 20)
    monkeypatch.setattr(simhash, "CUT_ABOVE", 40)
    monkeypatch.setattr(simhash, "blocks_for", lambda n, radius: blocks)
    values = sorted(set(values))
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(s, s) for s in signed], "print long, id long")
    found = {r.node: r.component for r in components.components(simhash.links(df, len(values))).collect()}
    root = brute_components(values)
    groups = {}
    for v, s in zip(values, signed, strict=True):
        groups.setdefault(root[v], set()).add(s)
    got = {}
    for s in signed:
        got.setdefault(found.get(s, s), set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_components_of_paths_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# decontamination ----------------------------------------------------------------------------


def test_contamination_maps_to_the_original(spark):
    item = "Alpha beta; GAMMA-delta epsilon zeta eta theta iota kappa lambda"
    bench = spark.createDataFrame([(1, item), (2, "Short one"), (3, None), (4, "!!"), (None, "no id here")], "item_id long, text string")
    rows = [(0, "ü – alpha BETA gamma delta, epsilon zeta eta theta iota\n\nkappa end"), (1, None), (2, ""), (3, "a SHORT (one) day"), (4, "no id here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["row"]["doc_id"]: r for r in decontaminate.find_contamination(df, bench).collect()}
    assert (got[0]["n_words"], got[0]["n_hit"], got[0]["items"]) == (13, 10, ["1"])
    a, b = got[0]["spans"][0]
    assert rows[0][1][a:b] == "alpha BETA gamma delta, epsilon zeta eta theta iota\n\nkappa"
    assert got[3]["items"] == ["2"] and rows[3][1][slice(*got[3]["spans"][0])] == "SHORT (one"
    assert got[4]["n_hit"] == 3 and got[4]["items"] == []
    assert got[1]["n_words"] == got[2]["n_words"] == 0
    assert decontaminate.find_contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_many_automata_give_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    one = decontaminate.find_contamination(docs, bench, ["doc_id"]).collect()
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 4000)
    assert sorted(decontaminate.find_contamination(docs, bench, ["doc_id"]).collect()) == sorted(one)
    assert any(r.n_hit for r in one)


# byte BPE -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(byte_bpe.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD_TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n", "x\t\ty  ", "don't I'll  we've", "1234 5678", "é ñ ü ß ção",
    "日本語のテキスト 한국어", "emoji 👩‍👩‍👧 done", "a b  c　d", "\x1c\x1d a\x1fb\x85c", "<|endoftext|> x", "\x00\x01 \x7f",
    "a" * 700, "ab" * 3000, "=" * 5000, "word " * 2000, "x" * 511, "y" * 512, "z" * 513, "qzj" * 300,
]


def test_byte_bpe_agrees_with_the_library(reference):
    own = byte_bpe.Encoder()
    for text, ids in zip(ODD_TEXTS, own.encode(ODD_TEXTS), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), text[:40]
        assert own.decode([ids]) == [text.encode()]


def test_byte_bpe_agrees_on_every_character(reference):
    text = " ".join(chr(c) + "a" + chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000)
    ids = byte_bpe.Encoder().encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)


def test_byte_bpe_query_on_all_documents(spark, reference):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.op10_byte_bpe(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        text = docs[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


# language -----------------------------------------------------------------------------------


def test_language_query_is_right_on_held_out_rows(spark):
    got = queries.op9_language(spark, "/root/testdata/sf0.01").collect()
    rows = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r.held_out and rows[r.doc_id].lang]
    assert len(got) == len(rows) and len(held) > 100
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = sum(r.lang_pred == rows[r.doc_id].lang for r in held) / len(held)
    assert right >= 0.97, right
    assert all(0 <= r.score <= 1 for r in got)


def naive_phrases(text, learned):
    count, i = 0, 0
    while i < len(text):
        n = 1
        while i + n <= len(text) and text[i : i + n] in learned:
            n += 1
        i += max(1, n - 1)
        count += 1
    return count


def test_phrases_are_longest_matches():
    rng = random.Random(1)
    learned = {k: "".join(rng.choice(a) for _ in range(300)) for k, a in (("x", "abc d"), ("y", "abcd "))}
    codes = np.full(256, 5, np.uint8)
    for i, c in enumerate("abcd "):
        codes[ord(c)] = i
    tables, roots, states = [], [], 0
    for text in learned.values():
        moves = language.suffix_automaton([int(codes[ord(c)]) for c in text])
        table = np.full((len(moves), 6), -1, np.int32)
        for s, out in enumerate(moves):
            for c, t in out.items():
                table[s, c] = t + states
        tables.append(table.reshape(-1))
        roots.append(states)
        states += len(moves)
    model = language.Model(["x", "y"], codes, 6, np.concatenate(tables), np.array(roots, np.int32), np.array([300, 300]))
    texts = ["".join(rng.choice("abcd z") for _ in range(n)) for n in (0, 1, 5, 90, 256, 255)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    want = [[naive_phrases(t, k) for t in texts] for k in learned.values()]
    assert language.phrases(model, data, bounds).tolist() == want


def test_language_of_odd_texts(spark):
    rows = [(0, None, "en"), (1, "", "en"), (2, "123 !!", "en"), (3, "the cat and the dog went to the house", "en"),
            (4, "der hund und die katze gingen in das haus", "de"), (5, "Ж", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(df)
    got = {r["row"]["doc_id"]: r for r in language.identify(df, model).collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["und", "und", "und", "en", "de"]
    assert got[0]["score"] == 0 and got[5]["lang_pred"] in ("en", "de")
    nothing = language.learn(df.limit(0))
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}


def test_a_text_that_many_rows_repeat_takes_one_place_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_DOCUMENTS", 5)
    texts = [f"wort nummer {'x' * i} hier" for i in range(20)]
    rows = [(i, t, "de") for i, t in enumerate(texts * 2)] + [(100 + i, texts[0], "de") for i in range(50)]
    df = spark.createDataFrame([*rows, (999, "Only ONE here", "en"), (1000, None, "fr")], "doc_id long, text string, lang string")
    held = language.sample_texts(df)
    assert set(held) == {"de", "en"} and held["en"] == ["only one here"]
    assert len(held["de"]) == len(set(held["de"])) == 5
    assert held == language.sample_texts(df.orderBy(F.desc("doc_id")))


# all ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("run", [
    lambda d, b: repeats.remove_repeats(d), lambda d, b: simhash.near_duplicates(d), lambda d, b: byte_bpe.encode_documents(d),
    lambda d, b: decontaminate.find_contamination(d, b), lambda d, b: language.identify(d, language.learn(d)),
])
def test_empty_tables_and_clashing_names(spark, run):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert run(docs_of(spark, []), bench).count() == 0
    full = docs_of(spark, ["a b c", None, "a b c", "x" * 200_000])
    assert run(full, bench).where(F.col("row").isNotNull()).count() == 4
