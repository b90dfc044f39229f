"""Whole jobs: what an operator must not leave out, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from perigee.llm import simhash
from perigee.llm.html_text import visible_text

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_firsts(rows):
    """The least doc_id of each component of fingerprints at most three bits apart."""
    prints, parent = {d: simhash.fingerprint((t or "").encode()) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(prints):
        for b in sorted(prints):
            if b < a and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted({find(d) for d in parent})


def near_copy_rows():
    rng, out = random.Random(5), []
    word = lambda: f"w{rng.randrange(5000)}"
    for _ in range(12):
        own = [word() for _ in range(rng.choice([4, 12, 60, 200]))]
        for _ in range(8):  # a chain: each a copy of the last, some with a word changed
            out.append(" ".join(own))
            own = list(own)
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] = word()
    out += [out[30].upper(), out[30] + "  ", "", None]
    rng.shuffle(out)
    return list(enumerate(out))


def test_near_dedup_stage_agrees_with_brute_force(spark):
    rows = near_copy_rows()
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCUMENTS).repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    want = brute_firsts(rows)
    assert got == want and len(want) < len(rows) - 20


def test_near_dedup_stage_tells_rows_apart(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, b, "en", "s", 1), (3, a, "en", "s", 1), (3, b, "en", "s", 1), (4, a, "en", "s", 1), (3, a, "en", "s", 1),
            (None, a, "en", "s", 1), (None, "x y", None, "s", 1), (None, "x y", "s", None, 1), (7, "z", "en", "s", 1), (7, "z", "de", "s", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumn("content_key", F.lit("own"))
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    kept = sorted((str(r.doc_id), r.text) for r in got.collect())
    assert got.columns == docs.columns and kept == [("1", b), ("3", a), ("7", "z"), ("None", "x y")]
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("limit", [2, 16, 10_000])
def test_shards_are_split_without_losing_links(spark, limit):
    rng = random.Random(limit)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({x ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(5))) for x in base for _ in range(40)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    whole = spark.createDataFrame([(p, i, b % 2) for i, p in enumerate(signed) for b in range(2)], "print long, id long, shard long")
    cut = [(r.shard, r.id) for r in simhash.split_shards(whole, 3, limit).collect()]
    held = {}
    for shard, i in cut:
        held.setdefault(shard, set()).add(i)
    met = {(a, b) for group in held.values() for a in group for b in group if a < b}
    near = {(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if (prints[a] ^ prints[b]).bit_count() <= 3}
    assert near <= met and len(near) > 100
    assert limit > 100 or max(map(len, held.values())) < len(prints) / 2


@pytest.mark.parametrize("sheet, body, text", [
    ("@media print { .nav, .side { display: none } }", "<p class=nav>a<p class=side>b", "a\n\nb"),
    ("@media (max-width: 600px) { .wide { display: none } }", "<p class=wide>a", "a"),
    ("@media screen and (max-width:9em){.a{color:red}.wide{display:none}} .b{display:none}", "<p class=wide>a<p class=b>b", "a"),
    ("@supports (display: grid) { p { display: none } }", "<p>a", "a"),
    ("@media screen, print { .x { display: none } }", "<p class=x>a<p>b", "b"),
    ("@layer base { @media only screen { .x { display: none } } }", "<p class=x>a<p>b", "b"),
    (".tab{display:none} .tab.active{display:block}", "<div class=tab>a</div><div class='tab active'>b</div>", "b"),
    (".tab.active{display:block} .tab{display:none}", "<div class=tab>a</div><div class='tab active'>b</div>", "b"),
    (".x{display:none} .x{display:block} .y{display:block} .y{display:none}", "<p class=x>a<p class=y>b", "a"),
    (".x{display:none; display:flex}", "<p class=x>a", "a"),
    (".menu{display:none} @media (min-width:60em){.menu{display:block}}", "<p class=menu>a", "a"),
    (".menu{display:none} @media print{.menu{display:block}} .menu:hover{display:block}", "<p class=menu>a<p>b", "b"),
    (".hidden{display:none} @media (min-width:768px){.md\\:block{display:block}}", "<p class='hidden md:block'>a<p class=hidden>b", "a"),
    (".menu{display:none} .open .menu{display:block}", "<div class=open><p class=menu>a</div>", "a"),
    (".menu{display:none} .open .menu{display:block}", "<div><p class=menu>a</div>b", "b"),
    (".a{display:none; &.on{display:block}} .b{content:'}'; display:none}", "<p class='a on'>a<p class=a>b<p class=b>c", "a"),
    (".x{display:none}", "<p class=x style='display:block'>a<p class=x>b", "a"),
    (".x{display:none!important}", "<p class=x style='display:block'>a<p>b", "b"),
    ("#y, DIV.z{display:none} /* p{display:none} */", "<p id=y>a<div class=z>b</div><p class=z>c", "c"),
    (".x::before{display:none} p:not(.y){display:none}", "<p class=x>a", "a"),
])
def test_style_sheets_hide_only_what_a_screen_hides(sheet, body, text):
    assert visible_text(f"<style>{sheet}</style>{body}") == text


def test_style_sheets_of_other_media_and_hostile_ones():
    assert visible_text("<style media=print>p{display:none}</style><p>a") == "a"
    for sheet in ("p{" * 20_000, "}" * 20_000 + "p{display:none}", "display@media(" * 5_000, "p:not(" * 5_000 + "{display:none}", "\\" * 9_999 + "display"):
        assert visible_text(f"<style>{sheet}</style><p>a") in ("a", "")


def test_language_stage_keeps_an_unlabelled_table(spark):
    rows = [(1, "the cat sat", None, "s", 1), (2, "1 2 3", None, "s", 1), (3, None, None, "s", 1), (4, "é", None, "s", 1), (5, "12", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = corpus_pipeline.identify_language(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.lang) for r in got.collect()) == [(1, None), (4, None)]


def test_language_stage_fills_what_the_source_leaves_out(spark):
    words = {"en": "the house and the garden with some flowers", "de": "das Haus und der Garten mit einigen Blumen"}
    rows = [(i, f"{words[k]} {i}", k, "s", 1) for i, k in enumerate(["en", "de"] * 4)]
    rows += [(10, "der Garten und das Haus", None, "s", 1), (11, "some flowers and the garden", None, "s", 1),
             (12, "the house and the garden", "de", "s", 1), (13, "!", None, "s", 1)]
    got = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, DOCUMENTS), "").collect()}
    assert {d: got[d] for d in got if d > 9} == {10: "de", 11: "en", 12: "de"} and len(got) == 11
