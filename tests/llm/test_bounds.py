"""Bounds that are documented: what they keep to, and that results do not change by them."""

from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from perigee.llm import byte_bpe, decontaminate, html_text, language, token_files

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    held = [r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    return [*held, "", " ", "Don't  STOP!\tnow\x0b", "naïve Größe", "日本 語", "a b", "<|endoftext|> <unk>", "x" * 5000]


@pytest.mark.parametrize("name, splits", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_any_vocabulary_gives_the_library_ids(texts, name, splits):
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    own = token_files.WordEncoder(path)
    assert own.splits is splits
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert own.encode([t.encode() for t in texts]) == want


def test_a_vocabulary_that_does_not_lower_is_not_taken_for_one_that_does(texts, tmp_path):
    tokenizer = Tokenizer.from_file(token_files.VOCABULARY)
    from tokenizers import normalizers

    tokenizer.normalizer = normalizers.NFC()
    path = str(tmp_path / "cased.json")
    tokenizer.save(path)
    own = token_files.WordEncoder(path)
    tokenizer.encode_special_tokens = True
    assert not own.plain
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert own.encode([t.encode() for t in texts]) == want


def test_caches_are_bounded_by_bytes(texts, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_BYTES", 2000)
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 2000)
    for own, plain in ((token_files.WordEncoder(token_files.VOCABULARY), [t.encode() for t in texts]), (byte_bpe.Encoder(), texts)):
        whole = own.encode(plain)
        for i in range(0, len(plain), 20):
            part = plain[i : i + 20]
            assert own.encode(part) == whole[i : i + 20]
            held = own.words if isinstance(own, token_files.WordEncoder) else own.spaced
            assert sum(map(len, held)) <= 2000 + 2 * sum(map(len, part))


def test_samples_are_cut_evenly():
    texts = ["aaa", "b" * 50, "c" * 9, "1 2", "dé " * 40]
    assert language.even_cut(texts, 10**9) == b" ".join(t.encode().strip() for t in texts if t != "1 2")
    cut = language.even_cut(texts, 40)
    assert len(cut) <= 40 and [cut.count(x) for x in (b"a", b"b", b"c")] == [3, 13, 9]


def test_many_languages_share_the_tables(spark):
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    docs = spark.createDataFrame([(f"{w}{w[::-1]} " * 80, f"l{i}") for i, w in enumerate(words)], "text string, lang string")
    model = language.learn(docs, table_bytes=200_000)
    assert len(model.languages) == 60 and 0 < model.table.nbytes <= 200_000 and model.size.min() > 0
    found = language.identify(docs, model).select("row.lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in found) > 50
    with pytest.raises(ValueError, match="do not fit"):
        language.learn(docs, table_bytes=1000)


def test_sample_takes_the_least_hashes_of_each_language(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_DOCUMENTS", 5)
    rows = [(f"text number {i % 90} x", "en" if i % 3 else "de") for i in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    at = {r.text: r.at for r in docs.select("text", F.xxhash64("text").alias("at")).collect()}
    want = {g: sorted({t for t, lang in rows if lang == g}, key=at.get)[:5] for g in ("de", "en")}
    assert language.sample_texts(docs) == want


def test_blocks_of_a_benchmark_are_scanned_in_turn(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    bench = bench.unionByName(spark.createDataFrame([(None, "the"), (10**6, None), (10**6 + 1, "..."), (10**6 + 2, "The")], "item_id long, text string"))
    key = lambda df: sorted(map(str, df.collect()))
    whole = key(decontaminate.find_contamination(docs, bench, ["doc_id"]))
    size = decontaminate.item_windows(bench, "item_id", "text").agg(F.sum(F.octet_length("key"))).first()[0]
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", size // 2 - 1)
    assert key(decontaminate.find_contamination(docs, bench, ["doc_id"])) == whole
    assert any("spans=[Row" in x for x in whole)


def test_the_pipeline_leaves_its_result_alone(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(str(tmp_path / "in" / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda _: str(tmp_path / "shared"))
    seen = []

    def stage(number):
        def run(_, docs, __):
            seen.append(docs.count())
            return docs.withColumn(f"s{number}", F.lit(number))
        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"step{i}", stage(i)) for i in range(3)])
    got = corpus_pipeline.run(spark, str(tmp_path / "in"))
    assert got.columns == ["doc_id", "text", "s0", "s1", "s2"] and got.count() == 1 and seen == [1, 1, 1]
    (place,) = (tmp_path / "shared").iterdir()
    assert [p.name for p in place.iterdir()] == ["2-step2"]


class _Plain(HTMLParser):
    """Visible words by the standard library's parser: block tags part words, others do not."""

    HIDDEN = {"script", "style", "title", "head", "template", "noscript"}
    BLOCKS = {"p", "div", "ul", "ol", "li", "nav", "article", "h1", "h2", "h3", "footer", "br", "body", "html", "section", "table", "tr", "td", "th"}

    def __init__(self):
        super().__init__()
        self.hidden, self.parts = [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden.append(tag)
        self.parts.append(" - " if tag == "li" else " " if tag in self.BLOCKS else "")

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
        self.parts.append(" " if tag in self.BLOCKS else "")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def test_pages_have_the_words_of_a_plain_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    got = {r.page_id: r.text for r in html_text.extract_text(pages, keep=["page_id"]).select("row.page_id", "text").collect()}
    rows = pages.collect()
    assert len(rows) > 100
    for row in rows:
        plain = _Plain()
        plain.feed(row.html or "")
        plain.close()
        assert got[row.page_id].split() == "".join(plain.parts).split()
