"""From raw documents to token ids: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, folder of the tables) and returns a table, which is written as
Parquet in the session's shared folder and read again for the next stage. All but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from perigee.llm import byte_bpe, decontaminate, language, repeats, simhash
from perigee.llm.components import checkpoint, remove, shared_folder
from perigee.llm.rows import free_name

#: The columns of documents; a row is told from others of its doc_id by their values.
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Languages are learned from the labelled documents. A document without a `lang` gets the
    one found; where the source says one, it stays. Documents without text or without a letter
    in it go, whatever was learned: if no document is labelled, all others stay as they are."""
    found = language.identify(docs, language.learn(docs))
    known = F.when(F.col("lang_pred") != language.UNKNOWN, F.col("lang_pred").cast(docs.schema["lang"].dataType))
    own = [F.coalesce("row.lang", known).alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns]
    return found.where(F.col("row.text").rlike(r"\p{L}")).select(own)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each component of fingerprints the row of least doc_id stays; rows without doc_id come
    last. Of rows of equal doc_id the one of least content key stays, once if it is repeated."""
    key = free_name(docs, "content_key")
    own = [F.col(f"`{c}`") for c in DOCUMENT if c in docs.columns]
    marked = docs.withColumn(key, F.xxhash64(*own, *[c.isNull() for c in own]))
    found = simhash.near_duplicates(marked, keep=["doc_id", key])
    rows = found.groupBy("component", F.col("row.doc_id").alias("id"), F.col(f"row.`{key}`").alias("key")).agg(F.count("*").alias("n"))
    least = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "n")).alias("first"))
    first = checkpoint(least.select("first.id", "first.key", "first.n"))

    def of(chosen: DataFrame) -> DataFrame:
        same = marked["doc_id"].eqNullSafe(chosen["id"]) & (marked[f"`{key}`"] == chosen["key"])
        return marked.join(chosen, same, "left_semi")

    several = first.where("n > 1")
    if several.isEmpty():
        return of(first).select(docs.columns)
    return of(first.where("n = 1")).unionByName(of(several).dropDuplicates(["doc_id", key])).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Passages that a document of lesser doc_id has too are cut out; a document of which
    nothing is left goes. The text goes through the job once, beside the other columns."""
    others = [c for c in docs.columns if c != "text"]
    left = repeats.remove_repeats(docs, keep=others).where("n_words = 0 OR n_removed < n_words")
    size = F.when(F.col("n_removed") > 0, F.length("text_left")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text_left"), "n_chars": size.cast(docs.schema["n_chars"].dataType)}
    return left.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with any window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontaminate.find_contamination(docs, benchmark).where("n_hit = 0").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the text they decode to."""
    done = byte_bpe.encode_documents(docs, keep=["doc_id", "lang", "source"])
    return done.select("row.*", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Language, fingerprints and token ids have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, applied to `documents`. What a stage has written is
    removed when the next one has; the last one's result stays."""
    place = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{place}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
