"""A training corpus from raw documents, in five stages.

Each stage takes what the one before it kept: documents that look bad go, one document
of each group of near copies stays, passages that an earlier document has are cut, the
sources are mixed to their weights, and what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import bpe, jaccard, mixing, quality, substring
from kmerloom.llm.queries import tokenizer_path
from kmerloom.llm.store import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rule ensemble, learnt from all labels, scores below 0.7.

    Null and empty texts are scored by the statistics of an empty text, and texts of any
    length whole.  Rows are judged one by one, so repeated ones go or stay together; a
    document on the border stays.  Without labels all score one half and go.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # written once with its texts, for the fit and for the scores
    stats = Scratch(spark, "classify").write(quality.with_statistics(docs.select(*COLUMNS), COLUMNS))
    model = quality.fit_on(stats, labels, "quality")
    return stats.filter(model.score() >= 0.7).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (5-word shingles, 0.8).

    Texts without words are no copies of one another.  Rows with one id are one document,
    of which the row that sorts first stays; rows with a null id all stay.
    """
    members = jaccard.ngram_jaccard_join(docs, width=5, threshold=0.8).members
    kept = members.filter(F.col("component_id") == F.col("doc_id")).groupBy("doc_id").agg(F.count("*").alias("_rows"))
    kept = Scratch(spark, "dedup").write(kept)
    docs = docs.select(*COLUMNS)
    chosen = docs.join(kept.filter("_rows = 1"), "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL"))
    repeated = kept.filter("_rows > 1")
    if repeated.isEmpty():
        return chosen
    first = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("_row"))
    return chosen.unionByName(first.select("_row.*"))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that an earlier document has; drops what has no word left.

    A document that loses nothing keeps its text as it is, null and empty ones too; the
    others have their words joined by one space and a new n_chars.
    """
    found = substring.dedup_substrings(docs.select(*COLUMNS), min_words=50)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    out = found.filter((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words"))).withColumn("text", text)
    return out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that each source comes near its target of words.

    A null source is one of its own; documents without words are repeated as their source
    is; rows with one id are taken alike.
    """
    return mixing.repeat_rows(mixing.mix_sources(docs.select(*COLUMNS))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix; a null text counts as empty, repeated rows come out again."""
    return bpe.encode_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("ngram_jaccard_join", dedup_documents),
    ("substring_dedup", cut_passages),
    ("source_mixing", mix),
    ("bpe_codec", encode),
]

#: The stages learn a model and encode: SQL can't express them; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again for the next.

    Columns beside those of ``COLUMNS`` are not read; an empty table goes through all stages.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    previous = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs)
            if previous is not None:
                scratch.drop(previous)
            previous = docs
            scratch.reclaim()
    return docs
