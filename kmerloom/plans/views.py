"""Sequence views of general tables: sequences, reads, pairs, qualities and contigs.

They let every operator run over tables that hold no DNA.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S

LETTERS = "abcdefghijklmnopqrstuvwxyz"
AS_BASES = "".join(S.BASES[i % 4] for i in range(26))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seqs(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """(id, seq): the letters of a text as bases."""
    letters = F.lower(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf_dir, name).select(F.col(key).alias("id"), F.translate(letters, LETTERS, AS_BASES).alias("seq"))


def noisy_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq): letters as bases, digits and punctuation as N, all else dropped."""
    kept = F.lower(F.regexp_replace("text", r"[^A-Za-z0-9.,;:!?-]", ""))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.translate(F.regexp_replace(kept, "[^a-z]", "N"), LETTERS, AS_BASES).alias("seq"))


def reads(spark: SparkSession, sf_dir: str, length: int = 100, step: int = 20) -> DataFrame:
    """(id, pos, seq): windows of the sequences."""
    s = seqs(spark, sf_dir).filter(F.length("seq") >= length)
    at = s.select("id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - length, F.lit(step))).alias("pos"))
    return at.select("id", "pos", F.substring("seq", F.col("pos") + 1, F.lit(length)).alias("seq"))


def quals(spark: SparkSession, sf_dir: str, length: int = 120) -> DataFrame:
    """(id, pos, seq, qual): pieces of the noisy sequences with a quality made of their own characters."""
    # the pieces themselves are exploded: a row that held its place only would carry the whole text to a Python function
    at = noisy_seqs(spark, sf_dir).select("id", F.posexplode(F.regexp_extract_all("seq", F.lit(f".{{1,{length}}}"), F.lit(0))).alias("_n", "seq"))
    piece = at.select("id", (F.col("_n") * length).alias("pos"), "seq")
    # A quality character for each base
    return piece.withColumn("qual", F.translate(F.concat(F.substring("seq", 3, length), F.lit("GA")), "ACGTN", "I?5+#"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sequence, mean_coverage, kmers_count): sequences as contigs."""
    s = seqs(spark, sf_dir).filter(F.length("seq") > 0)
    return s.select("id", F.col("seq").alias("sequence"), ((F.col("id") % 40) / 4 + 0.5).alias("mean_coverage"), F.greatest(F.length("seq") - 30, F.lit(1)).cast("long").alias("kmers_count"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, start, end): events as intervals; the kind is the chromosome."""
    # wall-clock seconds, whether the column has a time zone or not
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))") % 1_000_000
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("chrom"), start.cast("long").alias("start"), (start + F.floor("value").cast("long")).cast("long").alias("end"))
