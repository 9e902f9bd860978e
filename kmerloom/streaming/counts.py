"""Counts over streams of reads: an extension, for runs that deliver their reads over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S


def stream_kmers(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, cnt) of a stream of reads, for update or complete mode; the state has a row for each canonical k-mer."""
    return reads.select(F.explode(S.kmers(seq, k)).alias("w")).groupBy(S.canonical("w").alias("kmer")).agg(F.count("*").alias("cnt"))


def windowed_yield(reads: DataFrame, ts: str = "ts", window: str = "10 minutes", late: str = "30 minutes", seq: str = "seq") -> DataFrame:
    """(start, n_reads, n_bases) by time window; reads that come later than ``late`` are left out, and state older than that goes."""
    timed = reads.withWatermark(ts, late).groupBy(F.window(ts, window))
    return timed.agg(F.count("*").alias("n_reads"), F.sum(F.length(seq).cast("long")).alias("n_bases")).select(F.col("window.start").alias("start"), "n_reads", "n_bases")
