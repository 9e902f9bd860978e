"""Filters and splits of the assembly modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import seq as S
from .graph import end_key, upper_median


def meta_filter(contigs: DataFrame, min_length: int = 500, min_coverage: float = 2.0) -> DataFrame:
    return contigs.filter((F.length("sequence") >= min_length) & (F.col("mean_coverage") >= min_coverage))


def rna_filter(contigs: DataFrame, min_length: int = 200, min_coverage: float = 1.5) -> DataFrame:
    """Transcripts, the longest first."""
    return meta_filter(contigs, min_length, min_coverage).orderBy(F.desc(F.length("sequence")), "id")


def single_cell_normalize(contigs: DataFrame, least: float = 2.0, cap: float = 500.0) -> DataFrame:
    """Coverage capped, and contigs below the least dropped."""
    return contigs.withColumn("mean_coverage", F.least("mean_coverage", F.lit(cap))).filter(F.col("mean_coverage") >= least)


def circular(k: int, longest: int = 450_000):
    """Whether a prefix of min(15, k - 1) to k - 1 bases (half the sequence at most) is the suffix too."""
    s, n = F.col("sequence"), F.length("sequence")
    low, high = F.lit(min(15, k - 1)), F.least(F.lit(k - 1), F.floor(n / 2)).cast("int")
    some = F.exists(F.sequence(low, high), lambda o: F.left(s, o) == F.right(s, o))
    return n.between(20, longest) & (high >= low) & F.when(high >= low, some).otherwise(False)


def plasmid_split(contigs: DataFrame, k: int, min_length: int = 300) -> DataFrame:
    """Adds ``plasmid``: circular, or short with 1.8 times the median coverage or more; both from ``min_length`` on."""
    median = max(upper_median(contigs, "mean_coverage") or 0.0, 1.0)
    high_copy = (F.length("sequence") <= 350_000) & (F.col("mean_coverage") >= 1.8 * median)
    return contigs.withColumn("plasmid", (F.length("sequence") >= min_length) & (circular(k) | high_copy))


def phase_haplotigs(contigs: DataFrame, k: int) -> DataFrame:
    """Adds ``haplotig``: the lesser of two alleles between the same ends.

    Just two contigs have the ends, they differ on both strands, their lengths by 30 % at
    most and their coverage by a factor of 2.5 at most; the lower coverage, of equal ones
    the shorter, then the later, is the haplotig.
    """
    c = contigs.withColumn("_key", F.when(F.length("sequence") >= k - 1, end_key(k)))
    by, order = W.Window.partitionBy("_key"), W.Window.partitionBy("_key").orderBy("mean_coverage", F.length("sequence"), F.desc("id"))
    n = F.length("sequence")
    c = c.withColumn("_n", F.count("_key").over(by)).withColumn("_rank", F.row_number().over(order))
    c = c.withColumn("_hi", F.max(n).over(by)).withColumn("_lo", F.min(n).over(by)).withColumn("_chi", F.max("mean_coverage").over(by)).withColumn("_clo", F.min("mean_coverage").over(by))
    c = c.withColumn("_kinds", F.min(F.least("sequence", S.revcomp("sequence"))).over(by) != F.max(F.least("sequence", S.revcomp("sequence"))).over(by))
    pair = (F.col("_n") == 2) & F.col("_kinds") & ((F.col("_hi") - F.col("_lo")) / F.col("_hi") <= 0.30) & (F.col("_chi") <= 2.5 * F.col("_clo"))
    return c.withColumn("haplotig", F.coalesce(pair & (F.col("_rank") == 1), F.lit(False))).drop("_key", "_n", "_rank", "_hi", "_lo", "_chi", "_clo", "_kinds")
