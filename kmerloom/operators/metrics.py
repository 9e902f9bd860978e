"""Assembly statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import seq as S
from .packed import kmer_tallies

BINS = (500, 1_000, 5_000, 10_000, 50_000)
REFERENCE_K = 31


def length_ladder(contigs: DataFrame, seq: str = "sequence") -> DataFrame:
    """(len, n, upto, rank): lengths from the longest on, with bases and contigs up to and with each.

    A histogram first, so the one ordered window has a row for each length, not for each contig.
    """
    counted = contigs.groupBy(F.length(seq).cast("long").alias("len")).agg(F.count("*").alias("n"))
    w = W.Window.orderBy(F.desc("len")).rowsBetween(W.Window.unboundedPreceding, 0)
    return counted.select("len", "n", F.sum(F.col("len") * F.col("n")).over(w).alias("upto"), F.sum("n").over(w).alias("rank"))


def _at(ladder: DataFrame, target: DataFrame, name: str, rank_name: str) -> DataFrame:
    """One row: the length that reaches the target, and how many contigs that takes."""
    joined = ladder.crossJoin(target)  # one row
    reached = joined.filter(F.col("upto") >= F.col("target")).agg(F.max("len").alias(name), F.max(F.struct("len", "n", "upto", "target", "rank")).alias("p"))
    over = F.floor((F.col("p.upto") - F.greatest("p.target", F.lit(1))) / F.greatest("p.len", F.lit(1)))
    return reached.select(name, (F.col("p.rank") - F.least(over, F.col("p.n") - 1)).cast("long").alias(rank_name))


def nx_lx(contigs: DataFrame, fraction: float, seq: str = "sequence") -> DataFrame:
    """(nx, lx) with the target total * fraction, halves rounded up; 0 and 0 without contigs."""
    ladder = length_ladder(contigs, seq)
    target = ladder.agg(F.floor(F.max("upto") * F.lit(fraction) + 0.5).cast("long").alias("target"))
    return _at(ladder, target, "nx", "lx").select(F.coalesce("nx", F.lit(0)).cast("long").alias("nx"), F.coalesce("lx", F.lit(0)).cast("long").alias("lx"))


def ng50(contigs: DataFrame, reference_length: int, seq: str = "sequence") -> DataFrame:
    """(ng50, lg50) against half the reference, rounded up; 0 and 0 if the contigs don't reach it."""
    ladder = length_ladder(contigs, seq)
    target = ladder.agg(F.lit((reference_length + 1) // 2).cast("long").alias("target"))
    return _at(ladder, target, "ng50", "lg50").select(F.coalesce("ng50", F.lit(0)).cast("long").alias("ng50"), F.coalesce("lg50", F.lit(0)).cast("long").alias("lg50"))


def assembly_stats(contigs: DataFrame, seq: str = "sequence") -> DataFrame:
    """One row: n_contigs, total_length, longest, n50, l50 (target half the total, rounded up), gc of the ACGT bases."""
    sums = contigs.agg(
        F.count("*").alias("n_contigs"), F.coalesce(F.sum(F.length(seq).cast("long")), F.lit(0)).alias("total_length"), F.coalesce(F.max(F.length(seq)), F.lit(0)).cast("long").alias("longest"),
        F.coalesce(F.sum(S.gc_count(seq).cast("long")), F.lit(0)).alias("_gc"), F.coalesce(F.sum(S.acgt_count(seq).cast("long")), F.lit(0)).alias("_acgt"),
    )
    ladder = length_ladder(contigs, seq)
    half = _at(ladder, sums.select(F.ceil(F.col("total_length") / 2).cast("long").alias("target")), "n50", "l50")
    gc = F.when(F.col("_acgt") > 0, 100 * F.col("_gc") / F.col("_acgt")).otherwise(0.0)
    return sums.crossJoin(half).select("n_contigs", "total_length", "longest", F.coalesce("n50", F.lit(0)).cast("long").alias("n50"), F.coalesce("l50", F.lit(0)).cast("long").alias("l50"), gc.alias("gc"))


def composition(contigs: DataFrame, min_length: int = 200, seq: str = "sequence") -> DataFrame:
    """One row over contigs of ``min_length`` or more: n_contigs, total_length, gc of all bases, n_per_100k."""
    c = contigs.filter(F.length(seq) >= min_length)
    ns = F.length(F.regexp_replace(seq, "[^Nn]", ""))
    sums = c.agg(F.count("*").alias("n_contigs"), F.coalesce(F.sum(F.length(seq).cast("long")), F.lit(0)).alias("total_length"), F.coalesce(F.sum(S.gc_count(seq).cast("long")), F.lit(0)).alias("_gc"), F.coalesce(F.sum(ns.cast("long")), F.lit(0)).alias("_n"))
    per = lambda x, f: F.when(F.col("total_length") > 0, F.lit(f) * F.col(x) / F.col("total_length")).otherwise(0.0)
    return sums.select("n_contigs", "total_length", per("_gc", 100.0).alias("gc"), per("_n", 100_000.0).alias("n_per_100k"))


def length_bins(contigs: DataFrame, bins: tuple[int, ...] = BINS, seq: str = "sequence") -> DataFrame:
    """(threshold, n_contigs, total_length): contigs of each length or more."""
    n = F.length(seq)
    sums = contigs.agg(*(x for b in bins for x in (F.sum((n >= b).cast("long")).alias(f"c{b}"), F.sum(F.when(n >= b, n.cast("long"))).alias(f"t{b}"))))
    rows = F.array(*(F.struct(F.lit(b).cast("long").alias("threshold"), F.coalesce(f"c{b}", F.lit(0)).alias("n_contigs"), F.coalesce(f"t{b}", F.lit(0)).alias("total_length")) for b in bins))
    return sums.select(F.inline(rows))


def reference_metrics(contigs: DataFrame, reference: DataFrame, min_length: int = 200, k: int = REFERENCE_K, seq: str = "sequence") -> DataFrame:
    """One row: genome_fraction, duplication_ratio, mismatches_per_100k against the reference's k-mers.

    Distinct canonical k-mers shared with the reference, matching instances for each of
    them, and novel instances div k for each 100,000 bases of contigs.  Null where the
    reference has no sequence of k bases.
    """
    ref = kmer_tallies(reference, k, seq=seq).select("canon").distinct()
    long_ = contigs.filter(F.length(seq) >= min_length)
    own = kmer_tallies(long_, k, seq=seq).groupBy("canon").agg(F.sum("n").alias("n"))
    both = own.join(ref.withColumn("_in", F.lit(True)), "canon", "left")
    hits = both.agg(F.count("_in").alias("shared"), F.coalesce(F.sum(F.when(F.col("_in"), F.col("n"))), F.lit(0)).alias("matching"), F.coalesce(F.sum(F.when(F.col("_in").isNull(), F.col("n"))), F.lit(0)).alias("novel"))
    total = long_.agg(F.coalesce(F.sum(F.length(seq).cast("long")), F.lit(0)).alias("total"))
    rows = hits.crossJoin(ref.agg(F.count("*").alias("ref"))).crossJoin(total)
    known = F.col("ref") > 0
    return rows.select(
        F.when(known, 100.0 * F.col("shared") / F.col("ref")).alias("genome_fraction"),
        F.when(known, F.when(F.col("shared") > 0, F.col("matching") / F.col("shared")).otherwise(1.0)).alias("duplication_ratio"),
        F.when(known, F.when(F.col("total") > 0, 100_000.0 * F.floor(F.col("novel") / k) / F.col("total")).otherwise(0.0)).alias("mismatches_per_100k"),
    )
