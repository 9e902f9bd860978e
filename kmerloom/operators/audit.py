"""Comparison of assemblies with known loci, genes and alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .packed import kmer_codes, kmer_tallies


def locus_recovery(loci: DataFrame, contigs: DataFrame, k: int = 25, key: str = "id") -> DataFrame:
    """(locus, best_contig, covered, positions, percent): the contig that has most of a locus's k-mer positions.

    Of equal contigs the first, in the order of ids; a locus without hits has no contig.
    """
    own = kmer_tallies(loci, k, [key]).select(F.col(key).alias("locus"), "canon", "n")
    total = loci.select(F.col(key).alias("locus"), F.greatest(F.length("seq") - k + 1, F.lit(0)).cast("long").alias("positions"))
    have = kmer_tallies(contigs, k, ["id"], "sequence").select(F.col("id").alias("contig"), "canon").distinct()
    hits = own.join(have, "canon").groupBy("locus", "contig").agg(F.sum("n").alias("covered"))
    w = W.Window.partitionBy("locus").orderBy(F.desc("covered"), "contig")
    best = hits.withColumn("n", F.row_number().over(w)).filter("n = 1").select("locus", F.col("contig").alias("best_contig"), "covered")
    out = total.join(best, "locus", "left").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))
    return out.withColumn("percent", F.when(F.col("positions") > 0, 100.0 * F.col("covered") / F.col("positions")).otherwise(0.0))


def recovery_class(percent: Column, intact: float = 95.0, partial: float = 50.0, names: tuple[str, str, str] = ("INTACT", "PARTIAL", "MISSING")) -> Column:
    return F.when(percent >= intact, names[0]).when(percent >= partial, names[1]).otherwise(names[2])


def positional_recovery(loci: DataFrame, contigs: DataFrame, k: int = 31, key: str = "id") -> DataFrame:
    """(locus, covered, positions, percent): distinct positions of a locus whose k-mer any contig has on either strand."""
    own = kmer_tallies(loci, k, [key]).select(F.col(key).alias("locus"), "canon", "n")
    have = kmer_tallies(contigs, k, seq="sequence").select("canon").distinct()
    hits = own.join(have, "canon", "left_semi").groupBy("locus").agg(F.sum("n").alias("covered"))
    total = loci.select(F.col(key).alias("locus"), F.greatest(F.length("seq") - k + 1, F.lit(0)).cast("long").alias("positions"))
    out = total.join(hits, "locus", "left").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))
    return out.withColumn("percent", F.when(F.col("positions") > 0, 100.0 * F.col("covered") / F.col("positions")).otherwise(0.0))


def replicon_recovery(loci: DataFrame, plasmids: DataFrame, chromosomes: DataFrame, k: int = 25, key: str = "id") -> DataFrame:
    """(locus, positions, in_plasmids, in_chromosomes, plasmid_percent, chromosome_percent): k-mer positions of a replicon that either set has."""
    a = positional_recovery(loci, plasmids, k, key).select("locus", "positions", F.col("covered").alias("in_plasmids"))
    b = positional_recovery(loci, chromosomes, k, key).select("locus", F.col("covered").alias("in_chromosomes"))
    share = lambda c: 100.0 * F.col(c) / F.greatest("positions", F.lit(1))
    return a.join(b, "locus").select("locus", "positions", "in_plasmids", "in_chromosomes", share("in_plasmids").alias("plasmid_percent"), share("in_chromosomes").alias("chromosome_percent"))


def operon_bridging(flanks: DataFrame, contigs: DataFrame, k: int = 31, every: int = 10, least: int = 3) -> DataFrame:
    """(operon, status, contig): BRIDGED if a contig has ``least`` hits in both flanks and any inside, PARTIAL if inside only, UNCOVERED.

    ``flanks(operon, part, seq)`` with part in 'left', 'inside', 'right'; every ``every``-th
    window is looked up, and each place of it in a contig is a hit.  The contig is the first
    that bridges, by id, else the one with the most hits inside, else null.
    """
    own = kmer_codes(flanks, k, ["operon", "part"], every=every).select("operon", "part", "canon")
    have = kmer_tallies(contigs, k, ["id"], "sequence")
    hits = own.join(have, "canon").groupBy("operon", "id").agg(*(F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias(p) for p in ("left", "inside", "right")))
    hits = hits.filter("inside > 0").withColumn("_bridges", (F.col("left") >= least) & (F.col("right") >= least))
    per = hits.groupBy("operon").agg(F.min(F.when(F.col("_bridges"), F.col("id"))).alias("_bridge"), F.max(F.struct("inside", F.negate("id").alias("_id"))).alias("_most"))
    out = flanks.select("operon").distinct().join(per, "operon", "left")
    status = F.when(F.col("_bridge").isNotNull(), "BRIDGED").when(F.col("_most").isNotNull(), "PARTIAL").otherwise("UNCOVERED")
    return out.select("operon", status.alias("status"), F.coalesce("_bridge", F.negate(F.col("_most._id"))).alias("contig"))


# Intervals: closed, with chrom, start and end


def interval_union(intervals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, start, end): merged intervals; the next one joins if it starts at or before the end so far."""
    by = by or ["chrom"]
    w = W.Window.partitionBy(*by).orderBy("start", "end")
    marked = intervals.select(*by, "start", "end").withColumn("_upto", F.max("end").over(w.rowsBetween(W.Window.unboundedPreceding, -1)))
    marked = marked.withColumn("_new", F.coalesce((F.col("start") > F.col("_upto")).cast("int"), F.lit(1)))
    grouped = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def covered_bases(intervals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, covered): positions in the union."""
    by = by or ["chrom"]
    return interval_union(intervals, by).groupBy(*by).agg(F.sum(F.col("end") - F.col("start") + 1).alias("covered"))


def breadth(intervals: DataFrame, lengths: DataFrame) -> DataFrame:
    """(chrom, covered, length, percent) against ``lengths(chrom, length)``."""
    joined = lengths.join(covered_bases(intervals), "chrom", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return joined.select("chrom", "covered", "length", (100.0 * F.col("covered") / F.col("length")).alias("percent"))


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def overlap_join(left: DataFrame, right: DataFrame, slack: int = 0, width: int = 4096) -> DataFrame:
    """Pairs of intervals of one chromosome that overlap: all columns of left as l_*, of right as r_*.

    Both sides are cut into bins of ``width`` and joined on them, so neither side is
    compared as a whole; a pair is kept in the bin where its overlap begins.
    """
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns)).withColumn("_bin", F.explode(_bins(F.col("l_start") - slack, F.col("l_end") + slack, width)))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).withColumn("_rbin", F.explode(_bins(F.col("r_start"), F.col("r_end"), width)))
    first = F.floor(F.greatest(F.col("l_start") - slack, F.col("r_start")) / width)
    on = (F.col("l_chrom") == F.col("r_chrom")) & (F.col("_bin") == F.col("_rbin"))
    meet = (F.col("l_start") - slack <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end") + slack)
    return a.join(b, on & meet & (F.col("_bin") == first)).drop("_bin", "_rbin")


def contained(inner: DataFrame, outer: DataFrame, flank: int = 30, width: int = 4096) -> DataFrame:
    """Pairs where the right interval holds the left one with ``flank`` bases more at either end."""
    pairs = overlap_join(inner, outer, 0, width)
    return pairs.filter((F.col("r_start") <= F.col("l_start") - flank) & (F.col("r_end") >= F.col("l_end") + flank))


def longest_overlap(genes: DataFrame, alignments: DataFrame, key: str, width: int = 4096) -> DataFrame:
    """(key, overlap): the longest overlap of any single alignment with each gene; 0 without one."""
    both = overlap_join(genes, alignments, 0, width)
    size = F.least("l_end", "r_end") - F.greatest("l_start", "r_start") + 1
    best = both.groupBy(F.col(f"l_{key}").alias(key)).agg(F.max(size).alias("overlap"))
    return genes.select(key).join(best, key, "left").select(key, F.coalesce("overlap", F.lit(0)).alias("overlap"))


def gene_span(genes: DataFrame, alignments: DataFrame, key: str, flank: int = 30, width: int = 4096, distinct_from: str | None = None) -> DataFrame:
    """(key, spanned, percent, bucket): whether one alignment holds the gene and its flanks, and how much of the gene the longest covers.

    With ``distinct_from``, a column of the alignments, those whose value is the gene's key are left out.
    """
    both = overlap_join(genes, alignments, 0, width)
    both = both if distinct_from is None else both.filter(F.col(f"l_{key}") != F.col(f"r_{distinct_from}"))
    size = F.least("l_end", "r_end") - F.greatest("l_start", "r_start") + 1
    holds = (F.col("r_start") <= F.col("l_start") - flank) & (F.col("r_end") >= F.col("l_end") + flank)
    best = both.groupBy(F.col(f"l_{key}").alias(key)).agg(F.max(size).alias("_over"), F.max(holds).alias("_s"))
    out = genes.select(key, (F.col("end") - F.col("start") + 1).alias("_n")).join(best, key, "left")
    percent = 100.0 * F.coalesce("_over", F.lit(0)) / F.col("_n")
    bucket = F.when(percent >= 99, ">=99").when(percent >= 95, ">=95").when(percent >= 50, ">=50").otherwise("<50")
    return out.select(key, F.coalesce("_s", F.lit(False)).alias("spanned"), percent.alias("percent"), bucket.alias("bucket"))


def centromere_synteny(centromeres: DataFrame, alignments: DataFrame, key: str, flank: int = 200, width: int = 4096, distinct_from: str | None = None) -> DataFrame:
    """(key, status, left_flank, right_flank, contig): INTACT with ``flank`` bases on both sides in one alignment, MARGINAL with less, SPLIT without.

    Of several alignments that hold it, the one whose smaller flank is the largest, then the
    larger sum, then the smaller contig; flanks are 0 and the contig null without any.  With
    ``distinct_from``, a column of the alignments, those whose value is the key are left out.
    """
    pairs = contained(centromeres, alignments, 0, width)
    pairs = pairs if distinct_from is None else pairs.filter(F.col(f"l_{key}") != F.col(f"r_{distinct_from}"))
    left, right = F.col("l_start") - F.col("r_start"), F.col("r_end") - F.col("l_end")
    w = W.Window.partitionBy(f"l_{key}").orderBy(F.desc(F.least(left, right)), F.desc(left + right), "r_contig")
    best = pairs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(F.col(f"l_{key}").alias(key), left.alias("left_flank"), right.alias("right_flank"), F.col("r_contig").alias("contig"))
    out = centromeres.select(key).join(best, key, "left")
    status = F.when(F.col("left_flank").isNull(), "SPLIT").when(F.least("left_flank", "right_flank") >= flank, "INTACT").otherwise("MARGINAL")
    zero = F.lit(0).cast("long")
    return out.select(key, status.alias("status"), F.coalesce("left_flank", zero).alias("left_flank"), F.coalesce("right_flank", zero).alias("right_flank"), "contig")


# Species


def species_purity(alignments: DataFrame) -> DataFrame:
    """One row from (contig, species): aligned contigs, those of several species, percent of pure ones."""
    per = alignments.groupBy("contig").agg((F.countDistinct("species") > 1).cast("long").alias("mixed"))
    return per.agg(F.count("*").alias("n_contigs"), F.coalesce(F.sum("mixed"), F.lit(0)).alias("n_mixed")).withColumn("purity", F.when(F.col("n_contigs") > 0, 100.0 * (F.col("n_contigs") - F.col("n_mixed")) / F.col("n_contigs")).otherwise(0.0))


def assign_species(reads: DataFrame, references: DataFrame, k: int = 31, every: int = 10, key: str = "id") -> DataFrame:
    """(key, species): the first species, by order, that any probed k-mer of the read is in; ``references(order, species, seq)``."""
    have = kmer_tallies(references, k, ["order", "species"]).groupBy("canon").agg(F.min(F.struct("order", "species")).alias("s"))
    own = kmer_codes(reads, k, [key], every=every).select(key, "canon")
    return own.join(have, "canon").groupBy(key).agg(F.min("s").alias("s")).select(key, "s.species")


def identity_rate(reads: DataFrame, reference: DataFrame, k: int = 31, key: str = "id") -> DataFrame:
    """One row: reads, those with any k-mer of the reference, and their percent."""
    have = kmer_tallies(reference, k).select("canon").distinct()
    hit = kmer_tallies(reads, k, [key]).join(have, "canon", "left_semi").select(key).distinct()
    counts = reads.select(key).distinct().join(hit.withColumn("_h", F.lit(1)), key, "left").agg(F.count("*").alias("n_reads"), F.count("_h").alias("n_matching"))
    return counts.withColumn("percent", F.when(F.col("n_reads") > 0, 100.0 * F.col("n_matching") / F.col("n_reads")).otherwise(0.0))


def coverage_dynamics(headers: DataFrame) -> DataFrame:
    """One row of the coverages in contig headers: least, upper median, 95th percentile by rank, largest, fold."""
    c = headers.select(F.regexp_extract("header", r"cov_([^_\s]*)", 1).alias("_t")).select(F.expr("try_cast(_t AS double)").alias("cov")).filter("cov IS NOT NULL")
    bins = c.groupBy("cov").agg(F.count("*").alias("n"))
    ladder = bins.withColumn("upto", F.sum("n").over(W.Window.orderBy("cov").rowsBetween(W.Window.unboundedPreceding, 0)))
    total = bins.agg(F.sum("n").alias("total"))
    j = ladder.crossJoin(total)  # one row
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("total") * share), F.col("cov")))
    return j.agg(F.min("cov").alias("low"), at(0.5).alias("median"), at(0.95).alias("p95"), F.max("cov").alias("high")).withColumn("fold", F.col("high") / F.greatest("low", F.lit(0.1)))
