"""Reads on their way in: pairing, trimming, splitting and quality control."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import seq as S

CLEAN_1, CLEAN_2, UNPAIRED, SIDECAR = 1, 2, 3, 0


def pair_files(first: DataFrame, second: DataFrame) -> DataFrame:
    """(pair_id, r1, r2) from two (ordinal, seq) tables; a longer one's tail has a null mate."""
    a, b = first.select("ordinal", F.col("seq").alias("r1")), second.select("ordinal", F.col("seq").alias("r2"))
    return a.join(b, "ordinal", "full").withColumnRenamed("ordinal", "pair_id")


def deinterleave(reads: DataFrame) -> DataFrame:
    """(pair_id, r1, r2) of one (ordinal, seq) table whose neighbours are mates; an odd last one has none."""
    pair = F.floor(F.col("ordinal") / 2).alias("pair_id")
    return reads.groupBy(pair).agg(F.max(F.when(F.col("ordinal") % 2 == 0, F.col("seq"))).alias("r1"), F.max(F.when(F.col("ordinal") % 2 == 1, F.col("seq"))).alias("r2"))


def route(pairs: DataFrame, least: int = S.MIN_K) -> DataFrame:
    """(pair_id, block, mate, piece, seq): reads by what they are good for.

    Ends are trimmed to ACGT.  Two mates without inner ambiguous bases and of ``least``
    bases are a clean pair (blocks 1 and 2).  Else each is split at ambiguous bases into
    pieces of ``least`` or more (block 3); without any, what is not empty goes to block 0,
    which only polishing reads.
    """
    p = pairs.withColumns({m: S.trim_ambiguous_ends(F.upper(m)) for m in ("r1", "r2")})
    clean = lambda m: F.coalesce((F.length(m) >= least) & ~F.col(m).rlike("[^ACGT]"), F.lit(False))
    p = p.withColumn("_clean", clean("r1") & clean("r2"))
    paired = p.filter("_clean").select("pair_id", F.explode(F.array(*(F.struct(F.lit(b).alias("block"), F.lit(b).alias("mate"), F.lit(0).alias("piece"), F.col(m).alias("seq")) for b, m in ((CLEAN_1, "r1"), (CLEAN_2, "r2"))))).alias("x")).select("pair_id", "x.*")
    mates = p.filter("NOT _clean").select("pair_id", F.explode(F.array(*(F.struct(F.lit(i).alias("mate"), F.col(m).alias("seq")) for i, m in ((1, "r1"), (2, "r2"))))).alias("x")).select("pair_id", "x.*").filter("seq != ''")
    mates = mates.withColumn("_runs", S.clean_runs("seq", least))
    pieces = mates.filter(F.size("_runs") > 0).select("pair_id", F.lit(UNPAIRED).alias("block"), "mate", F.posexplode("_runs").alias("piece", "seq"))
    rest = mates.filter(F.size("_runs") == 0).select("pair_id", F.lit(SIDECAR).alias("block"), "mate", F.lit(0).alias("piece"), "seq")
    return paired.unionByName(pieces.select(*paired.columns)).unionByName(rest.select(*paired.columns))


def detect_phred(reads: DataFrame, qual: str = "qual") -> int:
    """33 or 64 for a whole file, by its lowest and highest quality characters."""
    chars = F.filter(F.transform(F.split(F.col(qual), ""), lambda c: F.ascii(c)), lambda c: c >= 33)
    row = reads.agg(F.min(F.array_min(chars)).alias("low"), F.max(F.array_max(chars)).alias("high")).select(S.phred_offset(F.col("low"), F.col("high"))).first()
    return row[0]


@dataclass(frozen=True)
class QcConfig:
    """Thresholds of read preprocessing."""

    min_quality: int = 10
    min_length: int = 30
    max_ns: int = 3
    window: int = 4
    window_quality: int = 15
    poly_g: int = 5
    min_overlap: int = 10
    #: The common beginnings of the two read-through adapters.
    adapters: tuple[str, ...] = field(default=("AGATCGGAAGAGCACACGTCTGAA", "AGATCGGAAGAGCGTCGTGTAGGG"))
    phred: int | None = None


def preprocess(reads: DataFrame, config: QcConfig = QcConfig()) -> DataFrame:
    """Reads after poly-N, poly-G, adapter and window trimming, with what was done and ``fate``.

    Adds poly_n_trimmed, poly_g_trimmed, adapter_trimmed, window_trimmed and fate ('pass' or
    why the read goes).  ``reads`` has seq and qual of the same length.
    """
    offset = config.phred or detect_phred(reads)
    cut = lambda df, end: df.withColumn("seq", F.substring(F.col("seq"), F.lit(1), end)).withColumn("qual", F.substring(F.col("qual"), F.lit(1), end))
    start, size = S.poly_n_bounds("seq")
    df = reads.withColumns({"_a": start, "_n": size, "_was": F.length("seq")})
    df = df.withColumns({"seq": F.substring(F.col("seq"), F.col("_a"), F.col("_n")), "qual": F.substring(F.col("qual"), F.col("_a"), F.col("_n")), "poly_n_trimmed": F.col("_n") < F.col("_was")})
    df = df.withColumn("_end", S.poly_g_end("seq", config.poly_g)).withColumn("poly_g_trimmed", F.col("_end") < F.length("seq"))
    df = cut(df, F.col("_end"))
    df = df.withColumn("_at", S.adapter_start("seq", list(config.adapters), config.min_overlap)).withColumn("adapter_trimmed", F.col("_at").isNotNull())
    df = cut(df, F.coalesce("_at", F.length("seq")))
    df = df.withColumn("_end", S.window_end("qual", config.window, config.window_quality, offset)).withColumn("window_trimmed", F.col("_end") < F.length("seq"))
    df = cut(df, F.col("_end"))
    df = df.withColumn("fate", S.read_fate("seq", "qual", config.min_length, config.max_ns, config.min_quality, offset))
    return df.drop("_a", "_n", "_was", "_end", "_at")


def preprocess_pairs(pairs: DataFrame, config: QcConfig = QcConfig()) -> DataFrame:
    """(pair_id, mate, seq, qual, ..., fate, route): mates from ``pairs(pair_id, mate, seq, qual)``.

    ``route``: 'paired' if both pass, 'singleton' if one does, 'dropped'.
    """
    return routed(preprocess(pairs, config))


def routed(reads: DataFrame) -> DataFrame:
    """Adds ``route`` to reads with pair_id and fate: 'paired' if both pass, 'singleton' if one does, 'dropped'."""
    passed = F.sum((F.col("fate") == "pass").cast("int")).over(W.Window.partitionBy("pair_id"))
    return reads.withColumn("route", F.when(F.col("fate") != "pass", "dropped").when(passed == 2, "paired").otherwise("singleton"))


def drop_singletons(reads: DataFrame) -> DataFrame:
    """Routed reads where one that lost its mate is dropped as too short."""
    return reads.withColumn("fate", F.when(F.col("route") == "singleton", "too_short").otherwise(F.col("fate")))


def read_totals(reads: DataFrame, offset: int = 33) -> DataFrame:
    """One row: n_reads, n_bases, q20, q30 and gc bases."""
    q = S.scores("qual", offset)
    at_least = lambda t: F.coalesce(F.sum(F.size(F.filter(q, lambda x: x >= t)).cast("long")), F.lit(0))
    return reads.agg(F.count("*").alias("n_reads"), F.coalesce(F.sum(F.length("seq").cast("long")), F.lit(0)).alias("n_bases"), at_least(20).alias("q20"), at_least(30).alias("q30"), F.coalesce(F.sum(S.gc_count("seq").cast("long")), F.lit(0)).alias("gc"))


def drop_reasons(reads: DataFrame) -> DataFrame:
    """(fate, n_reads) of preprocessed reads."""
    return reads.groupBy("fate").agg(F.count("*").alias("n_reads"))


def quality_trim(reads: DataFrame, least: int = 10, min_length: int = 30, max_ns: int = 3, offset: int | None = None) -> DataFrame:
    """The filter of a quality-aware scan: 3' trim, then length and N limits."""
    end = S.quality_end("qual", least, offset or detect_phred(reads))
    df = reads.withColumn("_end", end)
    df = df.withColumns({"seq": F.substring(F.col("seq"), F.lit(1), F.col("_end")), "qual": F.substring(F.col("qual"), F.lit(1), F.col("_end"))}).drop("_end")
    ns = F.length("seq") - F.length(F.regexp_replace("seq", "[Nn]", ""))
    return df.filter((F.length("seq") >= min_length) & (ns <= max_ns))


def systematic_sample(reads: DataFrame, most: int = 8192, ordinal: str = "ordinal") -> DataFrame:
    """Every n-th read, so that ``most`` are taken at most."""
    total = reads.count()
    step = max(total // most, 1)
    return reads.filter((F.col(ordinal) % step == 0) & (F.floor(F.col(ordinal) / step) < most))


def first_reads(reads: DataFrame, most: int, ordinal: str = "ordinal") -> DataFrame:
    """The first reads of a file, by their place in it."""
    return reads.filter(F.col(ordinal) < most)
