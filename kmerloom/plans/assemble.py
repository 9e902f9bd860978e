"""Assembly, read preprocessing, evaluation and polishing from end to end."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import graph, kmers, mapping, metrics, modes, polish, resolve
from ..operators import reads as R

MODES = ("meta", "plasmid", "rna", "sc", "diploid")


def validate_k(k: int) -> int:
    if not (11 <= k <= 127 and k % 2):
        raise ValueError(f"k must be odd and 11 to 127, not {k}")
    return k


@dataclass(frozen=True)
class AssemblerConfig:
    """Options of an assembly; ``multik`` replaces ``k``."""

    k: int = 31
    min_coverage: float = 5.0
    min_length: int = 200
    error_correct: bool = False
    careful: bool = False
    polish: bool = True
    mode: str | None = None
    multik: tuple[int, ...] = ()
    min_links: int = 3

    def __post_init__(self) -> None:
        for k in self.multik or (self.k,):
            validate_k(k)
        if any(a >= b for a, b in zip(self.multik, self.multik[1:], strict=False)):
            raise ValueError("the k-mer sizes must rise")
        if self.mode not in (None, *MODES):
            raise ValueError(f"unknown mode {self.mode}")


@dataclass
class AssemblyResult:
    contigs: DataFrame
    scaffolds: DataFrame
    k: int
    plasmids: DataFrame | None = None
    haplotigs: DataFrame | None = None

    def stats(self) -> DataFrame:
        return metrics.assembly_stats(self.contigs)


def _mates(blocks: DataFrame) -> DataFrame:
    """(read_id, pair_id, mate, seq) of the clean pairs."""
    two = blocks.filter(F.col("block").isin(R.CLEAN_1, R.CLEAN_2))
    return two.select((F.col("pair_id") * 2 + F.col("mate") - 1).alias("read_id"), "pair_id", "mate", "seq")


def _links(mates: DataFrame, contigs: DataFrame, k: int) -> DataFrame:
    at = mapping.map_reads(mates, mapping.unique_anchors(contigs, k), k)
    return graph.cut(mapping.paired_links(mapping.mate_pairs(at, mates)))


POLISH_K = 21


def _step(blocks: DataFrame, k: int, config: AssemblerConfig, priors: DataFrame | None, last: bool, long_reads: DataFrame | None, linked_reads: DataFrame | None, mate_pairs: DataFrame | None) -> AssemblyResult:
    """One k from the counts on; ``blocks(ordinal, block, pair_id, mate, seq)``."""
    with graph.scope(blocks.sparkSession) as keep:
        usable = blocks.filter(F.col("block") != R.SIDECAR).select(F.col("ordinal").alias("id"), "seq")
        if config.error_correct or config.careful:
            twice = kmers.seen_twice(kmers.count_packed(usable, k))
            # corrected reads only count; pairs and polishing go on with the reads as they are
            counts = kmers.count_packed(kmers.correct_reads(usable, twice, k), k)
        else:
            counts = kmers.count_packed(usable, k)
        counts = kmers.seen_twice(counts)
        if priors is not None:
            counts = kmers.boost_priors(counts, priors, k, config.min_coverage)
        counts = graph.cut(counts)
        contigs = graph.unitigs(kmers.solid(counts, kmers.solid_cutoff(counts, config.min_coverage)), k)
        if config.mode == "sc":
            contigs = modes.single_cell_normalize(contigs)
        contigs = keep(graph.simplify(contigs, k, config.min_coverage, config.min_length, config.mode == "rna"))
        mates = _mates(blocks)
        paired = last and not mates.isEmpty()
        if paired:
            contigs = graph.cut(resolve.resolve_repeats(contigs, _links(mates, contigs, k), k))
        if last and long_reads is not None:
            contigs = graph.cut(resolve.bridge_long_reads(contigs, long_reads, k))
        if last and linked_reads is not None:
            at = mapping.map_reads(linked_reads, mapping.unique_anchors(contigs, k, per_contig=True), k)
            shared = mapping.barcode_links(at.join(linked_reads.select("read_id", "barcode"), "read_id"))
            contigs = graph.cut(resolve.linked_scaffolds(contigs, shared))
        if config.mode == "rna":
            contigs = modes.rna_filter(contigs)
        haplotigs = None
        if last and config.mode == "diploid":
            phased = graph.cut(modes.phase_haplotigs(contigs, k))
            haplotigs, contigs = phased.filter("haplotig").drop("haplotig"), phased.filter("NOT haplotig").drop("haplotig")
        scaffolds = contigs
        if paired:
            pool = usable.select(F.col("id").alias("ordinal"), "seq")
            scaffolds = graph.cut(resolve.build_scaffolds(contigs, _links(mates, contigs, k), pool, config.min_links))
        if last and mate_pairs is not None:
            far = _mates(mate_pairs)
            scaffolds = graph.cut(resolve.build_scaffolds(scaffolds, _links(far, scaffolds, k), None, config.min_links))
        if last and config.polish:
            votes = blocks.select(F.col("ordinal").alias("read_id"), "seq")
            fixed = lambda c: graph.cut(polish.polish(c, votes, POLISH_K, config.careful).drop("changed"))
            contigs = fixed(contigs)
            # without pairs the scaffolds are the polished contigs
            scaffolds = fixed(scaffolds) if paired else contigs
            haplotigs = None if haplotigs is None else fixed(haplotigs)
        plasmids = None
        if last and config.mode == "plasmid":
            split = graph.cut(modes.plasmid_split(contigs, k))
            plasmids, contigs = split.filter("plasmid").drop("plasmid"), split.filter("NOT plasmid").drop("plasmid")
        if config.mode == "meta":
            contigs, scaffolds = (modes.meta_filter(c, config.min_length) for c in (contigs, scaffolds))
        done = lambda c: None if c is None else keep(graph.length_filter(c, 0))
        return AssemblyResult(done(contigs), done(scaffolds), k, done(plasmids), done(haplotigs))


def assemble(pairs: DataFrame, config: AssemblerConfig = AssemblerConfig(), *, trusted: DataFrame | None = None, long_reads: DataFrame | None = None, linked_reads: DataFrame | None = None, mate_pairs: DataFrame | None = None) -> AssemblyResult:
    """Contigs and scaffolds of ``pairs(pair_id, r1, r2)``; single reads have a null r2.

    ``trusted(sequence)``: contigs whose k-mers count as solid.  ``long_reads(read_id, seq)``,
    ``linked_reads(read_id, barcode, seq)`` and ``mate_pairs(pair_id, r1, r2)`` are further
    libraries.  With several k, the contigs of each step are trusted by the next one, only
    the last step resolves and polishes, and contigs of earlier steps that it lost come back.
    """
    # clean first mates, their mates and single pieces in this order, then what only polishing reads
    blocks = graph.numbered(R.route(pairs).withColumn("_last", F.col("block") == R.SIDECAR), ["_last", "block", "pair_id", "mate", "piece"], name="ordinal").drop("_last")
    blocks = graph.cut(blocks)
    far = R.route(mate_pairs) if mate_pairs is not None else None
    sizes = config.multik or (config.k,)
    priors, earlier = trusted, None
    for i, k in enumerate(sizes):
        last = i == len(sizes) - 1
        result = _step(blocks, k, config, priors, last, long_reads, linked_reads, far)
        if not last:
            priors = result.contigs.select("sequence") if trusted is None else result.contigs.select("sequence").unionByName(trusted.select("sequence"))
            tagged = result.contigs.withColumn("id", F.col("id") + F.lit(i * 10**12))
            earlier = tagged if earlier is None else earlier.unionByName(tagged)
    if earlier is not None:
        final = result.contigs.select("sequence")
        for part in (result.plasmids, result.haplotigs):
            final = final if part is None else final.unionByName(part.select("sequence"))
        back = resolve.rescue(final, earlier, sizes[-1], config.min_coverage)
        result = replace(result, contigs=graph.length_filter(result.contigs.unionByName(back), 0), scaffolds=graph.length_filter(result.scaffolds.unionByName(back), 0))
    return result


def qc(reads: DataFrame, config: R.QcConfig = R.QcConfig(), keep_singletons: bool = True) -> tuple[DataFrame, DataFrame]:
    """Preprocessed reads and a one-row report over raw and clean reads and reasons.

    Of pairs, a read that passes goes with its mate if ``keep_singletons`` is off; it then
    counts as too short.
    """
    offset = config.phred or R.detect_phred(reads)
    paired = "pair_id" in reads.columns
    done = graph.cut((R.preprocess_pairs if paired else R.preprocess)(reads, replace(config, phred=offset)))
    if paired and not keep_singletons:
        done = R.drop_singletons(done)
    clean = done.filter("fate = 'pass'")
    raw, kept = R.read_totals(reads, offset), R.read_totals(clean, offset)
    report = raw.select(*(F.col(c).alias(f"raw_{c}") for c in raw.columns)).crossJoin(kept.select(*(F.col(c).alias(f"clean_{c}") for c in kept.columns)))
    flags = {"adapter_trimmed": "adapter_trimmed", "poly_g_trimmed": "poly_g_trimmed", "quality_trimmed": "window_trimmed"}
    why = done.agg(
        *(F.coalesce(F.sum((F.col("fate") == f).cast("long")), F.lit(0)).alias(f"dropped_{f}") for f in ("too_short", "too_many_ns", "low_quality")),
        *(F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(name) for name, c in flags.items()),
    )
    return clean, report.crossJoin(why).withColumn("phred", F.lit(offset))


def evaluate(contigs: DataFrame, reference: DataFrame | None = None, min_length: int = 200) -> DataFrame:
    """One row of metrics over contigs of ``min_length`` or more, with length_bins; with a reference those against it."""
    kept = contigs.filter(F.length("sequence") >= min_length)
    sums = kept.agg(F.coalesce(F.max(F.length("sequence")), F.lit(0)).cast("long").alias("longest"), F.coalesce(F.sum(F.length(F.regexp_replace("sequence", "[^Nn]", "")).cast("long")), F.lit(0)).alias("total_ns"))
    bins = metrics.length_bins(kept).agg(F.sort_array(F.collect_list(F.struct("threshold", "n_contigs", "total_length"))).alias("length_bins"))
    out = metrics.composition(contigs, min_length).crossJoin(sums)  # one row each
    for f in (0.5, 0.75, 0.9):
        out = out.crossJoin(metrics.nx_lx(kept, f).toDF(f"n{f * 100:.0f}", f"l{f * 100:.0f}"))
    out = out.crossJoin(bins)
    if reference is not None:
        total = reference.agg(F.coalesce(F.sum(F.length("seq").cast("long")), F.lit(0))).first()[0]
        ref = reference.withColumnRenamed("seq", "sequence").select("sequence")
        out = out.crossJoin(metrics.ng50(kept, total)).crossJoin(metrics.reference_metrics(contigs.select("sequence"), ref, min_length)).withColumn("reference_length", F.lit(total).cast("long"))
    return out


def polish_contigs(contigs: DataFrame, reads: DataFrame, k: int = 21, min_support: int = 5, careful: bool = False) -> DataFrame:
    """Polished (id, sequence, ...) of ``contigs(id, sequence)`` by ``reads(read_id, seq)``."""
    return polish.polish(contigs, reads, validate_k(k), careful, min_support)


__all__ = ["MODES", "AssemblerConfig", "AssemblyResult", "S", "assemble", "evaluate", "polish_contigs", "qc", "validate_k"]
