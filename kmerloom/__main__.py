"""Command line: ``python -m kmerloom assemble|qc|eval|polish``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import reads as R
from .plans import assemble as A
from .sources import fastx, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kmerloom")
    sub = top.add_subparsers(dest="command", required=True)
    a = sub.add_parser("assemble")
    a.add_argument("-1", dest="first")
    a.add_argument("-2", dest="second")
    a.add_argument("-s", dest="single", action="append", default=[])
    a.add_argument("--12", dest="interleaved", action="append", default=[])
    a.add_argument("-i", dest="inputs", action="append", default=[])
    a.add_argument("-o", dest="out", required=True)
    a.add_argument("-k", type=int, default=31)
    a.add_argument("-c", dest="min_coverage", type=float, default=5.0)
    a.add_argument("-m", dest="min_length", type=int, default=200)
    for name in ("error-correct", "careful", "no-polish", *A.MODES):
        a.add_argument(f"--{name}", action="store_true")
    a.add_argument("--mp1-1")
    a.add_argument("--mp1-2")
    a.add_argument("--nanopore")
    a.add_argument("--pacbio")
    a.add_argument("--trusted-contigs")
    a.add_argument("--splitter", "--linked-reads", dest="linked")
    a.add_argument("--multik", help="rising k-mer sizes, joined by commas")
    q = sub.add_parser("qc", aliases=["preprocess"])
    q.add_argument("-1", dest="first")
    q.add_argument("-2", dest="second")
    q.add_argument("-s", dest="single")
    q.add_argument("-o", dest="out", required=True)
    q.add_argument("--adapter", action="append", default=[])
    q.add_argument("--phred33", action="store_true")
    q.add_argument("--phred64", action="store_true")
    q.add_argument("--json")
    e = sub.add_parser("eval")
    e.add_argument("contigs")
    e.add_argument("-r", dest="reference")
    e.add_argument("-l", dest="min_length", type=int, default=200)
    e.add_argument("--json")
    p = sub.add_parser("polish")
    p.add_argument("contigs")
    p.add_argument("-i", dest="reads", action="append", required=True)
    p.add_argument("-o", dest="out", required=True)
    p.add_argument("-k", type=int, default=21)
    p.add_argument("--min-coverage", type=int, default=5)
    p.add_argument("--careful", action="store_true")
    return top


def _numbered(spark: SparkSession, *paths: str) -> DataFrame:
    return fastx.scan(spark, *paths).select(F.monotonically_increasing_id().alias("read_id"), "id", "seq", "qual")


def _contigs(spark: SparkSession, path: str) -> DataFrame:
    rows = fastx.scan(spark, path, keep_empty=True, letters_only=True)
    return rows.select(F.col("ordinal").alias("id"), F.col("seq").alias("sequence"), F.lit(10.0).alias("mean_coverage"), F.lit(1).cast("long").alias("kmers_count"))


def run_assemble(spark: SparkSession, o: argparse.Namespace) -> None:
    if bool(o.first) != bool(o.second) or bool(o.mp1_1) != bool(o.mp1_2):
        raise ValueError("mates come as two files")
    modes = [m for m in A.MODES if getattr(o, m)]
    if len(modes) > 1:
        raise ValueError(f"modes exclude one another: {', '.join(modes)}")
    if o.interleaved:
        if o.first or o.single or o.inputs:
            raise ValueError("interleaved files don't mix with others")
        pairs = fastx.scan_interleaved(spark, *o.interleaved)
    else:
        paths = [x for x in (o.first, o.second) if x] + o.single + o.inputs
        if not paths:
            raise ValueError("no reads")
        # single reads alone are never mates of one another
        pairs = fastx.scan_reads(spark, *paths) if o.first or not o.single else fastx._single(_numbered(spark, *paths).withColumnRenamed("read_id", "ordinal"), 0, 1)
    config = A.AssemblerConfig(
        k=o.k, min_coverage=o.min_coverage, min_length=o.min_length, error_correct=o.error_correct or o.careful, careful=o.careful, polish=not o.no_polish, mode=modes[0] if modes else None, multik=tuple(int(x) for x in o.multik.split(",")) if o.multik else ()
    )
    long_ = [x for x in (o.nanopore, o.pacbio) if x]
    linked = fastx.scan_linked(spark, o.linked).select(F.monotonically_increasing_id().alias("read_id"), "barcode", "seq") if o.linked else None
    result = A.assemble(
        pairs, config, trusted=fastx.scan_trusted(spark, o.trusted_contigs) if o.trusted_contigs else None, long_reads=_numbered(spark, *long_).select("read_id", "seq") if long_ else None,
        linked_reads=linked, mate_pairs=fastx.scan_pairs(spark, o.mp1_1, o.mp1_2) if o.mp1_1 else None,
    )
    at = lambda name: os.path.join(o.out, name)
    sinks.write_contigs(result.contigs, at("contigs.fasta"))
    sinks.write_scaffolds(result.scaffolds, at("scaffolds.fasta"))
    sinks.write_gfa(result.contigs, result.k, at("graph.gfa"))
    for name, found in (("plasmids", result.plasmids), ("haplotigs", result.haplotigs)):
        if found is not None and not found.isEmpty():
            sinks.write_contigs(found, at(f"{name}.fasta"))
    print(sinks.summary(result.stats(), "Assembly"))


def run_qc(spark: SparkSession, o: argparse.Namespace) -> None:
    if bool(o.first) == bool(o.single):
        raise ValueError("give a pair of files or a single one")
    inputs = [x for x in (o.first, o.second, o.single) if x]
    outputs = [os.path.join(o.out, f"clean_{m}.fastq.gz") for m in ("1", "2", "single")]
    sinks.guard_paths(inputs, outputs)
    extra = R.QcConfig()
    config = R.QcConfig(adapters=(*extra.adapters, *o.adapter), phred=33 if o.phred33 else 64 if o.phred64 else None)
    files = fastx.scan(spark, *inputs).select(F.col("ordinal").alias("pair_id"), (F.col("file") + 1).alias("mate"), F.col("ordinal"), "id", "seq", "qual")
    clean, report = A.qc(files if o.first else files.drop("pair_id", "mate"), config)
    if o.first:
        for mate, path in ((1, outputs[0]), (2, outputs[1])):
            sinks.write_fastq(clean.filter((F.col("route") == "paired") & (F.col("mate") == mate)), path)
        sinks.write_fastq(clean.filter("route = 'singleton'"), outputs[2])
    else:
        sinks.write_fastq(clean, outputs[2])
    if o.json:
        sinks.qc_json(report, o.json)
    print(sinks.summary(report, "Reads"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("kmerloom").getOrCreate()
    if o.command == "assemble":
        run_assemble(spark, o)
    elif o.command in ("qc", "preprocess"):
        run_qc(spark, o)
    elif o.command == "eval":
        reference = fastx.scan(spark, o.reference, letters_only=True).select("seq") if o.reference else None
        report = A.evaluate(_contigs(spark, o.contigs), reference, o.min_length)
        if o.json:
            sinks.evaluation_json(report, o.contigs, o.reference, o.json)
        print(sinks.summary(report, "Assembly"))
    else:
        sinks.guard_paths([o.contigs, *o.reads], [o.out])
        done = A.polish_contigs(_contigs(spark, o.contigs), _numbered(spark, *o.reads).select("read_id", "seq"), o.k, o.min_coverage, o.careful)
        sinks.write_polished(done, o.out)
        print(f"{done.agg(F.sum('changed')).first()[0]} bases changed")


if __name__ == "__main__":
    main(sys.argv[1:])
