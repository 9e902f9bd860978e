"""Writers: FASTA, FASTQ, GFA and reports."""

from __future__ import annotations

import gzip
import json
import os
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import numbered, overlaps


def guard_paths(inputs: list[str], outputs: list[str]) -> None:
    """Outputs must differ from inputs and from one another."""
    real = [os.path.realpath(p) for p in outputs]
    if len(set(real)) < len(real):
        raise ValueError("two outputs have the same path")
    clash = set(real) & {os.path.realpath(p) for p in inputs}
    if clash:
        raise ValueError(f"would overwrite an input: {sorted(clash)[0]}")


def wrapped(seq: Column | str, width: int = 80) -> Column:
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.rtrim(F.regexp_replace(s, f"(.{{{width}}})", "$1\n"), F.lit("\n")) if width else s


def one_decimal(x: Column | str) -> Column:
    """A double with one decimal, its exact value rounded, halves to even (0.35 is a bit less, so 0.3; 2.25 gives 2.2).

    ``format_string`` and casts to decimals round the shortest decimal form, halves up.
    """
    return F.pandas_udf(lambda v: pd.Series([None if pd.isna(y) else f"{y:.1f}" for y in v], dtype=object), "string")(F.col(x) if isinstance(x, str) else x)


def fasta_records(contigs: DataFrame, prefix: str = "contig", width: int = 80, coverage: Column | None = None, length_word: str = "len") -> DataFrame:
    """(ordinal, value): a record for each contig in the order of ids, numbered from 1."""
    cov = one_decimal(F.col("mean_coverage").cast("double") if coverage is None else coverage)
    rows = numbered(contigs.withColumn("_cov", cov), ["id"], name="ordinal", start=1)
    head = F.concat(F.lit(f">{prefix}_"), F.col("ordinal").cast("string"), F.lit(f"_{length_word}_"), F.length("sequence").cast("string"), F.lit("_cov_"), F.col("_cov"))
    return rows.select("ordinal", F.concat(head, F.lit("\n"), wrapped("sequence", width)).alias("value"))


def _write_lines(rows: DataFrame, path: str) -> None:
    """One file, in the order of ordinals, a partition at a time; gzip by its name."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    opener = (lambda: gzip.open(path, "wt", compresslevel=1)) if path.lower().endswith(".gz") else (lambda: open(path, "w"))
    with opener() as f:
        for r in rows.orderBy("ordinal").select("value").toLocalIterator():
            f.write(r.value + "\n")


def write_contigs(contigs: DataFrame, path: str) -> None:
    _write_lines(fasta_records(contigs, "contig"), path)


def write_scaffolds(contigs: DataFrame, path: str) -> None:
    _write_lines(fasta_records(contigs, "scaffold"), path)


def write_polished(contigs: DataFrame, path: str) -> None:
    """Unwrapped, with a coverage of 10.0 throughout."""
    _write_lines(fasta_records(contigs, "NODE", 0, F.lit(10.0), "length"), path)


def write_fasta_folder(contigs: DataFrame, path: str, prefix: str = "contig") -> None:
    """Records as a folder of parts, for results of any size."""
    fasta_records(contigs, prefix).select("value").write.mode("overwrite").text(path)


def write_fastq(reads: DataFrame, path: str) -> None:
    """Records of (ordinal, id, seq, qual) in order."""
    _write_lines(reads.select("ordinal", F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")), path)


def write_fastq_folder(reads: DataFrame, path: str) -> None:
    reads.select(F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")).write.mode("overwrite").option("compression", "gzip").text(path)


def gfa_lines(contigs: DataFrame, k: int) -> DataFrame:
    """(ordinal, value): header, segments in the order of ids, then links, each on one strand only."""
    if k < 2:
        raise ValueError("a graph needs k of 2 or more")
    head = contigs.sparkSession.range(1).select(F.lit("0").alias("ordinal"), F.lit("H\tVN:Z:1.1").alias("value"))
    i = F.lpad(F.col("id").cast("string"), 20, "0")
    seg = contigs.withColumn("_cov", one_decimal(F.col("mean_coverage").cast("double")))
    seg = seg.select(F.concat(F.lit("1"), i).alias("ordinal"), F.concat_ws("\t", F.lit("S"), F.col("id").cast("string"), "sequence", F.concat(F.lit("LN:i:"), F.length("sequence")), F.concat(F.lit("cv:f:"), "_cov"), F.concat(F.lit("RC:f:"), "_cov")).alias("value"))
    sign = lambda c: F.when(F.col(c), "-").otherwise("+")
    e = overlaps(contigs, k)
    there = F.struct(F.col("src").alias("a"), sign("src_rc").alias("x"), F.col("dst").alias("b"), sign("dst_rc").alias("y"))
    mirror = F.struct(F.col("dst").alias("a"), F.when(F.col("dst_rc"), "+").otherwise("-").alias("x"), F.col("src").alias("b"), F.when(F.col("src_rc"), "+").otherwise("-").alias("y"))
    one = e.select(F.least(there, mirror).alias("l")).distinct().select("l.*")
    links = one.select(F.concat(F.lit("2"), F.lpad(F.col("a").cast("string"), 20, "0"), "x", F.lpad(F.col("b").cast("string"), 20, "0"), "y").alias("ordinal"), F.concat_ws("\t", F.lit("L"), F.col("a").cast("string"), "x", F.col("b").cast("string"), "y", F.lit(f"{k - 1}M")).alias("value"))
    return head.unionByName(seg).unionByName(links)


def write_gfa(contigs: DataFrame, k: int, path: str) -> None:
    _write_lines(gfa_lines(contigs, k), path)


def _written(text: str, path: str | None) -> str:
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text + "\n")
    return text


def to_json(row: DataFrame, path: str | None = None) -> str:
    """A one-row table as a JSON object, floats with two decimals; written if a path is given."""
    found = {k: round(v, 2) if isinstance(v, float) else v for k, v in row.first().asDict(recursive=True).items()}
    return _written(json.dumps(found, indent=2), path)


class _Fixed(float):
    """A number that JSON shows with a fixed number of decimals."""

    def __new__(cls, value: float | None, places: int = 2) -> _Fixed:
        self = super().__new__(cls, value or 0.0)
        self.places = places
        return self

    def __repr__(self) -> str:
        return f"{float(self):.{self.places}f}"


def _percent(part: int, whole: int) -> _Fixed:
    return _Fixed(100.0 * part / whole if whole else 0.0)


def qc_json(report: DataFrame, path: str | None = None) -> str:
    """The report of ``qc`` as nested JSON: raw, clean and trimming, shares in percent with two decimals."""
    r = report.first().asDict()
    part = lambda p: {"reads": r[f"{p}_n_reads"], "bases": r[f"{p}_n_bases"], **{f"{c}_pct": _percent(r[f"{p}_{c}"], r[f"{p}_n_bases"]) for c in ("q20", "q30", "gc")}}
    clean = part("clean") | {"survival_rate_pct": _percent(r["clean_n_reads"], r["raw_n_reads"])}
    names = {"adapter_trimmed_reads": "adapter_trimmed", "poly_g_trimmed_reads": "poly_g_trimmed", "quality_trimmed_reads": "quality_trimmed", "dropped_too_short": "dropped_too_short", "dropped_too_many_ns": "dropped_too_many_ns", "dropped_low_quality": "dropped_low_quality"}
    return _written(_dump({"detected_phred": f"Phred+{r['phred']}", "raw": part("raw"), "clean": clean, "trimming": {k: r[v] for k, v in names.items()}}), path)


def evaluation_json(report: DataFrame, contigs_file: str, reference_file: str | None = None, path: str | None = None) -> str:
    """The row of ``evaluate`` as nested JSON: metrics, length_bins and, with a reference, what was compared with it."""
    r = report.first().asDict(recursive=True)
    names = {"total_contigs": r["n_contigs"], "total_length": r["total_length"], "max_contig_length": r["longest"], "gc_pct": _Fixed(r["gc"]), "total_ns": r["total_ns"], "ns_per_100kbp": _Fixed(r["n_per_100k"])}
    out = {"contigs_file": contigs_file, "metrics": names | {f"{c}{f}": r[f"{c}{f}"] for f in (50, 75, 90) for c in "nl"}}
    out["length_bins"] = [{"min_length": b["threshold"], "contigs": b["n_contigs"], "total_bp": b["total_length"]} for b in r["length_bins"]]
    if reference_file is not None:
        ref = {"file": reference_file, "length": r["reference_length"], "genome_fraction_pct": _Fixed(r["genome_fraction"]), "duplication_ratio": _Fixed(1.0 if r["duplication_ratio"] is None else r["duplication_ratio"], 3), "mismatches_per_100kbp": _Fixed(r["mismatches_per_100k"])}
        out["reference"] = ref | ({"ng50": r["ng50"], "lg50": r["lg50"]} if r["reference_length"] else {})
    return _written(_dump(out), path)


def _dump(value, depth: int = 0) -> str:
    """JSON with two blanks a level; ``json`` would print fixed numbers as plain ones."""
    pad = "  " * (depth + 1)
    if isinstance(value, dict):
        return "{\n" + ",\n".join(f"{pad}{json.dumps(k)}: {_dump(v, depth + 1)}" for k, v in value.items()) + "\n" + "  " * depth + "}"
    if isinstance(value, list):
        return "[\n" + ",\n".join(pad + _dump(v, depth + 1) for v in value) + "\n" + "  " * depth + "]"
    return repr(value) if isinstance(value, _Fixed) else json.dumps(value)


def summary(row: DataFrame, title: str) -> str:
    """A one-row table as lines of names and values."""
    found = row.first().asDict(recursive=True)
    wide = max(map(len, found), default=0)
    return "\n".join([title, *(f"  {k:<{wide}}  {v:.2f}" if isinstance(v, float) else f"  {k:<{wide}}  {v}" for k, v in found.items())])
