"""FASTQ and FASTA as a Spark data source: ``spark.read.format("fastx")``.

One partition for each file, as records of a compressed stream can't be found from the
middle; many files are read in parallel.  Files are read by the executors, through
fsspec-like paths that Python can open there (local or mounted).
"""

from __future__ import annotations

import glob
import gzip
import io
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import seq as S
from ..operators import reads as R

SCHEMA = "file int, ordinal long, id string, seq string, qual string"
BATCH = 4096


class FormatError(ValueError):
    """A file that breaks the rules of its format."""


def _open(path: str) -> io.TextIOBase:
    if path.lower().endswith(".gz"):
        return io.TextIOWrapper(gzip.open(path, "rb"), encoding="latin-1", newline="\n")
    return open(path, encoding="latin-1", newline="\n")


def parse_fastq(lines: Iterator[str], path: str = "", lenient: bool = False) -> Iterator[tuple[str, str, str]]:
    """(id, seq, qual) of four-line records; blank lines may stand between them.

    Lenient: neither mark is checked and an end within a record stops silently.
    """
    lines = (x.rstrip("\r\n") for x in lines)
    for head in lines:
        if not head.strip():
            continue
        record = [head, *(x for x in (next(lines, None) for _ in range(3)) if x is not None)]
        if len(record) < 4:
            if lenient:
                return
            raise FormatError(f"{path}: ends within the record {head!r}")
        _, seq, plus, qual = record
        if not lenient:
            if head[0] != "@":
                raise FormatError(f"{path}: expected @ at {head!r}")
            if not plus.startswith("+"):
                raise FormatError(f"{path}: expected + in the record {head!r}")
            if len(seq) != len(qual):
                raise FormatError(f"{path}: {len(seq)} bases and {len(qual)} qualities in {head!r}")
        yield head[1:], seq, qual


def parse_fasta(lines: Iterator[str], keep_empty: bool = False, letters_only: bool = False) -> Iterator[tuple[str, str, None]]:
    """(id, seq, None) of wrapped records; one without sequence is dropped unless ``keep_empty``."""
    name, parts = None, []
    clean = (lambda s: "".join(c for c in s if c.isalpha()).upper()) if letters_only else str.strip
    for line in lines:
        line = line.rstrip("\r\n")
        if line.startswith(">"):
            if name is not None and (keep_empty or any(parts)):
                yield name, "".join(parts), None
            name, parts = line[1:], []
        elif name is not None:
            parts.append(clean(line))
    if name is not None and (keep_empty or any(parts)):
        yield name, "".join(parts), None


def read_file(path: str, options: dict[str, str] | None = None) -> Iterator[tuple[str, str, str | None]]:
    """Records of one file; its first character that is not blank says which format it has."""
    options = options or {}
    flag = lambda name: str(options.get(name, "false")).lower() == "true"
    with _open(path) as f:
        first = ""
        for line in f:
            if line.strip():
                first = line
                break
        if not first:
            return

        def rest() -> Iterator[str]:
            yield first
            yield from f

        if first.lstrip()[0] == "@":
            yield from parse_fastq(rest(), path, lenient=options.get("mode") == "lenient")
        elif first.lstrip()[0] == ">":
            yield from parse_fasta(rest(), flag("keep_empty"), flag("letters_only"))
        else:
            raise FormatError(f"{path}: neither FASTQ nor FASTA")


class _File(InputPartition):
    def __init__(self, number: int, path: str) -> None:
        self.number, self.path = number, path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[_File]:
        paths = []
        for p in self.options["path"].split(","):
            found = sorted(glob.glob(os.path.join(p, "*"))) if os.path.isdir(p) else sorted(glob.glob(p))
            if not found:
                raise FileNotFoundError(p)
            paths += found
        return [_File(i, p) for i, p in enumerate(paths)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.int32()), ("ordinal", pa.int64()), ("id", pa.string()), ("seq", pa.string()), ("qual", pa.string())])
        rows: list[tuple] = []
        for ordinal, record in enumerate(read_file(partition.path, self.options)):
            rows.append((partition.number, ordinal, *record))
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


def scan(spark: SparkSession, *paths: str, mode: str = "strict", keep_empty: bool = False, letters_only: bool = False) -> DataFrame:
    """(file, ordinal, id, seq, qual) of FASTQ or FASTA files, plain or .gz; qual is null in FASTA."""
    spark.dataSource.register(FastxSource)
    options = {"mode": mode, "keep_empty": str(keep_empty).lower(), "letters_only": str(letters_only).lower()}
    return spark.read.format("fastx").options(**options).load(",".join(paths))


def scan_quality(spark: SparkSession, *paths: str, least: int = 10, min_length: int = 30, max_ns: int = 3) -> DataFrame:
    """A scan with 3' quality trimming and the length and N limits."""
    return R.quality_trim(scan(spark, *paths), least, min_length, max_ns)


def scan_linked(spark: SparkSession, *paths: str) -> DataFrame:
    """A scan with the barcode of each header, as text and as a number, null where there is none."""
    return scan(spark, *paths).withColumn("barcode", S.header_barcode("id")).withColumn("barcode_number", S.barcode_number("barcode"))


def scan_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """(pair_id, r1, r2) of two files, record by record."""
    return R.pair_files(scan(spark, first), scan(spark, second))


def scan_interleaved(spark: SparkSession, *paths: str) -> DataFrame:
    """(pair_id, r1, r2) of interleaved files; pairs never cross files."""
    out = None
    for number, path in enumerate(paths):
        own = R.deinterleave(scan(spark, path)).withColumn("pair_id", F.col("pair_id") * len(paths) + number)
        out = own if out is None else out.unionByName(own)
    return out


def scan_reads(spark: SparkSession, *paths: str) -> DataFrame:
    """(pair_id, r1, r2): the first two of several files are mates, all others are single reads."""
    if len(paths) < 2:
        return _single(scan(spark, *paths), 0, 1)
    out = scan_pairs(spark, *paths[:2]).withColumn("pair_id", F.col("pair_id") * len(paths))
    for number, path in enumerate(paths[2:], 2):
        out = out.unionByName(_single(scan(spark, path), number, len(paths)))
    return out


def _single(reads: DataFrame, number: int, step: int) -> DataFrame:
    return reads.select((F.col("ordinal") * step + number).alias("pair_id"), F.col("seq").alias("r1"), F.lit(None).cast("string").alias("r2"))


def append_unpaired(pairs: DataFrame, reads: DataFrame) -> DataFrame:
    """``pairs(pair_id, r1, r2)`` with the reads of (ordinal, seq) as single ones after them."""
    after = pairs.agg(F.coalesce(F.max("pair_id") + 1, F.lit(0).cast("long"))).first()[0]
    return pairs.unionByName(_single(reads, after, 1))


def in_memory(spark: SparkSession, first: list[str], second: list[str] | None = None, interleaved: bool = False) -> DataFrame:
    """(pair_id, r1, r2) of sequences at hand."""
    if interleaved:
        return R.deinterleave(spark.createDataFrame(list(enumerate(first)), "ordinal long, seq string"))
    a = spark.createDataFrame(list(enumerate(first)), "ordinal long, seq string")
    if second is None:
        return _single(a, 0, 1)
    return R.pair_files(a, spark.createDataFrame(list(enumerate(second)), "ordinal long, seq string"))


def scan_trusted(spark: SparkSession, path: str) -> DataFrame | None:
    """Trusted contigs as (id, sequence), or None with a warning if the file can't be read."""
    import warnings

    try:
        found = scan(spark, path).select(F.col("ordinal").alias("id"), F.col("seq").alias("sequence"))
        found.count()
    except Exception as e:  # noqa: BLE001  Spark wraps whatever a reader raises
        warnings.warn(f"trusted contigs {path} are left out: {e}", stacklevel=2)
        return None
    return found


# Annotation tables


def scan_gff(spark: SparkSession, path: str, kind: str | None = "gene") -> DataFrame:
    """(chrom, type, start, end, strand, attributes map) of a GFF file; ``kind`` None takes all types."""
    raw = spark.read.schema("chrom string, source string, type string, start long, end long, score string, strand string, phase string, attrs string").csv(path, sep="\t", comment="#")
    raw = raw if kind is None else raw.filter(F.col("type") == kind)
    return raw.select("chrom", "type", "start", "end", "strand", F.expr("str_to_map(rtrim(';', attrs), ';', '=')").alias("attributes"))


def scan_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(start, end, qstart, qend, chrom, contig, identity) of a table of alignments; heading lines go, spans are put in order."""
    raw = spark.read.schema("s1 string, e1 string, s2 string, e2 string, chrom string, contig string, identity string").csv(path, sep="\t", comment="#")
    rows = raw.filter(F.col("s1").rlike(r"^\d+$"))
    n = lambda c: F.col(c).cast("long")
    return rows.select(F.least(n("s1"), n("e1")).alias("start"), F.greatest(n("s1"), n("e1")).alias("end"), n("s2").alias("qstart"), n("e2").alias("qend"), "chrom", "contig", F.col("identity").cast("double").alias("identity"))
